"""Vector normalization and exact blocked top-k scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from recspark.functions.ordering import bucketed, even_cuts, top_k
from recspark.operators import vector_balls
from recspark.operators.masks import with_constraints
from recspark.session import release, stored

#: Users of a query block, least vectors of a stripe, and numbers in a stripe's matrix.
QUERY_BLOCK, ITEM_BLOCK, STRIPE_CELLS = 32768, 4096, 1 << 25
#: Items of one vector that a row holds on average at most; an item counts as so many numbers.
COPIES, ITEM_CELLS = 1 << 20, 8
#: Items of a ball, or k if that is more.
LEAF = 512
#: Items that a task packs into balls at once, about.
PIECE = 1 << 16
MAX_PARTITIONS = 1 << 16
#: Rows of a key that are added up in one task.
KEY_ROWS = 100_000


def divided(values: Column, by: Column) -> Column:
    """Every array element divided by one scalar, which is computed once per row.

    Inside a plain ``transform`` the optimizer would inline the scalar into the
    lambda and evaluate it again for every element.
    """
    return F.zip_with(values, F.array_repeat(by, F.size(values)), lambda v, n: v / n)


def unit(vector: Column) -> Column:
    """L2-normalized vector in double precision; a zero or non-finite vector raises."""
    values = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))
    usable = norm.isNotNull() & (norm > 0) & ~F.isnan(norm) & (norm < F.lit(float("inf")))
    checked = F.when(usable, norm).otherwise(F.raise_error(F.lit("embeddings must be finite and non-zero")).cast("double"))
    return divided(values, checked)


def embed_normalize(df: DataFrame, encoder: Callable[[Column], Column] | None = None, source: str = "text",
                    vector: str = "embedding") -> DataFrame:
    """Encode ``source`` with a user-supplied pandas UDF when given, then L2-normalize ``vector``."""
    encoded = df.withColumn(vector, encoder(F.col(source))) if encoder else df
    return encoded.withColumn(vector, unit(F.col(vector)))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k, v, n)``: vectors and counts added up over runs of a key, across batch borders too."""

    def made(keys: pa.Array, total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * total.shape[1])
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(total.ravel())), pa.array(n)], ["k", "v", "n"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, lists = batch.column(0), batch.column(1)
        width = lists.value_lengths().to_numpy(zero_copy_only=False)
        if lists.flatten().null_count or (width != width[0]).any() or last is not None and last[1].shape[1] != width[0]:
            raise ValueError("vectors must have one length and no null")
        runs = pc.run_end_encode(keys)
        first = np.append(0, np.asarray(runs.run_ends)[:-1])
        own = runs.values
        total = np.add.reduceat(lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), first, axis=0)
        n = np.add.reduceat(batch.column(2).to_numpy(), first)
        if last is not None and last[0][0].as_py() == own[0].as_py():
            total[0] += last[1][0]
            n[0] += last[2][0]
        elif last is not None:
            yield made(*last)
        if len(n) > 1:
            yield made(own[:-1], total[:-1], n[:-1])
        last = own[-1:], total[-1:].copy(), n[-1:].copy()
    if last is not None:
        yield made(*last)


def mean_vector(members: DataFrame, vectors: DataFrame, key: str = "user_id", vector: str = "embedding") -> DataFrame:
    """Normalized mean of the member items' vectors per key. A task adds up runs of rows sorted by key
    as they stream by; a key of more than ``KEY_ROWS`` rows is added up in parts first."""
    schema = f"k {dict(members.dtypes)[key]}, v array<double>, n double"
    own = stored(members.select(F.col(key).alias("k"), "item_id"), "members")
    most = own.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(most / KEY_ROWS)))).alias("part")
    rows = own.join(vectors.select("item_id", F.col(vector).cast("array<double>").alias("v")), "item_id").select(
        "k", "v", F.lit(1.0).alias("n"), part)
    sums = rows.repartition("k", "part").sortWithinPartitions("k").drop("part").mapInArrow(_summed, schema)
    if most > KEY_ROWS:
        sums = sums.repartition("k").sortWithinPartitions("k").mapInArrow(_summed, schema)
    return sums.select(F.col("k").alias(key), unit(divided(F.col("v"), F.col("n"))).alias(vector))


def _blocks(count: int, size: int, at_least: int) -> int:
    return max(1, min(max(math.ceil(count / size), at_least), max(count, 1)))


def pieces(about: DataFrame, count: int) -> DataFrame:
    """Adds ``range`` and ``piece``, which cut the ``count`` rows into groups of about ``PIECE`` vectors:
    ranges of the first coordinate, and parts of a range that holds more."""
    cuts = even_cuts(about.select(F.get("weights", F.lit(0)).alias("v")), "v", math.ceil(count / PIECE))
    ranged = bucketed(about.withColumn("__first", F.get("weights", F.lit(0))), "__first", cuts, "range").drop("__first")
    if count <= PIECE:
        return ranged.withColumn("piece", F.lit(0))
    parts = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("__parts"))
    return ranged.join(F.broadcast(parts), "range").withColumn("piece", F.pmod(F.xxhash64("weights"), F.col("__parts")).cast("int")).drop("__parts")


def block_topk(
    queries: DataFrame, items: DataFrame, k: int, blocked: DataFrame | None = None, allowed: DataFrame | None = None,
    states: DataFrame | None = None, catalog: DataFrame | None = None,
) -> DataFrame:
    """Exact top ``k`` items per user by inner product, written and read back.

    ``queries(user_id, weights)`` and ``items(item_id, weights)`` are packed into blocks,
    one binary row each. A cell is a block of queries and a stripe of items; it searches
    the stripe's balls (``vector_balls``), so vectors that can't reach a user's first k
    are never multiplied, and returns k rows per user. Items of one vector are one row of
    a stripe, and a stripe is as large as a task's memory allows: every block of queries is
    sent each stripe, and every stripe gives k rows a user. Balls are made piece by piece,
    so no task sorts a stripe.
    ``blocked`` pairs are left out; given ``allowed(user_id, item_id)``, only those stay.
    ``states`` holds hard constraints on the genres and years of ``catalog``, which act
    in the cells before the k: no (profile, item) table is written. An item without a
    genre list fails for every user who has a state.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if states is not None and catalog is None:
        raise ValueError("constraints need the items' genres and years")
    spark = queries.sparkSession
    vector = F.col("weights").cast("array<double>").alias("weights")
    asked = stored(with_constraints(queries.select("user_id", vector), states), "queries")
    about = items.select("item_id", vector)
    if states is None:
        about = about.withColumns({"genres": F.lit(None).cast("array<string>"), "year": F.lit(None).cast("int")})
    else:
        own = catalog.select("item_id", "genres", F.col("year").cast("int").alias("year")).dropDuplicates(["item_id"])
        about = about.join(own, "item_id", "left")
    vectors = about = stored(about, "vectors")
    size = about.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("weights")), F.lit(1)).alias("width"),
                     F.approx_count_distinct(F.xxhash64("weights")).alias("vectors")).first()
    width = max(1, size["width"])
    stripes = _blocks(size["n"], max(ITEM_BLOCK, int(size["n"] * STRIPE_CELLS / (min(size["vectors"], size["n"]) * width + size["n"] * ITEM_CELLS + 1))), 1)
    cores = spark.sparkContext.defaultParallelism
    parts = _blocks(asked.count(), QUERY_BLOCK, max(1, cores // stripes))
    block = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    leaf = max(k, min(LEAF, ITEM_BLOCK))
    copy = F.pmod(F.xxhash64("item_id"), F.lit(math.ceil(max(1, size["n"]) / COPIES)))
    about = about.withColumn("ib", F.pmod(F.xxhash64("weights", copy), F.lit(stripes)).cast("int"))
    members = F.collect_list(F.struct("item_id", "genres", "year")).alias("members")
    packed_items = pieces(about, size["n"]).groupBy("ib", "range", "piece", copy.alias("copy"), "weights").agg(members).groupBy(
        "ib", "range", "piece").applyInArrow(
        lambda rows: vector_balls.pack_items(rows, leaf), "ib int, block binary")
    packed_queries = asked.withColumn("qb", block("user_id", parts)).groupBy("qb").applyInArrow(
        vector_balls.pack_queries, "qb int, block binary")
    cells = packed_items.select(every(parts).alias("qb"), "ib", F.lit(False).alias("asked"), "block").unionByName(
        packed_queries.select("qb", every(stripes).alias("ib"), F.lit(True).alias("asked"), "block"))
    # Few large cells: enough partitions that hardly two of them meet in one.
    spread = lambda df: df.repartition(min(4 * parts * stripes, MAX_PARTITIONS), "qb", "ib").groupBy("qb", "ib")
    stripe = about.select("item_id", "ib").distinct()
    striped = lambda pairs: pairs.withColumn("ib", F.lit(0)) if stripes == 1 else pairs.join(stripe, "item_id")
    place = lambda pairs, keep: striped(pairs.select("user_id", "item_id")).select(
        block("user_id", parts).alias("qb"), "ib", "user_id", "item_id", F.lit(keep).alias("keep"))
    marked = [place(pairs, keep) for pairs, keep in ((blocked, False), (allowed, True)) if pairs is not None]
    schema, restricted = "user_id bigint, item_id bigint, score double", allowed is not None
    whole = stripes == 1  # a cell then has all items and all rows of its users, and ranks them
    if whole:
        schema += ", rank int"
    if marked:
        found = spread(cells).cogroup(spread(reduce(DataFrame.unionByName, marked))).applyInArrow(
            lambda rows, pairs: vector_balls.search_cell(rows, pairs, k, restricted, whole), schema)
    else:
        found = spread(cells).applyInArrow(lambda rows: vector_balls.search_cell(rows, None, k, False, whole), schema)
    out = stored(found if whole else top_k(found.repartition("user_id"), k), "top")
    release(asked, vectors)
    return out


def dense_retrieve(item_vectors: DataFrame, query_vectors: DataFrame, k: int = 100, blocked: DataFrame | None = None,
                   allowed: DataFrame | None = None, vector: str = "embedding", states: DataFrame | None = None,
                   catalog: DataFrame | None = None) -> DataFrame:
    """Exact cosine top ``k`` over normalized vectors, seen items and those that break
    a user's hard constraints removed first."""
    return block_topk(
        query_vectors.select("user_id", F.col(vector).alias("weights")),
        item_vectors.select("item_id", F.col(vector).alias("weights")),
        k, blocked, allowed, states, catalog,
    )
