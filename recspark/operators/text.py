"""TF-IDF text retrieval and semantic profiles."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from recspark.operators import postings
from recspark.session import stored

# fixed value: what counts as a token of lower-cased text
TOKEN_PATTERN = "[a-z0-9]+"
#: Token counts that are weighted together.
CHUNK_POSTINGS = 250_000
#: Bits for the tokens of queries.
MARKS = 1 << 20

#: From (message, liked genres, liked items) to a query text.
Builder = Callable[[Column, Column, Column], Column]
ITEM_FIELDS = {"title": "string", "year": "int", "genres": "array<string>", "text": "string"}


def counted(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Token counts ``(key, tokens, tfs, chunk, own)``, one row a key, written and read back.

    The texts are shuffled once; a key's texts meet in one task, which counts them as they
    come. Rows of about ``CHUNK_POSTINGS`` counts make a chunk, whose first row has its
    tokens and in how many rows they are in ``own``. Keys without a token have no row."""
    rows = docs.select(F.col(key), F.lower(text).alias("text")).repartition(key).sortWithinPartitions(key)
    found = re.compile(TOKEN_PATTERN).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, kind = TaskContext.get().partitionId() << 32, None
        held: list[tuple] = []
        size, last, own = 0, None, Counter()

        def made() -> pa.RecordBatch:
            within = Counter(t for _, c in held for t in c)
            first = [[{"token": t, "n": n} for t, n in within.items()]] + [None] * (len(held) - 1)
            lists = [sorted(c.items()) for _, c in held]
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in held], kind), pa.array([[t for t, _ in x] for x in lists], pa.list_(pa.string())),
                pa.array([[n for _, n in x] for x in lists], pa.list_(pa.int64())), pa.array([chunk] * len(held), pa.int64()),
                pa.array(first, pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))], [key, "tokens", "tfs", "chunk", "own"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != last:
                    if own:
                        held.append((last, own))
                        size += len(own)
                    if size >= CHUNK_POSTINGS:
                        yield made()
                        held, size, chunk = [], 0, chunk + 1
                    last, own = k, Counter()
                if t:
                    own.update(found(t))
        if own:
            held.append((last, own))
        if held:
            yield made()

    schema = StructType([docs.select(key).schema[0], *StructType.fromDDL(
        "tokens array<string>, tfs array<bigint>, chunk bigint, own array<struct<token:string,n:bigint>>")])
    return stored(rows.mapInArrow(count, schema), "counts")


def tfidf_fit(docs: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(vectors(key, tokens, weights), idf(token, idf))`` with L2-normalized weights."""
    counts = counted(docs, key, text)
    size = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    n = size.first()["n"]
    within = counts.select(F.explode("own").alias("e")).groupBy(F.col("e.token").alias("token"))
    idf = stored(within.agg((F.log((1 + n) / (1 + F.sum("e.n"))) + 1).alias("idf")), "idf")
    return vectorize(counts, idf, key), idf


def vectorize(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Normalized tf * idf per key of ``counted`` rows; tokens unknown to ``idf`` are dropped.

    Only the tokens of a chunk meet ``idf``, not its counts."""
    known = counts.select(F.col("chunk").alias("of"), F.explode("own.token").alias("token")).join(idf, "token").select("of", "token", "idf")

    def weigh(rows: pa.Table, known: pa.Table) -> pa.Table:
        lists = rows.column("tokens").combine_chunks()
        place = pc.index_in(lists.flatten(), value_set=known.column("token").combine_chunks())
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        there = place.is_valid()
        keep = there.to_numpy(zero_copy_only=False)
        row = row[keep]
        w = rows.column("tfs").combine_chunks().flatten().to_numpy()[keep] * known.column("idf").to_numpy()[place.drop_null().to_numpy()]
        norm = np.sqrt(np.bincount(row, w * w, len(lists)))
        size = np.bincount(row, minlength=len(lists))
        ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        out = pa.table({
            key: rows.column(key), "tokens": pa.ListArray.from_arrays(ends, lists.flatten().filter(there)),
            "weights": pa.ListArray.from_arrays(ends, pa.array(w / norm[row]))})
        return out.filter(pa.array(size > 0))

    schema = StructType([counts.schema[key], *StructType.fromDDL("tokens array<string>, weights array<double>")])
    rows = counts.select("chunk", key, "tokens", "tfs")
    return rows.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(weigh, schema)


def vector_rows(vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """Long form ``(key, token, weight)``."""
    zipped = F.explode(F.arrays_zip("tokens", "weights")).alias("e")
    return vectors.select(key, zipped).select(key, F.col("e.tokens").alias("token"), F.col("e.weights").alias("weight"))


def tfidf_retrieve(
    vectors: DataFrame, idf: DataFrame, queries: DataFrame, k: int = 100, blocked: DataFrame | None = None,
    states: DataFrame | None = None, items: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` items per query text ``queries(user_id, text)`` by cosine; only scores above 0.

    ``states`` holds hard constraints on the genres and years of ``items``."""
    if states is not None and items is None:
        raise ValueError("constraints need the items' genres and years")
    counts = counted(queries, "user_id")
    made = postings.index(asked_only(vectors, counts), "item_id", None if states is None else items)
    return postings.postings_topk(made, vectorize(counts, idf, "user_id"), k, blocked, states)


def asked_only(vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """``vectors`` without most tokens that no query of the ``counted`` rows has: they add nothing to a score.

    The queries' tokens are marks in ``MARKS`` bits, so what the driver holds is bounded."""
    place = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(MARKS)).cast("int")
    asked = counts.select(F.explode("own.token").alias("token")).select(place.alias("at")).distinct()
    marks = np.zeros(MARKS, bool)
    marks[[r["at"] for r in asked.collect()]] = True
    bits = np.packbits(marks)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(bits).astype(bool)
        for batch in batches:
            lists = batch.column("tokens")
            coded = lists.flatten().dictionary_encode()
            own = marks[np.array([crc32(t.encode()) % MARKS for t in coded.dictionary.to_pylist()], np.int64)][coded.indices.to_numpy()]
            size = np.bincount(np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))[own], minlength=batch.num_rows)
            ends, some = pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(own)
            cut = {c: pa.ListArray.from_arrays(ends, batch.column(c).flatten().filter(some)) for c in ("tokens", "weights")}
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), **cut}).filter(pa.array(size > 0))

    rows = vectors.select("item_id", "tokens", "weights")
    return rows.mapInArrow(keep, rows.schema)


def semantic_profile(
    states: DataFrame, hist: DataFrame, items: DataFrame, cap: int, style: str | Builder = "baseline", message: str = ""
) -> DataFrame:
    """Query text per user: message, liked genres, then the first ``cap`` liked items by id.

    ``style`` picks what an item adds: its text (``baseline``), its title
    (``titles-only``, no message or genres), or title, year and genres
    (``titles-genres-year``, no message). A function makes the text itself: it is given
    columns, the message, the sorted liked genres and those items by id as structs of
    ``item_id, title, year, genres, text``.
    """
    w = Window.partitionBy("user_id").orderBy("item_id")
    liked = hist.select("user_id", "item_id").distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)
    if callable(style):
        known = F.struct("item_id", *[F.col(c) if c in items.columns else F.lit(None).cast(t).alias(c) for c, t in ITEM_FIELDS.items()])
        rows = liked.join(items, "item_id").select("user_id", known.alias("item"))
        ordered = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("item")).alias("liked_items"))
        joined = states.select("user_id", "liked_genres").join(ordered, "user_id", "left")
        text = style(F.lit(message), F.array_sort("liked_genres"), F.coalesce("liked_items", F.array().cast(ordered.schema["liked_items"].dataType)))
        return joined.select("user_id", text.alias("text"))
    genres = F.array_join("genres", " ")
    year = F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit(""))
    part = {
        "baseline": F.col("text"),
        "titles-only": F.col("title"),
        "titles-genres-year": F.concat("title", year, F.lit(" "), genres),
    }.get(style)
    if part is None:
        raise ValueError(f"unsupported query style: {style}")
    texts = liked.join(items, "item_id").select("user_id", "item_id", part.alias("part"))
    ordered = texts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "part"))).alias("p"))
    joined = states.select("user_id", "liked_genres").join(ordered, "user_id", "left")
    item_parts = F.coalesce(F.transform("p", lambda e: e["part"]), F.array().cast("array<string>"))
    lead = {
        "baseline": F.concat(F.array(F.lit(message)), F.array_sort("liked_genres")),
        "titles-only": F.array().cast("array<string>"),
        "titles-genres-year": F.array_sort("liked_genres"),
    }[style]
    return joined.select("user_id", F.array_join(F.concat(lead, item_parts), " ").alias("text"))
