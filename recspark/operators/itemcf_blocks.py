"""Item similarities as sparse blocks, multiplied with packed histories cell by cell.

The similarities into a block of items are stored once as compressed row matrices
(sources x items), a piece for each part of the sources. A cell takes the pieces of one
block of items and a block of users, adds up the rows of each user's history, and gives
back only k rows a user, or the wanted ones. Neither the neighbours of a history nor any
other (user, item) pair but results and requests passes through a shuffle.

Item blocks are ranges of ids that hold ``BLOCK_LINKS`` similarities on average, user
blocks are ranges of the mean id in a history, and only those cells exist where some
history of the block of users has a neighbour in the block of items. Where near ids are
liked together, the cells grow with the input; where any item is liked with any other,
every block of users meets every block of items.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from recspark.functions.ordering import bucketed, even_cuts, top_k
from recspark.functions.portable import SCORE_DIGITS
from recspark.operators.masks import CONSTRAINTS, BlockMasks, profiles_of, rows_allowed, with_constraints
from recspark.operators.popularity import catalog_order
from recspark.operators.vector_balls import first_rows, within_k
from recspark.session import release, stored

BLOCK_LINKS, PIECE_LINKS, BLOCK_USERS = 4_000_000, 250_000, 65_536
#: Links of a task that are packed together.
BUNDLE_LINKS = 1 << 20
#: Items of a block in popularity order, and by how much more blocks each round looks at.
POPULAR_ITEMS, POPULAR_GROWTH = 4096, 16
MAX_PARTITIONS = 1 << 14
#: Scores that a cell holds at once, and similarities that it adds up at once.
CELL_SCORES, CELL_LINKS = 1 << 18, 1 << 22


@dataclass(frozen=True)
class Packed:
    """``items(ib, block)``: ids, popularity and constraints' attributes of each item block;
    ``pieces(ib, block)``: the similarities into it; ``reach(src, ib)``: the blocks where an
    item has neighbours; ``count`` blocks."""

    items: DataFrame
    pieces: DataFrame
    reach: DataFrame
    count: int


def _blob(value: dict) -> pa.Array:
    return pa.array([squeezed(value)], pa.binary())


def squeezed(value: dict) -> bytes:
    """A packed and compressed block; its first eight bytes tell the size of the rest unpacked."""
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> dict:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "big"), codec="zstd"))


def catalog(items: DataFrame) -> DataFrame:
    """Each item once, with the columns that constraints ask for."""
    wanted = {"genres": "array<string>", "year": "int"}
    have = [F.col(c).cast(t).alias(c) if c in items.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()]
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), *have, F.lit(True).alias("listed")).dropDuplicates(["item_id"])


def describe(rows: pa.Table) -> pa.Table:
    """The items of a block as one packed row."""
    rows = rows.sort_by("item_id")
    block = {
        "ids": rows.column("item_id").to_numpy(), "listed": rows.column("listed").fill_null(False).to_numpy(),
        "popularity": rows.column("popularity").fill_null(0.0).to_numpy(), "years": rows.column("year").cast(pa.float64()).to_numpy(),
        "genres": rows.column("genres").to_pylist(),
    }
    return pa.table({"ib": pa.array([rows.column("ib")[0].as_py()], pa.int32()), "block": _blob(block)})


def pack(sim: DataFrame, pop: DataFrame, items: DataFrame, links: int = BLOCK_LINKS, piece: int = PIECE_LINKS) -> Packed:
    """Blocks of ``sim(src, dst, score)``, whose items all stand in ``pop``.

    A block knows which of its items are in the catalog ``items``."""
    total = sim.count()
    cuts = even_cuts(sim, "dst", max(1, math.ceil(total / links)))
    count = len(cuts) + 1
    parts = max(1, math.ceil(total / count / piece))
    place = lambda df, c: bucketed(df, c, cuts, "ib")
    popular = pop.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("popularity").cast("double").alias("popularity"))
    about = place(catalog(items).join(popular, "item_id", "full_outer"), "item_id")
    described = stored(about.groupBy("ib").applyInArrow(describe, "ib int, block binary"), "item-blocks")

    def compress(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows or not own.num_rows:
            return pa.table({"ib": pa.array([], pa.int32()), "block": pa.array([], pa.binary())})
        ids = unpacked(own.column("block")[0].as_py())["ids"]
        bundles = [unpacked(b.as_py()) for b in rows.column("links")]
        src, dst, score = (np.concatenate([b[c] for b in bundles]) for c in ("src", "dst", "score"))
        order = np.argsort(src, kind="stable")
        sources, first = np.unique(src[order], return_index=True)
        block = {"sources": sources, "ends": np.append(first, len(src)), "at": np.searchsorted(ids, dst[order]).astype(np.int32), "score": score[order]}
        return pa.table({"ib": rows.column("ib").slice(0, 1), "block": _blob(block)})

    cut = F.pmod(F.xxhash64("src", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    placed = place(sim, "dst")
    rows = placed.select("ib", cut, F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "score")
    rows = rows.mapInArrow(bundled, "ib int, part int, links binary")
    spread = described.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pieces = rows.groupBy("ib", "part").cogroup(spread.groupBy("ib", "part")).applyInArrow(compress, "ib int, block binary")
    reach = stored(placed.select(F.col("src").cast("bigint").alias("src"), "ib").distinct(), "reach")
    return Packed(described, stored(pieces, "sim-blocks"), reach, count)


def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each block and part of ``BUNDLE_LINKS`` rows of a task as one packed row:
    sorted ids and repeated scores shuffle in a fraction of the bytes of rows."""
    names = ("ib", "part", "src", "dst", "score")

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ib, part, src, dst, score = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in names)
        order = np.lexsort((src, ib.astype(np.int64) << 32 | part))
        ib, part, src, dst, score = (c[order] for c in (ib, part, src, dst, score))
        first = np.flatnonzero(np.r_[True, (ib[1:] != ib[:-1]) | (part[1:] != part[:-1])])
        links = [squeezed({"src": src[a:b], "dst": dst[a:b], "score": score[a:b]}) for a, b in zip(first, np.r_[first[1:], len(ib)])]
        return pa.RecordBatch.from_arrays([pa.array(ib[first]), pa.array(part[first]), pa.array(links, pa.binary())], ["ib", "part", "links"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= BUNDLE_LINKS:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def found(sim: DataFrame, pop: DataFrame, items: DataFrame, asked: DataFrame, k: int | None, name: str) -> DataFrame:
    """The rows of ``cells``, stored; the blocks and the ``requests`` that they were made of are deleted.

    Given ``k``, only each user's first ``k`` of all blocks are stored, with their ``rank``."""
    packed = pack(sim, pop, items)
    rows = cells(packed, asked, k)
    if k is not None:
        # A cell gives k rows a user at most, so there is nothing to rank before the shuffle.
        rows = top_k(rows.repartition("user_id").withColumn("linked", F.col("item_id").isNull()), k, ("user_id", "linked")).drop("linked")
    rows = stored(rows, name)
    release(packed.items, packed.pieces, packed.reach, asked)
    return rows


def requests(
    users: DataFrame, hist: DataFrame, blocked: DataFrame | None = None, states: DataFrame | None = None, wanted: DataFrame | None = None,
    hidden: DataFrame | None = None, popular: bool = False,
) -> DataFrame:
    """One packed row per user: the history as a set and what the cells shall do with it.

    ``wanted(user_id, item_id)`` asks for these scores and no ranking;
    ``hidden(user_id, item_id, own, weight)`` takes a user's own ``own`` rows off an
    item's popularity and one link with the history, whose share is ``weight``;
    ``popular`` ranks by popularity instead."""
    sets = lambda df, name: df.groupBy("user_id").agg(F.collect_set("item_id").alias(name))
    longs, none = "array<bigint>", F.lit(None)
    out = users.select("user_id").distinct().join(sets(hist, "seen"), "user_id", "left")
    for name, pairs in (("blocked", blocked), ("wanted", wanted)):
        out = out.join(sets(pairs, name), "user_id", "left") if pairs is not None else out.withColumn(name, none.cast(longs))
    if hidden is None:
        out = out.withColumn("hidden", none.cast("array<struct<item_id:bigint,own:bigint>>")).withColumn("weight", none.cast("double"))
    else:
        mine = F.collect_list(F.struct(F.col("item_id").cast("bigint").alias("item_id"), F.col("own").cast("bigint").alias("own")))
        out = out.join(hidden.groupBy("user_id").agg(mine.alias("hidden"), F.first("weight").alias("weight")), "user_id", "left")
    packed = out.select("user_id", *[F.coalesce(F.col(c).cast(longs), F.array().cast(longs)).alias(c) for c in ("seen", "blocked", "wanted")],
                        F.coalesce("hidden", F.array().cast("array<struct<item_id:bigint,own:bigint>>")).alias("hidden"),
                        F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit(popular).alias("popular"))
    return stored(with_constraints(packed, states), "requests")


def cells(packed: Packed, asked: DataFrame, k: int | None) -> DataFrame:
    """``(user_id, item_id, score)``: each user's ``k`` best unseen items of each block, or
    with None the wanted ones. A row without an item tells that the user has an unseen
    neighbour in the block, whether or not it may be ranked. Users without a history
    have no cell."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    near = asked.filter(F.size("seen") > 0).withColumn("near", F.aggregate("seen", F.lit(0.0), lambda a, v: a + v) / F.size("seen"))
    cuts = even_cuts(near, "near", max(1, math.ceil(asked.count() / BLOCK_USERS), math.ceil(cores / packed.count)))
    users = bucketed(near, "near", cuts, "ub").drop("near")
    sources = users.select("ub", F.explode("seen").alias("src")).distinct()
    met = stored(sources.join(packed.reach, "src").select("ub", "ib").distinct(), "cells")  # a row for each pair of blocks
    left = packed.items.withColumn("piece", F.lit(False)).unionByName(packed.pieces.withColumn("piece", F.lit(True)))
    return _searched(left.join(F.broadcast(met), "ib"), users.join(F.broadcast(met), "ub"), met.count(), k)


def _searched(left: DataFrame, users: DataFrame, count: int, k: int | None) -> DataFrame:
    """The rows of every cell (ub, ib) of ``count``, from its packed blocks and its users."""

    def run(stored_: pa.Table, asked_: pa.Table) -> pa.Table:
        if not stored_.num_rows or not asked_.num_rows:
            return _table([], [], [])
        read = lambda kind: [unpacked(b.as_py()) for b in stored_.filter(pc.equal(stored_.column("piece"), kind)).column("block")]
        return _cell(read(False)[0], read(True), asked_, k)

    # Few large cells: enough partitions that hardly two of them meet in one.
    spread = lambda df: df.repartition(max(1, min(4 * count, MAX_PARTITIONS)), "ub", "ib")
    packed = spread(left.select("ub", "ib", "piece", "block"))
    return packed.groupBy("ub", "ib").cogroup(spread(users).groupBy("ub", "ib")).applyInArrow(run, "user_id bigint, item_id bigint, score double")


def popular_first(pop: DataFrame, items: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(user_id, item_id, score)`` with each user's ``k`` most popular items that may be returned.

    The catalog is cut into blocks in popularity order. Everybody meets the first block;
    only users who found less than ``k`` items so far go on to the blocks behind it."""
    known = catalog(items).join(pop.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("popularity").cast("double").alias("popularity")), "item_id")
    order = catalog_order(known, pop).select("item_id", F.floor((F.col("position") - 1) / POPULAR_ITEMS).cast("int").alias("ib"))
    blocks = stored(known.join(order, "item_id").groupBy("ib").applyInArrow(describe, "ib int, block binary"), "popular-blocks")
    total, lo, size, found, open_ = blocks.count(), 0, 1, [], asked
    while lo < total:
        parts = max(1, math.ceil(open_.count() / BLOCK_USERS), asked.sparkSession.sparkContext.defaultParallelism)
        hi = min(lo + size, total)
        every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
        left = blocks.filter(F.col("ib").between(lo, hi - 1)).select(every(0, parts).alias("ub"), "ib", F.lit(False).alias("piece"), "block")
        users = open_.select(F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int").alias("ub"), every(lo, hi).alias("ib"), "*")
        rows = _searched(left, users, parts * (hi - lo), k).filter("item_id IS NOT NULL")
        found.append(stored(top_k(rows, k).drop("rank"), "popular"))
        lo, size = hi, size * POPULAR_GROWTH
        if lo < total:
            have = reduce(DataFrame.unionByName, found).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            open_ = stored(asked.join(have, "user_id", "left_anti"), "open")
            if open_.isEmpty():
                break
    return reduce(DataFrame.unionByName, found) if found else asked.sparkSession.createDataFrame([], "user_id bigint, item_id bigint, score double")


def _table(users, ids, score) -> pa.Table:
    return pa.table({"user_id": pa.array(users, pa.int64()), "item_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, elements) of a list column."""
    lists = column.combine_chunks()
    return np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), lists.flatten().to_numpy(zero_copy_only=False)


def _places(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each value in sorted ``ids``, whether it is there)."""
    at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
    return at, (ids[at] == own) if len(ids) else np.zeros(len(own), bool)


def joined(pieces: list[dict]) -> dict:
    """The pieces of a block as one: where the links of each of its sorted sources begin, and how many there are."""
    if not pieces:
        return {"sources": np.zeros(0, np.int64), "begin": np.zeros(0, np.int64), "lengths": np.zeros(0, np.int64),
                "at": np.zeros(0, np.int32), "score": np.zeros(0)}
    before = np.cumsum([0, *(len(p["at"]) for p in pieces)])
    sources = np.concatenate([p["sources"] for p in pieces])
    order = np.argsort(sources, kind="stable")
    begin = np.concatenate([p["ends"][:-1] + n for p, n in zip(pieces, before)])
    lengths = np.concatenate([np.diff(p["ends"]) for p in pieces])
    at, score = (np.concatenate([p[c] for p in pieces]) for c in ("at", "score"))
    return {"sources": sources[order], "begin": begin[order], "lengths": lengths[order], "at": at, "score": score}


def _sums(links: dict, width: int, row: np.ndarray, seen: np.ndarray, users: int) -> np.ndarray:
    """Summed similarity of each user to each item, a bounded number of links at a time."""
    total = None
    at, there = _places(links["sources"], seen)
    owner, at = row[there], at[there]
    lengths, begin = links["lengths"][at], links["begin"][at]
    upto = np.cumsum(lengths)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELL_LINKS, side="right")))
        own = lengths[lo:hi]
        link = np.repeat(begin[lo:hi] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        some = np.bincount(np.repeat(owner[lo:hi] * width, own) + links["at"][link], links["score"][link], users * width)
        total = some if total is None else total + some
        lo = hi
    return (np.zeros(users * width) if total is None else total).reshape(users, width)


def _positive(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of the positive scores, and where each row's begin and end among them."""
    met = np.flatnonzero(scores > 0)
    return met, np.searchsorted(met, np.arange(len(scores) + 1) * scores.shape[1])


def _touched(pieces: list[dict], asked: pa.Table) -> pa.Table:
    """The users with a neighbour here, or who are ranked by popularity."""
    row, seen = _flat(asked.column("seen"))
    keep = asked.column("popular").to_numpy(zero_copy_only=False).astype(bool)
    for piece in pieces:
        keep[row[_places(piece["sources"], seen)[1]]] = True
    return asked.filter(pa.array(keep))


def _cell(block: dict, pieces: list[dict], asked: pa.Table, k: int | None) -> pa.Table:
    asked = _touched(pieces, asked)
    ids, width, links = block["ids"], len(block["ids"]), joined(pieces)
    masks = BlockMasks(block["genres"], block["years"])
    listed = None if block["listed"].all() else block["listed"]
    step = max(1, CELL_SCORES // max(width, 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, asked.num_rows, step):
        part = asked.slice(lo, step)
        users = part.column("user_id").to_numpy()
        row, seen = _flat(part.column("seen"))
        scores = _sums(links, width, row, seen, len(users))
        at, there = _places(ids, seen)
        scores[row[there], at[there]] = 0.0
        _hide(block, part, scores)
        met, ends = _positive(scores)
        linked = np.diff(ends) > 0
        popular = part.column("popular").to_numpy(zero_copy_only=False)
        if popular.any():
            scores[popular] = block["popularity"]
            scores[row[there], at[there]] = 0.0
        out.append((users[linked], np.full(linked.sum(), -1), np.zeros(linked.sum())))
        if k is None:
            r, own = _flat(part.column("wanted"))
            at, there = _places(ids, own)
            r, at = r[there], at[there]
            some = scores[r, at] != 0
            out.append((users[r[some]], ids[at[some]], scores[r[some], at[some]]))
            continue
        r, own = _flat(part.column("blocked"))
        at, there = _places(ids, own)
        scores[r[there], at[there]] = 0.0
        allowed = rows_allowed(masks, profiles_of({c: part.column(c).to_pylist() for c in ("bound", *CONSTRAINTS)}))
        if listed is not None:
            scores[:, ~listed] = 0.0
        if allowed is not None:
            scores[~allowed] = 0.0
        if popular.any() or there.any() or listed is not None or allowed is not None:
            met, ends = _positive(scores)
        value = scores.ravel()[met]
        near = within_k(value, ends, k)
        met, value = met[near], value[near]
        r, c = np.divmod(met, max(width, 1))
        found = first_rows(r, c, value, len(users), k)  # ids ascend, so ties go to the smaller id
        out.append((users[r[found]], ids[c[found]], value[found]))
    if not out:
        return _table([], [], [])
    users, found, score = (np.concatenate(x) for x in zip(*out))
    return _table(users, pa.array(found, pa.int64(), mask=found < 0), score)


def _hide(block: dict, part: pa.Table, scores: np.ndarray) -> None:
    """Correct the sums of hidden items, in place; what is left of them may be nothing."""
    lists = part.column("hidden").combine_chunks()
    if not len(lists.flatten()):
        return
    r, fields = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), lists.flatten()
    at, there = _places(block["ids"], fields.field("item_id").to_numpy())
    r, at, own = r[there], at[there], fields.field("own").to_numpy()[there]
    met = scores[r, at] > 0
    r, at, own = r[met], at[met], own[met]
    whole = block["popularity"][at]
    left = whole - own
    weight = part.column("weight").to_numpy()[r]
    fixed = (scores[r, at] * np.sqrt(whole) - weight) / np.sqrt(np.maximum(left, 1))
    scores[r, at] = np.where((left > 0) & (np.round(fixed, SCORE_DIGITS) > 0), fixed, 0.0)
