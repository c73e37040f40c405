"""SimHash near-duplicates by pigeonring filtering (operator 10).

The 64 bits are cut into a ring of five segments. If two fingerprints differ in at
most d bits, some start on the ring has, for every length l, at most l*d/5
differences in its first l segments (the pigeonring principle). With d = 4 the first
segment is then equal and the first two differ in one bit at most. So each distinct
fingerprint is indexed under its five pairs of neighbouring segments and probes each
such key and its one-bit changes of the second segment; of what meets, the whole
distance decides. Only these two segments of the chain filter: small cells look at the
rest after the distance, large ones not at all.

Copies collapse to one row per fingerprint before anything is compared. A key's
fingerprints meet in cells of bounded size; a cell walks from one fingerprint to its
unvisited neighbours and emits a spanning forest, never all pairs. Components of the
forests are those of all links.

Defined results: null and empty texts have fingerprint zero and link like any other;
shorter texts are one shingle; rows that share an id are documents of their own, each
with the component of its text; a row with a null id links and joins like any other but
is no component's name unless all ids in it are null;
other columns are ignored; an empty table gives an empty result; a text of any length
is hashed whole in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import map_text
from recspark.llm.components import components, stored

#: Bits of the five segments of the ring and where each begins.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: Fingerprints of one key that meet in a cell at most, from either side.
CELL = 2048


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the hashes of the ``words``-word shingles, repeats included."""
    own = text.encode("utf-8").lower().split()  # bytes: ASCII case and white space only
    if not own:
        return 0
    joined, hashed = b" ".join(own), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    begin = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(own))
    n = len(own) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        top = min(n, at + (1 << 16))
        hashes = [hashed(joined[a:b], seed) for a, b in zip(begin[at:top].tolist(), ends[at + k - 1 : top + k - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def rows(keys: list, texts: list[str]) -> list[pa.Array]:
        return [pa.array(keys, pa.int64()), pa.array([fingerprint(x, words) for x in texts], pa.int64())]

    return map_text(docs, "key long, fp long", rows, key, text).withColumnRenamed("key", "doc_id")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1).cast("long"))


def _keys(fp: Column, changes: bool) -> Column:
    """Keys of the ring's five starts: the start, the segment, the next segment."""
    out = []
    for i in range(5):
        j = (i + 1) % 5
        base = F.shiftleft(_segment(fp, i), 13).bitwiseOR(_segment(fp, j)).bitwiseOR(F.lit(i << 28).cast("long"))
        out += [base, *(base.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(WIDTHS[j] if changes else 0))]
    return F.array(*out)


def _chain(diff: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether the differences, from each pair's start on the ring, stay within the budgets."""
    parts = np.stack([np.bitwise_count(diff >> np.uint64(s) & np.uint64((1 << w) - 1)) for s, w in zip(STARTS, WIDTHS)], axis=1)
    ring = np.take_along_axis(parts, (start[:, None] + np.arange(5)) % 5, axis=1).cumsum(axis=1)
    return (ring * 5 <= np.arange(1, 6) * distance).all(axis=1)


def _walk(index: np.ndarray, probe: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two sides, as positions of both.

    Each step compares one fingerprint with the other side's unvisited ones only, so a
    dense cell costs little; a cell without links costs its product."""
    left, right = [], []
    free = [np.arange(len(index)), np.arange(len(probe))]
    sides = (index, probe)
    while len(free[0]) and len(free[1]):
        first, free[1] = free[1][0], free[1][1:]
        queue = [(1, first)]
        while queue:
            side, at = queue.pop()
            other = free[1 - side]
            hit = np.bitwise_count(sides[1 - side][other] ^ sides[side][at]) <= distance
            for x in other[hit].tolist():
                left.append(at if side == 0 else x)
                right.append(x if side == 0 else at)
                queue.append((1 - side, x))
            free[1 - side] = other[~hit]
    return left, right


def _link(cell: np.ndarray, start: np.ndarray, kind: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int, small: int = 24) -> np.ndarray:
    """Links (node, node) inside whole cells of sorted rows (kind 0: indexed, 1: probing)."""
    if not len(cell):
        return np.empty((0, 2), np.int64)
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(edge, len(cell)))
    indexed = np.add.reduceat(kind == 0, edge)
    probing = size - indexed
    found = []
    few = (indexed > 0) & (probing > 0) & (indexed <= small)
    # Small cells: all meetings at once, an indexed row at a time.
    for turn in range(min(small, int(indexed[few].max(initial=0)))):
        cells = np.flatnonzero(few & (indexed > turn))
        n = probing[cells]
        a = np.repeat(edge[cells] + turn, n)
        b = np.repeat(edge[cells] + indexed[cells], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        new = node[a] < node[b]
        a, b = a[new], b[new]
        diff = fp[a] ^ fp[b]
        close = np.bitwise_count(diff) <= distance
        a, b, diff = a[close], b[close], diff[close]
        ok = _chain(diff, start[a].astype(np.int64), distance)
        found.append(np.stack([node[a[ok]], node[b[ok]]], axis=1))
    for c in np.flatnonzero((indexed > small) & (probing > 0)):
        lo, mid, hi = edge[c], edge[c] + indexed[c], edge[c] + size[c]
        a, b = _walk(fp[lo:mid], fp[mid:hi], distance)
        found.append(np.stack([node[lo:mid][a], node[mid:hi][b]], axis=1))
    links = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return links[links[:, 0] != links[:, 1]]


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``distance`` bits.

    ``distinct`` has one row per fingerprint: fp and node, a number of its own."""
    if not 0 <= distance <= 4:
        raise ValueError("five segments serve distances of 0 to 4 bits")
    index = distinct.select(F.explode(_keys(F.col("fp"), False)).alias("k"), F.lit(0).alias("kind"), "fp", "node")
    probe = distinct.select(F.explode(_keys(F.col("fp"), True)).alias("k"), F.lit(1).alias("kind"), "fp", "node")
    # Keys with more fingerprints than a cell holds: each side is dealt to chunks, and
    # each pair of chunks is a cell of its own.
    hot = index.groupBy("k").count().where(F.col("count") > CELL).select("k", F.ceil(F.col("count") / CELL).cast("int").alias("chunks"))
    hot, _ = stored(hot, "hot-keys")
    rows = index.unionByName(probe).join(hot, "k", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1))
    cells = rows.select("k", "kind", "fp", "node", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other")).select(
        "k", "kind", "fp", "node",
        F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own")).alias("j"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell that a batch cuts is carried over to the next."""
        rest = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            now = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            if not len(now[0]):
                continue
            last = (now[0] == now[0][-1]) & (now[4] == now[4][-1]) & (now[5] == now[5][-1])
            cut = int(np.flatnonzero(last)[0])
            yield emit([x[:cut] for x in now])
            rest = [x[cut:] for x in now]
            if len(rest[0]) > 8 * CELL:
                # Links of a part of the probing side are done; the bounded indexed side stays.
                yield emit(rest)
                rest = [x[rest[1] == 0] for x in rest]
        if rest is not None:
            yield emit(rest)

    def emit(now: list[np.ndarray]) -> pa.RecordBatch:
        k, kind, fp, node, i, j = now
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        out = _link(np.cumsum(new), k >> 28, kind, fp.view(np.uint64), node, distance)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    spread = cells.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "kind")
    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest id that links reach) of every row."""
    prints, _ = stored(fingerprints(docs, words, key, text), "fingerprints")
    # A generated key stands for each fingerprint: ids may be null or repeat.
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("name")).withColumn("node", F.monotonically_increasing_id())
    named, _ = stored(distinct, "distinct-fingerprints")
    roots = components(links(named.select("fp", "node"), distance))
    placed = named.join(roots, "node", "left").select("fp", "name", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("name").alias("component_id"))
    return prints.join(placed.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
