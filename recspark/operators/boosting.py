"""Leaf-wise gradient boosting for ranking on distributed histograms.

The training rows are binned once and packed into blocks of whole queries. Each round
turns scores into pair lambdas inside the blocks, grows one tree best-first and writes
the blocks with the scores it adds. Growing asks for histograms of (node, feature, bin):
tasks add up their blocks, sums per node reach the driver, whose size is fixed by the
number of leaves, features and bins. A node's smaller child is scanned, its sibling is
the difference. One job scans the children of all nodes that may still be split, so a
tree takes about as many jobs as it is deep, and the heap that picks the greatest gain
next sees the same gains as one job a split would give.

Lambdas: the pairs of a query are its target and each other row, weighed by the change of
NDCG if they swapped places; pairs outside the first ``TRUNCATION`` places don't count,
the change is divided by the score gap plus 0.01 once scores differ, and a query's
lambdas are scaled by log2(1 + sum) / sum.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recspark.functions.portable import SCORE_DIGITS
from recspark.session import release, stored

BINS, BLOCK_ROWS = 255, 1 << 16
TRUNCATION, LEAST_HESSIAN = 30, 1e-3


def cut_points(matrix: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 thresholds a feature, at its quantiles; a value goes left if not above."""
    at = [i / bins for i in range(1, bins)]
    columns = matrix.select(*[F.col(f).cast("double").alias(f) for f in features])
    found = columns.approxQuantile(list(features), at, 0.25 / bins)
    return [np.unique(np.array([c for c in own if math.isfinite(c)])) for own in found]


def lambdas(score: np.ndarray, label: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient to climb, hessian) of each row. Rows stand by query, inside it by item;
    query i has the rows ``ends[i]`` to ``ends[i + 1]`` and at most one target."""
    size = np.diff(ends)
    query = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((np.arange(len(score)), -np.round(score, SCORE_DIGITS), query))
    rank = np.empty(len(score), np.int64)
    rank[order] = np.arange(len(score)) - np.repeat(ends[:-1], size) + 1
    target = np.full(len(size), -1)
    target[query[label > 0]] = np.flatnonzero(label > 0)
    own = target[query]
    pair = (own >= 0) & (label <= 0)
    gap = np.where(pair, score[own] - score, 0.0)
    swap = np.abs(1 / np.log2(1.0 + rank[own]) - 1 / np.log2(1.0 + rank))
    swap = np.where(pair & (np.minimum(rank, rank[own]) <= TRUNCATION), swap, 0.0)
    high, low = (np.full(len(size), sign * -np.inf) for sign in (1, -1))
    np.maximum.at(high, query, score)
    np.minimum.at(low, query, score)
    swap = np.where((high > low)[query], swap / (0.01 + np.abs(gap)), swap)
    rho = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
    push, bend = rho * swap, rho * (1 - rho) * swap
    total, bent = np.bincount(query, push, len(size)), np.bincount(query, bend, len(size))
    scale = np.where(total > 0, np.log2(1 + 2 * total) / np.maximum(2 * total, 1e-300), 1.0)
    is_target = own == np.arange(len(score))
    return np.where(is_target, total[query], -push) * scale[query], np.where(is_target, bent[query], bend) * scale[query]


def pack(matrix: DataFrame, features: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """``(ub, block)``: whole queries of the training rows, binned, with scores of 0 and their lambdas."""
    cores = matrix.sparkSession.sparkContext.defaultParallelism
    count = max(cores, math.ceil(matrix.count() / BLOCK_ROWS))
    rows = matrix.select(F.pmod(F.xxhash64("user_id"), F.lit(count)).cast("int").alias("ub"), "user_id", "item_id", F.col("label").cast("int").alias("label"),
                         *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("user_id", "ascending"), ("item_id", "ascending")])
        user = table.column("user_id").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], user[1:] != user[:-1]]))
        bins = np.empty((len(user), len(cuts)), np.uint8)
        for i, own in enumerate(cuts):
            bins[:, i] = np.searchsorted(own, table.column(f"x{i}").to_numpy(zero_copy_only=False), side="left")
        block = {"user": user, "item": table.column("item_id").to_numpy(), "label": table.column("label").to_numpy(), "bins": bins,
                 "ends": np.append(first, len(user)), "score": np.zeros(len(user))}
        block["push"], block["bend"] = lambdas(block["score"], block["label"], block["ends"])
        return pa.table({"ub": table.column("ub").slice(0, 1), "block": pa.array([pickle.dumps(block, protocol=5)], pa.binary())})

    return stored(rows.groupBy("ub").applyInArrow(build, "ub int, block binary"), "boost")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, pickle.loads(batch.column(1)[i].as_py())


@dataclass
class Growing:
    """A tree whose nodes are numbered as they are explored; -1 stands for no split."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for own, value in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1)):
            own += [value, value]
        return self.left[node], self.right[node]

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            live = live[feature[at[live]] >= 0]
            if not len(live):
                return at
            node = at[live]
            at[live] = np.where(bins[live, feature[node]] <= cut[node], left[node], right[node])


def histograms(blocks: DataFrame, tree: Growing, nodes: Sequence[int], features: int) -> dict[int, np.ndarray]:
    """(feature, bin, [sum of gradients, of hessians, rows]) of each of ``nodes``, from one pass."""
    shape = (features, BINS + 1, 3)
    slot = np.full(len(tree.feature), -1)
    slot[list(nodes)] = np.arange(len(nodes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), *shape))
        for _, _, block in _blocks(batches):
            at = slot[tree.place(block["bins"])]
            rows = np.flatnonzero(at >= 0)
            at, bins = at[rows], block["bins"][rows]
            for f in range(features):
                key = at * (BINS + 1) + bins[:, f]
                for i, weight in enumerate((block["push"][rows], block["bend"][rows], None)):
                    total[:, f, :, i] += np.bincount(key, weight, len(nodes) * (BINS + 1)).reshape(len(nodes), -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["node", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in table.column("sums"))
        return pa.table({"node": table.column("node").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = blocks.mapInArrow(scan, "node int, sums binary").groupBy("node").applyInArrow(merge, "node int, sums binary").collect()
    return {r["node"]: np.frombuffer(r["sums"]).reshape(shape) for r in rows}


def best_split(sums: np.ndarray, least_rows: int) -> tuple[float, int, int]:
    """(gain, feature, cut) of the greatest gain; ties go to the first feature, then the
    first cut. A gain of 0 means that no split is allowed."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[0].sum(axis=0)
    right = whole - left
    fine = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN)
    part = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-300)
    gain = np.where(fine, part(left) + part(right) - whole[0] ** 2 / max(whole[1], 1e-300), 0.0)
    f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(max(gain[f, cut], 0.0)), int(f), int(cut)


@dataclass
class Grown:
    """A finished tree: the explored nodes, which of them are split, and all nodes' sums."""

    tree: Growing
    kept: set[int]
    sums: dict[int, np.ndarray]


def grow(blocks: DataFrame, features: int, leaves: int, least_rows: int) -> Grown:
    """Best-first growth to ``leaves`` leaves; one job explores the children of all nodes
    that could still be split."""
    tree = Growing()
    sums = histograms(blocks, tree, [0], features)
    best = {0: best_split(sums[0], least_rows)}
    heap, kept = [(-best[0][0], 0)], set()
    while heap and len(kept) + 1 < leaves:
        gain, node = heap[0]
        if not -gain > 0:
            break
        if tree.left[node] < 0:
            open_ = [n for g, n in sorted(heap) if -g > 0 and tree.left[n] < 0][: leaves - 1 - len(kept)]
            small = {}
            for n in open_:
                _, f, cut = best[n]
                a, b = tree.split(n, f, cut)
                few = 2 * sums[n][f, : cut + 1, 2].sum() <= sums[n][f, :, 2].sum()
                small[n] = (a, b) if few else (b, a)
            found = histograms(blocks, tree, [s for s, _ in small.values()], features)
            for n, (scanned, other) in small.items():
                sums[scanned] = found[scanned]
                sums[other] = sums[n] - found[scanned]
                for child in (scanned, other):
                    best[child] = best_split(sums[child], least_rows)
            continue
        heapq.heappop(heap)
        kept.add(node)
        for child in (tree.left[node], tree.right[node]):
            heapq.heappush(heap, (-best[child][0], child))
    return Grown(tree, kept, sums)


def advance(blocks: DataFrame, grown: Grown, rate: float) -> DataFrame:
    """The blocks with the tree's values added to the scores, and the lambdas of the new scores."""
    tree, value = Growing(*([*x] for x in (grown.tree.feature, grown.tree.cut, grown.tree.left, grown.tree.right))), np.zeros(len(grown.tree.feature))
    for n in range(len(tree.feature)):
        if n not in grown.kept:
            tree.feature[n] = -1
        if n in grown.sums:
            value[n] = leaf_value(grown.sums[n], rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _blocks(batches):
            block["score"] = block["score"] + value[tree.place(block["bins"])]
            block["push"], block["bend"] = lambdas(block["score"], block["label"], block["ends"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([pickle.dumps(block, protocol=5)], pa.binary())], ["ub", "block"])

    after = stored(blocks.mapInArrow(run, "ub int, block binary"), "boost")
    release(blocks)
    return after


def leaf_value(sums: np.ndarray, rate: float) -> float:
    push, bend, _ = sums[0].sum(axis=0)
    return float(rate * push / bend) if bend > 0 else 0.0


def current_rows(blocks: DataFrame) -> DataFrame:
    """The blocks as rows: user_id, item_id, label, score, lambda, hessian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, block in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(block[c]) for c in ("user", "item", "label", "score", "push", "bend")], names)

    names = ["user_id", "item_id", "label", "score", "lambda", "hessian"]
    return blocks.mapInArrow(run, "user_id bigint, item_id bigint, label int, score double, lambda double, hessian double")
