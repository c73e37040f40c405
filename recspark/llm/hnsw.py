"""Embedding near-duplicates with one small-world graph per shard (operator 6).

Equal vectors collapse to one row. Distinct vectors are dealt to shards by hash; a
task builds a hierarchical navigable small-world graph of its shard (levels with
geometric sizes, neighbours chosen for diversity, links both ways) and audits it: the
links found with the current beam are compared with brute force inside the shard, a
vector's hit on itself left out. Three groups must each reach the recall: a sample of
the shard's vectors, a sample of all vectors (most of them of other shards), and
planted queries just inside the threshold of a sampled vector, so a shard whose samples
link with nothing is audited too. The beam doubles until they do; a shard where they
never do is searched exactly. Graphs are written as rows of the shared folder. Then
every vector queries every shard: cells of (shard, part of the queries) read the graph
first and stream the queries; a query whose beam ends inside the threshold is widened
again, up to the exact search. Pairs are verified by cosine
in double precision. A cell emits one count per query and a spanning forest of what
it linked, never the pairs, and components unite the forests.

Work is queries x shards x log(shard). Shards grow to ``shard_rows`` vectors before
their number does, so it stays near-linear until shards are full.

Defined results: null, zero, empty and non-finite vectors, and those with a null
component, link with nothing and are their own component; vectors of unequal lengths
never link; copies link with each other; rows that share an id are vectors of their own,
each with its own links and component; a row with a null id links and is counted like
any other, but names a component only if all its ids are null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.components import components, stored

LINKS, EDGES = 0, 1


class Graph:
    """A navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, unit: np.ndarray, m: int = 12, beam: int = 48, seed: int = 7) -> None:
        self.unit, self.m, self.beam = np.ascontiguousarray(unit, np.float32), m, beam
        n = len(unit)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(m)).astype(int), 8)
        order = np.argsort(-self.level, kind="stable")
        self.entry = int(order[0]) if n else -1
        #: Per level: ids of its nodes and their neighbours as positions among all nodes.
        self.links = [np.full((n, 2 * m if at == 0 else m), -1, np.int32) for at in range(int(self.level.max(initial=0)) + 1)]
        done, size = 1, 1
        while done < n:
            batch = order[done : done + min(size, 512)]
            self._insert(batch, order[:done])
            done += len(batch)
            size = done
        self._mend()

    def _mend(self, spare: int = 4) -> None:
        """Give every node that the entry can't reach on the lowest level a link from a
        near one that it can; choosing neighbours anew may have cut its last."""
        n = len(self.unit)
        if not n:
            return
        self.links[0] = np.pad(self.links[0], ((0, 0), (0, spare)), constant_values=-1)
        reached = np.zeros(n, bool)
        front = np.array([self.entry])
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(self.links[0][front])
                front = near[(near >= 0)]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            lost, known = lost[:256], np.flatnonzero(reached & (self.links[0][:, -1] < 0))
            near = known[np.argmax(self.unit[lost] @ self.unit[known].T, axis=1)]
            near, first = np.unique(near, return_index=True)
            self.links[0][near, np.argmax(self.links[0][near] < 0, axis=1)] = lost[first]
            front = lost[first]

    def _insert(self, batch: np.ndarray, before: np.ndarray) -> None:
        q = self.unit[batch]
        entry = np.full(len(batch), self.entry)
        for at in range(len(self.links) - 1, -1, -1):
            here = self.level[batch] >= at
            ids, sims = self._search(q, entry, at, self.beam if here.any() else 1)
            entry = np.where(ids[:, 0] >= 0, ids[:, 0], entry)
            if not here.any():
                continue
            own, found, sims = batch[here], ids[here], sims[here]
            # Vectors of the same batch don't stand in the graph yet: compare them directly.
            near = q[here] @ q[here].T
            np.fill_diagonal(near, -2)
            keep = min(self.m, len(own))
            top = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            found = np.concatenate([found, own[top]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(near, top, axis=1)], axis=1)
            sims[found == own[:, None]] = -2
            rows, new = self._choose(found, sims, self.m)
            self.links[at][own, : self.m] = new
            self._back(at, np.repeat(own, self.m), new.ravel(), rows.ravel())

    def _choose(self, ids: np.ndarray, sims: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates the nearest ones that are nearer to the row than to
        any chosen one; free places are filled with the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.unit[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -2, np.float32)
        valid = (ids >= 0) & (sims > -1.5)
        for c in range(ids.shape[1]):
            ok = valid[:, c] & (sims[:, c] > closest[:, c]) & (chosen.sum(axis=1) < limit)
            chosen[:, c] = ok
            closest = np.where(ok[:, None], np.maximum(closest, between[:, :, c]), closest)
        rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :limit]
        out = np.take_along_axis(np.where(valid, ids, -1), rank, 1).astype(np.int32)
        score = np.take_along_axis(sims, rank, 1)
        if out.shape[1] < limit:
            short = ((0, 0), (0, limit - out.shape[1]))
            out, score = np.pad(out, short, constant_values=-1), np.pad(score, short, constant_values=-2)
        return score, out

    def _back(self, at: int, source: np.ndarray, target: np.ndarray, sims: np.ndarray) -> None:
        """Add the links back; a full node chooses its neighbours anew."""
        ok = target >= 0
        source, target, sims = source[ok], target[ok], sims[ok]
        order = np.lexsort((-sims, target))
        source, target, sims = source[order], target[order], sims[order]
        edge = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.empty(0, int)
        nodes = target[edge]
        place = np.arange(len(target)) - np.repeat(edge, np.diff(np.append(edge, len(target))))
        links = self.links[at]
        width = links.shape[1]
        in_width = place < width
        extra = np.full((len(nodes), width), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), np.diff(np.append(edge, len(target))))[in_width], place[in_width]] = source[in_width]
        for lo in range(0, len(nodes), 512):
            part = nodes[lo : lo + 512]
            ids = np.concatenate([links[part], extra[lo : lo + 512]], axis=1)
            ids = np.sort(ids, axis=1)[:, ::-1]
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            score = np.einsum("bmd,bd->bm", self.unit[np.maximum(ids, 0)], self.unit[part])
            score[ids < 0] = -2
            links[part] = self._choose(ids, score, width)[1]

    def _search(self, q: np.ndarray, entry: np.ndarray, at: int, beam: int, wide: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found for each query and their cosines, best first."""
        n, b, links = len(self.unit), len(q), self.links[at]
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -2, np.float32)
        open_ = np.zeros((b, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("bd,bd->b", self.unit[entry], q), True
        seen = np.zeros((b, n), bool)
        seen[np.arange(b), entry] = True
        live = np.arange(b)
        while len(live):
            # The best unexpanded places of each beam; beams are kept sorted.
            step = min(wide, beam)
            at_ = np.argsort(~open_[live], axis=1, kind="stable")[:, :step]
            take = np.take_along_axis(open_[live], at_, 1)
            go = take.any(axis=1)
            live, at_, take = live[go], at_[go], take[go]
            if not len(live):
                break
            nodes = np.where(take, np.take_along_axis(ids[live], at_, 1), -1)
            open_[live[:, None], at_] = False
            near = links[np.maximum(nodes, 0)].astype(np.int64)
            near[nodes < 0] = -1
            near = near.reshape(len(live), -1)
            known = (near < 0) | seen[live[:, None], np.maximum(near, 0)]
            if step > 1:  # a node reached from two places counts once
                order = np.argsort(near, axis=1, kind="stable")
                line = np.take_along_axis(near, order, 1)
                twice = np.zeros(near.shape, bool)
                np.put_along_axis(twice, order[:, 1:], line[:, 1:] == line[:, :-1], 1)
                known |= twice
            r, c = np.nonzero(~known)
            seen[live[r], near[r, c]] = True
            score = np.full(near.shape, -2, np.float32)
            score[r, c] = np.einsum("kd,kd->k", self.unit[near[r, c]], q[live[r]])
            all_s = np.concatenate([sims[live], score], axis=1)
            all_i = np.concatenate([ids[live], np.where(score > -2, near, -1)], axis=1)
            all_o = np.concatenate([open_[live], score > -2], axis=1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_s, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            open_[live] = np.take_along_axis(all_o, best, 1)
        return ids, sims

    def find(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine ``least`` or more that the beams meet. A beam
        whose worst node is still inside is widened until it isn't; one of the graph's
        size is no beam any more but the whole product."""
        if not len(self.unit) or not len(q):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q = np.ascontiguousarray(q, np.float32)
        entry = np.full(len(q), self.entry)
        for at in range(len(self.links) - 1, 0, -1):
            entry = self._search(q, entry, at, 1)[0][:, 0]
        rows, nodes, todo = [], [], np.arange(len(q))
        beam = min(beam, len(self.unit))
        while len(todo):
            if beam >= len(self.unit):
                step = max(1, (8 << 20) // len(self.unit))
                for lo in range(0, len(todo), step):
                    r, c = np.nonzero(q[todo[lo : lo + step]] @ self.unit.T >= least)
                    rows.append(todo[lo : lo + step][r])
                    nodes.append(c)
                break
            step = max(1, min(256, (64 << 20) // max(len(self.unit), beam * 64)))
            again = []
            for lo in range(0, len(todo), step):
                part = todo[lo : lo + step]
                ids, sims = self._search(q[part], entry[part], 0, beam)
                full = sims[:, -1] >= least
                r, c = np.nonzero((sims >= least) & ~full[:, None])
                rows.append(part[r])
                nodes.append(ids[r, c])
                again.append(part[full])
            todo, beam = np.concatenate(again), min(beam * 4, len(self.unit))
        return np.concatenate(rows), np.concatenate(nodes)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaling by a power of two first is exact and keeps squares in range."""
    if x.size and x.dtype == np.float64:
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(graph: Graph, q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """By brute force: which queries have a link, and a row of bits for each of those.
    ``own`` is the place of a query's vector in the graph, or -1."""
    some, bits = [np.empty(0, np.int64)], [np.empty((0, -(-len(graph.unit) // 8)), np.uint8)]
    for lo in range(0, len(q), 128):
        inside = q[lo : lo + 128] @ graph.unit.T >= least
        at = np.flatnonzero(own[lo : lo + 128] >= 0)
        inside[at, own[lo + at]] = False
        linked = np.flatnonzero(inside.any(axis=1))
        some.append(lo + linked)
        bits.append(np.packbits(inside[linked], axis=1))
    return np.concatenate(some), np.concatenate(bits)


def found_share(graph: Graph, q: np.ndarray, own: np.ndarray, least: float, beam: int) -> tuple[int, int]:
    """(links that the beam finds, links there are) of the queries, without those to themselves."""
    if not len(q) or not len(graph.unit):
        return 0, 0
    some, bits = _links(graph, q, own, least)
    return _hits(graph, q[some], bits, least, beam), int(np.bitwise_count(bits).sum())


def _hits(graph: Graph, q: np.ndarray, bits: np.ndarray, least: float, beam: int) -> int:
    hits = 0
    for lo in range(0, len(q), 128):
        r, c = graph.find(q[lo : lo + 128], least - 1e-6, beam)
        hits += int((bits[lo + r, c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).sum())
    return hits


def planted(unit: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """A query for each vector, at a cosine between ``least`` and 1 in a random direction."""
    away = rng.standard_normal(unit.shape).astype(np.float32)
    away -= np.einsum("bd,bd->b", away, unit)[:, None] * unit
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    cosine = (least + (1 - least) * rng.uniform(0.01, 0.5, (len(unit), 1))).astype(np.float32)
    return unit_rows(cosine * unit + np.sqrt(1 - cosine**2) * away).astype(np.float32)


def audited_beam(
    graph: Graph, unit: np.ndarray, least: float, recall: float, sample: int, beam: int, seed: int = 3,
    others: np.ndarray | None = None, places: np.ndarray | None = None,
) -> int:
    """The least beam, doubling from ``beam``, that finds ``recall`` of the links of each
    of three groups of queries; brute force gives them: own vectors, ``others`` (unit
    vectors of any shard and their ``places`` in this one or -1) and planted queries.
    If none does, the shard's size, at which ``find`` is exact."""
    rng = np.random.default_rng(seed)
    own = rng.permutation(len(unit))[:sample]
    near = planted(unit[own], least, rng)
    groups = [(unit[own], own), (near, np.full(len(near), -1))]
    if others is not None and len(others):
        groups.append((others.astype(np.float32), places if places is not None else np.full(len(others), -1)))
    audits = []
    for q, place in groups:
        some, bits = _links(graph, q, place, least)
        audits.append((q[some], bits, recall * int(np.bitwise_count(bits).sum())))
    while beam < len(unit):
        if all(_hits(graph, q, bits, least, beam) >= need for q, bits, need in audits):
            return beam
        beam *= 2
    return len(unit)


class Forest:
    """Union-find over arbitrary integers that reports each node's root once."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while (y := self.up.get(x, x)) != top:
            self.up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.up]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding",
    min_shards: int = 8, shard_rows: int = 100_000, parts: int = 3, beam: int = 32, recall: float = 0.99, sample: int = 1024,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    ``min_shards`` is for parallel builds, ``shard_rows`` bounds a task's graph,
    ``parts`` splits each shard's queries, ``sample`` bounds each group of a shard's audit."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(x == x, F.lit(False)) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0), F.lit(False))
    rows, _ = stored(rows.select("vec_id", F.when(usable, F.col("v")).alias("v")), "vectors")
    # -0.0 and 0.0 are one value to groupBy; a copy's links are counted from the group. A
    # generated key stands for each distinct vector: ids may be null or repeat.
    groups = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"))
    keyed = groups.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("v"))
    placed, _ = stored(keyed, "distinct-vectors")
    shards = {r[0]: max(min_shards, -(-r[1] // shard_rows)) for r in placed.groupBy("length").count().collect()}
    counts: list[DataFrame] = []
    forests: list[DataFrame] = []
    for length, n in sorted(shards.items()):
        found = _search_all(placed.where(F.col("length") == length), n, parts, least, beam, recall, sample)
        counts.append(found.where(F.col("kind") == LINKS).groupBy("a").agg(F.sum("b").alias("others")))
        forests.append(found.where(F.col("kind") == EDGES).select("a", "b"))
    if not shards:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    others, edges = counts[0], forests[0]
    for more in counts[1:]:
        others = others.unionByName(more)
    for more in forests[1:]:
        edges = edges.unionByName(more)
    roots = components(edges)
    known = placed.join(others.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left").select(
        "v", "name", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root"))
    names = known.groupBy("root").agg(F.min("name").alias("component"))
    return rows.join(known.join(names, "root").select("v", "links", "component"), "v", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )


def _search_all(placed: DataFrame, shards: int, parts: int, least: float, beam: int, recall: float, sample: int) -> DataFrame:
    """Rows (kind, a, b): how many others query a links with, or a forest's edge."""
    place = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    dealt = placed.select(place.alias("shard"), "node", "copies", "v").repartition(shards, "shard")
    # At most ``sample`` rows, whichever shards they are dealt to: every shard's audit asks them.
    drawn = placed.orderBy(F.xxhash64("v", F.lit(2)), "node").limit(sample).select("node", "v").collect()
    asked, others = np.array([r[0] for r in drawn], np.int64), unit_rows(np.array([r[1] for r in drawn], np.float64))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            shard, x = batch.column(0).to_numpy(), _vectors(batch.column(3))
            for s in np.unique(shard):
                own = shard == s
                held.setdefault(int(s), []).append((batch.column(1).to_numpy()[own], batch.column(2).to_numpy()[own], x[own]))
        for s, many in held.items():
            node, copies, x = (np.concatenate(y) for y in zip(*many))
            order = np.lexsort(x.T)  # the same graph whatever order the rows came in
            node, copies, x = node[order], copies[order], x[order]
            unit = unit_rows(x)
            graph = Graph(unit)
            known = {n: i for i, n in enumerate(node.tolist())}
            at = np.array([known.get(n, -1) for n in asked.tolist()], np.int64)
            wide = audited_beam(graph, graph.unit, least, recall, sample, beam, others=others, places=at)
            blob = pickle.dumps((node, copies, unit, graph.links, graph.entry, wide), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], ["shard", "graph"])

    graphs, _ = stored(dealt.mapInArrow(build, "shard int, graph binary"), "graphs")
    # Few vectors may leave shards empty; those have no graph to ask.
    present = sorted(r[0] for r in graphs.select("shard").collect())
    part = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(parts)).cast("int")
    nothing = F.lit(None)
    queries = placed.select(
        F.explode(F.array(*map(F.lit, present))).alias("shard"), part.alias("part"), F.lit(1).alias("kind"),
        "node", "copies", "v", nothing.cast("binary").alias("graph"))
    first = graphs.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"),
        nothing.cast("long").alias("node"), nothing.cast("long").alias("copies"), nothing.cast("array<double>").alias("v"), "graph")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = forest = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            turns = np.flatnonzero(kind == 0)
            for lo, hi in zip([0, *turns], [*turns, len(kind)]):
                if lo in turns:
                    if forest:
                        yield pack_edges(forest)
                    node, copies, unit, links, entry, wide = pickle.loads(batch.column(6)[int(lo)].as_py())
                    graph = Graph.__new__(Graph)
                    graph.unit, graph.links, graph.entry = unit.astype(np.float32), links, entry
                    forest, lo = Forest(), lo + 1
                if lo >= hi:
                    continue
                own = batch.slice(int(lo), int(hi - lo))
                ids, q = own.column(3).to_numpy(), unit_rows(_vectors(own.column(5)))
                r, c = graph.find(q, least - 1e-6, wide)
                exact = np.concatenate([np.einsum("kd,kd->k", q[r[i : i + 65536]], unit[c[i : i + 65536]]) >= least
                                        for i in range(0, len(r), 65536)] or [np.empty(0, bool)])
                ok = exact & (node[c] != ids[r])
                r, c = r[ok], c[ok]
                total = np.bincount(r, weights=copies[c], minlength=len(ids)).astype(np.int64)
                for a, b in set(zip(ids[r].tolist(), node[c].tolist())):
                    forest.join(a, b)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), LINKS, np.int32)), pa.array(ids[some]), pa.array(total[some])], ["kind", "a", "b"])
        if forest:
            yield pack_edges(forest)

    def pack_edges(forest: Forest) -> pa.RecordBatch:
        pairs = np.array(forest.edges(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(pairs), EDGES, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["kind", "a", "b"])

    cells = queries.unionByName(first).repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "kind", "node")
    found, _ = stored(cells.mapInArrow(search, "kind int, a long, b long"), "found-links")
    return found
