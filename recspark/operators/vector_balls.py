"""Exact inner-product search of packed vector blocks, ball by ball.

A stripe of items is halved at the median of its widest coordinate until the pieces are
small: balls with a centre, a radius and a largest norm. By Cauchy-Schwarz no vector of a
ball scores above ``min(q.c + |q| radius, |q| norm)`` for a query q. Queries meet the
balls by falling bound and leave out those below their kth score so far. Items of one
vector stand in a ball once, with the list of their ids: the vector is multiplied once, and
only as many of its items are looked at as can reach a user's first k.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from recspark.functions.portable import SCORE_DIGITS
from recspark.operators.masks import CONSTRAINTS, BlockMasks, profiles_of, rows_allowed

#: Queries that meet the balls together.
CHUNK = 256
#: Scores closer than this may change places when they are rounded for the order.
NEAR = 2 * 10.0**-SCORE_DIGITS


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def first_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each row's ``k`` greatest finite scores, rounded for the order; ties go to
    the smaller column."""
    row, col = np.nonzero(scores > -np.inf)
    at = first_rows(row, col, scores[row, col], len(scores), k)
    return row[at], col[at]


def within_k(value: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Whether a value is within a rounding of the kth of its row, which lies between two ``ends``."""
    near, ends = np.ones(len(value), bool), ends.tolist()
    for lo, hi in zip(ends, ends[1:]):
        if hi - lo > k:
            own = value[lo:hi]
            near[lo:hi] = own >= np.partition(own, hi - lo - k)[hi - lo - k] - NEAR
    return near


def first_rows(row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Places of each row's first ``k``; ``row`` ascends. Only what is within a rounding
    of the row's kth score is rounded and sorted."""
    near = within_k(value, np.searchsorted(row, np.arange(rows + 1)), k)
    at = np.flatnonzero(near)
    at = at[np.lexsort((col[at], -np.round(value[at], SCORE_DIGITS), row[at]))]
    return at[np.arange(len(at)) - np.searchsorted(row[at], row[at]) < k]


def balls(vectors: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of each ball, at most ``leaf``."""
    done, open_ = [], [np.arange(len(vectors))]
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        own = vectors[rows]
        order = rows[np.argsort(own[:, own.var(axis=0).argmax()], kind="stable")]
        open_ += [order[len(order) // 2:], order[:len(order) // 2]]
    return done


def pack_items(rows: pa.Table, leaf: int) -> pa.Table:
    """The balls of a stripe, one packed row each. A row is an item with its vector, or a
    vector with the list ``members`` of its items."""
    if "members" in rows.column_names:
        vectors = matrix(rows.column("weights"), rows.num_rows)
        lists = rows.column("members").combine_chunks()
        of, fields = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths())), lists.flatten()
        ids, years, genres = (fields.field(c) for c in ("item_id", "year", "genres"))
    else:
        vectors, of = matrix(rows.column("weights"), rows.num_rows), np.arange(rows.num_rows)
        ids, years, genres = (rows.column(c).combine_chunks() for c in ("item_id", "year", "genres"))
    ids, years, genres = ids.to_numpy(), years.cast(pa.float64()).to_numpy(zero_copy_only=False), genres.to_pylist()
    # Vectors by their smallest item, and the items of each by id.
    order = np.lexsort((ids, of))
    of, ids = of[order], ids[order]
    first = np.searchsorted(of, np.arange(len(vectors) + 1))
    by = np.argsort(ids[first[:-1]], kind="stable")
    out = []
    for at in balls(vectors[by], leaf):
        chosen = by[at]
        own = vectors[chosen]
        centre = own.mean(axis=0)
        size = first[chosen + 1] - first[chosen]
        ends = np.append(0, np.cumsum(size))
        place = np.repeat(first[chosen] - ends[:-1], size) + np.arange(ends[-1])
        out.append(pickle.dumps({
            "ids": ids[place], "ends": ends, "vectors": own, "centre": centre, "radius": np.sqrt(((own - centre) ** 2).sum(axis=1).max()),
            "norm": np.sqrt((own**2).sum(axis=1).max()), "years": years[order[place]], "genres": [genres[i] for i in order[place]],
        }, protocol=5))
    return pa.table({"ib": pa.array([rows.column("ib")[0].as_py()] * len(out), pa.int32()), "block": pa.array(out, pa.binary())})


def pack_queries(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("user_id")
    block = {"users": rows.column("user_id").to_numpy(), "vectors": matrix(rows.column("weights"), rows.num_rows),
             "profiles": profiles_of({c: rows.column(c).to_pylist() for c in ("bound", *CONSTRAINTS)})}
    return pa.table({"qb": pa.array([rows.column("qb")[0].as_py()], pa.int32()), "block": pa.array([pickle.dumps(block, protocol=5)], pa.binary())})


def _table(users, ids, score) -> pa.Table:
    return pa.table({"user_id": pa.array(users, pa.int64()), "item_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


def search_cell(rows: pa.Table, pairs: pa.Table | None, k: int, restricted: bool, whole: bool = False) -> pa.Table:
    """First ``k`` of the cell's items for each of its users; with their ranks if the cell has the ``whole`` catalog."""
    done = (lambda u, i, s: ranked(*map(np.asarray, (u, i, s)), k)) if whole else _table
    read = lambda kind: [pickle.loads(b.as_py()) for b in rows.filter(pc.equal(rows.column("asked"), kind)).column("block")]
    found, stripe = (read(True), read(False)) if rows.num_rows else ([], [])
    if not found or not stripe:
        return done(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    asked = found[0]
    if not np.isfinite(asked["vectors"]).all() or not all(np.isfinite(b["vectors"]).all() for b in stripe):
        raise ValueError("similarity scores must be finite")
    marks = _marks(asked["users"], stripe, pairs) if pairs is not None else None
    users, ids, score, _ = search(asked, stripe, k, marks, restricted)
    return done(users, ids, score)


def _marks(users: np.ndarray, stripe: list[dict], pairs: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per ball the (query row, place in the ball, keep) of the marked pairs, by row."""
    ids = np.concatenate([b["ids"] for b in stripe])
    ball = np.repeat(np.arange(len(stripe)), [len(b["ids"]) for b in stripe])
    place = np.concatenate([np.arange(len(b["ids"])) for b in stripe])
    order = np.argsort(ids, kind="stable")
    u, i, keep = (pairs.column(c).to_numpy(zero_copy_only=False) for c in ("user_id", "item_id", "keep"))
    row = np.minimum(np.searchsorted(users, u), len(users) - 1)
    at = order[np.minimum(np.searchsorted(ids, i, sorter=order), len(ids) - 1)]
    met = (users[row] == u) & (ids[at] == i)
    row, at, keep = row[met], at[met], keep[met].astype(bool)
    by = np.lexsort((row, ball[at]))
    row, at, keep = row[by], at[by], keep[by]
    ends = np.searchsorted(ball[at], np.arange(len(stripe) + 1)).tolist()
    return [(row[a:b], place[at[a:b]], keep[a:b]) for a, b in zip(ends, ends[1:])]


def _part(marks: tuple[np.ndarray, np.ndarray, np.ndarray], lo: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marks of the queries from ``lo`` on, by their place among them."""
    r, at, kind = marks
    part = slice(*np.searchsorted(r, [lo, lo + rows]))
    return r[part] - lo, at[part], kind[part]


def opened(own: dict, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``mask`` and how many items of each vector it leaves."""
    return mask, np.diff(np.append(0, np.cumsum(mask))[own["ends"]])


def copies(own: dict, scores: np.ndarray, kth: float, k: int, mask: np.ndarray | None, size: np.ndarray, marks, row: int,
            restricted: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(places, vectors)`` of one query's items that may be among its first ``k``, from a ball
    whose vectors have several items: the first ``k`` open ones of each vector that counts."""
    ends, shut = own["ends"], np.zeros(0, np.int64)
    if marks is not None:
        r, at, kind = marks
        mine = slice(*np.searchsorted(r, [row, row + 1]))
        shut = np.unique(at[mine][~kind[mine]])
        if restricted:
            only = np.zeros(len(own["ids"]), bool)
            only[at[mine][kind[mine]]] = True
            mask, size = opened(own, only if mask is None else only & mask)
    closed = shut if mask is None else shut[mask[shut]]
    if len(closed):
        size = size - np.bincount(np.searchsorted(ends, closed, side="right") - 1, minlength=len(size))
    some = np.flatnonzero((scores >= kth - NEAR) & (size > 0))
    if len(some) > k:
        some = some[scores[some] >= np.partition(scores[some], len(some) - k)[len(some) - k] - NEAR]
    some = some[np.argsort(-scores[some], kind="stable")]
    upto = np.cumsum(size[some])
    if len(some) and upto[-1] > k:
        some = some[scores[some] >= scores[some[np.searchsorted(upto, k)]] - NEAR]
    lo, hi = ends[some], ends[some + 1]
    if mask is None:
        hi = np.minimum(hi, lo + k + len(shut))
    width = hi - lo
    of, at = np.repeat(np.arange(len(some)), width), np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
    keep = np.ones(len(at), bool) if mask is None else mask[at]
    if len(shut):
        keep &= ~np.isin(at, shut)
    of, at = of[keep], at[keep]
    first = np.arange(len(of)) - np.searchsorted(of, of) < k
    return at[first], some[of[first]]


class OpenItems:
    """The items of each ball's vectors that a profile leaves: ``(places, ends)`` of the ball,
    made once per profile."""

    def __init__(self, stripe: list[dict], masks: list[BlockMasks] | None) -> None:
        self.stripe, self.masks, self.memo = stripe, masks, {}

    def of(self, ball: int, profile: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        key = ball, profile
        if key not in self.memo:
            own = self.stripe[ball]
            if profile is None:
                self.memo[key] = np.arange(len(own["ids"])), own["ends"]
            else:
                mask = self.masks[ball].allowed(*profile)
                self.memo[key] = np.flatnonzero(mask), np.append(0, np.cumsum(mask))[own["ends"]]
        return self.memo[key]


def _by_vectors(q: np.ndarray, bound: np.ndarray, stripe: list[dict], k: int, items: OpenItems, profiles: list, shut: list | None):
    """``(row, item, score)`` of what may be among each query's first ``k``, by row, and how
    many (query, ball) pairs were multiplied, where vectors have several items.

    A query needs as many items as ``k`` and its shut ones together: vectors are ranked by
    score and held until those above them have that many, and only then read as items."""
    hidden = [(r[~keep], at[~keep]) for r, at, keep in shut] if shut is not None else [(np.zeros(0, np.int64),) * 2] * len(stripe)
    need = k + np.bincount(np.concatenate([r for r, _ in hidden]), minlength=len(q))
    kinds = list(dict.fromkeys(profiles))
    kind = np.array([kinds.index(p) for p in profiles])
    kth, done = np.full(len(q), -np.inf), 0
    row, ball, vector, score, size = held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64, np.int64)]
    for b in np.argsort(-bound.max(axis=0), kind="stable").tolist():
        live = np.flatnonzero(bound[:, b] >= kth)
        if not len(live):
            continue
        done += len(live)
        scores = q[live] @ stripe[b]["vectors"].T
        sizes = np.stack([np.diff(items.of(b, p)[1]) for p in kinds])
        r, c = np.nonzero((scores >= kth[live, None] - NEAR) & (sizes > 0)[kind[live]])
        new = live[r], np.full(len(r), b), c, scores[r, c], sizes[kind[live[r]], c]
        held = [np.concatenate(x) for x in zip(held, new)]
        order = np.lexsort((-held[3], held[0]))
        row, ball, vector, score, size = held = [x[order] for x in held]
        first = np.searchsorted(row, np.arange(len(q) + 1))
        upto = np.append(0, np.cumsum(size))
        full = np.searchsorted(upto, upto[first[:-1]] + need, side="left")  # one past the vector that has enough
        have = full <= first[1:]
        kth[have] = score[full[have] - 1]
        held = [x[score >= kth[row] - NEAR] for x in held]
    row, ball, vector, score, size = held
    out = [[], [], [], []]
    for b, p in dict.fromkeys(zip(ball.tolist(), kind[row].tolist())):
        mine = np.flatnonzero((ball == b) & (kind[row] == p))
        places, ends = items.of(b, kinds[p])
        lo = ends[vector[mine]]
        width = np.minimum(ends[vector[mine] + 1] - lo, need[row[mine]])
        of = np.repeat(mine, width)
        at = places[np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        r, closed = hidden[b]
        if len(r):
            n = len(stripe[b]["ids"])
            keep = ~np.isin(row[of] * n + at, r * n + closed)
            of, at = of[keep], at[keep]
        for x, new in zip(out, (row[of], stripe[b]["ids"][at], score[of])):
            x.append(new)
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), done
    r, item, value = (np.concatenate(x) for x in out[:3])
    by = np.argsort(r, kind="stable")
    return r[by], item[by], value[by], done


def ranked(users: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> pa.Table:
    """Each user's first ``k`` rows with their rank; a user may come in several rows of queries."""
    names, row = np.unique(users, return_inverse=True)
    by = np.argsort(row, kind="stable")
    row, ids, score = row[by], ids[by], score[by]
    at = first_rows(row, ids, score, len(names), k)
    row = row[at]
    return _table(names[row], ids[at], score[at]).append_column("rank", pa.array(np.arange(len(at)) - np.searchsorted(row, row) + 1, pa.int32()))


def search(asked: dict, stripe: list[dict], k: int, marks=None, restricted: bool = False):
    """``(users, items, scores, share)`` of the first ``k`` per query; ``share`` of the
    (query, ball) pairs was multiplied."""
    centres = np.stack([b["centre"] for b in stripe])
    radius, norm = (np.array([b[c] for b in stripe]) for c in ("radius", "norm"))
    masks = [BlockMasks(b["genres"], b["years"]) for b in stripe] if any(p is not None for p in asked["profiles"]) else None
    shared = not restricted and any(len(b["ids"]) > len(b["vectors"]) for b in stripe)
    opened_items = OpenItems(stripe, masks) if shared else None
    out, done = [], 0
    for lo in range(0, len(asked["users"]), CHUNK):
        q, users, profiles = (asked[c][lo:lo + CHUNK] for c in ("vectors", "users", "profiles"))
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        bound = np.minimum(q @ centres.T + length * radius, length * norm)
        bound += NEAR + 1e-9 * length * (norm + radius)  # more than any rounding of the sums
        if shared:
            shut = [_part(m, lo, len(q)) for m in marks] if marks is not None else None
            row, item, value, n = _by_vectors(q, bound, stripe, k, opened_items, profiles, shut)
            done += n
            at = first_rows(row, item, value, len(q), k)
            out.append((users[row[at]], item[at], value[at]))
            continue
        best = np.full((len(q), k), -np.inf)
        kth = best[:, 0].copy()
        row, item, value = [], [], []
        for b in np.argsort(-bound.max(axis=0), kind="stable"):
            live = np.flatnonzero(bound[:, b] >= kth)
            if not len(live):
                continue
            done += len(live)
            own = stripe[b]
            scores = q[live] @ own["vectors"].T
            if len(own["ids"]) > len(own["vectors"]):
                part = _part(marks[b], lo, len(q)) if marks is not None else None
                bound_by = {None: (None, np.diff(own["ends"]))}  # each profile of these queries once
                for n, i in enumerate(live.tolist()):
                    if profiles[i] not in bound_by:
                        bound_by[profiles[i]] = opened(own, masks[b].allowed(*profiles[i]))
                    at, of = copies(own, scores[n], kth[i], k, *bound_by[profiles[i]], part, i, restricted)
                    new = scores[n, of]
                    best[i] = np.sort(np.concatenate([best[i], new]))[-k:]
                    kth[i] = best[i, 0]
                    row.append(np.full(len(at), i))
                    item.append(own["ids"][at])
                    value.append(new)
                continue
            open_ = None
            if masks is not None:
                open_ = rows_allowed(masks[b], [profiles[i] for i in live])
            if marks is not None:
                keep = np.full((len(q), len(own["ids"])), not restricted)
                r, at, kind = _part(marks[b], lo, len(q))
                keep[r[kind], at[kind]] = True
                keep[r[~kind], at[~kind]] = False
                open_ = keep[live] if open_ is None else open_ & keep[live]
            if open_ is not None:
                scores[~open_] = -np.inf
            better = np.flatnonzero((scores > kth[live, None]).any(axis=1))
            if len(better):
                some = live[better]
                both = np.concatenate([best[some], scores[better]], axis=1)
                best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[some] = best[some].min(axis=1)
            r, c = np.nonzero((scores >= kth[live, None] - NEAR) & (scores > -np.inf))
            row.append(live[r])
            item.append(own["ids"][c])
            value.append(scores[r, c])
        if row:
            row, item, value = np.concatenate(row), np.concatenate(item), np.concatenate(value)
            by = np.argsort(row, kind="stable")
            row, item, value = row[by], item[by], value[by]
            at = first_rows(row, item, value, len(q), k)
            out.append((users[row[at]], item[at], value[at]))
    users, items, scores = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
    return users, items, scores, done / max(1, len(asked["users"]) * len(stripe))
