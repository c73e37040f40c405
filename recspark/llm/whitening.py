"""Whitening of embeddings by refined eigenvectors (operator 12).

Entries become integers, each distinct vector enters the fit once, and the covariance is
summed as exact integers of entries less the floor of their mean: blocks of base 2**20
digits are multiplied as doubles, in which such products are exact, so neither the order
of rows nor their number costs a digit. Partial matrices are cut into stripes of rows,
so a task adds up a stripe and not a matrix, and one task solves a whole matrix, whose
size is the vectors' length squared.

The solve starts from float32 eigenvectors and corrects them by the iterations of Ogita
and Aishima in extended precision: with R = I - X'X and S = X'VX, each pair of columns
is rotated by (S_ij + e_j R_ij) / (e_j - e_i), which squares the error. Where eigenvalues
lie closer than the iteration can tell apart, the columns of such a cluster are first
turned by the eigenvectors of their own small matrix, taken less its mean so that the
small gaps keep their digits; what is equal after that stays an orthonormal basis.

Vectors of unequal lengths have nothing in common, so each length is fitted by itself.
Models go to the tasks with the code: 17 numbers an entry for each length, whose total is
checked against ``model_bytes``.

Defined results: rows whose vector is null or holds a null or non-finite entry are
dropped, and so are entries whose integer doesn't fit in a long; an empty vector has no
component; a component without variance is whitened to null and left out of
the identity error, which is null if none has any; ``explained`` is null where the trace
is 0; a deviation that doesn't fit in a long is null; a null id stays a null id; repeated
rows are each listed; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.components import stored

SCALE, SHIFT = 64, 1_000_000
DIGIT, BLOCK, STRIPE = 20, 4096, 32
Extended = np.longdouble


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows that remain: x = floor(scale * entry) + shift as longs."""
    raw = F.col(vector).cast("array<double>")
    room = float(1 << 62)
    whole = F.forall("v", lambda c: F.coalesce(F.abs(c * scale) < room, F.lit(False)))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), raw.alias("v")).where(F.col("v").isNotNull() & whole)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long")).alias("x"))


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the rows of each length."""
    lists = batch.column(column)
    size = np.asarray(lists.value_lengths())
    flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        for lo in range(0, len(rows), BLOCK):
            part = rows[lo : lo + BLOCK]
            yield length, part, flat[start[part][:, None] + np.arange(length)]


def totals(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per length: the number of vectors and the exact sum of each entry, as Python integers.
    Only these sums, one number an entry, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for length, rows, x in _matrices(batch, 0):
                own = held.setdefault(length, [0, np.zeros(length, object)])
                own[0] += len(rows)
                high = x >> 31  # two halves: neither can overflow in a block
                own[1] += high.sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        for length, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()),
                 pa.array([str(v) for v in [n, *sums.tolist()]], pa.string())], ["length", "at", "value"])

    parts = fit.select("x").mapInArrow(run, "length int, at int, value string")
    sums = parts.groupBy("length", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found: dict[int, tuple[int, np.ndarray]] = {}
    for length in {r["length"] for r in sums}:
        own = sorted((r["at"], int(r["value"])) for r in sums if r["length"] == length)
        found[length] = own[0][1], np.array([v for _, v in own[1:]], object)
    return found


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Doubles d_k below 2**20 in size with y = sum of d_k * 2**(20 k)."""
    out = []
    while True:
        low = y & ((1 << DIGIT) - 1)
        if (np.abs(y) < 1 << DIGIT).all():
            return [*out, y.astype(np.float64)]
        out.append(low.astype(np.float64))
        y = y >> DIGIT


def gram(y: np.ndarray) -> np.ndarray:
    """y'y exactly, as (levels, d, d) longs of base 2**20; ``y`` has at most BLOCK rows."""
    parts = digits(y)
    levels = np.zeros((2 * len(parts), y.shape[1], y.shape[1]), np.int64)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            levels[i + j] += (a.T @ b).astype(np.int64)
    return levels


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two stacks of levels, with carries, so that no level overflows."""
    out = np.zeros((max(len(a), len(b)) + 1, *a.shape[1:]), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    for i in range(len(out) - 1):
        out[i + 1] += out[i] >> DIGIT
        out[i] &= (1 << DIGIT) - 1
    while len(out) > 1 and not out[-1].any():
        out = out[:-1]
    return out


def covariances(fit: DataFrame, means: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """(length, at, width, levels): stripes of the exact matrices of x less its floored mean."""
    center = {length: np.array([int(s) // n for s in sums], np.int64) for length, (n, sums) in means.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in _matrices(batch, 0):
                own = gram(x - center[length])
                held[length] = add(held[length], own) if length in held else add(own, own[:0])
        for length, levels in held.items():
            for lo in range(0, length, STRIPE):
                yield pack(length, lo, levels[:, lo : lo + STRIPE])

    def pack(length: int, lo: int, levels: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([length], pa.int32()), pa.array([lo], pa.int32()), pa.array([np.ascontiguousarray(levels).tobytes()], pa.binary())], ["length", "at", "levels"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a stripe come one after another; one sum is held."""
        here, total = None, None
        for batch in batches:
            for length, lo, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                levels = np.frombuffer(blob, np.int64).reshape(-1, min(STRIPE, length - lo), length)
                if here == (length, lo):
                    total = add(total, levels)
                else:
                    if here:
                        yield pack(*here, total)
                    here, total = (length, lo), levels
        if here:
            yield pack(*here, total)

    parts = fit.select("x").mapInArrow(run, "length int, at int, levels binary")
    return parts.repartition("length", "at").sortWithinPartitions("length", "at").mapInArrow(merge, "length int, at int, levels binary")


def _turn_clusters(v: np.ndarray, x: np.ndarray, gap: Extended) -> np.ndarray:
    """Turn the columns of each cluster by the eigenvectors of its own matrix."""
    value = (x * (v @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order], value[order]
    cuts = np.flatnonzero(value[:-1] - value[1:] > gap) + 1
    for own in np.split(np.arange(len(value)), cuts):
        if len(own) > 1:
            small = x[:, own].T @ v @ x[:, own]
            small = (small + small.T) / 2 - np.eye(len(own), dtype=Extended) * value[own].mean()
            size = np.abs(small).max()
            if size > 0:
                turn = np.linalg.eigh((small / size).astype(np.float64))[1][:, ::-1]
                x[:, own] = x[:, own] @ turn.astype(Extended)
    return x


def refined(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix in
    extended precision, from a float32 start."""
    d = len(v)
    scale = np.abs(v).max() if d else 0
    if not scale:
        return np.zeros(d), np.eye(d)
    v = v.astype(Extended) / scale
    x = np.linalg.eigh(v.astype(np.float32))[1][:, ::-1].astype(Extended)
    one, tiny = np.eye(d, dtype=Extended), np.finfo(Extended).eps
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ v @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # a small gap would blow up what rounding leaves between the halves
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(value)
        # Pairs nearer than a multiple of the columns' error would be turned too far to converge.
        error = np.linalg.norm(off.astype(np.float64)) + np.linalg.norm(v.astype(np.float64)) * np.linalg.norm(r.astype(np.float64))
        gap = 100 * (error + float(tiny))
        apart = value[None, :] - value[:, None]
        wide = np.abs(apart) > gap
        move = np.where(wide, (s + value[None, :] * r) / np.where(wide, apart, 1), r / 2)
        x = x + x @ move
        np.fill_diagonal(wide, True)
        if not wide.all():
            x = _turn_clusters(v, x, Extended(gap))
        if np.abs(move).max() <= 4 * tiny * d and error <= 16 * tiny * d:
            break
    x = x + x @ (one - x.T @ x) / 2
    value = (x * (v @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order], value[order]
    sign = np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return (value * scale), x * sign


@dataclass(frozen=True)
class Whitener:
    """The model of one length: a vector x becomes (x - center - rest) @ project."""

    n: int
    sums: list[int]
    center: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def project(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; NaN where there is no variance."""
        root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return self.vectors / root


def solve(n: int, sums: np.ndarray, levels: np.ndarray, components: int) -> Whitener:
    """The model from n, the exact sums and the exact centred products."""
    exact = sum((level.astype(object) << (DIGIT * k) for k, level in enumerate(levels)), start=np.zeros(levels.shape[1:], object))
    center = np.array([int(s) // n for s in sums], np.int64)
    over = np.array([int(s) - n * int(c) for s, c in zip(sums, center)], object)
    square = exact * n - np.outer(over, over)  # n * n times the covariance, an integer
    v = np.array([[_extended(int(c)) for c in row] for row in square], Extended).reshape(square.shape) / (Extended(n) * Extended(n))
    values, vectors = refined(v)
    trace = np.trace(v)
    least = len(v) * np.finfo(np.float64).eps * trace
    kept = min(components, len(v))
    top = np.where(values[:kept] > least, values[:kept], 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = (values[:kept] / trace).astype(np.float64)
    return Whitener(n, [int(s) for s in sums], center, np.array([int(o) / n for o in over], np.float64), top.astype(np.float64),
                    vectors[:, :kept].astype(np.float64), share)


def _extended(value: int) -> Extended:
    """An integer in extended precision, without going through a double."""
    sign, value = (-1 if value < 0 else 1), abs(value)
    down = max(value.bit_length() - 64, 0)
    value >>= down
    return sign * np.ldexp(np.ldexp(Extended(value >> 32), 32) + Extended(value & 0xFFFFFFFF), down)


def fit(distinct: DataFrame, components: int = 16, model_bytes: int = 64 << 20) -> dict[int, Whitener]:
    """Models by length. A matrix is solved where its stripes meet, one task a length."""
    means = totals(distinct)
    size = sum(8 * length * (components + 3) for length in means)
    if size > model_bytes:
        raise ValueError(f"models of {size} bytes are over model_bytes")

    def run(group: pa.Table) -> pa.Table:
        length = group.column("length")[0].as_py()
        parts = sorted(zip(group.column("at").to_pylist(), group.column("levels").to_pylist()))
        stripes = [np.frombuffer(blob, np.int64).reshape(-1, min(STRIPE, length - lo), length) for lo, blob in parts]
        levels = np.zeros((max(map(len, stripes)), length, length), np.int64)
        for (lo, _), stripe in zip(parts, stripes):
            levels[: len(stripe), lo : lo + stripe.shape[1]] = stripe
        model = solve(*means[length], levels, components)
        return pa.table({
            "length": pa.array([length], pa.int32()), "values": pa.array([model.values.tolist()], pa.list_(pa.float64())),
            "vectors": pa.array([model.vectors.ravel().tolist()], pa.list_(pa.float64())), "explained": pa.array([model.explained.tolist()], pa.list_(pa.float64()))})

    rows = covariances(distinct, means).groupBy("length").applyInArrow(
        run, "length int, values array<double>, vectors array<double>, explained array<double>").collect()
    models = {}
    for r in rows:
        n, sums = means[r["length"]]
        center = np.array([int(s) // n for s in sums], np.int64)
        rest = np.array([(int(s) - n * int(c)) / n for s, c in zip(sums, center)], np.float64)
        models[r["length"]] = Whitener(n, [int(s) for s in sums], center, rest, np.array(r["values"]),
                                       np.array(r["vectors"]).reshape(r["length"], -1), np.array(r["explained"], np.float64))
    return models


def identity_errors(distinct: DataFrame, models: dict[int, Whitener]) -> dict[int, float | None]:
    """Per length: the largest entry, in size, of the covariance of what the model gives
    for its fit vectors, less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in _matrices(batch, 0):
                if length:
                    w = (x - models[length].center - models[length].rest) @ models[length].project
                    w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
                    held[length] = held.get(length, 0) + w.T @ w
        for length, sums in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * sums.size, pa.int32()), pa.array(range(sums.size), pa.int32()), pa.array(sums.ravel())], ["length", "at", "value"])

    sums = distinct.select("x").mapInArrow(run, "length int, at int, value double").groupBy("length", "at").agg(F.sum("value").alias("value")).collect()
    errors: dict[int, float | None] = {}
    for length, model in models.items():
        kept = len(model.values) + 1
        own = np.zeros(kept * kept)
        for r in sums:
            if r["length"] == length:
                own[r["at"]] = r["value"]
        own = own.reshape(kept, kept) / model.n
        cov = own[:-1, :-1] - np.outer(own[-1, :-1], own[-1, :-1]) - np.eye(kept - 1)
        some = model.values > 0
        errors[length] = float(np.abs(cov[some][:, some]).max()) if some.any() else None
    return errors


def transform(rows: DataFrame, models: dict[int, Whitener], errors: dict[int, float | None]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per
    vector and component. ``rows`` has vec_id and x."""
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    longest = (1 << 63) - 1

    def deviation(x: np.ndarray, model: Whitener) -> list[int | None]:
        """Sum of (n * x - sum)**2, exactly: in longs where they hold it, else as Python integers."""
        far = model.n * (int(np.abs(x - model.center).max()) + 1)
        over = [s - model.n * int(c) for s, c in zip(model.sums, model.center)]
        if far * far * x.shape[1] <= longest:
            y = (x - model.center) * model.n - np.array(over, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = (x - model.center).astype(object) * model.n - np.array(over, object)
        return [v if v <= longest else None for v in (y * y).sum(axis=1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for length, at, x in _matrices(batch, 1):
                if not length:
                    continue
                model = models[length]
                kept = len(model.values)
                w = ((x - model.center - model.rest) @ model.project).ravel()
                far = pa.array(deviation(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), kept)))
                many = len(at) * kept
                share = np.tile(model.explained, len(at))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(at, kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(many, model.n)), far, pa.array(w, mask=np.isnan(w)), pa.array(share, mask=np.isnan(share)),
                    pa.array([errors[length]] * many, pa.float64())], names)

    return rows.select("vec_id", "x").mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The fit over the distinct integer vectors, applied to every row that remains."""
    rows = integers(vectors, key, vector)
    distinct, _ = stored(rows.select("x").distinct(), "fit-vectors")
    models = fit(distinct, components)
    return transform(rows, models, identity_errors(distinct, models))
