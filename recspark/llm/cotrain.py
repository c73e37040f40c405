"""Quality classification by co-training (operator 7).

Two logistic models see different views of a document: its text (hashed words that
occur, and shares such as symbols, capitals and repeated words and lines) and its
metadata (source, language and length class). Both start from labelled rows; in each
round either one labels the documents of a pool of which it is most certain, and these
join the other's training rows. Each view is then calibrated on labelled rows that no
round has used, and a third logistic model combines the calibrated log-odds. This is
done for two targets, quality and toxicity, and every document is scored in one pass
over whole texts without a shuffle.

Fitting reads bounded samples chosen by hash: ``per_class`` labelled documents of each
pair of labels, null being one, and a pool of ``pool`` others. Folds are cut per target
and class, so a rare class reaches both; a row that lacks a target's label is of that
target's pool. Scoring covers all rows.

Defined results: null and empty texts are scored by their shares (zero) and metadata;
unseen or null metadata adds nothing; without both classes of a target in the labels,
its score is the share of the class seen (0.5 without labels); several labels of one
document count as the worst of them; rows that share an id are each listed; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import WordCache, first_rows, slices

DIMENSIONS = 1 << 20
SHARES = 9
TARGETS = ("quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8")) % DIMENSIONS


def text_view(text: str, slots: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the distinct lower-case words, and the shares."""
    raw = text.split()
    words = _WORD.findall(text.lower())
    distinct = set(words)
    found = np.fromiter({*map(slots.__getitem__, distinct)}, np.int32)
    n, w = max(1, len(text)), max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, raw))
    return found, np.array([
        np.log1p(len(raw)) / 10, 1 - letters / n, upper / w, len(set(raw)) / w if raw else 0.0,
        len(set(lines)) / max(1, len(lines)), letters / max(1, len(words)) / 10,
        sum(map(text.count, "0123456789")) / n, sum(map(text.count, "|#$%&*!?<>{}=")) / n, text.count("\n") / w,
    ])


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[str]:
    size = "" if n_chars is None else str(max(0, n_chars).bit_length())
    return [f"s={source}" if source is not None else "", f"l={lang}" if lang is not None else "", f"n={size}", f"l={lang},n={size}"]


@dataclass
class Rows:
    """Sparse rows: slots of row i stand at ends[i]..ends[i+1], dense columns beside them."""

    slots: np.ndarray
    ends: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, parts: list[np.ndarray], dense: np.ndarray) -> Rows:
        ends = np.cumsum([0, *map(len, parts)])
        return cls(np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64), ends, dense)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """L2-regularised logistic regression with classes of equal weight, by Adam on all rows.

    Dense columns are standardised. Of the ``size`` slots those stay that ``rarest`` rows
    hold at least and whose chi-square with the label is ``least`` or more."""

    size: int
    dense: int
    slots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    w: np.ndarray = field(default_factory=lambda: np.empty(0))
    v: np.ndarray = field(default_factory=lambda: np.empty(0))
    b: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.empty(0))
    width: np.ndarray = field(default_factory=lambda: np.empty(0))

    def _select(self, x: Rows, y: np.ndarray, rarest: int, least: float) -> np.ndarray:
        positive = y[x.row_of()] == 1
        a = np.bincount(x.slots[positive], minlength=self.size).astype(float)
        b = np.bincount(x.slots[~positive], minlength=self.size).astype(float)
        n, p = len(y), max(1.0, y.sum())
        q = max(1.0, n - y.sum())
        chi = n * (a * (q - b) - b * (p - a)) ** 2 / (np.maximum(1.0, (a + b) * (n - a - b)) * p * q)
        return np.flatnonzero((a + b >= rarest) & (chi >= least))

    def _placed(self, x: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the chosen slots, and their rows."""
        if not len(self.slots):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.slots, x.slots), len(self.slots) - 1)
        ok = self.slots[at] == x.slots
        return at[ok], x.row_of()[ok]

    def fit(self, x: Rows, y: np.ndarray, decay: float = 1e-4, steps: int = 200, rate: float = 0.05, rarest: int = 4, least: float = 10.8) -> Logistic:
        self.slots = self._select(x, y, rarest, least) if self.size else self.slots
        self.mean = x.dense.mean(axis=0) if self.dense else np.empty(0)
        self.width = x.dense.std(axis=0) + 1e-9 if self.dense else np.empty(0)
        at, row = self._placed(x)
        z_dense, n, k = self._scaled(x), len(y), len(self.slots)
        weight = np.where(y == 1, n / (2 * max(1, y.sum())), n / (2 * max(1, n - y.sum())))
        p = np.zeros(k + self.dense + 1)
        m, s = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            z = np.bincount(row, weights=p[at], minlength=n) + z_dense @ p[k:-1] + p[-1]
            d = (sigmoid(z) - y) * weight / n
            g = np.concatenate([np.bincount(at, weights=d[row], minlength=k), z_dense.T @ d, [d.sum()]])
            g[:-1] += decay * p[:-1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        self.w, self.v, self.b = p[:k], p[k:-1], float(p[-1])
        return self

    def _scaled(self, x: Rows) -> np.ndarray:
        return np.clip((x.dense - self.mean) / self.width, -4, 4) if self.dense else x.dense

    def logits(self, x: Rows) -> np.ndarray:
        at, row = self._placed(x)
        return np.bincount(row, weights=self.w[at], minlength=len(x.ends) - 1) + self._scaled(x) @ self.v + self.b


@dataclass
class Target:
    """One target's fitted views and how their log-odds are combined; constant if not learnable."""

    text: Logistic | None = None
    meta: Logistic | None = None
    scale: tuple[float, float, float, float] = (1.0, 0.0, 1.0, 0.0)
    mix: tuple[float, float, float] = (1.0, 0.0, 0.0)
    constant: float = 0.5

    def combine(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a, b, c, d = self.scale
        u, v, w = self.mix
        return sigmoid(u * (a * text + b) + v * (c * meta + d) + w)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model on log-odds."""
    model = Logistic(0, z.shape[1]).fit(Rows.of([np.empty(0, np.int64)] * len(z), z), y, decay=1e-3, steps=300)
    return model.v / model.width, model.b - float(model.mean @ (model.v / model.width))


def cotrain(
    text: list[Rows], meta: list[Rows], y: np.ndarray, meta_size: int, rounds: int = 3, share: float = 0.05, sure: float = 0.95,
) -> Target:
    """``text`` and ``meta`` hold the views of training, calibration and pool rows; ``y``
    the labels of the first two, in order. Training rows of one class give a constant;
    calibration rows of one class leave the views as they are, at equal weights."""
    n = len(text[0].ends) - 1
    y_train, y_check = y[:n], y[n:]
    if len(set(y_train)) < 2:
        return Target(constant=float(y.mean()) if len(y) else 0.5)
    size = (DIMENSIONS, meta_size)
    views = (text, meta)
    extra: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0)) for _ in views]
    fitted: list[Logistic] = []
    for turn in range(rounds + 1):
        fitted = []
        for view, rows in enumerate(views):
            ids, guess = extra[view]
            both = _stack(rows[0], _pick(rows[2], ids))
            fitted.append(Logistic(size[view], rows[0].dense.shape[1]).fit(both, np.concatenate([y_train, guess])))
        if turn == rounds:
            break
        for view in (0, 1):
            p = sigmoid(fitted[view].logits(views[view][2]))
            most = int(share * len(p) * (turn + 1))
            top, low = np.argsort(-p, kind="stable")[:most], np.argsort(p, kind="stable")[:most]
            top, low = top[p[top] >= sure], low[p[low] <= 1 - sure]
            extra[1 - view] = np.concatenate([top, low]), np.concatenate([np.ones(len(top)), np.zeros(len(low))])
    if len(set(y_check)) < 2:
        return Target(*fitted, mix=(0.5, 0.5, 0.0))
    logits = [f.logits(rows[1]) for f, rows in zip(fitted, views)]
    scale: list[float] = []
    for z in logits:
        v, b = _platt(z[:, None], y_check)
        scale += [float(v[0]), b]
    v, b = _platt(np.stack([scale[0] * logits[0] + scale[1], scale[2] * logits[1] + scale[3]], axis=1), y_check)
    return Target(*fitted, tuple(scale), (float(v[0]), float(v[1]), b))


def _pick(x: Rows, ids: np.ndarray) -> Rows:
    return Rows.of([x.slots[x.ends[i] : x.ends[i + 1]] for i in ids], x.dense[ids])


def _stack(a: Rows, b: Rows) -> Rows:
    return Rows(np.concatenate([a.slots, b.slots]), np.concatenate([a.ends, a.ends[-1] + b.ends[1:]]), np.concatenate([a.dense, b.dense]))


@dataclass
class Model:
    targets: dict[str, Target]
    meta_slots: dict[str, int]


def _columns(docs: DataFrame, key: str, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(n_chars).cast("long").alias("n_chars"))


def sample(rows: DataFrame, labels: DataFrame, per_class: int, pool: int) -> DataFrame:
    """The chosen documents with their labels (both null: of the pool); ids are chosen before
    texts are read, and of the rows that share an id the first by hash stands for all."""
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = rows.where("key IS NOT NULL").select("key").distinct().join(known, "key", "left")
    order = [F.xxhash64("key", F.lit(23)), F.col("key")]
    picked = [first_rows(part, ["quality", "toxic"], order, n) for part, n in (
        (ids.where("quality IS NOT NULL OR toxic IS NOT NULL"), per_class), (ids.where("quality IS NULL AND toxic IS NULL"), pool))]
    chosen = picked[0].unionByName(picked[1])
    met = rows.join(F.broadcast(chosen), "key")  # bounded by per_class and pool, but for repeated ids
    one = F.min_by(F.struct("text", "source", "lang", "n_chars", "quality", "toxic"), F.xxhash64("text", "source", "lang", "n_chars"))
    return met.groupBy("key").agg(one.alias("r")).select("key", "r.*")


def folds(rows: list, target: str) -> tuple[list[int], list[int], list[int]]:
    """Places of the training, calibration and pool rows of a target: of each class, in the
    order of hashed ids, the second row of every four is for calibration; rows without
    this label are of the pool."""
    train, check = [], []
    for label in (0, 1):
        own = [i for i, r in enumerate(rows) if r[target] == label]
        own.sort(key=lambda i: (zlib.crc32(f"fold{rows[i]['key']}".encode()), rows[i]["key"]))
        for n, i in enumerate(own):
            (check if n % 4 == 1 else train).append(i)
    return sorted(train), sorted(check), [i for i, r in enumerate(rows) if r[target] is None]


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = 1000, pool: int = 2000, key: str = "doc_id", text: str = "text",
    source: str = "source", lang: str = "lang", n_chars: str = "n_chars", rounds: int = 3,
) -> Model:
    """Both targets' models, fitted on the driver to at most 8 x ``per_class`` + ``pool`` documents."""
    chosen = sample(_columns(docs, key, text, source, lang, n_chars), labels, per_class, pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = WordCache(_slot)
        for batch in batches:
            for part in slices(batch):
                views = [text_view(x, slots) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("key", "source", "lang", "n_chars", "quality", "toxic")]
                    + [pa.array([v[0].tobytes() for v in views], pa.binary()), pa.array([v[1].tobytes() for v in views], pa.binary())],
                    ["key", "source", "lang", "n_chars", "quality", "toxic", "slots", "shares"])

    schema = "key long, source string, lang string, n_chars long, quality int, toxic int, slots binary, shares binary"
    named = chosen.select("key", "text", "source", "lang", "n_chars", "quality", "toxic")
    got = sorted(named.mapInArrow(run, schema).collect(), key=lambda r: (r["key"], bytes(r["shares"])))  # bounded by the sample
    names = sorted({x for r in got for x in meta_view(r["source"], r["lang"], r["n_chars"]) if x})
    at = {x: i for i, x in enumerate(names)}
    dense = np.array([np.frombuffer(r["shares"]) for r in got]).reshape(-1, SHARES)
    text_rows = Rows.of([np.frombuffer(r["slots"], np.int32) for r in got], dense)
    meta_rows = Rows.of([np.array([at[x] for x in meta_view(r["source"], r["lang"], r["n_chars"]) if x], np.int64) for r in got], np.empty((len(got), 0)))
    targets = {}
    for target in TARGETS:
        parts = folds(got, target)
        y = np.array([float(got[i][target]) for part in parts[:2] for i in part])
        views = [[_pick(rows, np.array(part, np.int64)) for part in parts] for rows in (text_rows, meta_rows)]
        targets[target] = cotrain(*views, y, len(names), rounds)
    return Model(targets, at)


def score(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
    least_quality: float = 0.5, most_toxic: float = 0.5,
) -> DataFrame:
    """doc_id, quality_score, toxic_score and keep of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, at = WordCache(_slot), model.meta_slots
        for batch in batches:
            for part in slices(batch):
                views = [text_view(x, slots) for x in part.column("text").to_pylist()]
                text_rows = Rows.of([v[0] for v in views], np.array([v[1] for v in views]).reshape(-1, SHARES))
                meta = zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
                meta_rows = Rows.of([np.array([at[x] for x in meta_view(*m) if x in at], np.int64) for m in meta], np.empty((len(views), 0)))
                out = [part.column("key")]
                for name in TARGETS:
                    t = model.targets[name]
                    p = np.full(len(views), t.constant) if t.text is None else t.combine(t.text.logits(text_rows), t.meta.logits(meta_rows))
                    out.append(pa.array(p, pa.float64()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "quality_score", "toxic_score"])

    rows = _columns(docs, key, text, source, lang, n_chars)
    scored = rows.mapInArrow(run, "doc_id long, quality_score double, toxic_score double")
    return scored.withColumn("keep", (F.col("quality_score") >= least_quality) & (F.col("toxic_score") < most_toxic))
