"""Language identification by a byte convolutional network (operator 3).

Texts are cut into fixed windows of bytes. Embedded bytes pass through filters of
several widths; the largest response of each filter over the window, rectified, feeds
a softmax. The network is trained with numpy on a bounded sample of labelled texts:
at most ``per_label`` documents of each language, chosen by hash, and at most
``windows`` windows of each. Prediction reads every window of the whole text in
batches and takes the mean of the windows' probabilities, weighted by their bytes.
Weights (a few thousand numbers) travel with the task; prediction needs no shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties
go to the smaller label; with nothing to learn from every row is ``und``; null or
repeated ids are each listed (a null id is not held out and never learned from);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import first_rows, map_text

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4, 5), 12, 8
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def windows_of(raw: bytes, length: int = WINDOW) -> np.ndarray:
    """The windows of a text, each overlapping the one before by a filter's width less one."""
    step = length - (max(WIDTHS) - 1)
    n = max(1, -(-(len(raw) - (max(WIDTHS) - 1)) // step))
    data = np.zeros((n - 1) * step + length, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, length)[::step]


class ByteCnn:
    def __init__(self, labels: list[str], seed: int = 11) -> None:
        self.labels = labels
        rng = np.random.default_rng(seed)
        k = FILTERS * len(WIDTHS)
        self.embed = (rng.standard_normal((256, EMBED)) * 0.3).astype(np.float32)
        self.embed[0] = 0
        self.conv = (rng.standard_normal((max(WIDTHS) * EMBED, k)) * 0.2).astype(np.float32)
        #: A filter narrower than the widest has zeros beyond its own width.
        self.shape = np.zeros_like(self.conv)
        for i, w in enumerate(WIDTHS):
            self.shape[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.conv *= self.shape
        self.bias = np.zeros(k, np.float32)
        self.out = (rng.standard_normal((k, len(labels))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """[windows, positions, widest width * EMBED]"""
        e = self.embed[x].reshape(len(x), -1)
        view = np.lib.stride_tricks.sliding_window_view(e, max(WIDTHS) * EMBED, axis=1)[:, ::EMBED]
        return view

    def features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = np.ascontiguousarray(self._columns(x))
        b, p, w = cols.shape
        response = (cols.reshape(-1, w) @ self.conv).reshape(b, p, -1)
        best = response.argmax(axis=1) if self.training else None
        top = response.max(axis=1) + self.bias
        return np.maximum(top, 0), best, cols

    training = False

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.concatenate([self.features(x[i : i + 64])[0] for i in range(0, len(x), 64)])
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 5) -> None:
        """Adam on the cross-entropy, classes weighted to equal sums."""
        rng = np.random.default_rng(seed)
        weight = (len(y) / (len(self.labels) * np.maximum(np.bincount(y, minlength=len(self.labels)), 1))).astype(np.float32)
        names = ("embed", "conv", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        self.training, step = True, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                grads = self._gradients(x[part], y[part], weight)
                step += 1
                for k in names:
                    m[k] += 0.1 * (grads[k] - m[k])
                    v[k] += 0.001 * (grads[k] ** 2 - v[k])
                    getattr(self, k)[...] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                self.embed[0] = 0
        self.training = False

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        hidden, best, cols = self.features(x)
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= (weight[y] / len(y))[:, None]
        dh = (d @ self.out.T) * (hidden > 0)
        b, k = dh.shape
        picked = cols[np.arange(b)[:, None], best]  # [b, k, width * EMBED]
        d_conv = np.einsum("bk,bkw->wk", dh, picked) * self.shape
        d_cols = (dh[:, :, None] * self.conv.T[None]).reshape(b * k, max(WIDTHS), EMBED)
        at = best.reshape(-1)[:, None] + np.arange(max(WIDTHS))
        letters = x[np.repeat(np.arange(b), k)[:, None], at]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, letters.ravel(), d_cols.reshape(-1, EMBED))
        return {"embed": d_embed, "conv": d_conv, "bias": dh.sum(axis=0), "out": hidden.T @ d, "out_bias": d.sum(axis=0)}


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, per_label: int, key: str, text: str, lang: str) -> DataFrame:
    """At most ``per_label`` learnable documents of each language, the smallest by hash.

    The choice is made on ids alone; texts are read for the chosen ids only, and of the
    rows that share an id and a language the one of the smallest text hash stands for all."""
    ids = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(
        F.col(key).alias("id"), F.col(lang).alias("label")).distinct()
    chosen = first_rows(ids, ["label"], [F.xxhash64("id", F.lit(17)), F.col("id")], per_label)
    whole = docs.select(F.col(key).alias("id"), F.col(lang).alias("label"), F.col(text).alias("text"))
    return whole.where(F.col("text").isNotNull()).join(F.broadcast(chosen), ["id", "label"]).groupBy("id", "label").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))


def train(
    docs: DataFrame, per_label: int = 300, windows: int = 4, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 5,
) -> ByteCnn | None:
    """A network fitted on the driver to at most ``per_label`` x ``windows`` windows a language."""
    rng = np.random.default_rng(seed)

    def rows(keys: list, texts: list[str]) -> list[pa.Array]:
        picked = []
        for k, x in zip(keys, texts):
            every = windows_of(x.encode("utf-8"))
            at = np.random.default_rng(k & 0x7FFFFFFF).permutation(len(every))[:windows]
            picked.append([every[i].tobytes() for i in at])
        return [pa.array(keys, pa.int64()), pa.array(picked, pa.list_(pa.binary()))]

    chosen = training_rows(docs, per_label, key, text, lang)
    hashed = chosen.select(F.xxhash64("id", "label").alias("h"), "text", "label")
    cut = map_text(hashed, "key long, windows array<binary>", rows, "h", "text")
    got = hashed.select("h", "label").distinct().join(cut.withColumnRenamed("key", "h"), "h").orderBy("h").collect()  # bounded by per_label
    labels = sorted({r["label"] for r in got})
    if not labels:
        return None
    at = {label: i for i, label in enumerate(labels)}
    x = np.array([np.frombuffer(w, np.uint8) for r in got for w in r["windows"]])
    y = np.array([at[r["label"]] for r in got for _ in r["windows"]])
    order = rng.permutation(len(y))
    model = ByteCnn(labels)
    model.fit(x[order], y[order])
    return model


def classify(model: ByteCnn | None, texts: list[str | None], group: int = 512) -> tuple[list[str], list[float]]:
    """Label and score of each text; windows of several texts go through the network together."""
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    pending: list[tuple[int, np.ndarray, int]] = []

    def flush() -> None:
        p = model.probabilities(np.concatenate([x for _, x, _ in pending]))
        lo = 0
        for i, x, size in pending:
            weight = np.full(len(x), float(WINDOW))
            weight[-1] = max(1, size - (len(x) - 1) * (WINDOW - max(WIDTHS) + 1))
            total = weight @ p[lo : lo + len(x)] / weight.sum()
            lo += len(x)
            best = int(np.argmax(total))
            labels[i], scores[i] = model.labels[best], float(min(1.0, total[best]))

    held = 0
    for i, text in enumerate(texts):
        if model is None or not text or not _LETTER.search(text):
            continue
        raw = text.encode("utf-8")
        x = windows_of(raw)
        pending.append((i, x, len(raw)))
        held += len(x)
        if held >= group:
            flush()
            pending, held = [], 0
    if pending:
        flush()
    return labels, scores


def predict(docs: DataFrame, model: ByteCnn | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone."""

    def rows(keys: list, texts: list[str]) -> list[pa.Array]:
        labels, scores = classify(model, texts)
        return [pa.array(keys, pa.int64()), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]

    return map_text(docs, "key long, lang_pred string, score double", rows, key, text).withColumnRenamed("key", "doc_id")


def annotate(docs: DataFrame, model: ByteCnn | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score beside its columns."""

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def guess(x: pd.Series) -> pd.DataFrame:
        labels, scores = classify(model, [None if pd.isna(t) else t for t in x])
        return pd.DataFrame({"lang_pred": labels, "score": scores})

    # Not deterministic to the optimizer, or a filter on the guess would make it twice.
    return docs.withColumn("_guess", guess.asNondeterministic()(F.col(text))).select("*", "_guess.lang_pred", "_guess.score").drop("_guess")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **training) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = train(docs, key=key, text=text, lang=lang, **training)
    return predict(docs, model, key, text).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
