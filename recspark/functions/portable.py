"""Scalar building blocks with the same value in Spark and in ANSI SQL."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, functions as F

SCORE_DIGITS = 9


def draw(*parts: Column | int | str) -> Column:
    """Deterministic 32-bit draw from integer or string key parts.

    Depends on the key only, never on partitioning or execution order.
    """
    keys = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draws_of(ids: np.ndarray, *before: int | str, after: tuple = ()) -> np.ndarray:
    """``draw(*before, id, *after)`` of each id, inside a task."""
    head, tail = "".join(f"{p}|" for p in before).encode(), "".join(f"|{p}" for p in after).encode()
    cells = [md5(b"%b%d%b" % (head, i, tail)).digest()[:4] for i in ids.tolist()]
    return np.frombuffer(b"".join(cells), ">u4").astype(np.int64)


def order_score(score: Column | str) -> Column:
    """Score as used for ordering: float sums differ in the last bits, ties must not."""
    return F.round(F.col(score) if isinstance(score, str) else score, SCORE_DIGITS)


def epoch_seconds(df, column: str) -> Column:
    """Epoch seconds of a timestamp column, with or without time zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})").cast("bigint")
    return F.unix_seconds(F.col(column)).cast("bigint")


def bounded_collect(df, limit: int, what: str) -> list:
    """Collect a result whose size is fixed by arguments, and prove that it is."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; this step is for bounded results only")
    return rows
