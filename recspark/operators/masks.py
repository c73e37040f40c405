"""Allowed items of a block as bitsets per constraint profile.

A block keeps one bitset per genre and its years. A profile's allowed items are an AND
of its required genres, an AND NOT of its excluded ones and two comparisons of years,
computed once per (profile, block), however many users hold the profile. So no table of
profiles x items or users x items is ever written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: What a user row carries for its profile, in the order of ``BlockMasks.allowed``.
CONSTRAINTS = ("required_genres", "excluded_genres", "year_min", "year_max")


def names(column: str) -> Column:
    """A genre list as a sorted set; a null list asks for nothing."""
    return F.array_sort(F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>"))))


def with_constraints(users: DataFrame, states: DataFrame | None) -> DataFrame:
    """``users`` with the columns of ``CONSTRAINTS`` and ``bound``; a user without a state is not bound."""
    kinds = ("array<string>", "array<string>", "int", "int")
    if states is None:
        free = [F.lit(None).cast(k).alias(c) for c, k in zip(CONSTRAINTS, kinds)]
        return users.select("*", *free, F.lit(False).alias("bound"))
    own = states.select("user_id", names("required_genres").alias("required_genres"), names("excluded_genres").alias("excluded_genres"),
                        F.col("year_min").cast("int").alias("year_min"), F.col("year_max").cast("int").alias("year_max"), F.lit(True).alias("bound"))
    return users.join(own, "user_id", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))


class BlockMasks:
    """Bitsets of one item block: ``genres`` is a list or None per item, ``years`` has NaN for none."""

    def __init__(self, genres: list[list[str] | None], years: np.ndarray) -> None:
        self.size, self.years = len(genres), years
        self.known = self._packed([i for i, g in enumerate(genres) if g is not None])
        places: dict[str, list[int]] = {}
        for i, own in enumerate(genres):
            for g in own or ():
                places.setdefault(g, []).append(i)
        self.of = {g: self._packed(at) for g, at in places.items()}
        self.memo: dict[tuple, np.ndarray] = {}

    def _packed(self, at: list[int]) -> np.ndarray:
        bits = np.zeros(self.size, bool)
        bits[at] = True
        return np.packbits(bits)

    def allowed(self, required: tuple, excluded: tuple, low: int | None, high: int | None) -> np.ndarray:
        """One boolean per item. An unknown year fails an active bound, and items without
        a genre list fail always."""
        key = (required, excluded, low, high)
        if key not in self.memo:
            nothing = np.zeros_like(self.known)
            bits = self.known.copy()
            for g in required:
                bits &= self.of.get(g, nothing)
            for g in excluded:
                bits &= ~self.of.get(g, nothing)
            keep = np.unpackbits(bits, count=self.size).astype(bool)
            if low is not None:
                keep &= self.years >= low
            if high is not None:
                keep &= self.years <= high
            self.memo[key] = np.packbits(keep)
        return np.unpackbits(self.memo[key], count=self.size).astype(bool)


def rows_allowed(masks: BlockMasks, profiles: list[tuple | None]) -> np.ndarray | None:
    """A boolean row per user; None if no user is bound. ``profiles`` has None for a free user."""
    if all(p is None for p in profiles):
        return None
    out = np.ones((len(profiles), masks.size), bool)
    for i, p in enumerate(profiles):
        if p is not None:
            out[i] = masks.allowed(*p)
    return out


def profiles_of(columns: dict[str, list]) -> list[tuple | None]:
    """Profiles of the user rows of a block, from the lists of their columns."""
    rows = zip(columns["bound"], *(columns[c] for c in CONSTRAINTS))
    return [(tuple(required), tuple(excluded), low, high) if bound else None for bound, required, excluded, low, high in rows]
