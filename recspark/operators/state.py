"""Preference state: from history, and folded from ordered patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ID_FIELDS = ("liked_ids", "disliked_ids", "excluded_ids")
HARD_GENRES = ("required_genres", "excluded_genres")
SOFT_GENRES = ("liked_genres", "disliked_genres")
SCALARS = ("year_min", "year_max", "requested_count", "ranking_mode")
# fixed values: defaults and limits of a preference state
DEFAULT_COUNT, MAX_COUNT, DEFAULT_MODE = 10, 100, "balanced"
TURN_RANGE = 4096  # turns of a session that one window task orders


def genre_counts(hist: DataFrame, items: DataFrame) -> DataFrame:
    """How often each genre occurs in the given history rows, per user."""
    genres = items.select("item_id", "genres")
    exploded = hist.select("user_id", "item_id").join(genres, "item_id").select("user_id", F.explode("genres").alias("genre"))
    return exploded.groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"))


def favorite_genres(hist: DataFrame, items: DataFrame) -> DataFrame:
    """Genres ranked by count DESC, name ASC; duplicate history rows count."""
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("genre").asc())
    return genre_counts(hist, items).withColumn("rank", F.row_number().over(w))


def state_from_history(hist: DataFrame, items: DataFrame, n_genres: int = 3) -> DataFrame:
    """``user_id, liked_genres, liked_count``: top genres over distinct liked items.

    Ties are broken by genre name. Liked ids stay in the history table; an
    unbounded id array per user would not survive a heavy user.
    """
    distinct = hist.select("user_id", "item_id").distinct()
    top = favorite_genres(distinct, items).filter(F.col("rank") <= n_genres)
    genres = top.groupBy("user_id").agg(F.array_sort(F.collect_set("genre")).alias("liked_genres"))
    sizes = distinct.join(items.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("liked_count")
    )
    return sizes.join(genres, "user_id", "left").select(
        "user_id", F.coalesce("liked_genres", F.array().cast("array<string>")).alias("liked_genres"), "liked_count"
    )


def _tagged(field: str) -> F.Column:
    """The values of one set column as (field, value) structs."""
    return F.transform(F.col(field), lambda v: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value")))


def fold_preferences(patches: DataFrame, key: str = "session_id", order: str = "turn") -> DataFrame:
    """Final state per session as a long table ``(key, field, value)``.

    Id sets and hard genres only grow. Soft genres keep the values since the
    last ``replace_soft`` patch, that patch included. A scalar keeps its last
    non-null value. Everything is a partial aggregate: no session is gathered
    into one array, however many turns it has.
    """
    last = patches.groupBy(key).agg(
        F.max(F.when(F.col("replace_soft"), F.col(order))).alias("since"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in SCALARS],
    )
    checked = last.join(_broken(patches, key, order), key, "left").filter(
        F.when(F.col("broken_years"), F.raise_error(F.lit("a patch leaves year_min above year_max")))
        .when(F.col("broken_count"), F.raise_error(F.lit(f"requested_count must be 1 to {MAX_COUNT}")))
        .otherwise(F.lit(True))
    )
    current = F.col("since").isNull() | (F.col(order) >= F.col("since"))
    nothing = F.filter(_tagged(SOFT_GENRES[0]), lambda _: F.lit(False))
    lasting = [_tagged(f) for f in (*ID_FIELDS, *HARD_GENRES)]
    soft = [F.when(current, _tagged(f)).otherwise(nothing) for f in SOFT_GENRES]
    sets = (
        patches.join(last.select(key, "since"), key)
        .select(key, F.explode(F.concat(*lasting, *soft)).alias("v"))
        .select(key, "v.field", "v.value")
    )
    defaults = {"requested_count": F.lit(DEFAULT_COUNT), "ranking_mode": F.lit(DEFAULT_MODE)}
    scalar_map = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.coalesce(F.col(c).cast("string"), defaults[c].cast("string") if c in defaults else F.lit(None)).alias("value"),
            )
            for c in SCALARS
        ]
    )
    scalars = checked.select(key, F.explode(scalar_map).alias("s")).select(key, "s.field", "s.value").filter("value IS NOT NULL")
    return sets.distinct().unionByName(scalars)


def _broken(patches: DataFrame, key: str, order: str) -> DataFrame:
    """Per session: does the state after any patch break the year range or the count.

    Only patches that set a year are ranked, within ranges of ``TURN_RANGE`` turns; each
    range starts from the last years of the ranges before it, so a session of any
    length is spread over as many tasks as it has ranges. ``order`` is a number."""
    dated = patches.filter("year_min IS NOT NULL OR year_max IS NOT NULL").select(
        key, F.col(order).alias("__turn"), F.floor(F.col(order) / TURN_RANGE).alias("__range"), "year_min", "year_max")
    years = ("year_min", "year_max")
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = dated.groupBy(key, "__range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__turn"))).alias(c) for c in years])
    starts = ends.select(key, "__range", *[F.last(c, True).over(before).alias(f"__{c}") for c in years])
    so_far = Window.partitionBy(key, "__range").orderBy("__turn")
    low, high = (F.coalesce(F.last(c, True).over(so_far), F.col(f"__{c}")) for c in years)
    judged = dated.join(starts, [key, "__range"]).select(key, (low > high).alias("bad"))
    years = judged.groupBy(key).agg(F.bool_or("bad").alias("broken_years"))
    counts = patches.groupBy(key).agg(F.bool_or(~F.col("requested_count").between(1, MAX_COUNT)).alias("broken_count"))
    return counts.join(years, key, "left")


def stateless_preferences(patches: DataFrame, key: str = "session_id", order: str = "turn") -> DataFrame:
    """Each turn applied to an empty state: ``(key, turn, field, value)``."""
    single = patches.withColumn("__turn_key", F.struct(key, order))
    folded = fold_preferences(single, "__turn_key", order)
    return folded.select(F.col(f"__turn_key.{key}").alias(key), F.col(f"__turn_key.{order}").alias(order), "field", "value")
