"""Adapters from the star-schema test tables to the recommender tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recspark.functions.ordering import numbered
from recspark.functions.portable import epoch_seconds
from recspark.sources.files import with_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, item_id, rating 1..5, ts, row_key``; ``row_key`` orders duplicate rows."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    orders = table(spark, sf_dir, "orders")
    orders = orders.select("o_orderkey", "o_custkey", epoch_seconds(orders, "o_orderdate").alias("ts"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.least(F.lit(5), F.ceil(F.col("l_quantity") / 10)).cast("int").alias("rating"),
        "ts",
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("row_key"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return with_text(
        part.select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("title"),
            F.array("p_type", "p_brand").alias("genres"),
            F.when(F.col("p_size") % 10 != 0, F.col("p_size") + 1950).cast("int").alias("year"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def constraint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard constraints per user, by market segment."""
    seg = F.col("c_mktsegment")

    def names(when: dict[str, str]):
        empty = F.array().cast("array<string>")
        expr = empty
        for segment, genre in when.items():
            expr = F.when(seg == segment, F.array(F.lit(genre))).otherwise(expr)
        return expr

    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        names({"FURNITURE": "STANDARD"}).alias("required_genres"),
        names({"HOUSEHOLD": "PROMO", "MACHINERY": "SMALL"}).alias("excluded_genres"),
        F.when(seg == "BUILDING", 1960).cast("int").alias("year_min"),
        F.when(seg == "AUTOMOBILE", 1990).cast("int").alias("year_max"),
    )


def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded catalog: item ``i`` takes vector ``i % N``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    return (
        items(spark, sf_dir)
        .select("item_id", (F.col("item_id") % n).alias("vec_id"))
        .join(vectors, "vec_id")
        .select("item_id", "embedding")
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference patch per event; ``turn`` numbers a session's events in time order."""
    events = table(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k").cast("bigint")
    genre = items(spark, sf_dir).select(F.col("item_id").alias("k"), F.element_at("genres", 1).alias("g"))
    base = events.select(
        F.col("user_id").alias("session_id"), F.col("ts").alias("event_time"), "event_id", "event_type", key.alias("k"),
        F.floor(epoch_seconds(events, "ts") / 3600).alias("hour"),
    )
    order = [F.col("event_time"), F.col("event_id")]
    turns = numbered(base, order, [("hour", False)], ("session_id",), "turn")
    return patch_columns(turns.join(genre, "k", "left"))


def patch_columns(base: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    ids = F.array().cast("array<bigint>")
    names = F.array().cast("array<string>")
    has_genre = F.col("g").isNotNull()
    return base.select(
        "session_id",
        F.col("turn").cast("int").alias("turn"),
        "event_time",
        (kind == "signup").alias("replace_soft"),
        F.when(kind.isin("click", "purchase"), F.array("k")).otherwise(ids).alias("liked_ids"),
        ids.alias("disliked_ids"),
        F.when(kind == "error", F.array("k")).otherwise(ids).alias("excluded_ids"),
        F.when(kind.isin("view", "purchase", "signup") & has_genre, F.array("g")).otherwise(names).alias("liked_genres"),
        F.when((kind == "error") & has_genre, F.array("g")).otherwise(names).alias("disliked_genres"),
        names.alias("required_genres"),
        names.alias("excluded_genres"),
        F.when(kind == "signup", 1950 + F.col("k") % 20).cast("int").alias("year_min"),
        F.lit(None).cast("int").alias("year_max"),
        F.lit(None).cast("int").alias("requested_count"),
        F.lit(None).cast("string").alias("ranking_mode"),
    )
