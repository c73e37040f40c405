"""Text, JSON and parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

STATE_FIELDS = T.StructType(
    [
        T.StructField("liked_ids", T.ArrayType(T.LongType())),
        T.StructField("disliked_ids", T.ArrayType(T.LongType())),
        T.StructField("excluded_ids", T.ArrayType(T.LongType())),
        T.StructField("liked_genres", T.ArrayType(T.StringType())),
        T.StructField("disliked_genres", T.ArrayType(T.StringType())),
        T.StructField("required_genres", T.ArrayType(T.StringType())),
        T.StructField("excluded_genres", T.ArrayType(T.StringType())),
        T.StructField("year_min", T.IntegerType()),
        T.StructField("year_max", T.IntegerType()),
        T.StructField("requested_count", T.IntegerType()),
        T.StructField("ranking_mode", T.StringType()),
    ]
)

CASE_SCHEMA = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("turns", T.ArrayType(T.StringType())),
        T.StructField("relevant_ids", T.ArrayType(T.LongType())),
        T.StructField("initial_state", STATE_FIELDS),
        T.StructField("expected_preferences", STATE_FIELDS),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

# fixed values: other names of these fields in case files
OTHER_NAMES = {
    "relevant_ids": "relevant_movie_ids",
    "liked_ids": "liked_movie_ids",
    "disliked_ids": "disliked_movie_ids",
    "excluded_ids": "excluded_movie_ids",
}


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Catalog lines ``id::title (year)::genre|genre`` in latin-1; blank lines are skipped."""
    schema = "item_id BIGINT, title STRING, genre_text STRING"
    raw = (
        spark.read.schema(schema)
        .option("sep", "::")
        .option("encoding", "ISO-8859-1")
        .option("quote", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    year = F.nullif(F.regexp_extract("title", r"\((\d{4})\)\s*$", 1), F.lit("")).cast("int")
    genres = F.split("genre_text", r"\|")
    return with_text(raw.select("item_id", "title", genres.alias("genres"), year.alias("year")))


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Rating lines ``user::item::rating::epoch``; a malformed line fails the read."""
    return (
        spark.read.schema("user_id BIGINT, item_id BIGINT, rating INT, ts BIGINT")
        .option("sep", "::")
        .option("encoding", "ISO-8859-1")
        .option("quote", "")
        .option("mode", "FAILFAST")
        .csv(path)
        .withColumn("row_key", F.struct("rating"))
    )


def with_text(items: DataFrame) -> DataFrame:
    """Add ``text``: the title followed by the genre names."""
    return items.withColumn("text", F.concat_ws(" ", "title", F.array_join("genres", " ")))


def _with_other_names(kind: T.StructType) -> T.StructType:
    fields = []
    for f in kind.fields:
        own = _with_other_names(f.dataType) if isinstance(f.dataType, T.StructType) else f.dataType
        fields += [T.StructField(n, own) for n in (f.name, OTHER_NAMES.get(f.name)) if n]
    return T.StructType(fields)


def _own_names(kind: T.StructType, at: str = "") -> list[Column]:
    """The fields of ``kind``, each from whichever of its names is filled; a null struct stays null."""
    out = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            value = F.when(F.col(at + f.name).isNotNull(), F.struct(*_own_names(f.dataType, f"{at}{f.name}.")))
        else:
            value = F.coalesce(*[F.col(at + n) for n in (f.name, OTHER_NAMES.get(f.name)) if n])
        out.append(value.alias(f.name))
    return out


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Evaluation cases: a file is one JSON array over many lines or, with ``lines``, a case a line.

    Fields go by the names of ``CASE_SCHEMA`` or those of ``OTHER_NAMES``; a file that
    isn't JSON fails the read. Arrays are read whole by one task each, so large sets
    belong in lines, which Spark splits."""
    raw = spark.read.schema(_with_other_names(CASE_SCHEMA)).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return raw.select(*_own_names(CASE_SCHEMA))


def write_cases(cases: DataFrame, path: str) -> None:
    """A case a line; an existing target is refused."""
    cases.select(*CASE_SCHEMA.fieldNames()).write.mode("errorifexists").json(path)


def write_episodes(episodes: DataFrame, path: str) -> None:
    """Nested episode records as JSON lines; an existing target is refused."""
    episodes.write.mode("errorifexists").json(path)


def write_user_metrics(metrics: DataFrame, path: str) -> None:
    """Per-user evidence rows, one folder per cohort and method; never overwritten."""
    metrics.write.mode("errorifexists").partitionBy("cohort", "method").parquet(path)


def write_vectors(vectors: DataFrame, path: str, **params: object) -> None:
    """Embedding or factor table together with the one-row table of its fit parameters.

    Parameters keep their types: booleans, whole numbers, doubles, strings and lists of them."""
    vectors.write.mode("errorifexists").parquet(f"{path}/vectors")
    names = sorted(params)
    one = vectors.sparkSession.range(1)
    cells = [F.lit(params[n]).alias(n) if not isinstance(params[n], int) or isinstance(params[n], bool)
             else F.lit(params[n]).cast("bigint").alias(n) for n in names]
    one.select(*(cells or [F.lit("").alias("params")])).write.parquet(f"{path}/params")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/params")
