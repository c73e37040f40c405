"""Finite, shape and alignment checks: violations come back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def not_finite(value: Column) -> Column:
    number = value.cast("double")
    return number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))


def check_finite(df: DataFrame, keys: list[str], columns: list[str], strict: bool = False) -> DataFrame:
    """One row per non-finite cell with its keys; ``strict`` raises inside the job instead."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    bad = F.filter(cells, lambda cell: not_finite(cell["value"]))
    if strict:
        context = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
        message = F.concat(F.lit("value must be finite: "), context, F.lit(", feature="), F.element_at(bad, 1)["feature"])
        return df.filter(F.when(F.size(bad) > 0, F.raise_error(message)).otherwise(F.lit(True)))
    return df.select(*keys, F.explode(bad).alias("cell")).select(*keys, "cell.feature", F.col("cell.value").cast("string").alias("value"))


def check_vectors(df: DataFrame, key: str, vector: str, dimension: int, unit: bool = False, tolerance: float = 1e-5) -> DataFrame:
    """Vectors with a wrong dimension, a non-finite entry, zero norm, or (``unit``) a norm off one."""
    values = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))
    broken = F.exists(values, not_finite)
    reason = (
        F.when(F.col(vector).isNull() | (F.size(vector) != dimension), F.lit("dimension"))
        .when(broken, F.lit("not finite"))
        .when(norm == 0, F.lit("zero norm"))
    )
    if unit:
        reason = reason.when(F.abs(norm - 1) > tolerance, F.lit("not normalized"))
    return df.select(key, reason.alias("reason")).filter("reason IS NOT NULL")


def check_user_alignment(
    metrics: DataFrame, cohort: DataFrame, numeric: list[str], flag: str = "constraint_satisfied"
) -> DataFrame:
    """Evidence rows against the cohort: duplicate, missing and extra users, invalid cells."""
    invalid = F.lit(False)
    for c in numeric:
        invalid = invalid | not_finite(F.col(c))
    if flag in metrics.columns:
        invalid = invalid | F.col(flag).isNull()
    have = metrics.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(invalid).alias("invalid")
    )
    want = cohort.select("user_id").distinct().withColumn("expected", F.lit(True))
    both = have.join(want, "user_id", "full_outer")
    problems = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, F.lit("duplicate")),
            F.when(F.col("n").isNull(), F.lit("missing")),
            F.when(F.col("expected").isNull(), F.lit("extra")),
            F.when(F.col("invalid"), F.lit("invalid")),
        )
    )
    return both.select("user_id", F.explode(problems).alias("problem"))
