"""Mixing sources to target weights by entropy balancing (operator 11).

A source's weight gives it a target of words. Each document gets a rate: of all rates
between 0 and ``most`` that meet the source's target, those with the least relative
entropy to a rate of 1 are ``min(most, exp(tilt * size / mean size))``. The tilt is the
source's dual variable. All sources are solved at once by safeguarded Newton steps on
the logarithm of the dual's gradient equation: a step is one aggregate over the
histogram of (source, size), whose terms are summed as decimals, so the order of rows
never shows in a tilt. A step outside the bracket known so far is replaced by a
bisection, because the cap puts kinks into the gradient.

Rates become copies group by group of equal (source, size): a group takes its rate
times its rows, rounded, and what the rounding leaves over in words is carried to the
source's next smaller size. So a source ends within about half of its smallest document
of its target. Inside a group the order of hashed ids says who gets the odd copy.

Nothing of a source's size meets in one task: a source has at most sqrt(2 * words)
sizes, groups of over ``hot`` rows are dealt to salts, and the carry streams through
the sorted histogram. The driver sees one pair of numbers a round and one count a task.

Defined results: a null text has size 0; documents of size 0 are never taken; the null
source is a source of its own and the last; a source without words has target 0; rows
that share an id are each listed and ranked; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.llm.components import discard, stored

WEIGHTS = (5, 2, 1)
#: White space that parts words.
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size in words) of every row; ``origin`` is the source, never null."""
    name = F.col(source).cast("string")
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), name.alias("source"),
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("origin"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def weighted_sources(histogram: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(origin, source_size, documents, weight): weights repeat in the order of the sources.

    Rows are numbered inside the parts of a range sort; only the parts' counts reach
    the driver."""
    totals = histogram.groupBy("origin", "source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("documents"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ordered, _ = stored(ordered, "sources")
    part = F.shiftright("at", 33).cast("int")
    counts = {r[0]: r[1] for r in ordered.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    place = F.element_at(F.array(*[F.lit(b).cast("long") for b in before] or [F.lit(0).cast("long")]), part + 1) \
        + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ordered.select(
        "origin", "source_size", "documents", F.element_at(cycle, (place % len(weights) + 1).cast("int")).alias("weight"))


def water_level(sources: DataFrame, share: float, most: float) -> float:
    """The level at which ``least(most * size, level * weight)`` adds up to ``share`` of all
    sizes: what a full source can't take goes to the others by weight, until none is over."""
    full = F.col("source_size") * most
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while total:
        over = full <= F.col("weight") * level
        held, open_ = sources.agg(F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("weight")))).first()
        if not open_:
            break
        higher = (share * total - (held or 0.0)) / open_
        if higher <= level:
            break
        level = higher
    return level


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    level = water_level(sources, share, most)
    return sources.withColumn("target", F.least(F.col("source_size") * most, F.col("weight") * level))


def rate(tilt: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(tilt * size / mean))


def tilts(histogram: DataFrame, wanted: DataFrame, most: float = 2.0, within: float = 1e-10, rounds: int = 200) -> DataFrame:
    """(origin, tilt, mean) of every source; full sources have an infinite tilt.

    Raises if a source doesn't settle in ``rounds`` rounds."""
    spark = histogram.sparkSession
    inf, full = F.lit(float("inf")), F.col("target") >= F.col("source_size") * most
    state, path = stored(wanted.select(
        "origin", "target", F.when(F.col("source_size") > 0, F.col("source_size") / F.col("documents")).otherwise(F.lit(1.0)).alias("mean"),
        F.when(full & (F.col("source_size") > 0), inf).otherwise(F.lit(0.0)).alias("tilt"),
        (-inf).alias("low"), inf.alias("high"), (full | (F.col("source_size") == 0)).alias("done"),
    ), "tilts")
    words, z = F.col("size") * F.col("rows"), F.col("size") / F.col("mean")
    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            return state.select("origin", "tilt", "mean")
        grown = F.col("tilt") * z
        at = F.when(grown < math.log(most), F.exp(grown))
        sums = histogram.where("size > 0").join(state.where("not done"), "origin").groupBy("origin").agg(
            exact(words * F.coalesce(at, F.lit(most))).alias("value"), exact(words * F.coalesce(at, F.lit(0.0)) * z).alias("slope"))
        gap = F.log(F.col("value") / F.col("target"))
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - gap * F.col("value") / F.col("slope"))
        wide = F.greatest(F.abs("tilt"), F.lit(1.0))
        other = F.when(F.col("l") == -inf, F.col("h") - wide).when(F.col("h") == inf, F.col("l") + wide).otherwise((F.col("l") + F.col("h")) / 2)
        moved = state.join(sums, "origin", "left").withColumn("gap", gap).withColumn("l", low).withColumn("h", high).withColumn("newton", newton)
        inside = (F.col("newton") > F.col("l")) & (F.col("newton") < F.col("h"))
        narrow = (F.col("h") - F.col("l")) <= F.lit(1e-15) * wide
        settled = F.col("done") | F.coalesce(F.abs("gap") <= within, F.lit(False)) | F.coalesce(narrow, F.lit(False))
        step = F.when(settled, F.col("tilt")).when(inside, F.col("newton")).otherwise(other)
        after, new = stored(moved.select(
            "origin", "target", "mean", step.alias("tilt"), F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high"),
            settled.alias("done")), "tilts")
        discard(spark, path)
        state, path = after, new
    raise RuntimeError(f"tilts did not settle in {rounds} rounds")


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of each group, sorted by source and falling size; the rest in words is carried on."""
    here, rest = None, 0.0
    for batch in batches:
        copies = []
        for origin, size, rows, each, most in zip(*(batch.column(c).to_pylist() for c in ("origin", "size", "rows", "rate", "most"))):
            if origin != here:
                here, rest = origin, 0.0
            if not size:
                copies.append(0)
                continue
            want = rows * each + rest / size
            take = min(max(math.floor(want + 0.5), 0), math.floor(most) * rows)
            rest = (want - take) * size
            copies.append(take)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("origin", "size", "salt", "rows")), pa.array(copies, pa.int64())], ["origin", "size", "salt", "rows", "copies"])


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2, hot: int = 1 << 18,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row.

    ``weights`` repeat over the sources in order and share ``share`` of all words; no
    document is taken more than ``most`` times."""
    sized, _ = stored(sizes(docs, key, text, source), "sizes")
    histogram, _ = stored(sized.groupBy("origin", "source", "size").agg(F.count("*").alias("rows")), "size-histogram")
    wanted, _ = stored(targets(weighted_sources(histogram, weights), share, most), "targets")
    solved = tilts(histogram, wanted, most)
    # Groups too large for one task: at most rows / hot of them.
    salts = histogram.where(F.col("rows") > hot).select("origin", "size", F.ceil(F.col("rows") / hot).cast("int").alias("salts"))
    salts, _ = stored(salts, "size-salts")
    salt = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.col("salts")), F.lit(0)).cast("int")
    dealt = sized.join(salts, ["origin", "size"], "left").select("doc_id", "source", "origin", "size", salt.alias("salt"))
    small = histogram.join(salts, ["origin", "size"], "left_anti").select("origin", "size", F.lit(0).alias("salt"), "rows")
    split = dealt.join(salts, ["origin", "size"], "left_semi").groupBy("origin", "size", "salt").agg(F.count("*").alias("rows"))
    groups = small.unionByName(split).join(solved, "origin").select(
        "origin", "size", "salt", "rows", rate(F.col("tilt"), F.col("size"), F.col("mean"), most).alias("rate"), F.lit(most).alias("most"))
    plan = groups.repartition("origin").sortWithinPartitions("origin", F.desc("size"), "salt").mapInArrow(
        _carry, "origin string, size long, salt int, rows long, copies long")
    plan, _ = stored(plan, "copies")
    place = F.row_number().over(Window.partitionBy("origin", "size", "salt").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = dealt.withColumn("place", place).join(plan, ["origin", "size", "salt"]).join(wanted.select("origin", "source_size", "target"), "origin")
    copies = F.floor(F.col("copies") / F.col("rows")) + (F.col("place") <= F.col("copies") % F.col("rows")).cast("int")
    rated = chosen.join(solved, "origin").withColumn("each", copies.cast("long"))
    return rated.select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, rate(F.col("tilt"), F.col("size"), F.col("mean"), most)).otherwise(F.lit(0.0)).alias("rate"),
        F.col("each").alias("copies"), (F.col("each") * F.col("size")).alias("taken"))
