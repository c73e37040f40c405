"""Benchmark decontamination by exact shingle containment (operator 9, native).

An item leaks into a document that holds at least ``least`` of its distinct five-word
shingles. Each shingle of a document meets the postings of all items once, and the
matches are counted, so every leak is found whatever the document's length, texts are
read once and only matches are shuffled. (Banded MinHash over whole documents can't: a
60-word item in 20,000 words has a Jaccard similarity of 0.003.) An item's sketch, the
q - ceil(least*q) + 1 of its q shingles of smallest hash, and its size class are marked
but filter nothing: a document that misses the whole sketch fails the count anyway.

Postings are broadcast while they number ``broadcast_rows`` at most and joined by
shuffle beyond that; both give the same rows.

Defined results: null and empty texts hold nothing; an item of fewer than five words
is one shingle of its own length; an item without words leaks nowhere; rows that share
an id are one document, or one item; a null id is an id of its own; other columns are
ignored; empty tables give an empty result. Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.components import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits and all characters from U+0080."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(df: DataFrame, key: str, length: int) -> DataFrame:
    """(key, w0.., h) for each run of ``length`` words of column ``words``."""
    n = F.size("words") - (length - 1)
    moved = [F.slice("words", i + 1, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(length)]
    # Shorter texts have no run, so they leave before the explosion.
    runs = df.where(F.size("words") >= length).select(key, F.inline(F.arrays_zip(*moved)))
    names = [f"w{i}" for i in range(length)]
    return runs.toDF(key, *names).withColumn("h", F.xxhash64(*names)).select(key, F.array(*names).alias("gram"), "h")


def postings(items: DataFrame, least: float, length: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, gram, h, q, size_class, sketch) of each item's distinct shingles.

    Numbers of shingles are those of one item, so the ranking is within small groups."""
    worded = items.select(F.col(key).cast("long").alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    own = F.least(F.size("words"), F.lit(length))
    every = None
    for n in range(1, length + 1):
        part = shingles(worded.where(own == n), "item_id", n)
        every = part if every is None else every.unionByName(part)
    sets = every.groupBy("item_id").agg(F.sort_array(F.collect_set(F.struct("h", "gram"))).alias("grams"))
    q = F.size("grams")
    sized = sets.select("item_id", q.alias("q"), F.ceil(F.log2(q)).cast("int").alias("size_class"), F.posexplode("grams").alias("rank", "g"))
    kept = F.col("q") - F.ceil(F.col("q") * F.lit(least) - F.lit(1e-9)) + 1
    return sized.select("item_id", "q", "size_class", "g.h", "g.gram", (F.col("rank") < kept).alias("sketch"))


def leaks(
    docs: DataFrame, items: DataFrame, least: float = 0.8, length: int = 5, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", broadcast_rows: int = 200_000,
) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, containment) of every leak."""
    index, _ = stored(postings(items, least, length, item_key, item_text), "postings")
    small = index.count() <= broadcast_rows
    lengths = [r[0] for r in index.select(F.size("gram")).distinct().collect()]  # at most ``length`` numbers
    worded = docs.select(F.col(key).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    found = None
    for n in sorted(lengths):
        side = index.where(F.size("gram") == n).withColumnRenamed("gram", "own")
        met = shingles(worded, "doc_id", n).join(F.broadcast(side) if small else side, "h")
        # Words decide where hashes agree; not written as an equality, or Spark would join by the words.
        part = met.where(F.coalesce(F.col("gram") == F.col("own"), F.lit(False))).select("doc_id", "item_id", "q", "sketch", "h")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return worded.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_common"),
                             F.lit(0).cast("long").alias("n_item"), F.lit(0.0).alias("containment")).where("false")
    # A group holds one item's shingles at most; sets are merged before the shuffle.
    counted = found.groupBy("doc_id", "item_id", "q").agg(F.max("sketch").alias("candidate"), F.size(F.collect_set("h")).alias("n"))
    return counted.where(F.col("candidate") & (F.col("n") >= F.col("q") * F.lit(least) - F.lit(1e-9))).select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_common"), F.col("q").cast("long").alias("n_item"),
        (F.col("n") / F.col("q")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the documents that an item leaks into."""
    key = options.get("key", "doc_id")
    bad = leaks(docs, items, **options).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(bad, docs[key].cast("long").eqNullSafe(bad["_leak"]), "left_anti")


ORACLE = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), ig AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), iq AS (SELECT item_id, count(*) AS q FROM ig GROUP BY item_id),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), dg AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)
)
SELECT d.doc_id, g.item_id, count(*) AS n_common, max(q) AS n_item, count(*) / max(q)::DOUBLE AS containment
FROM dg d JOIN ig g ON d.g = g.g AND d.n = g.n JOIN iq ON iq.item_id = g.item_id
GROUP BY d.doc_id, g.item_id HAVING count(*) >= 0.8 * max(q) - 1e-9
"""
