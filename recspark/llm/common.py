"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), so other columns can't clash."""
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose ``column`` holds about ``limit`` bytes; one long row stays whole."""
    start = held = 0
    for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(
    docs: DataFrame, schema: str, rows: Callable[[list, list[str]], list[pa.Array]],
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``rows(keys, texts)`` gives the columns of ``schema`` for a bounded part of the rows."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                arrays = rows(part.column("key").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(arrays, names)

    return keyed_text(docs, key, text).mapInArrow(run, schema)


def first_rows(rows: DataFrame, by: list[str], order: list[Column], limit: int, salts: int = 64) -> DataFrame:
    """The ``limit`` first rows of each group of ``by``.

    A group is ranked within hash parts first, so however many tasks hold rows of a
    hot group, the one that ranks it at last reads ``salts`` x ``limit`` rows at most."""
    part = F.pmod(F.hash(*order), F.lit(salts))
    for parts in ([*by, "_part"], by):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
        rows = rows.withColumn("_part", part).withColumn("_place", place).where(F.col("_place") <= limit).drop("_part", "_place")
    return rows


def hex_sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


class WordCache(dict):
    """A bounded memo of ``make(word)`` with two generations: words in use stay when it is full."""

    def __init__(self, make: Callable, size: int = 150_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, word):
        if len(word) > self.longest:
            return self.make(word)
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


# --- splitting of text before byte-pair merges --------------------------------------

#: The alternatives of the public pattern. The letter branch comes first: it starts
#: with a letter or a space before one, where no earlier branch can match.
_UNICODE = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over characters below U+0250 for the faster standard module, where \w and
#: \d agree with letters and numbers but for the characters that _ODD lists.
_LATIN = r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_ODD = re.compile("[\x1c-\x1f²³¹¼-¾ɐ-\U0010ffff]")


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Code points that this Python's Unicode tables don't assign: there the versions
    of Unicode in the splitting libraries may differ."""
    ranges, start = [], None
    for point in range(0x530, 0x110001):
        free = point < 0x110000 and unicodedata.category(chr(point)) == "Cn"
        if free and start is None:
            start = point
        elif not free and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


@lru_cache(maxsize=1)
def _splitters() -> tuple[Callable, Callable, Callable]:
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def slow(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    return re.compile(_LATIN).findall, regex.compile(_UNICODE).findall, slow


def split_words(text: str) -> list[str]:
    """The matches of the public tokenizer pattern, as the tokenizer libraries give them."""
    latin, unicode_, library = _splitters()
    if not _ODD.search(text):
        return latin(text)
    return library(text) if _unassigned().search(text) else unicode_(text)


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The byte-level alphabet: a printable character for each byte. Bytes that are
    printable in Latin-1 stand for themselves, the others take U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]
