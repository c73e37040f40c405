"""Token counts by byte-pair merging without identifiers (operator 5).

Each distinct word's symbols form a linked list; a heap yields the lowest-ranked
adjacent pair, leftmost first; the count is the number of symbols less the number of
merges. A bounded memo keeps the counts of words in use, so most words cost one
lookup. No shuffle and no state beyond a task.

Defined results: a null or empty text counts 0 tokens and 0 bytes; a special string
inside a text counts as one token, as is the library's default; repeated rows are
counted row by row; other columns are ignored; an empty table gives an empty result;
long texts are counted whole, O(n log n) in the longest word.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import WordCache, byte_characters, map_text, split_words


class Merger:
    """Counts in one Python worker, from the content of a byte-level tokenizer file."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level byte-pair files are counted here")
        self.symbol = [vocab[c] for c in byte_characters()]
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.left, self.right, self.made = ([vocab[f(*x)] for x in merges] for f in (
            lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(zip(self.left, self.right)):
            self.ranks.setdefault(a << 32 | b, rank)
        self.special = [x["content"] for x in spec.get("added_tokens") or () if x.get("special")]
        self.words = WordCache(self.count_word)

    def count_word(self, word: str) -> int:
        symbols = [self.symbol[b] for b in word.encode("utf-8")]
        n = count = len(symbols)
        rank_of = self.ranks.get
        # An entry is rank << 32 | place: the lowest rank comes first, then the leftmost.
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not heap:
            return count
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        lefts, rights = self.left, self.right
        while heap:
            entry = heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] != lefts[r] or symbols[j] != rights[r]:
                continue  # one of the two was merged meanwhile
            count -= 1
            made = symbols[i] = self.made[r]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank_of(made << 32 | symbols[k])) is not None:
                    heappush(heap, x << 32 | i)
            h = before[i]
            if h >= 0 and (x := rank_of(symbols[h] << 32 | made)) is not None:
                heappush(heap, x << 32 | h)
        return count

    def count(self, text: str) -> int:
        parts, specials = [text], 0
        for mark in self.special:
            cut = [y for x in parts for y in x.split(mark)]
            specials += len(cut) - len(parts)
            parts = cut
        return specials + sum(sum(map(self.words.__getitem__, split_words(x))) for x in parts if x)


@lru_cache(maxsize=2)
def merger(content: str) -> Merger:
    return Merger(content)


def token_counts(docs: DataFrame, content: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of each whole text, and whether the tokens are over ``limit``.

    ``content`` is the text of a byte-level tokenizer file; it is shipped to the tasks."""

    def rows(keys: list, texts: list[str]) -> list[pa.Array]:
        own = merger(content)
        return [
            pa.array(keys, pa.int64()),
            pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()),
            pa.array(list(map(own.count, texts)), pa.int64()),
        ]

    counted = map_text(docs, "key long, n_bytes long, n_tokens long", rows, key, text)
    return counted.withColumnRenamed("key", key).withColumn("over_limit", F.col("n_tokens") > limit)
