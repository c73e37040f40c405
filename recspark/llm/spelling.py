"""Spelling variants by a bit-sliced position index (operator 13).

For each (position, letter) the index holds a bitset over a part of the vocabulary: the
words with that letter there. A query's letters are taken in turn and one word-parallel
step updates four bitsets: the words equal so far, and those with one replaced, one
missing or one extra letter so far; the last two read the bitsets of the positions
before and after. At the end the lengths decide. A batch of queries takes each step
together, 64 words of the vocabulary at a time.

Two words with one error share their first letters or, if the error is there, their
last ones. So a word is indexed under both ends and asks both: the first cell keeps
what shares the beginning, which is the set of words equal so far after those letters,
the second keeps the others. Each pair is met once from either side and no pair leaves
a cell: per query go out a count and the most frequent near word. Ends are dealt to
cells by hash; an end with more letters than a cell holds is cut into chunks of
either side, and each pair of chunks is a cell. Words of ``LONG`` letters and more are
indexed by length with longer ends, which bounds a cell's index whatever stands in the texts.

Defined results: a null text has no words; a null id counts as the empty string in the
hash; rows that share an id are separate texts; other columns are ignored; a word
without a frequent enough near word is its own root; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import keyed_text, slices
from recspark.llm.components import discard, stored

RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters of the index that one cell holds, about.
LETTERS = 1 << 17
#: Length from which words are indexed by length, and the ends of shorter and longer words.
LONG, END, LONG_END = 64, 3, 31
#: Bytes of one bitset over a batch of queries.
BATCH = 1 << 20


def runs(text: str, doc_id: int | None, one_in: int = 199, least: int = 6) -> Iterator[tuple[str, int]]:
    """(word, times) of a text: runs of letters, of which one in ``one_in`` loses a letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, times in Counter(RUN.findall(text.encode("utf-8").lower().decode("utf-8"))).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, times


def vocabulary(
    docs: DataFrame, least: int = 6, times: int = 5, one_in: int = 199, key: str = "doc_id", text: str = "text", held: int = 200_000,
) -> DataFrame:
    """(word, n) of all words with ``least`` letters that occur ``times`` times.

    Tasks count up to ``held`` different words before they send them on."""

    def pack(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for doc_id, own in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    for word, n in runs(own, doc_id, one_in, least):
                        counts[word] += n
                    if len(counts) >= held:
                        yield pack(counts)
                        counts = Counter()
        yield pack(counts)

    found = keyed_text(docs, key, text).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class BitIndex:
    """Bitsets per (position, letter) over words, which stand in the order of preference."""

    def __init__(self, words: list[str]) -> None:
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.letters, letter = np.unique(codes, return_inverse=True)
        self.keys, row = np.unique(place * len(self.letters) + letter, return_inverse=True)
        self.width = -(-len(words) // 64)
        #: The last row is empty: it answers for a letter that stands nowhere at a position.
        self.bits = np.zeros((len(self.keys) + 1, self.width), np.uint64)
        bit = np.uint64(1) << (np.arange(len(words)) & 63).astype(np.uint64)
        np.bitwise_or.at(self.bits, (row, owner >> 6), bit[owner])
        self.all = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(self.all, np.arange(len(words)) >> 6, bit)
        self.of_length = {}
        for length in np.unique(lengths).tolist():
            own, bits = np.flatnonzero(lengths == length), np.zeros(self.width, np.uint64)
            np.bitwise_or.at(bits, own >> 6, bit[own])
            self.of_length[length] = bits

    def _at(self, place: int, letter: np.ndarray) -> np.ndarray:
        """The bitset of each query's letter at a position."""
        if place < 0:
            return self.bits[np.full(len(letter), -1)]
        key = place * len(self.letters) + letter
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.bits[np.where((letter >= 0) & (self.keys[row] == key), row, -1)]

    def near(self, queries: list[str], end: int, same_end: bool) -> np.ndarray:
        """A bitset per query, all of one length: words with exactly one error that share
        the first ``end`` letters, or those that don't."""
        length = len(queries[0])
        codes = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32).reshape(len(queries), length)
        letter = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letter = np.where(self.letters[letter] == codes, letter, -1)
        equal = np.broadcast_to(self.all, (len(queries), self.width)).copy()
        replaced, missing, extra = (np.zeros_like(equal) for _ in range(3))
        for i in range(length):
            here, before, after = (self._at(i + shift, letter[:, i]) for shift in (0, -1, 1))
            replaced = (replaced & here) | (equal & ~here)
            missing = (missing & before) | equal
            extra = (extra | equal) & after
            equal &= here
            if i == end - 1:
                begins = equal.copy()
        extra |= equal
        none = np.zeros(self.width, np.uint64)
        found = (replaced & self.of_length.get(length, none)) | (missing & self.of_length.get(length - 1, none)) \
            | (extra & self.of_length.get(length + 1, none))
        return found & begins if same_end else found & ~begins


def search(words: list[str], n: list[int], asking: list[str], end: int, same_end: bool) -> Iterator[tuple[str, int, str, int]]:
    """(query, near words, the most frequent of them, its n) of the queries that have any."""
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    index = BitIndex([words[i] for i in order])
    by_length: dict[int, list[str]] = {}
    for q in asking:
        by_length.setdefault(len(q), []).append(q)
    step = max(1, BATCH // (8 * index.width))
    for own in by_length.values():
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            found = index.near(part, end, same_end)
            total = np.bitwise_count(found).sum(axis=1)
            some = np.flatnonzero(total)
            first = np.argmax(found[some] != 0, axis=1)
            block = found[some, first]
            low = np.bitwise_count((block & (~block + np.uint64(1))) - np.uint64(1))
            for q, place in zip(some.tolist(), (first * 64 + low).tolist()):
                yield part[q], int(total[q]), words[order[place]], n[order[place]]


def _roles(words: DataFrame) -> DataFrame:
    """Each word as indexed and as asking, under its beginning and its end."""
    length = F.col("length")
    ends = lambda e: F.array(
        F.struct(F.lit(True).alias("same_end"), F.substring("word", 1, e).alias("letters")),
        F.struct(F.lit(False).alias("same_end"), F.substring("word", -e, e).alias("letters")))
    nothing = F.array().cast("array<struct<asks:boolean,band:int>>")
    role = lambda asks, band: F.struct(F.lit(asks).alias("asks"), band.cast("int").alias("band"))
    short = F.when(length < LONG, F.array(role(False, F.lit(0)), role(True, F.lit(0)))).otherwise(nothing)
    # Pairs of which one has LONG letters or more; LONG - 1 letters only meet LONG.
    long_ = F.when(length >= LONG, F.array(role(False, length), role(True, length), role(True, length - 1), role(True, length + 1))).when(
        length == LONG - 1, F.array(role(False, length), role(True, length + 1))).otherwise(nothing)
    placed = words.withColumn("length", F.length("word")).select("word", "n", "length", F.explode(F.concat(short, long_)).alias("r"))
    sided = placed.select("word", "n", "length", "r.asks", "r.band", F.explode(F.when(F.col("r.band") == 0, ends(END)).otherwise(ends(LONG_END))).alias("e"))
    return sided.select("word", "n", "length", "asks", "band", "e.same_end", F.xxhash64("band", "e.same_end", "e.letters").alias("k"))


def near_words(words: DataFrame, cells: int = 64, letters: int = LETTERS) -> DataFrame:
    """(word, n_near, near, near_n) of the words that have a near word: how many, and the
    one of greatest n (ties: the smallest). ``words`` has word and n, no word twice."""
    total = int(words.agg(F.sum(F.length("word"))).first()[0] or 0)
    cells = max(cells, -(-4 * total // letters))
    rows = _roles(words)
    hot = rows.where("not asks").groupBy("k").agg(F.sum("length").alias("held")).where(F.col("held") > letters).select(
        "k", F.ceil(F.col("held") / letters).cast("int").alias("chunks"))
    hot, _ = stored(hot, "hot-ends")
    chunks = F.coalesce("chunks", F.lit(1))
    cell: Column = F.when(F.col("chunks").isNull(), F.pmod("k", F.lit(cells))).otherwise(F.col("k"))
    dealt = rows.join(hot, "k", "left").select(
        "word", "n", "asks", "band", "same_end", cell.alias("cell"), F.col("chunks").isNotNull().alias("cut"),
        F.pmod(F.xxhash64("word"), chunks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    dealt = dealt.select(
        "cell", "cut", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("i"),
        F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("j"), "band", "same_end", "asks", "word", "n")

    def run(group: pa.Table) -> pa.Table:
        parts: dict[tuple, tuple[list, list, list]] = {}
        for band, same_end, asks, word, n in zip(*(group.column(c).to_pylist() for c in ("band", "same_end", "asks", "word", "n"))):
            indexed, times, asking = parts.setdefault((band, same_end), ([], [], []))
            if asks:
                asking.append(word)
            else:
                indexed.append(word)
                times.append(n)
        out = [row for (band, same_end), (indexed, times, asking) in parts.items() if indexed and asking
               for row in search(indexed, times, asking, LONG_END if band else END, same_end)]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))],
                        names=["word", "met", "near", "near_n"])

    found = dealt.groupBy("cell", "cut", "i", "j").applyInArrow(run, "word string, met long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    joined = found.groupBy("word").agg(F.sum("met").alias("n_near"), best.alias("b"))
    return joined.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): forms followed to the last, by doubling the steps.

    A form is more frequent than its word by a factor, so paths are short and end."""
    current, path = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = current.join(ahead, "root", "left")
        if moved.where("next is not null").isEmpty():
            return current
        after, new = stored(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(forms.sparkSession, path)
        current, path = after, new


def variants(
    docs: DataFrame, least: int = 6, times: int = 5, factor: int = 5, one_in: int = 199, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word: the form is the most frequent
    near word if it is ``factor`` times as frequent, the root the last form of the path."""
    words, _ = stored(vocabulary(docs, least, times, one_in, key, text), "vocabulary")
    near, _ = stored(near_words(words), "near-words")
    known = words.join(near, "word", "left")
    good = F.col("near_n") >= factor * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n"))
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: The same by joins on words with one letter cut out or masked; roots by a recursion.
ORACLE = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), seen AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL HAVING length(run) >= 6
), hashed AS (
  SELECT run, times, xor(list_reduce(
    list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM seen, steps
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5
), cut AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS r(i)
), near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS near, max(w.n) AS near_n FROM near JOIN words w ON w.word = b GROUP BY a
), formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT p.word, f.form FROM path p JOIN formed f ON f.word = p.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM formed f JOIN path p USING (word) JOIN formed l ON l.word = p.root WHERE l.form IS NULL
"""
