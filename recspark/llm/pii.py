r"""Personal data by anchor expansion (operator 2).

One Aho-Corasick pass over each whole text finds the anchors: at-signs, plus signs,
"://" and identifier cues in three spellings; one pass of digit runs serves what has
no anchor but digits. From each anchor a deterministic parser expands to both sides
and validates, in time linear in the text, without backtracking.

Kinds of the contract, leftmost and without overlap within a kind: email, ip, card,
phone. The method's own, listed after them:

account   the identifier after a cue such as "iban", "account" or "ssn": an IBAN by its
          check digits, a social security number by its shape, else 6 to 17 digits
address   scheme://user@host or scheme://user:secret@host, up to the host's end

Defined results: null and empty texts have no spans; repeated rows are each listed;
other columns are ignored by ``find`` and kept by ``mask``; an empty table gives an
empty result; texts are read whole whatever their length.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import hex_sha256, map_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address")
CUES = ("iban", "ssn", "account", "acct", "passport", "konto", "compte", "cuenta")

_DIGITS = re.compile("[0-9]+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_PHONE = re.compile(r"[ ().0-9-]*")
_FILLER = re.compile(r"(?i)(?:\s*(?:number|no\.?|nr\.?|code|id|#|:|=))*\s*")
_TOKEN = re.compile(r"[A-Za-z0-9]+(?:[ -][A-Za-z0-9]+)*")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_USER = re.compile(r"[^\s@/<>\"']+@")
_ALNUM = re.compile("[A-Za-z0-9]")


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in ("@", "+", "://"):
        found.add_word(sign, (sign, len(sign)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _iban(text: str, at: int) -> int | None:
    match = _IBAN.match(text, at)
    if not match:
        return None
    # The longest end whose check digits hold; further words may follow the number.
    for end in range(match.end(), at + 14, -1):
        own = text[at:end].replace(" ", "").upper()
        if text[end - 1] != " " and len(own) >= 15 and (end == len(text) or not _ALNUM.match(text[end])):
            if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
                return end
    return None


def _numbers(text: str, spans: dict[str, list]) -> None:
    """ip and card from the digit runs and what stands between them."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(_small(text[a:b]) for a, b in four):
                spans["ip"].append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j, digits = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            digits += runs[j][1] - runs[j][0]
        if 13 <= digits <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            spans["card"].append((runs[i][0], runs[j][1]))
        i = j + 1


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans [start, end) in code points of each kind, in order of their starts."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail = account = address = 0  # ends of the last matches
    for last, (what, size) in _anchors().iter(text):
        at = last + 1
        if what == "@":
            begin = last
            while begin > mail and text[begin - 1] in _LOCAL:
                begin -= 1
            domain = _DOMAIN.match(text, at)
            if begin < last and domain and "." in domain[0]:
                mail = domain.end()
                spans["email"].append((begin, mail))
        elif what == "+":
            if at < len(text) and text[at] in "0123456789":
                rest = _PHONE.match(text, at + 1)[0].rstrip(" ().-")
                digits = 1 + sum(map(rest.count, "0123456789"))
                if len(rest) > 1 and 9 <= digits <= 15:
                    spans["phone"].append((last, at + 1 + len(rest)))
        elif what == "://":
            begin = last - 2
            while begin > address and _ALNUM.match(text[begin - 1]):
                begin -= 1
            user = _USER.match(text, at)
            host = user and _DOMAIN.match(text, user.end())
            if host and begin < last - 2:
                address = host.end()
                spans["address"].append((begin, address))
        else:
            begin = at - size
            if begin < account or (begin and text[begin - 1].isalnum()) or (at < len(text) and text[at].isalnum()):
                continue
            start = _FILLER.match(text, at).end()
            end = _iban(text, start)
            if end is None:
                match = _SSN.match(text, start) or _NUMBER.match(text, start)
                end = match.end() if match and not (match.end() < len(text) and text[match.end()].isalnum()) else None
            if end is not None:
                account = end
                spans["account"].append((start, end))
    _numbers(text, spans)
    return spans


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end), by kind as listed, then start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(keys: list, texts: list[str]) -> list[pa.Array]:
        found = [[{"kind": k, "start": a, "end": b} for k, many in spans_of(x).items() for a, b in many] for x in texts]
        return [pa.array(keys, pa.int64()), pa.array(found, kind)]

    return map_text(docs, "key long, spans array<struct<kind:string,start:long,end:long>>", rows, key, text).withColumnRenamed("key", "doc_id")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``'s."""
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    text = lambda many: F.array_join(F.transform(many, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in BASE_KINDS),
        hex_sha256(text(base)).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def masked(text: str | None) -> str | None:
    """``text`` with each run of overlapping spans replaced by <KIND> of its first kind."""
    if not text:
        return text
    rank = {k: i for i, k in enumerate(KINDS)}
    every = sorted((a, rank[k], b, k) for k, many in spans_of(text).items() for a, b in many)
    if not every:
        return text
    out, done, top = [], 0, 0
    for a, _, b, k in every:
        if a >= top:
            out += [text[done:a], f"<{k.upper()}>"]
            done = b
        top = done = max(top, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, with the spans in ``text`` replaced; nulls stay null."""

    @F.pandas_udf("string")
    def cover(x: pd.Series) -> pd.Series:
        return x.map(masked, na_action="ignore")

    return docs.withColumn(text, cover(F.col(text)))
