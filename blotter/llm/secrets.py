"""Secret scans: fixed patterns, and a guess-cost segmentation of credential values.

`guess_cost` is a dynamic programme over the positions of a value: the least sum of
log10 guesses over all ways to cut it into dictionary words, dates, repeats, keyboard
walks and brute-force spans. It runs on values in a credential context (a key word,
then `:`, `=`, `=>` or `is`); a value that costs at least `least_cost` is reported as a
span of kind `guess`, beside the spans of the fixed patterns, which all stay.

Null text counts as empty and gives no spans. Whole texts are read; spans are in code
points, end exclusive, ordered by start and then kind. Every row is looked at by itself,
so repeated rows give equal results, and other columns pass through untouched.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from blotter.llm.common import map_batches
from blotter.llm.registry import query, table

KINDS = ("assign", "access", "hex", "guess")
#: log10 guesses from which a value in a credential context counts as a secret.
LEAST_COST = 12.0
#: What replaces a secret in a redacted text.
MARK = "[REDACTED]"

# Patterns of the base scan.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Key words of a credential context, wider than those of the base scan.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|(?:api|access|private)[_-]?key"
    r"|credentials?|authorization|bearer)[\"']?\s*(?:[:=]+>?|\bis\b)\s*[\"']?"
    r"([^\s\"'<>,;]{6,})",
    re.IGNORECASE | re.ASCII,
)
#: A text without any of these has no credential context.
STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer")

# Common passwords, most common first; they come before the vocabulary's words.
COMMON = (
    "password", "qwerty", "letmein", "welcome", "admin", "login", "monkey", "dragon", "master",
    "secret", "changeme", "default", "example", "required", "optional", "test", "none", "null",
    "true", "false", "undefined", "placeholder", "redacted", "hidden", "string", "value", "token",
    "user", "root", "guest", "sample", "dummy", "your", "here", "enter", "forgot", "reset",
)
# Rows of neighbouring keys, the alphabet and the digits.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "0123456789",
        "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@310$57", "aaeiosst")

_STEPS = {p for row in ROWS for r in (row, row[::-1]) for p in zip(r, r[1:])}
_DATE = re.compile(
    r"(?=((?:19|20)\d\d[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:3[01]|[12]\d|0?[1-9])"
    r"|(?:3[01]|[12]\d|0?[1-9])[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:19|20)\d\d))",
    re.ASCII,
)
_YEAR = re.compile(r"(?=((?:19|20)\d\d))", re.ASCII)
_REPEAT = re.compile(r"(.{1,8}?)\1{2,}", re.DOTALL)


@lru_cache(maxsize=2)
def word_ranks(vocabulary: str) -> dict[str, int]:
    """Rank of each word: common passwords, then whole words of a public vocabulary."""
    with open(vocabulary, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    for token, rank in entries.items():
        word = token.removesuffix("</w>")
        if word is not token and 3 <= len(word) <= 20 and word.isascii() and word.isalpha():
            ranks.setdefault(word, len(COMMON) + rank)
    return ranks


def _brute(char: str) -> float:
    return 1.0 if char.isdigit() else 1.415 if char.isascii() and char.isalpha() else 1.52


def _word_cost(part: str, rank: int, changed: bool) -> float:
    cost = math.log10(rank + 1)
    if not part.islower():
        cost += 0.31 if part[:1].isupper() and part[1:].islower() or part.isupper() else 1.0
    return cost + 0.5 * changed


def guess_cost(value: str, ranks: dict[str, int], longest: int = 20) -> float:
    """log10 of the guesses of the cheapest segmentation; linear in the value's length."""
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    ends: dict[int, list[tuple[int, float]]] = {}
    for pattern, cost in ((_DATE, 4.6), (_YEAR, 2.1)):
        for m in pattern.finditer(value):
            ends.setdefault(m.end(1), []).append((m.start(1), cost))
    for m in _REPEAT.finditer(value):
        unit = sum(map(_brute, m[1])) if len(m[1]) < 3 else guess_cost(m[1], ranks)
        ends.setdefault(m.end(), []).append((m.start(), unit + math.log10(len(m[0]) / len(m[1]))))
    best, walk = [0.0] * (n + 1), 0
    for j in range(1, n + 1):
        if j > 1 and (low[j - 2], low[j - 1]) not in _STEPS:
            walk = j - 1
        least = best[j - 1] + _brute(value[j - 1])
        if j - walk >= 3:
            least = min(least, best[walk] + 1.7 + math.log10(j - walk))
        for i, cost in ends.get(j, ()):
            least = min(least, best[i] + cost + 0.3)
        for i in range(max(0, j - longest), j - 2):
            if (rank := ranks.get(low[i:j])) is not None:
                least = min(least, best[i] + _word_cost(value[i:j], rank, False) + 0.3)
            elif (rank := ranks.get(plain[i:j])) is not None:
                least = min(least, best[i] + _word_cost(value[i:j], rank, True) + 0.3)
        best[j] = least
    return best[n]


def find_secrets(
    text: str, ranks: dict[str, int], least_cost: float = LEAST_COST
) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, cost) of every secret; cost only for kind `guess`."""
    found = []
    lower = text.lower()
    if any(stem in lower for stem in STEMS):
        found += [(*m.span(), "assign", None) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        for m in CONTEXT.finditer(text):
            cost = guess_cost(m[1], ranks)
            if cost >= least_cost:
                found.append((*m.span(1), "guess", cost))
    if "AKIA" in text:
        found += [(*m.span(), "access", None) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex", None) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def secret_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
    vocabulary: str | None = None, least_cost: float = LEAST_COST,
) -> DataFrame:
    """Per row its id and all spans, as an array of structs in order."""

    def make():
        ranks = word_ranks(vocabulary or default_vocabulary())

        def each(ids, texts):
            for key, content in zip(ids, texts):
                spans = find_secrets(content or "", ranks, least_cost)
                yield key, [dict(zip(("start", "end", "kind", "cost"), s)) for s in spans]

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(id_col, text),
        make,
        f"{id_col} {kind}, spans array<struct<start:long,end:long,kind:string,cost:double>>",
    )


def redacted(content: str, spans: list[tuple[int, int, str, float | None]]) -> str:
    """`content` with every span, or run of spans that touch, replaced by the mark."""
    out, at, end = [], 0, 0
    for start, stop, *_ in spans:
        if start > end or not out:
            out += [content[max(at, end) : start], MARK] if start >= end else []
        end = max(end, stop)
        at = end
    return "".join(out) + content[at:] if out else content


def redact_secrets(
    docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars",
    vocabulary: str | None = None, least_cost: float = LEAST_COST,
) -> DataFrame:
    """All rows and columns, the secrets in `text` replaced; `n_chars`, if there, follows.

    Null texts stay null; further columns pass through.
    """
    names = docs.columns
    at = names.index(text)
    schema = StructType(
        [StructField(f.name, StringType() if f.name == text else f.dataType) for f in docs.schema]
    )

    def make():
        ranks = word_ranks(vocabulary or default_vocabulary())

        def each(*columns):
            clean = [
                None if t is None else redacted(t, find_secrets(t, ranks, least_cost))
                for t in columns[at]
            ]
            return zip(*columns[:at], clean, *columns[at + 1 :])

        return each

    out = map_batches(docs, make, schema)
    if n_chars in names:
        length = F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text))
        out = out.withColumn(n_chars, length.cast(docs.schema[n_chars].dataType))
    return out


@query()
def op2_secret_scans(spark, sf_dir):
    found = secret_spans(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, one))
    return found.select(
        "doc_id",
        *(of_kind(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
