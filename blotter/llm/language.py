"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Text likelihoods come from byte trigrams of lower-cased text, hashed to buckets, with
counts per language over all rows whose declared language is one of `languages`. From
the text alone each row gets a soft label. Grouped sums of the soft labels give, over
all rows, how often each declared value goes with a language, and the priors: all rows,
smoothed into each address suffix, smoothed into each host. A row's own soft label is
taken out of its host's sums. The posterior multiplies the four kinds of evidence;
trigrams overlap, so their log likelihood counts a third.

A row is rejected (`kept` false) where its text has no trigram with a letter, where no
language reaches `least_posterior`, or where its text fits the best language worse than
evenly spread trigrams would. Null texts count as empty: they get the language that the
other evidence favours (of equals the first of `languages`) and are rejected. A null
declared value, host or suffix is a value of its own. Repeated rows count as often as
they occur and get equal results. Without any declared language all texts are alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import map_batches, written
from blotter.llm.registry import query, table

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 1 << 15
#: Weight of overlapping trigrams.
TEXT_WEIGHT = 1 / 3
#: Rows that the wider prior weighs in a suffix and in a host.
PRIOR_ROWS = 20.0
LEAST_POSTERIOR = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0xC3, 256)]] = True


def trigram_buckets(text: str, buckets: int) -> np.ndarray:
    """Buckets of all byte trigrams of the lower-cased text that hold a letter."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    has = _LETTER[raw]
    some = has[:-2] | has[1:-1] | has[2:]
    a = raw.astype(np.uint32)
    codes = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    mixed = (codes[some] * np.uint32(0x9E3779B1)) >> np.uint32(7)
    return (mixed % np.uint32(buckets)).astype(np.int64)


def trigram_model(
    docs: DataFrame, *, text: str, declared: str, languages: tuple[str, ...], buckets: int
) -> np.ndarray:
    """log P(bucket | language), buckets x languages, from all rows that declare one."""

    class Counter:
        def __init__(self) -> None:
            self.counts = np.zeros((len(languages), buckets), np.int64)

        def __call__(self, texts, names):
            for content, name in zip(texts, names):
                np.add.at(self.counts[languages.index(name)], trigram_buckets(content, buckets), 1)
            return []

        def totals(self):
            rows, at = np.nonzero(self.counts)
            return list(zip(rows.tolist(), at.tolist(), self.counts[rows, at].tolist()))

    some = docs.where(F.col(declared).isin(*languages) & F.col(text).isNotNull())
    parts = map_batches(
        some.select(text, declared), Counter, "l int, bucket int, n long", last=Counter.totals
    )
    counts = np.zeros((buckets, len(languages)))
    # At most buckets x languages rows.
    for l, bucket, n in parts.groupBy("l", "bucket").agg(F.sum("n")).collect():
        counts[bucket, l] = n
    smooth = counts + 0.1
    return np.log(smooth / smooth.sum(0))


def text_evidence(
    docs: DataFrame, model: np.ndarray, *, id_col: str, text: str, keys: list[str],
    languages: tuple[str, ...],
) -> DataFrame:
    """Per row: id, keys, number of trigrams, log likelihood and soft label per language."""
    buckets, many = model.shape

    def make():
        table_ = model.astype(np.float32)

        def each(ids, texts, *rest):
            for key, content, *values in zip(ids, texts, *rest):
                at = trigram_buckets(content or "", buckets)
                like = table_[at].sum(0, dtype=np.float64) if len(at) else np.zeros(many)
                soft = np.exp((like - like.max()) * TEXT_WEIGHT)
                soft /= soft.sum()
                yield key, *values, len(at), *like.tolist(), *soft.tolist()

        return each

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [f"{id_col} {kinds[id_col]}", *(f"{k} {kinds[k]}" for k in keys), "_n long"]
    columns += [f"_like_{l} double" for l in languages] + [f"_soft_{l} double" for l in languages]
    return map_batches(docs.select(id_col, text, *keys), make, ", ".join(columns))


def identify_languages(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", declared: str | None = None,
    host: str | None = None, suffix: str | None = None, keep: tuple[str, ...] = (),
    languages: tuple[str, ...] = LANGUAGES, buckets: int = BUCKETS,
    prior_rows: float = PRIOR_ROWS, least_posterior: float = LEAST_POSTERIOR,
) -> DataFrame:
    """(id, `keep` columns, language, posterior, kept) of every row.

    `declared`, `host` and `suffix` name columns of evidence; evidence not named says
    nothing. Only sums per host are joined, never texts.
    """
    nothing = F.lit(None).cast("string")
    named = docs.select(
        F.col(id_col),
        F.col(text),
        *keep,
        *(
            (F.col(c).cast("string") if c else nothing).alias(name)
            for name, c in (("_declared", declared), ("_host", host), ("_suffix", suffix))
        ),
    )
    short = F.lower(F.substring_index(F.substring_index("_declared", "-", 1), "_", 1))
    named = named.withColumns(
        {
            "_declared": F.when(short.isin(*languages), short)
            .when(F.col("_declared").isNotNull(), "other")
            .otherwise("none"),
            "_host": F.coalesce("_host", F.lit("")),
            "_suffix": F.coalesce("_suffix", F.lit("")),
        }
    )
    model = trigram_model(
        named, text=text, declared="_declared", languages=languages, buckets=buckets
    )
    keys = [*keep, "_declared", "_host", "_suffix"]
    evidence = written(
        text_evidence(named, model, id_col=id_col, text=text, keys=keys, languages=languages),
        "language-evidence",
    )
    seen = evidence.where("_n > 0")
    sums = {l: F.sum(f"_soft_{l}") for l in languages}

    # At most two more declared values than languages.
    kinds = [*languages, "other", "none"]
    pairs = np.zeros((len(kinds), len(languages)))
    for row in seen.groupBy("_declared").agg(*(s.alias(l) for l, s in sums.items())).collect():
        pairs[kinds.index(row["_declared"])] = [row[l] for l in languages]
    totals = pairs.sum(0)
    said = dict(zip(kinds, np.log((pairs + 1.0) / (totals + len(kinds)))))
    everything = (totals + 1.0) / (totals.sum() + len(languages))

    hosts = seen.groupBy("_host", "_suffix").agg(*(s.alias(f"_h_{l}") for l, s in sums.items()))
    suffixes = hosts.groupBy("_suffix").agg(*(F.sum(f"_h_{l}").alias(f"_s_{l}") for l in languages))
    priors = hosts.join(suffixes, "_suffix")
    # Rows of hosts without any text still meet the prior of all rows.
    both = evidence.join(priors, ["_host", "_suffix"], "left").fillna(
        0.0, [f"_{k}_{l}" for l in languages for k in "hs"]
    )
    floor = float(np.log(1.0 / buckets))

    def fuse():
        def smoothed(counts: np.ndarray, own: np.ndarray, wider: np.ndarray) -> np.ndarray:
            left = np.maximum(counts - own, 0.0) + prior_rows * wider
            return left / left.sum(1, keepdims=True)

        def each(ids, names, units, *columns):
            extra, numbers = columns[: len(keep)], np.array(columns[len(keep) :]).T
            like, soft, host, suffix = np.split(numbers, 4, axis=1)
            units = np.array(units)
            own = np.where(units[:, None] > 0, soft, 0.0)
            prior = smoothed(host, own, smoothed(suffix, own, everything))
            score = TEXT_WEIGHT * like + np.array([said[n] for n in names]) + np.log(prior)
            best = score.argmax(1)
            posterior = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
            kept = (units > 0) & (posterior >= least_posterior) & (like.max(1) >= units * floor)
            named = [languages[i] for i in best.tolist()]
            return zip(ids, *extra, named, posterior.tolist(), kept.tolist())

        return each

    numbers = [f"_{k}_{l}" for k in ("like", "soft", "h", "s") for l in languages]
    kinds_of = {f.name: f.dataType.simpleString() for f in named.schema}
    schema = ", ".join(f"{c} {kinds_of[c]}" for c in (id_col, *keep))
    return map_batches(
        both.select(id_col, "_declared", "_n", *keep, *numbers),
        fuse,
        f"{schema}, language string, posterior double, kept boolean",
    )


def page_evidence(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with `text`, `declared`, `host` and `suffix` as evidence for the above."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return pages.withColumns(
        {
            "text": bare,
            "declared": F.when(declared != "", declared),
            "host": F.when(host != "", host),
            "suffix": F.when(host != "", F.substring_index(host, ".", -1)),
        }
    )


@query()
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, declared="lang", host="source")
