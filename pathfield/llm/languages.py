"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: the likelihood of the text's byte trigrams under each language's model, the language that
the record or its markup declares, the suffix of its address, and a prior of its host. Host priors are smoothed
hierarchically, host towards suffix towards all, from counts that one grouped aggregation of a first, text-and-declaration-only
decision gives; hot hosts collapse in partial aggregation.

Every declared language has a trigram model, fitted on a bounded sample of its distinct texts (about PER_LANGUAGE of each); every row is counted
and judged, over its whole text; of a long text no more than EVIDENCE trigrams count as independent, so no text outweighs all else by its
length. Defined results: missing evidence multiplies by one, so an empty text without declaration gets its host's
prior; hosts and declarations may be null; equal posteriors go to the language first in the alphabet; without any declared
language the result is null with posterior 0, and not accepted; rows that repeat count each; an empty table has an empty result; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfield.llm.common import read, sized, staged
from pathfield.llm.urls import host_of

#: Distinct texts of each declared language that its model is fitted on (expected number; twice that at most), longest of them in characters.
PER_LANGUAGE, LONGEST = 200, 20_000
#: Trigram buckets.
BUCKETS = 1 << 15
#: Trigrams that count as independent, at most.
EVIDENCE = 60
#: Weight, in records, of the level above in a smoothed prior.
PULL = 20.0
#: Chance that a declaration, and that an address suffix, names the right language.
DECLARED, SUFFIXED = 0.9, 0.6
LEAST = 0.6
SLICE = 1 << 20

# Address suffixes of one language.
SUFFIX_LANGUAGES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "uk": "en", "us": "en"}


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a lower-cased text."""
    data = text.lower().encode()
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), SLICE):
        b = np.frombuffer(data[at : at + SLICE + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            x = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
            counts += np.bincount(x >> np.uint32(17), minlength=BUCKETS)
    return counts


@dataclass
class TextModel:
    """logs: (BUCKETS, languages)."""

    languages: list[str]
    logs: np.ndarray

    def evidence(self, text: str) -> np.ndarray:
        """Log likelihood of each language, as of EVIDENCE trigrams at most."""
        data = text.lower().encode()
        total, n = np.zeros(len(self.languages)), max(0, len(data) - 2)
        for at in range(0, len(data), SLICE):
            b = np.frombuffer(data[at : at + SLICE + 2], np.uint8).astype(np.uint32)
            if len(b) > 2:
                x = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
                total += np.bincount(x >> np.uint32(17), minlength=BUCKETS) @ self.logs
        return total * min(1.0, EVIDENCE / n) if n else total


def fit_text_model(rows: DataFrame) -> TextModel:
    """rows: (text, declared). A hashed share of each language's distinct texts is fitted, about PER_LANGUAGE of them."""
    rows = rows.where("declared is not null")
    fits = F.length("text") <= LONGEST
    sizes = rows.groupBy("declared").agg(F.approx_count_distinct(F.when(fits, F.xxhash64("text"))).alias("n")).collect()
    if not sizes:
        return TextModel([], np.zeros((BUCKETS, 0)))
    rates = F.create_map(*[F.lit(x) for r in sizes for x in (r.declared, min(1.0, PER_LANGUAGE / max(1, r.n)))])
    h = F.xxhash64("text")
    sample = rows.where(fits & (F.pmod(h, F.lit(1 << 20)) / float(1 << 20) < rates[F.col("declared")])).distinct()
    rank = F.row_number().over(Window.partitionBy("declared").orderBy(F.xxhash64(h), "text"))
    sample = sample.withColumn("rank", rank).where(F.col("rank") <= 2 * PER_LANGUAGE).select("declared", "text")
    languages = sorted(r.declared for r in sizes)
    index, counts = {x: i for i, x in enumerate(languages)}, np.zeros((BUCKETS, len(languages)))
    for r in sample.toLocalIterator():
        counts[:, index[r.declared]] += trigram_counts(r.text)
    return TextModel(languages, np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * BUCKETS))


def suffix_of(host: Column) -> Column:
    """What follows the last dot of a host; null without a dot."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(F.lower(host), ".", -1))


def host_priors(firsts: DataFrame, languages: list[str]) -> DataFrame:
    """(host, suffix, first: language) to (host, prior array): counts smoothed towards the suffix's, and these towards all."""
    counts = [F.count_if(F.col("first") == x).cast("double").alias(f"n{i}") for i, x in enumerate(languages)]
    hosts = firsts.groupBy("host", "suffix").agg(*counts)
    hosts = staged(hosts.select("host", "suffix", F.array(*[f"n{i}" for i in range(len(languages))]).alias("n")), "hosts")
    add = lambda c: F.array(*[F.sum(F.get(c, i)) for i in range(len(languages))])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def smooth(n: Column, above: Column) -> Column:
        return F.zip_with(n, above, lambda x, p: (x + PULL * p) / (total(n) + PULL))

    whole = hosts.agg(add(F.col("n")).alias("all")).first()["all"]
    whole = [x or 0.0 for x in whole]
    everywhere = F.array(*[F.lit((x + 1) / (sum(whole) + len(whole))) for x in whole])
    suffixes = hosts.groupBy("suffix").agg(add(F.col("n")).alias("m")).select(F.col("suffix").alias("s"), smooth(F.col("m"), everywhere).alias("above"))
    joined = hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("s")))
    return joined.select("host", smooth(F.col("n"), F.col("above")).alias("prior"))


def fuse(model: TextModel, suffixes: Mapping[str, str] = SUFFIX_LANGUAGES):
    """UDF of (text, declared, suffix, prior) to struct(language, posterior)."""
    languages, index = model.languages, {x: i for i, x in enumerate(model.languages)}
    rest = max(1, len(languages) - 1)

    def told(at: int | None, right: float) -> np.ndarray:
        if at is None or len(languages) < 2:
            return np.zeros(len(languages))
        out = np.full(len(languages), np.log((1 - right) / rest))
        out[at] = np.log(right)
        return out

    by_declared = {x: told(i, DECLARED) for x, i in index.items()}
    by_suffix = {s: told(index[x], SUFFIXED) for s, x in suffixes.items() if x in index}
    none = np.zeros(len(languages))

    def run(text: pd.Series, declared: pd.Series, suffix: pd.Series, prior: pd.Series) -> pd.DataFrame:
        found = []
        for t, d, s, p in zip(text, declared, suffix, prior, strict=True):
            if not languages:
                found.append((None, 0.0))
                continue
            log = model.evidence(t or "") + by_declared.get(d, none) + by_suffix.get(s, none) + (none if p is None else np.log(np.asarray(p, float)))
            weight = np.exp(log - log.max())
            best = int(weight.argmax())
            found.append((languages[best], float(weight[best] / weight.sum())))
        return pd.DataFrame(found, columns=["language", "posterior"])

    return F.pandas_udf(run, "language string, posterior double")


def judged(rows: DataFrame, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """(row, found): each row as a struct, and struct(language, posterior).

    Host priors are joined by broadcast up to a counted size; a larger table is joined by host, where Spark splits skewed
    partitions.
    """
    of = lambda name: F.col("row").getField(name).cast("string")
    packed = rows.select(F.struct("*").alias("row"))
    source = packed.select(of(text).alias("text"), of(declared).alias("declared"), of(host).alias("host")).withColumn("suffix", suffix_of(F.col("host")))
    model = fit_text_model(source.select("text", "declared"))
    udf = fuse(model)
    nothing = F.lit(None).cast("array<double>")
    if not model.languages:
        return packed.withColumn("found", udf(of(text), of(declared), F.lit(None).cast("string"), nothing))
    firsts = source.select("host", "suffix", udf("text", "declared", "suffix", nothing)["language"].alias("first"))
    priors = staged(host_priors(firsts, model.languages), "priors")
    joined = packed.join(sized(priors, priors.count(), 50_000), of(host).eqNullSafe(F.col("host")), "left")
    return joined.withColumn("found", udf(of(text), of(declared), suffix_of(of(host)), F.col("prior"))).select("row", "found")


def identify(rows: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", keys: Sequence[str] = ("doc_id",), least: float = LEAST) -> DataFrame:
    """keys, declared, language, posterior, accepted (a posterior of at least `least`)."""
    found = judged(rows.select(*dict.fromkeys([*keys, text, declared, host])), text, declared, host)
    own = [F.col("row").getField(k).alias(k) for k in keys]
    found = found.select(*own, F.col("row").getField(declared).alias("declared"), F.col("found.language").alias("language"), F.col("found.posterior").alias("posterior"))
    return found.withColumn("accepted", F.col("posterior") >= least)


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, whose language has a posterior of at least `least`."""
    return judged(docs).where(F.col("found.posterior") >= least).select(*[F.col("row").getField(n).alias(n) for n in docs.columns])


def markup_language(html: Column) -> Column:
    """The language, without region, that a page's html element declares; null if none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-z]{2,3})\b""", 1)), F.lit(""))


def markup_text(html: Column) -> Column:
    """A page without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, lang, source): a page's text, the language its markup declares, the host of its address; null where there is none."""
    return pages.select("page_id", markup_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("lang"), F.nullif(host_of(F.col("url")), F.lit("")).alias("source"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: language of every document and every page. doc_id, page_id (one of them null), declared, language, posterior, accepted.

    A document's record gives its declared language and its source as host; a page's markup declares its language, its address has the
    host and the suffix.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "lang", "source")
    pages = page_evidence(read(spark, sf_dir, "pages")).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "lang", "source")
    return identify(docs.unionByName(pages), keys=("doc_id", "page_id"))
