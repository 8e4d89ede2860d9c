"""URL filters by a ratio of character language models, in DataFrame operations alone.

A url that a rule fits gets the rule's verdict. All others are judged by two smoothed variable-order Markov models of
characters, one of the urls that rules allow and one of those that rules block. Each order's estimate falls back on the
next shorter context in proportion to how little the context was seen. The verdict is allow where the mean log ratio
of a url's characters reaches a threshold, which is calibrated on the rule-labelled urls.

The models see a url's form: lower-case host and path, runs of digits as one 0, other characters outside a-z . _ / - as
one sign. Forms are counted before anything is scored, so copies and hot hosts collapse in partial aggregation.

Defined results: a null url, or one without ://, has an empty host and path and the verdict the models give the
empty form; if either class has no url, every url without a rule is allowed. Rows that repeat get the same verdict each; an empty table has
an empty result; a very long url is judged over all its signs; of the table's columns only page_id and url are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfield.llm.common import ascii_lower, read, sized, staged

#: (verdict, host, path): the query's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Longest context, and weight of the next shorter one.
ORDER, PULL = 3, 4.0
#: Signs a form can have: a-z, 0, . _ / -, the fold and the end.
SIGNS = 33
#: Bins a unit of the mean log ratio, for the calibration.
BINS = 50
#: Forms whose scores are broadcast: all of them, or the most frequent ones.
FORMS = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def form_of(host: Column, path: Column) -> Column:
    """What the models see of a url."""
    s = F.regexp_replace(ascii_lower(F.concat(host, path)), r"[0-9]+", "0")
    return F.regexp_replace(s, r"[^a-z0._/\-]", "~")


def _ratios(forms: DataFrame) -> DataFrame:
    """forms (form, allowed, blocked) to (gram, ratio): log ratio of a sign after ORDER signs.

    At most SIGNS ** (ORDER + 1) grams exist, however many urls there are; the window of order 0, one task, sees no more.
    """
    padded = F.concat(F.lit("^" * ORDER), F.col("form"), F.lit("$"))
    grams = forms.select("allowed", "blocked", F.explode(F.transform(F.sequence(F.lit(1), F.length("form") + 1), lambda i: F.substring(padded, i, ORDER + 1))).alias("gram"))
    found = grams.groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    known = found
    for k in range(ORDER + 1):
        part = F.substring("gram", ORDER + 1 - k, k + 1)
        context = F.substring("gram", ORDER + 1 - k, k)
        for kind in ("allowed", "blocked"):
            n, of = F.sum(kind).over(Window.partitionBy(part)), F.sum(kind).over(Window.partitionBy(context))
            lower = F.lit(1.0 / SIGNS) if k == 0 else F.col(f"{kind}_p")
            known = known.withColumn(f"{kind}_q", (n + PULL * lower) / (of + PULL))
        known = known.withColumns({"allowed_p": F.col("allowed_q"), "blocked_p": F.col("blocked_q")})
    return known.select("gram", (F.ln("allowed_p") - F.ln("blocked_p")).alias("ratio"))


def markov_scores(forms: DataFrame) -> DataFrame:
    """forms (form, allowed, blocked: counts of the labelled urls with that form) with their mean log ratio."""
    ratios = staged(_ratios(forms), "ratios")
    padded = F.concat(F.lit("^" * ORDER), F.col("form"), F.lit("$"))
    grams = forms.select("form", "allowed", "blocked", F.explode(F.transform(F.sequence(F.lit(1), F.length("form") + 1), lambda i: F.substring(padded, i, ORDER + 1))).alias("gram"))
    scored = grams.join(sized(ratios, ratios.count()), "gram")
    return scored.groupBy("form", "allowed", "blocked").agg(F.round(F.avg("ratio"), 9).alias("score"))


def calibrate(scored: DataFrame, bins: int = BINS) -> float | None:
    """The bin border with the largest difference of the classes' shares at or above it; the lowest of equal ones.

    None if a class is empty. The scores lie between -ln and +ln of a probability's bound, so the bins are few.
    """
    counts = scored.groupBy(F.floor(F.col("score") * bins).alias("bin")).agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    above = Window.orderBy(F.desc("bin"))
    whole = Window.partitionBy()
    shares = counts.select("bin", (F.sum("a").over(above) / F.nullif(F.sum("a").over(whole), F.lit(0)) - F.sum("b").over(above) / F.nullif(F.sum("b").over(whole), F.lit(0))).alias("gain"))
    best = shares.where("gain is not null").orderBy(F.desc("gain"), "bin").first()
    return None if best is None else best.bin / bins


def _with_scores(rows: DataFrame, scored: DataFrame, forms: DataFrame) -> DataFrame:
    """rows with their forms' scores. The most frequent forms are broadcast by their digests, so no form's rows meet in one task."""
    found = scored.select(F.md5("form").alias("digest"), "score")
    rows = rows.withColumn("digest", F.md5("form")).drop("form")
    if scored.count() <= FORMS:
        return rows.join(F.broadcast(found), "digest")
    often = forms.orderBy(F.desc("n"), "form").limit(FORMS).select(F.md5("form").alias("digest"))
    often = staged(found.join(often, "digest", "left_semi"), "often")
    first = rows.join(F.broadcast(often), "digest", "left")
    return first.where("score is not null").unionByName(first.where("score is null").drop("score").join(found, "digest"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Verdict for every row: page_id, host, path, rule, verdict, score (null where a class has no url)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "by_rule": verdict, "form": form_of(F.col("host"), F.col("path"))})
    counts = F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count(F.lit(1)).alias("n")
    forms = staged(rows.groupBy("form").agg(*counts), "forms")
    scored = staged(markov_scores(forms), "scored")
    cut = calibrate(scored)
    judged = _with_scores(rows, scored, forms)
    by_model = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    score = F.lit(None).cast("double") if cut is None else F.col("score")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), score.alias("score"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    """Query: every page's verdict under the five rules."""
    return filter_urls(read(spark, sf_dir, "pages"))
