"""URL verdicts: host and path rules, and a logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import ascii_lower, saved

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + start))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def grams(host: Column, path: Column, buckets: int, size: int = 3) -> Column:
    """Bucket numbers (from 1) of the character n-grams of host and of path, each text with marked ends."""
    def of(text, mark):
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        chars = F.filter(chars, lambda c: c != "")
        places = F.sequence(F.lit(1), F.greatest(F.size(chars) - size + 1, F.lit(1)))
        return F.transform(places, lambda i: (F.pmod(F.xxhash64(F.lit(mark), F.array_join(F.slice(chars, i, size), "")), F.lit(buckets)) + 1).cast("int"))

    return F.concat(of(host, "h"), of(path, "p"))


def _score(features: Column, weights: list[float], bias: float) -> Column:
    """Probability of a block. A URL's n-grams share one unit of length, so long URLs weigh no more than short ones."""
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(features, F.lit(0.0), lambda s, i: s + F.element_at(w, i))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(features).cast("double")) + F.lit(bias))))


def train(labelled: DataFrame, buckets: int = 1024, rounds: int = 20, rate: float = 4.0, decay: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by gradient descent on labelled (url, verdict), a small table.

    Each round is one aggregation by bucket; the driver keeps `buckets` numbers. Both verdicts weigh the same in all.
    Without rows of both verdicts the weights stay 0 and the score says nothing (0.5).
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(grams(host, path, buckets).alias("f"), (F.col("verdict") == "block").cast("double").alias("y"))
    rows = saved(rows, "labelled-urls")
    n, n_block = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    weights, bias = [0.0] * buckets, 0.0
    if not n or n_block in (0, n):
        return weights, bias
    each = F.when(F.col("y") == 1, 0.5 / n_block).otherwise(0.5 / (n - n_block))
    for _ in range(rounds):
        off = rows.withColumn("e", (_score(F.col("f"), weights, bias) - F.col("y")) * each)
        part = off.select(F.explode("f").alias("b"), (F.col("e") / F.sqrt(F.size("f").cast("double"))).alias("g"), F.lit(0.0).alias("c"))
        whole = off.select(F.lit(0).alias("b"), F.col("e").alias("g"), F.lit(0.0).alias("c"))
        step = {r["b"]: r["g"] for r in part.unionByName(whole).groupBy("b").agg(F.sum("g").alias("g")).collect()}
        bias -= rate * step.pop(0, 0.0)
        for b, g in step.items():
            weights[b - 1] -= rate * (g + decay * weights[b - 1])
    return weights, bias


def labelled_urls(pages: DataFrame, rules=RULES, per_verdict: int = 500) -> DataFrame:
    """A small labelled table (url, verdict): of the distinct URLs that a rule settles, per verdict the `per_verdict`
    with the least hash. It serves training only; every URL is judged."""
    host, path = host_and_path(F.col("url"))
    known = pages.select("url", matching_rule(host, path, rules).alias("m")).where("m IS NOT NULL")
    known = known.groupBy("url").agg(F.first("m.verdict").alias("verdict"))
    out = None
    for verdict in ("allow", "block"):
        one = known.where(F.col("verdict") == verdict).orderBy(F.xxhash64("url"), "url").limit(per_verdict)
        out = one if out is None else out.unionByName(one)
    return out


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages (page_id, url; other columns are ignored).

    The verdict is that of the longest rule that fits, else block where the regression gives threshold or more. A
    null url or one without :// has empty host and path and is judged by the regression. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    weights, bias = train(labelled, **how)
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    score = _score(grams(F.col("host"), F.col("path"), len(weights)), [round(w, 9) for w in weights], bias)
    judged = split.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("score", F.round(score, 6))
    verdict = F.coalesce("m.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), "score")
