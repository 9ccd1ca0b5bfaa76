"""Tokens, codes, n-grams and sentence pieces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowhow.constants import STOPWORDS

# Fixed patterns.
CODE = r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)+"
DOC_CODE = r"[A-Z]{2,5}-[0-9]{4}-[0-9]{4}"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
# A run is text without a break; its tokens are stretches of one script.
RUN = r"[\p{IsHan}々\p{IsKatakana}ー\p{N}\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]+"
TOKEN = r"[\p{IsHan}々]+|[\p{IsKatakana}ー]+|\p{N}+|[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]+"
NUMERAL = r"^\p{N}+$"
WIDE_DIGITS, DIGITS = "０１２３４５６７８９．", "0123456789."


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def codes(text) -> Column:
    """Part numbers and document codes, lower-cased, in order of appearance."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(CODE), F.lit(0)), F.lower)


def without_codes(text) -> Column:
    return F.regexp_replace(_c(text), CODE, " ")


def terms(text, stopwords=STOPWORDS) -> Column:
    """array<struct<term, kind>>: codes first, then the terms of each run in reading order."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")

    def usable(t):
        return ~F.array_contains(stop, t) & ~F.rlike(t, F.lit(NUMERAL))

    def tagged(words, kind):
        return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))

    def of_run(run):
        toks = F.regexp_extract_all(run, F.lit(TOKEN), F.lit(0))
        parts = F.filter(F.array_distinct(toks), lambda t: (F.length(t) >= 2) & usable(t))
        single = F.filter(F.array(run), usable)
        return F.when(F.size(toks) > 1, F.concat(tagged(F.array(run), "compound"), tagged(parts, "part"))).otherwise(
            tagged(single, "word")
        )

    runs = F.regexp_extract_all(F.lower(without_codes(text)), F.lit(RUN), F.lit(0))
    return F.concat(tagged(codes(text), "code"), F.flatten(F.transform(runs, of_run)))


def index_text(text) -> Column:
    return F.array_join(F.transform(terms(text), lambda t: t["term"]), " ")


def query_terms(text) -> Column:
    """Distinct search terms in order of first appearance."""
    return F.array_distinct(F.transform(terms(text), lambda t: t["term"]))


def plain_tokens(text) -> Column:
    """Lower-cased letter and digit stretches of two or more characters."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2)


def squeeze(text) -> Column:
    return F.regexp_replace(_c(text), r"\s+", "")


def ngrams(text, n: int) -> Column:
    """Character n-grams after removing white space.

    The text becomes an array of characters once: positions in a UTF-8 string are not constant time.
    """
    chars = F.split(squeeze(text), "")

    def grams(cs):
        count = F.size(cs) - (n - 1)
        positions = F.when(count >= 1, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(positions, lambda i: F.concat(*[F.get(cs, i + j) for j in range(n)]))

    return F.flatten(F.transform(F.array(chars), grams))


def numbers(text) -> Column:
    """Set of numbers in the text, full-width digits included."""
    return F.array_distinct(F.regexp_extract_all(F.translate(_c(text), WIDE_DIGITS, DIGITS), F.lit(NUMBER), F.lit(0)))


def doc_codes(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(DOC_CODE), F.lit(0))


def sentences(text) -> Column:
    """Pieces that end with their sentence mark or line break."""
    return F.filter(F.split(_c(text), r"(?<=[。！？\n])"), lambda s: s != "")


def squash(text) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def clip(text, limit: int, mark: str = "。") -> Column:
    """At most ``limit`` characters, cut after the last full stop unless that loses over half."""
    t = squash(text)
    head = F.substring(t, 1, limit)
    cut = F.when(
        F.locate(mark, head) > 0, F.length(head) - F.locate(mark, F.reverse(head)) + 1
    ).otherwise(F.lit(0))
    return (
        F.when(F.length(t) <= limit, t)
        .when(cut >= limit // 2, F.substring(head, F.lit(1), cut))
        .otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))
    )


def term_counts(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, term, n): how often each token occurs per key."""
    return df.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def keyword_counts(df: DataFrame, key: str, text, top_n: int = 5) -> DataFrame:
    """Most frequent terms per key; parts of compounds and one-letter terms do not count."""
    wanted = F.filter(terms(text), lambda t: (t["kind"] != "part") & (F.length(t["term"]) >= 2))
    counts = term_counts(df, [key], F.transform(wanted, lambda t: t["term"]))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
