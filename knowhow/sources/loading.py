"""Reading, cleaning, keying, merging and writing of document tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from knowhow import constants as K
from knowhow.functions import text as T
from knowhow.functions.vector import parse_vector, unit


def read_json(spark: SparkSession, path: str, schema: str, names: dict[str, str | None], multi_line: bool = False) -> DataFrame:
    """Bulk JSON whose keys may carry the new or the old name: {column: old name or None}."""
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return rename_old_keys(raw, names)


def rename_old_keys(raw: DataFrame, names: dict[str, str | None]) -> DataFrame:
    cols = []
    for new, old in names.items():
        have = [F.col(n) for n in (new, old) if n and n in raw.columns]
        cols.append((F.coalesce(*have) if have else F.lit(None)).alias(new))
    return raw.select(*cols)


def clean(df: DataFrame) -> DataFrame:
    """Trim text and turn empty text into null; other types pass through."""
    return df.select(*[
        F.when(F.trim(f.name) != "", F.trim(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def section_vectors(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Embedded sections with their document's code, title and type, and a unit vector."""
    s = sections.where(F.col("embedding").isNotNull())
    if dict(s.dtypes)["embedding"] == "string":
        s = s.withColumn("embedding", parse_vector("embedding"))
    d = documents.select("doc_id", "doc_code", "title", "doc_type")
    return s.join(d, "doc_id", "left").withColumn("embedding", unit("embedding"))


def profile_vectors(profiles: DataFrame, vectors_only: bool = False) -> DataFrame:
    """Profiles with parsed unit vectors; people without one are kept for their text unless vectors_only."""
    p = profiles
    if dict(p.dtypes)["embedding"] == "string":
        p = p.withColumn("embedding", parse_vector("embedding"))
    p = p.where(F.col("embedding").isNotNull()) if vectors_only else p
    return p.withColumn("embedding", F.when(F.col("embedding").isNotNull(), unit("embedding")))


def embedding_input(title="title", name="section_name", body="body"):
    return F.concat_ws(" / ", F.col(title), F.col(name), F.col(body))


def to_embed(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections without a vector yet, with the text a model would get."""
    s = sections.where(F.col("embedding").isNull()).join(documents.select("doc_id", "title"), "doc_id")
    return s.select("section_id", "doc_id", embedding_input().alias("text"))


def embedding_cost(pending: DataFrame) -> DataFrame:
    return pending.agg(F.count(F.lit(1)).alias("sections"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).withColumn(
        "usd", F.col("chars") * K.TOKENS_PER_CHAR / 1e6 * K.USD_PER_MTOKEN
    )


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose vector is not in the cache."""
    return texts.select("text").distinct().join(cache.select("text"), "text", "left_anti")


def embed(texts: DataFrame, model: Callable[[pd.Series], list], column: str = "text") -> DataFrame:
    """Add vectors with a caller's model; the model sees one Arrow batch of texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(embedding=list(model(pdf[column])))

    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes)
    return texts.mapInPandas(run, f"{schema}, embedding array<float>")


def map_codes(rows: DataFrame, parent: DataFrame, code: str, surrogate: str, parent_code: str | None = None) -> DataFrame:
    """Replace a code column by the parent's surrogate id (rows of unknown parents keep null)."""
    p = parent.select(F.col(parent_code or code).alias(code), F.col(surrogate))
    return rows.join(p, code, "left").drop(code)


def existing_codes(incoming: DataFrame, stored: DataFrame, code: str = "doc_code") -> DataFrame:
    return stored.join(incoming.select(code), code, "left_semi")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last one by ``order``; combined before the shuffle, so repeated keys cost nothing."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored rows with the same key."""
    kept = stored.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming.select(*stored.columns))


def registered_ids(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """Arrivals (doc_id, doc_code, ...) under the ids they are stored by: the code says which document it is.

    A known code takes the stored document's id, whatever id it arrives with. A new code keeps its own id unless that
    is null, belongs to another stored code or comes with several codes; then it gets one of at least 2**62 that
    follows from the code, the same on every run.
    """
    known = stored.select("doc_code", F.col("doc_id").alias("_known"))
    taken = stored.select("doc_id", F.lit(True).alias("_taken"))
    several = arrivals.groupBy("doc_id").agg(F.count_distinct("doc_code").alias("_codes"))
    x = arrivals.join(known, "doc_code", "left").join(taken, "doc_id", "left").join(several, "doc_id", "left")
    made = F.pmod(F.xxhash64("doc_code"), F.lit(1 << 62)) + F.lit(1 << 62)
    own = F.when(F.col("_taken").isNull() & (F.col("_codes") == 1), F.col("doc_id"))
    return x.withColumn("doc_id", F.coalesce("_known", own, made)).select(*arrivals.columns)


def merge_registration(stored: dict[str, DataFrame], docs: DataFrame, sections: DataFrame, authors: DataFrame,
                       keywords: DataFrame) -> dict[str, DataFrame]:
    """Register new versions of documents over the stored tables.

    Sections keep their id, lose their vector and are cut at the new length; authors are replaced except that
    kept ones stay in place; keywords are replaced. ``affected`` lists everybody whose profile must be rebuilt;
    ``changed`` has the new rows of each table by themselves. Ids are those of ``registered_ids``.
    """
    ids = docs.select("doc_id").distinct()
    new_sections = sections.join(
        stored["sections"].select("doc_id", "section_no", "section_id"), ["doc_id", "section_no"], "left"
    ).withColumn("embedding", F.lit(None).cast(dict(stored["sections"].dtypes)["embedding"]))
    old_authors = stored["authors"].join(ids, "doc_id", "left_semi")
    removed = old_authors.join(authors.select("doc_id", "emp_id"), ["doc_id", "emp_id"], "left_anti")
    counts = ids
    changed = {"documents": docs, "sections": new_sections, "authors": authors, "keywords": keywords}
    changed = {t: df.select(*stored[t].columns) for t, df in changed.items()}
    old_sections = stored["sections"].join(ids, "doc_id", "left_semi")
    dropped = old_sections.join(sections.select("doc_id", "section_no"), ["doc_id", "section_no"], "left_anti")
    for name, df in (("sections", sections), ("authors", authors), ("keywords", keywords),
                     ("removed_sections", dropped), ("removed_authors", removed)):
        counts = counts.join(df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left")
    tables = {t: stored[t].join(ids, "doc_id", "left_anti").unionByName(df) for t, df in changed.items()}
    affected = authors.select("emp_id").unionByName(removed.select("emp_id")).distinct()
    return tables | {"counts": counts.na.fill(0), "affected": affected, "changed": changed}


def document_keywords(docs: DataFrame, sections: DataFrame, top_n: int = 5) -> DataFrame:
    """Keywords of title and all section bodies; counted per text first, so no document is glued together."""
    texts = docs.select("doc_id", F.col("title").alias("text")).unionByName(
        sections.select("doc_id", F.col("body").alias("text"))
    ).where(F.col("text").isNotNull())
    return T.keyword_counts(texts, "doc_id", "text", top_n).select(
        "doc_id", F.col("term").alias("keyword"), F.col("n").alias("count")
    )


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def unpivot_items(sheets: DataFrame, ids: list[str], items: list[str]) -> DataFrame:
    """One row per filled item of a wide sheet."""
    return sheets.unpivot(ids, items, "memo_kind", "body").withColumn("body", F.trim("body")).where(
        F.col("body").isNotNull() & (F.col("body") != "")
    )


BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">])*>"""
# An end tag of h1 without a heading before it ends no line.
BLOCK_TAG = rf"(?i)</?(?:{'|'.join(b for b in BLOCKS if b != 'h1')})(?![a-z0-9]){ATTRIBUTES}"
WHITE = r"[ \t\n\r\f\x0B]+"
CELL, LINE = "\u0001", "\u0002"


def _character(number: Column) -> Column:
    """The character with this code; the replacement character where there is none."""
    fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    code = F.unhex(F.lpad(F.hex(F.when(fine, number).otherwise(F.lit(0xFFFD)).cast("long")), 8, "0"))
    return F.decode(code, "UTF-32")


def decoded_entities(text: Column, closed: bool = False) -> Column:
    """Character references replaced, each once: numbers, and the named ones of HTML 4. Others stay as they are.

    With ``closed`` a reference counts only with its semicolon.
    """
    reference = "^(#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,8}|[A-Za-z0-9]+);" + ("" if closed else "?")
    names = F.create_map(*[x for n, c in sorted(name2codepoint.items()) for x in (F.lit(n), F.lit(chr(c)))])

    def one(piece):
        name = F.regexp_extract(piece, reference, 1)
        tail = F.regexp_replace(piece, reference, "")
        hexa = F.conv(F.regexp_extract(name, "^#[xX](.*)$", 1), 16, 10).cast("long")
        number = F.regexp_extract(name, "^#([0-9]+)$", 1).try_cast("long")
        known = F.when(name.rlike("^#[xX]"), _character(hexa)).when(name.startswith("#"), _character(number)).otherwise(F.try_element_at(names, name))
        return F.when(known.isNotNull(), F.concat(known, tail)).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))


def _without_tags(text: Column) -> Column:
    return F.regexp_replace(text, rf"</?[a-zA-Z]{ATTRIBUTES}", "")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def split_sections(docs: DataFrame, key: str, html: str, closed: bool = False) -> DataFrame:
    """(key, section_no, section_name, body): level-1 headings with all text below them, up to the next.

    Text before the first heading is ignored. Ends of blocks (paragraphs, list items, table rows, line breaks) and
    line breaks in pre become line breaks, cells of a row are parted by " | ", other tags fall away, entities are decoded,
    white space is squeezed, empty lines, comments, scripts and styles are left out. A null page has no sections.
    As in browsers, an entity may lack its semicolon, unless ``closed``: then a text cut inside one keeps the rest of it.
    """
    seen = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<!(?!--)[^>]*>", "")
    pieces = F.split(seen, r"(?i)(?=<pre\b)|(?<=</pre>)")
    lined = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"(?i)^<pre\b"), F.replace(x, F.lit("\n"), F.lit("<br>"))).otherwise(x)), "")
    parts = F.split(F.regexp_replace(lined, WHITE, " "), rf"(?i)<h1(?![a-z0-9]){ATTRIBUTES}")
    s = docs.select(key, F.posexplode(parts).alias("section_no", "part")).where("section_no > 0")
    # A heading ends at its end tag, or where a block begins.
    end = F.regexp_instr("part", F.lit(rf"(?i)</h1(?![a-z0-9]){ATTRIBUTES}|<(?:{'|'.join(BLOCKS)})(?![a-z0-9]){ATTRIBUTES}"))
    name = F.when(end > 0, F.substring("part", F.lit(1), end - 1)).otherwise(F.col("part"))
    rest = F.when(end > 0, F.substr("part", end)).otherwise(F.lit(""))
    name = _squeezed(decoded_entities(_without_tags(F.regexp_replace(name, rf"(?i)<br(?![a-z0-9]){ATTRIBUTES}", " ")), closed))
    rest = F.regexp_replace(rest, rf"(?i)<br(?![a-z0-9]){ATTRIBUTES}|{BLOCK_TAG}", LINE)
    rest = _without_tags(F.regexp_replace(rest, rf"(?i)<t[dh](?![a-z0-9]){ATTRIBUTES}", CELL))
    lines = F.transform(F.split(decoded_entities(rest, closed), LINE), lambda x: _squeezed(F.replace(F.regexp_replace(x, rf"^[ {CELL}]+", ""), F.lit(CELL), F.lit(" | "))))
    body = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return s.select(key, "section_no", name.alias("section_name"), body.alias("body"))


# A cell that is only figures, units and date marks (fixed pattern).
NUMERIC_CELL = r"^[0-9,.%約件時間分回社—QY\s〜年月平均]+$"


def wordy_tables(docs: DataFrame, key: str, text: str, separator: str = " | ") -> DataFrame:
    """Rows of tabular text as sentences, unless at least half of the cells are figures.

    Also returns how many cells and figures there are; ``sentences`` is null for dropped tables.
    """
    def cells_of(line):
        # A bare F.trim would get the place of the cell as the characters to trim.
        return F.transform(F.split(line, r" \| "), lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+$", ""))

    lines = F.filter(F.split(F.col(text), "\n"), lambda l: F.instr(l, separator) > 0)
    t = docs.select(key, lines.alias("lines")).where(F.size("lines") > 0)
    cells = F.flatten(F.transform("lines", cells_of))
    t = t.withColumn("cells", cells).withColumn("n_cells", F.size("cells").cast("long"))
    t = t.withColumn("n_numeric", F.size(F.filter("cells", lambda c: F.rlike(c, F.lit(NUMERIC_CELL)))).cast("long"))
    keep = F.col("n_numeric") / F.col("n_cells") < 0.5
    rows = F.transform("lines", lambda l: F.array_join(cells_of(l), "："))
    return t.select(key, "n_cells", "n_numeric", F.when(keep, F.array_join(rows, "\n")).alias("sentences"))
