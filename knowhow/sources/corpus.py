"""The document corpus as DataFrames.

``Corpus`` holds the base tables every operator works on. ``derived`` builds them from the star-schema and
text tables of a folder: all orders are documents, all customers employees, all order lines co-authorships
and all texts document sections; nothing is filtered out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowhow.functions import text as T
from knowhow.operators import inverted
from knowhow.session import cut_lineage
from knowhow.sources.stored import stored, version


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share the rows of a scan that has fewer splits than the cluster has cores.

    Long texts in a single file would otherwise be tokenised by one task; a scan with enough splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _pad(c, width):
    return F.lpad(c.cast("string"), width, "0")


class Corpus:
    #: Tables that stored ones are derived from.
    TABLES = ("nation", "customer", "orders", "lineitem", "documents", "embeddings", "benchmark")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def _read(self) -> dict:
        return {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            df = read(self.spark, self.folder, name)
            self._read[name] = spread(df, "doc_id") if name == "documents" else df
        return self._read[name]

    @cached_property
    def version(self) -> int:
        return version(self.spark, [f"{self.folder}/{t}.parquet" for t in self.TABLES])

    def stored(self, name: str, build, layout=None) -> DataFrame:
        """A table derived from this folder that every query of the session reads from where the first wrote it."""
        return stored(self.spark, (self.folder, self.version, name), build, layout)

    def once(self, name, build) -> DataFrame:
        """A short table that this query reads several times, computed once."""
        if name not in self._made:
            self._made[name] = cut_lineage(build())
        return self._made[name]

    @cached_property
    def _made(self) -> dict:
        return {}

    def _one_row(self, table: str, name: str) -> DataFrame:
        """Row count of a table as a one-row frame, joined to every row through a literal key."""
        return self.table(table).agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))

    def _with(self, df: DataFrame, *rows: DataFrame) -> DataFrame:
        df = df.withColumn("_one", F.lit(1))
        for r in rows:
            df = df.join(r, "_one")
        return df.drop("_one")

    @cached_property
    def departments(self) -> DataFrame:
        n, r = F.col("n_nationkey"), F.col("n_regionkey")
        func = F.concat(F.lit("func"), (n % 7).cast("string"))
        site = F.concat(F.lit("site"), r.cast("string"))
        return self.table("nation").select(
            n.cast("long").alias("dept_id"),
            F.concat(F.lit("D"), _pad(n, 3)).alias("dept_code"),
            F.when(r == 0, F.concat(func, F.lit("部")))
            .otherwise(F.concat(site, F.lit(" "), func, F.lit("課")))
            .alias("dept_name"),
            F.when(r == 0, "hq").when(r == 4, "branch").otherwise("plant").alias("dept_type"),
        )

    @cached_property
    def employees(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("emp_id"),
            _pad(F.col("c_custkey"), 5).alias("emp_no"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").cast("long").alias("dept_id"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        k, pri, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
        day = F.col("o_orderdate").cast("date")
        kind = F.when(k % 5 < 2, "proposal").when(k % 5 == 2, "project").otherwise("idea")
        prefix = F.when(k % 5 < 2, "KZ-").when(k % 5 == 2, "PJ-").otherwise("IDEA-")
        code = F.concat(prefix, _pad(F.floor(k / 10000), 4), F.lit("-"), _pad(k % 10000, 4))
        proposal, project = k % 5 < 2, k % 5 == 2
        result = (
            F.when(pri == "3-MEDIUM", "rejected").when(pri == "4-NOT SPECIFIED", "on_hold")
            .when(pri == "5-LOW", "in_review").otherwise("accepted")
        )
        status = (
            F.when(pri == "3-MEDIUM", "cancelled").when(pri == "4-NOT SPECIFIED", "running")
            .when(pri == "5-LOW", "planned").otherwise("done")
        )
        areas = F.array(*[F.lit(a) for a in ("efficiency", "cost", "delivery", "safety", "quality", "other")])
        return self.table("orders").select(
            k.alias("doc_id"),
            code.alias("doc_code"),
            kind.alias("doc_type"),
            F.when(proposal, "1-4").when(project, "2-1").otherwise("7-5").alias("doc_category"),
            F.concat(F.lit("Case "), code, F.lit(" "), F.lower(pri)).alias("title"),
            F.concat(code, F.lit(".docx")).alias("source_file"),
            F.when(~project, day).alias("submitted_at"),
            F.when(proposal, F.get(areas, (F.col("o_custkey") % 6).cast("int"))).alias("proposal_area"),
            F.when(proposal, result).alias("result"),
            F.when(proposal & (st != "O"), F.date_add(day, 30)).alias("decided_at"),
            F.when(proposal & (st == "F"), F.concat(F.lit("decided "), pri)).alias("result_reason"),
            F.when(project, status).alias("pj_status"),
            F.when(project, day).alias("started_at"),
            F.when(project, F.date_add(day, 180)).alias("planned_end_at"),
            F.when(project & (st == "F"), F.date_add(day, 200)).alias("ended_at"),
            F.when(project, (F.col("o_custkey") % 25).cast("long")).alias("owner_dept_id"),
            F.when(project, F.date_add(day, 210)).alias("updated_at"),
        )

    @cached_property
    def raw_sections(self) -> DataFrame:
        """Sections with the vector stored under their own id, null where there is none yet."""
        v = self.table("embeddings").select(F.col("vec_id").alias("section_id"), "embedding")
        return self._sections_base.join(v, "section_id", "left")

    @cached_property
    def _sections_base(self) -> DataFrame:
        s = F.col("section_id")
        doc = F.floor(s / 4).cast("long")
        j = s % 4
        role = (
            F.when(j == 0, "background")
            .when(j == 1, F.when(doc % 5 == 2, "purpose").otherwise("problem"))
            .when(j == 2, F.when(doc % 5 == 2, "action").otherwise("action_plan"))
            .otherwise(F.when(doc % 5 == 2, "outcome").otherwise("goal"))
        )
        return self.table("documents").select(F.col("doc_id").alias("section_id"), F.col("text").alias("body")).select(
            "section_id", doc.alias("doc_id"), (j + 1).cast("int").alias("section_no"), role.alias("section_role"),
            F.concat(F.lit("Part "), F.initcap(role)).alias("section_name"), "body",
        )

    @cached_property
    def sections(self) -> DataFrame:
        """Every section with a vector: a blend of two stored ones, so that neighbours are related."""
        n = self._one_row("embeddings", "n")
        s = self._with(self._sections_base, n)
        ia = F.col("section_id") % F.col("n")
        ib = (F.col("section_id") + 1 + 37 * F.floor(F.col("section_id") / F.col("n"))) % F.col("n")
        s = s.withColumn("ia", ia).withColumn("ib", ib.cast("long"))
        v = self.table("embeddings")
        s = s.join(v.select(F.col("vec_id").alias("ia"), F.col("embedding").alias("va")), "ia")
        s = s.join(v.select(F.col("vec_id").alias("ib"), F.col("embedding").alias("vb")), "ib")
        mix = F.zip_with("va", "vb", lambda x, y: (x.cast("double") + F.lit(0.5) * y.cast("double")).cast("float"))
        return s.select(
            "section_id", "doc_id", "section_no", "section_role", "section_name", "body", mix.alias("embedding")
        )

    @cached_property
    def section_documents(self) -> DataFrame:
        return self._sections_base.select("section_id", "doc_id")

    @cached_property
    def section_vectors(self) -> DataFrame:
        return self.sections.select("section_id", "doc_id", "section_role", "embedding")

    @cached_property
    def authors(self) -> DataFrame:
        """(doc_id, emp_id, role, dept_id_at_time), each author of a document once; a stored table, as most queries read it several times."""
        return self.stored("authors", self._authors)

    def _authors(self) -> DataFrame:
        n = self._one_row("customer", "n")
        lead = self.table("orders").select(
            F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("emp_id"), F.lit(0).alias("ln")
        )
        lines = self._with(self.table("lineitem"), n).select(
            F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % F.col("n")).alias("emp_id"),
            F.col("l_linenumber").alias("ln"),
        )
        a = lead.unionByName(lines).groupBy("doc_id", "emp_id").agg(F.min("ln").alias("ln"))
        k = F.col("doc_id")
        role = (
            F.when(k % 5 < 2, "proposer").when(k % 5 > 2, "poster")
            .when(F.col("ln") == 0, "lead").when(F.col("ln") % 3 == 0, "owner").otherwise("member")
        )
        dept = self.employees.select("emp_id", "dept_id")
        then = F.when((k + F.col("emp_id")) % 10 == 0, (F.col("dept_id") + 1) % 25).otherwise(F.col("dept_id"))
        return a.join(dept, "emp_id").select("doc_id", "emp_id", role.alias("role"), then.alias("dept_id_at_time"))

    @cached_property
    def terms(self) -> DataFrame:
        """(section_id, doc_id, term, n)"""
        return T.term_counts(self._sections_base, ["section_id", "doc_id"], T.plain_tokens("body"))

    def _by_document(self, tokens) -> DataFrame:
        """(doc_id, term, n): texts are dealt by document before they are tokenised, so that the many rows of terms stay where they form."""
        sc, conf = self.spark.sparkContext, self.spark.conf
        tasks = max(2 * sc.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
        return T.term_counts(self._sections_base.select("doc_id", "body").repartition(tasks, "doc_id"), ["doc_id"], tokens)

    @cached_property
    def document_terms(self) -> DataFrame:
        """(doc_id, term, n) of plain tokens."""
        return self._by_document(T.plain_tokens("body"))

    @cached_property
    def document_words(self) -> DataFrame:
        """(doc_id, term, n) of search terms, a document's rows side by side; a stored table."""
        return self.stored("document_words", lambda: self._by_document(F.transform(T.terms("body"), lambda t: t["term"])).sortWithinPartitions("doc_id"))

    @cached_property
    def index(self) -> DataFrame:
        """Search terms of all sections (part, term, section_id, doc_id, n), see operators.inverted."""
        return self.stored("index", lambda: inverted.postings(self._sections_base), inverted.by_part)

    @cached_property
    def keywords(self) -> DataFrame:
        """(doc_id, keyword, count): the five most frequent words of four letters and more."""
        from pyspark.sql import Window

        def build():
            c = self.document_terms.where(F.length("term") >= 4).withColumnRenamed("n", "count")
            w = Window.partitionBy("doc_id").orderBy(F.desc("count"), "term")
            return c.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select(
                "doc_id", F.col("term").alias("keyword"), "count"
            )

        return self.stored("keywords", build)

    @cached_property
    def queries(self) -> DataFrame:
        """(query_id, text, qvec, searcher)"""
        b = self._with(self.table("benchmark"), self._one_row("embeddings", "n"), self._one_row("customer", "m"))
        b = b.select(
            F.col("item_id").alias("query_id"), "text", ((F.col("item_id") * 11) % F.col("n")).alias("src"),
            ((F.col("item_id") * 13) % F.col("m")).alias("searcher"),
        )
        v = self.table("embeddings").select(F.col("vec_id").alias("src"), F.col("embedding").alias("qvec"))
        return b.join(v, "src")

    @cached_property
    def gold_docs(self) -> DataFrame:
        """(query_id, doc_id, expected): documents built on the query's vector, and as many unrelated ones."""
        n = self._one_row("embeddings", "n")
        s = self._with(self._sections_base.select("section_id", "doc_id"), n)
        q = self.queries.select("query_id", "src")
        pos = s.select((F.col("section_id") % F.col("n")).alias("src"), "doc_id").join(q, "src")
        neg = s.select(
            ((F.col("section_id") + F.floor(F.col("n") / 2)) % F.col("n")).alias("src"), "doc_id"
        ).join(q, "src")
        return (
            pos.select("query_id", "doc_id", F.lit(True).alias("expected"))
            .unionByName(neg.select("query_id", "doc_id", F.lit(False).alias("expected")))
            .distinct()
        )

    @cached_property
    def gold_people(self) -> DataFrame:
        return self.gold_docs.where("expected").join(self.authors, "doc_id").select("query_id", "emp_id").distinct()

    @cached_property
    def profiles(self) -> DataFrame:
        """(emp_id, vec): role-weighted mean of the person's document vectors, a stored table."""
        from knowhow.operators.ranking import person_vectors

        return self.stored("profiles", lambda: person_vectors(self.section_vectors, self.authors))

    @cached_property
    def career_sheets(self) -> DataFrame:
        """Wide self-written sheets: conversation turns of an employee, one column per item."""
        n = self._one_row("customer", "n")
        c = self._with(self.table("conversations"), n)
        return c.groupBy((F.col("conv_id") * 3 % F.col("n")).alias("emp_key"), "conv_id").agg(
            F.max(F.when(F.col("turn") % 3 == 0, F.struct("turn", "text")))["text"].alias("current_job"),
            F.max(F.when(F.col("turn") % 3 == 1, F.struct("turn", "text")))["text"].alias("future_wish"),
            F.max(F.when(F.col("turn") % 3 == 2, F.struct("turn", "text")))["text"].alias("effort"),
        ).select(
            _pad(F.col("emp_key"), 5).alias("emp_no"), "conv_id", "current_job", "future_wish", "effort",
            F.lit("2026-04-01").alias("updated_at"),
        )


class Incoming:
    """A batch as it arrives: text values, blanks, wrong codes, repeated people and unknown keys included."""

    SECTION_NAMES = (
        "current_state", "issue", "proposal", "expected_effect", "obstacle", "background", "purpose", "work", "outcome",
        "misc",
    )

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    @cached_property
    def documents(self) -> DataFrame:
        c = self.corpus
        o = c.table("orders").select(
            F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
        )
        d = c.documents.join(o, "doc_id")
        price, st = F.col("o_totalprice"), F.col("o_orderstatus")
        prefix = F.concat(F.split("doc_code", "-")[0], F.lit("-"))
        code = F.concat(prefix, F.when(price < 10000, "26-").otherwise("2026-"), _pad(F.col("o_custkey") % 10000, 4))
        sub = F.col("submitted_at")
        local = F.concat(
            F.year(sub).cast("string"), F.lit("年"), F.month(sub).cast("string"), F.lit("月"),
            F.dayofmonth(sub).cast("string"), F.lit("日"),
        )
        name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".docx"))
        name = (
            F.when((st == "P") & (F.col("o_orderpriority") == "1-URGENT"), F.concat(F.lit("~$"), name))
            .when((st == "P") & (F.col("o_orderpriority") == "2-HIGH"), F.regexp_replace(name, "docx$", "xlsx"))
            .otherwise(name)
        )
        return d.select(
            F.col("doc_id").alias("file_id"), name.alias("file_name"), code.alias("doc_code"), "doc_type",
            F.when(price < 30000, "  ").when(price > 480000, F.repeat(F.concat("title", F.lit(" ")), 10))
            .otherwise(F.col("title")).alias("title"),
            F.when(st == "P", local).otherwise(sub.cast("string")).alias("submitted_at"),
            F.when((price >= 200000) & (price < 210000) & F.col("proposal_area").isNotNull(), "misc")
            .otherwise(F.col("proposal_area")).alias("proposal_area"),
            "result", F.col("decided_at").cast("string").alias("decided_at"), "result_reason", "pj_status",
            F.col("started_at").cast("string").alias("started_at"),
            F.col("planned_end_at").cast("string").alias("planned_end_at"),
            F.col("ended_at").cast("string").alias("ended_at"),
            F.when(F.col("doc_type") == "project", F.concat(F.lit("D"), _pad(F.col("o_custkey") % 27, 3))).alias("owner_dept"),
            F.when(price >= 20000, F.col("updated_at").cast("string")).alias("updated_at"),
            name.alias("source_file"),
        )

    @cached_property
    def authors(self) -> DataFrame:
        ln = F.col("l_linenumber")
        role = F.when(ln % 4 == 0, "owner").when(ln % 4 == 1, "lead").when(ln % 4 == 2, "member").otherwise("proposer")
        who = F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).otherwise(F.col("l_suppkey"))
        return self.corpus.table("lineitem").select(
            F.col("l_orderkey").alias("file_id"), role.alias("role"), _pad(F.col("l_partkey"), 5).alias("emp_no"),
            F.concat(F.lit("Customer#"), _pad(who, 9)).alias("name"),
            F.concat(F.lit("D"), _pad(F.col("l_suppkey") % 27, 3)).alias("dept_code"),
        )

    @cached_property
    def sections(self) -> DataFrame:
        names = F.array(*[F.lit(n) for n in self.SECTION_NAMES])
        return self.corpus.table("documents").select(
            F.floor(F.col("doc_id") / 4).cast("long").alias("file_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("section_no"),
            F.get(names, (F.col("n_chars") % 10).cast("int")).alias("section_name"), F.col("text").alias("body"),
        )
