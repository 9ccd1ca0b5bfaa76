"""Profile building, lookups and checks of generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowhow.operators import grounding as G, profiles as P, ranking as R, reports as L4
from knowhow.plans.ingest import CAREER_ITEMS, CLIP
from knowhow.plans.people import common_keywords
from knowhow.plans.registry import query, view
from knowhow.plans.search import contribs, docs, people
from knowhow.session import cut_lineage
from knowhow.sources import loading as L

MARK = "."  # the corpus ends its sentences with a plain full stop


def squashed(t):
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


# ---- B: profiles ---------------------------------------------------------------------------------------------

view("v_note_parts", """
SELECT doc_id, place, t, 300 // count(*) OVER (PARTITION BY doc_id) AS share FROM (
  SELECT doc_id, place, """ + squashed("body") + """ AS t, row_number() OVER (PARTITION BY doc_id, place ORDER BY section_no) AS rn FROM (
    SELECT s.*, CASE WHEN d.doc_type = 'project' THEN list_position(['purpose', 'action', 'outcome'], section_role) ELSE list_position(['problem', 'action_plan'], section_role) END AS place
    FROM fx_sections_base s JOIN fx_documents d USING (doc_id)) WHERE place IS NOT NULL AND place > 0) WHERE rn = 1""")
view("v_note_bodies", "SELECT doc_id, string_agg(" + CLIP.format(t="t", n="share") + ", ' ' ORDER BY place) AS body FROM v_note_parts GROUP BY doc_id")


def bodies(c):
    return P.note_bodies(c.documents, c.raw_sections, mark=MARK)


@query("B1_note_bodies", "SELECT doc_id, body FROM v_note_bodies")
def _(c):
    return bodies(c)


view("v_labels", """
SELECT doc_id, CASE doc_type WHEN 'proposal' THEN concat('proposal (', result, ')') WHEN 'project' THEN concat('project (', pj_status, ')') ELSE 'idea' END AS label,
  CAST(coalesce(submitted_at, started_at) AS VARCHAR) AS note_date, CASE WHEN doc_type = 'project' THEN 'execution' ELSE 'ambition' END AS kind, title FROM fx_documents""")
view("v_doc_notes", """
SELECT a.emp_id, d.doc_id, d.kind, d.label, d.note_date, a.role, d.title, b.body, coalesce(t.tags, '') AS tags FROM v_labels d JOIN v_note_bodies b USING (doc_id)
JOIN fx_authors a USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(keyword, ' ' ORDER BY position) AS tags FROM v_tags GROUP BY 1) t USING (doc_id) WHERE b.body <> ''""")


def doc_notes(c):
    tags = P.document_tags(c.keywords, common_keywords(c))
    return P.document_notes(c.documents, bodies(c), c.authors, tags)


@query("B2_document_notes", "SELECT emp_id, doc_id, kind, label, note_date, role, title, body, tags FROM v_doc_notes")
def _(c):
    return doc_notes(c)


view("v_memos", """
SELECT e.emp_id, memo_kind, trim(body) AS body, CASE WHEN memo_kind <> 'effort' THEN updated_at END AS updated_at, '2025-11-03 09:30:00' AS created_at FROM (UNPIVOT (SELECT emp_no, updated_at, current_job, future_wish, effort FROM fx_career) ON current_job, future_wish, effort INTO NAME memo_kind VALUE body) m
JOIN fx_employees e USING (emp_no) WHERE trim(body) <> ''""")
view("v_own_notes", "SELECT emp_id, CAST(NULL AS BIGINT) AS doc_id, 'career' AS kind, memo_kind AS label, coalesce(updated_at, left(created_at, 10)) AS note_date, NULL AS role, NULL AS title, " + CLIP.format(t="t", n="1000") + """ AS body, '' AS tags
FROM (SELECT *, """ + squashed("body") + " AS t FROM v_memos)")


def memos(c):
    m = L.unpivot_items(c.career_sheets, ["emp_no", "updated_at"], CAREER_ITEMS)
    # Efforts were never changed since they were written.
    m = m.withColumn("updated_at", F.when(F.col("memo_kind") != "effort", F.col("updated_at"))).withColumn("created_at", F.lit("2025-11-03 09:30:00"))
    return m.join(c.employees.select("emp_id", "emp_no"), "emp_no")


def own_notes(c):
    return P.own_notes(memos(c), mark=MARK)


@query("B3_own_notes", "SELECT emp_id, label, note_date, body FROM v_own_notes")
def _(c):
    return own_notes(c).select("emp_id", "label", "note_date", "body")


view("v_summaries", "SELECT emp_id, doc_id, concat('Summary of ', doc_id) AS body FROM fx_authors WHERE role = 'lead'")
view("v_notes", """
SELECT n.* REPLACE (coalesce(s.body, n.body) AS body), s.body IS NOT NULL AS is_summary FROM v_doc_notes n LEFT JOIN v_summaries s USING (emp_id, doc_id)
UNION ALL SELECT *, false FROM v_own_notes""")


def summaries(c):
    return c.authors.where("role = 'lead'").select(
        "emp_id", "doc_id", F.concat(F.lit("Summary of "), F.col("doc_id").cast("string")).alias("body")
    )


def notes(c):
    return P.use_summaries(doc_notes(c).unionByName(own_notes(c)), summaries(c))


ASSEMBLE = """
SELECT t.emp_id, coalesce(p.profile_text, '') AS profile_text, coalesce(p.used, 0) AS used, t.notes FROM (SELECT emp_id, count(*) AS notes FROM {n} GROUP BY 1) t LEFT JOIN (
  SELECT emp_id, string_agg(text, chr(10) || chr(10) ORDER BY note_date, ord, label, text) AS profile_text, count(*) AS used FROM (
    SELECT *, sum(length(text) + 2) OVER (PARTITION BY emp_id ORDER BY note_date DESC, ord DESC, label DESC, text DESC ROWS UNBOUNDED PRECEDING) AS through FROM (
      SELECT emp_id, note_date, coalesce(doc_id, 0) AS ord, label, concat('[', kind, '|', label, '|', CASE WHEN kind <> 'career' THEN concat(role, '|') END, note_date, ']', title, chr(10), body,
        CASE WHEN tags <> '' THEN concat(chr(10), 'tags: ', tags) END) AS text FROM {n})) WHERE through <= {limit} + 2 GROUP BY 1) p USING (emp_id)"""
view("v_built", ASSEMBLE.format(n="v_notes", limit=6000))
view("v_short", ASSEMBLE.format(n="v_notes", limit=1500))
view("v_built_docs", ASSEMBLE.format(n="v_doc_notes", limit=6000))


def built(c):
    return P.assemble(notes(c))


@query("B4_assembled_profiles", "SELECT emp_id, md5(profile_text) AS digest, CAST(length(profile_text) AS BIGINT) AS len, used, notes FROM v_short")
def _(c):
    return P.assemble(notes(c), 1500).select(
        "emp_id", F.md5("profile_text").alias("digest"), F.length("profile_text").cast("long").alias("len"), "used", "notes"
    )


@query("B5_summary_override", "SELECT emp_id, doc_id, body, is_summary FROM v_notes WHERE doc_id IS NOT NULL")
def _(c):
    return notes(c).where("doc_id is not null").select("emp_id", "doc_id", "body", "is_summary")


view("v_stored_profiles", """
SELECT b.emp_id, b.profile_text, CASE WHEN e.is_active THEN '2026-01-01' END AS embedded_at FROM v_built_docs b JOIN fx_employees e USING (emp_id)""")


def stored_profiles(c):
    """An earlier build: documents only, and no vectors for people who have left."""
    b = P.assemble(doc_notes(c)).join(c.employees.select("emp_id", "is_active"), "emp_id")
    return b.select("emp_id", "profile_text", F.when(F.col("is_active"), F.lit("2026-01-01")).alias("embedded_at"))


@query("B6_profiles_to_rebuild", """
SELECT b.emp_id, s.emp_id IS NULL AS is_new FROM v_built b LEFT JOIN v_stored_profiles s USING (emp_id)
WHERE s.emp_id IS NULL OR s.profile_text <> b.profile_text OR s.embedded_at IS NULL""")
def _(c):
    return P.to_rebuild(built(c), stored_profiles(c)).select("emp_id", "is_new")


view("v_affected", "SELECT DISTINCT emp_id FROM fx_authors WHERE doc_id IN (SELECT doc_id FROM v_rev_docs)")


@query("B7_notes_to_write", """
SELECT emp_id, doc_id, body, 'excerpt' AS body_source FROM v_notes WHERE doc_id IS NOT NULL AND NOT is_summary AND emp_id IN (SELECT emp_id FROM v_affected)""")
def _(c):
    from knowhow.plans.ingest import registration

    stored = summaries(c).withColumn("body_source", F.lit("summary"))
    return P.notes_to_write(notes(c), stored, registration(c)["affected"])


@query("B8_build_statistics", """
SELECT count(*) AS people, CAST(sum(notes) AS BIGINT) AS notes, CAST(max(CASE WHEN rn = n // 2 + 1 THEN len END) AS BIGINT) AS median_len, CAST(max(len) AS BIGINT) AS max_len, count(*) FILTER (used < notes) AS cut_people
FROM (SELECT *, length(profile_text) AS len, row_number() OVER (ORDER BY length(profile_text)) AS rn, count(*) OVER () AS n FROM v_built)""")
def _(c):
    return P.build_statistics(built(c))


# ---- L: lookups ----------------------------------------------------------------------------------------------

@query("L1_person_documents", """
SELECT f.query_id, f.emp_id, d.doc_code, l.label, a.role, l.note_date AS doc_date, h.doc_id IS NOT NULL AS hit,
  row_number() OVER (PARTITION BY f.query_id, f.emp_id ORDER BY l.note_date DESC, a.doc_id) AS position, coalesce(m.items, '') AS career
FROM v_found f JOIN fx_authors a USING (emp_id) JOIN fx_documents d USING (doc_id) JOIN v_labels l USING (doc_id)
LEFT JOIN v_docs h ON h.query_id = f.query_id AND h.doc_id = a.doc_id
LEFT JOIN (SELECT emp_id, string_agg(DISTINCT memo_kind, ',' ORDER BY memo_kind) AS items FROM v_memos GROUP BY 1) m ON m.emp_id = f.emp_id""")
def _(c):
    found = R.frames(people(c))
    x = L4.person_documents(found, c.authors, c.documents, docs(c)).join(L4.career_items(memos(c)), "emp_id", "left")
    return x.select(
        "query_id", "emp_id", "doc_code", "label", "role", "doc_date", "hit", F.col("position").cast("long").alias("position"),
        F.coalesce("items", F.lit("")).alias("career"),
    )


view("v_found", """
SELECT query_id, emp_id, frame, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, frame ORDER BY score DESC, emp_id) AS position
  FROM (SELECT *, CASE WHEN proven THEN 'proven' ELSE 'hidden' END AS frame FROM v_people)) WHERE position <= 5""")


@query("L2_role_catalog", """
SELECT role, doc_type, n FROM (SELECT role, doc_type, count(*) AS n, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, doc_type DESC) AS rn
  FROM fx_authors JOIN fx_documents USING (doc_id) GROUP BY 1, 2) WHERE rn = 1""")
def _(c):
    return L4.role_catalog(c.authors, c.documents)


@query("L3_document_detail", """
SELECT d.doc_code, d.title, l.label, l.note_date AS doc_date, coalesce(p.part, '-') AS part, coalesce(p.item_no, 0) AS item_no, coalesce(p.item, '-') AS item, coalesce(p.role, '-') AS item_role
FROM fx_documents d JOIN v_labels l USING (doc_id)
LEFT JOIN (SELECT doc_id, 'author' AS part, 0 AS item_no, concat(emp_no, ' ', name) AS item, role FROM fx_authors JOIN fx_employees USING (emp_id)
  UNION ALL SELECT doc_id, 'section', section_no, section_name, section_role FROM fx_sections_base) p USING (doc_id)""")
def _(c):
    d = L4.document_detail(c.documents, c.authors, c.employees, c.raw_sections)
    dash = F.lit("-")
    return d.select(
        "doc_code", "title", "label", "doc_date", F.coalesce("part", dash).alias("part"),
        F.coalesce(F.col("item_no").cast("long"), F.lit(0)).alias("item_no"), F.coalesce("item", dash).alias("item"),
        F.coalesce("item_role", dash).alias("item_role"),
    )


@query("L4_person_notes", """
SELECT emp_id, source, note_date, row_number() OVER (PARTITION BY emp_id ORDER BY note_date, source) AS position FROM (
  SELECT n.emp_id, n.note_date, CASE WHEN n.doc_id IS NULL THEN concat('career:', n.label) ELSE d.doc_code END AS source FROM v_notes n LEFT JOIN fx_documents d USING (doc_id))""")
def _(c):
    return L4.person_material(notes(c), c.documents).select(
        "emp_id", "source", "note_date", F.col("position").cast("long").alias("position")
    )


@query("L4_full_texts", "SELECT query_id, emp_id, doc_id, md5(" + CLIP.format(t="t", n="1200") + """) AS digest FROM v_numbered n JOIN (
  SELECT doc_id, string_agg(""" + squashed("concat('■', section_name, chr(10), body)") + """, ' ' ORDER BY section_no) AS t FROM fx_sections_base GROUP BY 1) s USING (doc_id) WHERE place <= 3""")
def _(c):
    e = R.evidence(contribs(c))
    return L4.full_texts(e, c.raw_sections, mark=MARK).select("query_id", "emp_id", "doc_id", F.md5("full_text").alias("digest"))


# ---- G: grounding --------------------------------------------------------------------------------------------

view("v_claims", """
SELECT conv_id * 1000 + turn AS claim_id, emp_id, (['strength', 'track_record', 'ambition', 'caveat', 'relation'])[CAST(turn % 5 AS INT) + 1] AS section, turn AS seq,
  concat(CASE WHEN turn % 3 = 1 THEN 'この人は、' ELSE '' END, CASE WHEN turn % 2 = 0 THEN concat(text, ' ', turn * 7) ELSE text END) AS text, (['none', 'direct', 'partial'])[CAST(turn % 3 AS INT) + 1] AS level, s1.doc_code AS source1, s2.doc_code AS source2
FROM (SELECT *, conv_id * 3 % (SELECT count(*) FROM customer) AS emp_id FROM conversations) v
LEFT JOIN (SELECT emp_id, min(doc_id) AS doc_id FROM fx_authors GROUP BY 1) f USING (emp_id) LEFT JOIN fx_documents s1 ON s1.doc_id = f.doc_id LEFT JOIN fx_documents s2 ON s2.doc_id = v.conv_id""")


def claims(c):
    """Turns of the conversations as statements about a person; every third begins as models like to."""
    n = c._one_row("customer", "n")
    t = F.col("turn")
    v = c._with(c.table("conversations"), n).withColumn("emp_id", F.col("conv_id") * 3 % F.col("n"))
    first = c.authors.groupBy("emp_id").agg(F.min("doc_id").alias("doc_id"))
    code = c.documents.select("doc_id", "doc_code")
    v = v.join(first.join(code, "doc_id").select("emp_id", F.col("doc_code").alias("source1")), "emp_id", "left")
    v = v.join(code.select(F.col("doc_id").alias("conv_id"), F.col("doc_code").alias("source2")), "conv_id", "left")
    names = F.array(*[F.lit(x) for x in (G.STRENGTH, G.RECORD, G.AMBITION, G.CAVEAT, G.RELATION)])
    levels = F.array(*[F.lit(x) for x in ("none", "direct", "partial")])
    return v.select(
        (F.col("conv_id") * 1000 + t).alias("claim_id"), "emp_id", F.get(names, (t % 5).cast("int")).alias("section"),
        t.alias("seq"), F.concat(F.when(t % 3 == 1, "この人は、").otherwise(""), F.when(t % 2 == 0, F.concat("text", F.lit(" "), (t * 7).cast("string"))).otherwise(F.col("text"))).alias("text"),
        F.get(levels, (t % 3).cast("int")).alias("level"), F.array_compact(F.array("source1", "source2")).alias("sources"),
    )


view("v_material", """
SELECT a.emp_id, d.doc_code AS source, d.doc_id, d.doc_type, coalesce(d.result, d.pj_status) AS status, concat_ws(' ', d.title, l.note_date, n.body) AS text
FROM fx_authors a JOIN fx_documents d USING (doc_id) JOIN v_labels l USING (doc_id) LEFT JOIN v_notes n ON n.emp_id = a.emp_id AND n.doc_id = a.doc_id
WHERE a.emp_id IN (SELECT emp_id FROM v_claims)
UNION ALL SELECT emp_id, concat('career:', label), NULL, NULL, NULL, concat_ws(' ', body, note_date) FROM v_own_notes WHERE emp_id IN (SELECT emp_id FROM v_claims)""")


def material(c, people):
    """Notes and own notes of the people (emp_id); other people's are not built."""
    from knowhow.functions import derive as D

    authors = c.authors.join(people, "emp_id", "left_semi").select("emp_id", "doc_id")
    documents = c.documents.join(authors, "doc_id", "left_semi")
    d = documents.select(
        "doc_id", F.col("doc_code").alias("source"), "doc_type", D.doc_state().alias("status"),
        F.concat_ws(" ", "title", D.doc_date()).alias("text"),
    )
    null = F.lit(None).cast("string")
    own = own_notes(c).join(people, "emp_id", "left_semi").select(
        "emp_id", F.concat(F.lit("career:"), "label").alias("source"), F.lit(None).cast("long").alias("doc_id"),
        null.alias("doc_type"), null.alias("status"), F.concat_ws(" ", "body", "title", "note_date").alias("text"),
    )
    excerpt = P.note_bodies(documents, c.raw_sections, mark=MARK).where("body <> ''")
    docs_ = authors.join(d, "doc_id").join(excerpt, "doc_id", "left")
    docs_ = docs_.join(summaries(c).select("emp_id", "doc_id", F.col("body").alias("summary")), ["emp_id", "doc_id"], "left")
    note = F.when(F.col("body").isNotNull(), F.coalesce("summary", "body"))
    docs_ = docs_.withColumn("text", F.concat_ws(" ", "text", note)).select("emp_id", "source", "doc_id", "doc_type", "status", "text")
    return docs_.unionByName(own)


def section_texts(c):
    """(doc_id, text): every section in full."""
    return c.raw_sections.select("doc_id", F.concat_ws("\n", "section_name", "body").alias("text"))


NUMS = "list_distinct(regexp_extract_all(translate(text, '０１２３４５６７８９．', '0123456789.'), '[0-9]+(?:\\.[0-9]+)?'))"
view("v_judged", f"""
SELECT *, CASE WHEN section = 'relation' AND level = 'none' THEN '{G.NO_MATCH}' WHEN section = 'relation' AND level <> 'direct' THEN concat('{G.NOT_DIRECT}', regexp_replace(trim(text), '{G.OPENER}', '')) ELSE regexp_replace(trim(text), '{G.OPENER}', '') END AS stated,
  CASE WHEN section = 'strength' AND n_good = 0 THEN 'no document source' WHEN extra THEN 'number not in material'
    WHEN n_good = 0 AND section <> 'caveat' AND NOT (section = 'relation' AND level = 'none') THEN 'no source' END AS reason
FROM (SELECT c.*, coalesce(g.n, 0) AS n_good, coalesce(g.sources, '') AS good, c.claim_id IN (
    SELECT claim_id FROM (SELECT claim_id, emp_id, unnest({NUMS}) AS number FROM v_claims) s
    WHERE (emp_id, number) NOT IN (SELECT (emp_id, number) FROM (SELECT emp_id, unnest({NUMS}) AS number FROM v_material UNION
      SELECT a.emp_id, number FROM fx_authors a JOIN (SELECT doc_id, unnest({NUMS}) AS number FROM (SELECT doc_id, concat(section_name, chr(10), body) AS text FROM fx_sections_base)) USING (doc_id)
      WHERE number IN (SELECT unnest({NUMS}) FROM v_claims) AND a.emp_id IN (SELECT emp_id FROM v_claims)))) AS extra
  FROM v_claims c LEFT JOIN (
    SELECT claim_id, count(*) AS n, string_agg(source, ',' ORDER BY i) AS sources FROM (
      SELECT k.claim_id, k.source, min(k.i) AS i FROM (SELECT claim_id, emp_id, section, source1 AS source, 1 AS i FROM v_claims UNION ALL SELECT claim_id, emp_id, section, source2, 2 FROM v_claims) k
      JOIN v_material m ON m.emp_id = k.emp_id AND m.source = k.source WHERE k.section <> 'track_record' OR (m.doc_type = 'project' AND m.status IN ('done', 'running')) GROUP BY 1, 2) GROUP BY 1) g USING (claim_id))""")
view("v_verified", "SELECT *, " + CLIP.format(t="t", n="160") + """ AS shown FROM (SELECT j.*, """ + squashed("stated") + """ AS t,
  CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY emp_id, section, reason IS NULL ORDER BY seq, claim_id) END AS position FROM v_judged j)""")


def verified(c):
    # Both are read several times and written once, as the views behind them make a large plan.
    said = cut_lineage(claims(c))
    given = cut_lineage(material(c, said.select("emp_id").distinct()))
    return G.verify_claims(said, given, mark=MARK, full_texts=section_texts(c))


@query("G1_claim_verification", """
SELECT claim_id, section, coalesce(reason, '') AS reason, CASE WHEN position <= 3 THEN position ELSE 0 END AS position, shown, good AS sources,
  CASE WHEN reason IS NULL OR reason = 'no source' THEN array_to_string(list_filter([source1, source2], lambda x: x IS NOT NULL AND NOT list_contains(string_split(good, ','), x)), ',') ELSE '' END AS bad_sources
FROM v_verified""")
def _(c):
    return verified(c).select(
        "claim_id", "section", F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce(F.col("position").cast("long"), F.lit(0)).alias("position"), "shown", F.array_join("sources", ",").alias("sources"),
        F.array_join("bad_sources", ",").alias("bad_sources"),
    )


@query("G2_apply_verdicts", f"""
SELECT v.claim_id, CASE WHEN b.quality = 0 THEN concat(v.shown, '{G.PARTIAL_MARK}') ELSE v.shown END AS shown FROM v_verified v LEFT JOIN labels b ON b.doc_id = v.claim_id // 1000
WHERE v.position <= 3 AND coalesce(b.toxic, 0) = 0""")
def _(c):
    lab = c.table("labels").select(
        F.col("doc_id").alias("conv_id"), F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 0, "partial").otherwise("supported").alias("verdict")
    )
    kept = verified(c).where("position is not null").withColumn("conv_id", F.floor(F.col("claim_id") / 1000).cast("long"))
    v = kept.select("claim_id", "conv_id").join(lab, "conv_id").select("claim_id", "verdict")
    return G.apply_verdicts(kept, v).select("claim_id", "shown")


view("v_messages", """
SELECT doc_id AS message_id, concat(text, '。See KZ-0000-', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'), '。Also PJ-0000-', lpad(CAST(doc_id * 3 % 10000 AS VARCHAR), 4, '0'), '。End.') AS text FROM documents""")
view("v_allowed", """
SELECT m.doc_id AS message_id, d.doc_code AS code FROM documents m JOIN fx_documents d ON d.doc_id = m.doc_id OR d.doc_id = m.doc_id * 3""")


@query("G3_unknown_codes_dropped", r"""
SELECT message_id, md5(trim(coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT bad), ''))) AS kept, count(*) FILTER (bad) AS n_dropped, coalesce(string_agg(s, '' ORDER BY i) FILTER (bad), '') AS dropped FROM (
  SELECT message_id, i, s, len(list_filter(regexp_extract_all(s, '[A-Z]{2,5}-[0-9]{4}-[0-9]{4}'), lambda x: NOT list_contains(ok, x))) > 0 AS bad FROM (
    SELECT message_id, ok, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
      SELECT m.message_id, a.ok, regexp_extract_all(trim(m.text), '[^。！？\n]*[。！？\n]|[^。！？\n]+$') AS p FROM v_messages m JOIN (SELECT message_id, list(code) AS ok FROM v_allowed GROUP BY 1) a USING (message_id))))
GROUP BY 1""")
def _(c):
    d = c.table("documents")
    k = F.col("doc_id")

    def pad(x):
        return F.lpad((x % 10000).cast("string"), 4, "0")

    m = d.select(k.alias("message_id"), F.concat(
        "text", F.lit("。See KZ-0000-"), pad(k), F.lit("。Also PJ-0000-"), pad(k * 3), F.lit("。End.")).alias("text"))
    wanted = d.select(k.alias("message_id"), F.explode(F.array_distinct(F.array(k, k * 3))).alias("doc_id"))
    allowed = wanted.join(c.documents.select("doc_id", F.col("doc_code").alias("code")), "doc_id")
    out = G.drop_unknown_codes(m, allowed)
    return out.select("message_id", F.md5("kept_text").alias("kept"), "n_dropped", "dropped")


@query("G4_usable_experience", """
SELECT claim_id FROM v_verified WHERE position <= 3 AND section <> 'caveat' AND shown <> '' AND good <> '' AND NOT (section = 'relation' AND level = 'none')""")
def _(c):
    return G.usable_experience(verified(c).where("position is not null")).select("claim_id")
