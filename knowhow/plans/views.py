"""The corpus as SQL views, written independently of the DataFrame version for checking."""

from knowhow.plans.registry import view

view("fx_departments", """
SELECT CAST(n_nationkey AS BIGINT) AS dept_id, concat('D', lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) AS dept_code,
  CASE WHEN n_regionkey = 0 THEN concat('func', n_nationkey % 7, '部')
       ELSE concat('site', n_regionkey, ' func', n_nationkey % 7, '課') END AS dept_name,
  CASE WHEN n_regionkey = 0 THEN 'hq' WHEN n_regionkey = 4 THEN 'branch' ELSE 'plant' END AS dept_type
FROM nation""")

view("fx_employees", """
SELECT c_custkey AS emp_id, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS emp_no, c_name AS name,
  CAST(c_nationkey AS BIGINT) AS dept_id, c_acctbal >= 0 AS is_active FROM customer""")

view("fx_documents", """
SELECT o_orderkey AS doc_id, code AS doc_code, kind AS doc_type,
  CASE kind WHEN 'proposal' THEN '1-4' WHEN 'project' THEN '2-1' ELSE '7-5' END AS doc_category,
  concat('Case ', code, ' ', lower(o_orderpriority)) AS title, concat(code, '.docx') AS source_file,
  CASE WHEN kind <> 'project' THEN day END AS submitted_at,
  CASE WHEN kind = 'proposal' THEN (['efficiency','cost','delivery','safety','quality','other'])[CAST(o_custkey % 6 AS INT) + 1] END AS proposal_area,
  CASE WHEN kind = 'proposal' THEN CASE o_orderpriority WHEN '3-MEDIUM' THEN 'rejected' WHEN '4-NOT SPECIFIED' THEN 'on_hold' WHEN '5-LOW' THEN 'in_review' ELSE 'accepted' END END AS result,
  CASE WHEN kind = 'proposal' AND o_orderstatus <> 'O' THEN day + 30 END AS decided_at,
  CASE WHEN kind = 'proposal' AND o_orderstatus = 'F' THEN concat('decided ', o_orderpriority) END AS result_reason,
  CASE WHEN kind = 'project' THEN CASE o_orderpriority WHEN '3-MEDIUM' THEN 'cancelled' WHEN '4-NOT SPECIFIED' THEN 'running' WHEN '5-LOW' THEN 'planned' ELSE 'done' END END AS pj_status,
  CASE WHEN kind = 'project' THEN day END AS started_at,
  CASE WHEN kind = 'project' THEN day + 180 END AS planned_end_at,
  CASE WHEN kind = 'project' AND o_orderstatus = 'F' THEN day + 200 END AS ended_at,
  CASE WHEN kind = 'project' THEN o_custkey % 25 END AS owner_dept_id,
  CASE WHEN kind = 'project' THEN day + 210 END AS updated_at
FROM (SELECT *, CAST(o_orderdate AS DATE) AS day,
  CASE WHEN o_orderkey % 5 < 2 THEN 'proposal' WHEN o_orderkey % 5 = 2 THEN 'project' ELSE 'idea' END AS kind,
  concat(CASE WHEN o_orderkey % 5 < 2 THEN 'KZ-' WHEN o_orderkey % 5 = 2 THEN 'PJ-' ELSE 'IDEA-' END,
    lpad(CAST(o_orderkey // 10000 AS VARCHAR), 4, '0'), '-', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')) AS code
  FROM orders)""")

view("fx_sections_base", """
SELECT section_id, doc_id, section_no, section_role,
  concat('Part ', upper(section_role[1]), section_role[2:]) AS section_name, body
FROM (SELECT doc_id AS section_id, doc_id // 4 AS doc_id, CAST(doc_id % 4 + 1 AS INT) AS section_no,
  CASE doc_id % 4 WHEN 0 THEN 'background'
    WHEN 1 THEN CASE WHEN (doc_id // 4) % 5 = 2 THEN 'purpose' ELSE 'problem' END
    WHEN 2 THEN CASE WHEN (doc_id // 4) % 5 = 2 THEN 'action' ELSE 'action_plan' END
    ELSE CASE WHEN (doc_id // 4) % 5 = 2 THEN 'outcome' ELSE 'goal' END END AS section_role,
  text AS body FROM documents)""")

view("fx_raw_sections", """
SELECT s.*, e.embedding FROM fx_sections_base s LEFT JOIN embeddings e ON e.vec_id = s.section_id""")

view("fx_sections", """
SELECT s.section_id, s.doc_id, s.section_no, s.section_role, s.section_name, s.body,
  list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(CAST(p[1] AS DOUBLE) + 0.5 * CAST(p[2] AS DOUBLE) AS FLOAT)) AS embedding
FROM fx_sections_base s CROSS JOIN (SELECT count(*) AS n FROM embeddings) c
JOIN embeddings a ON a.vec_id = s.section_id % c.n
JOIN embeddings b ON b.vec_id = (s.section_id + 1 + 37 * (s.section_id // c.n)) % c.n""")

# Unit vectors in double precision.
view("fx_unit", """
SELECT section_id, doc_id, section_role, list_transform(w, lambda x: x / nn) AS u
FROM (SELECT *, CASE WHEN sqrt(list_dot_product(w, w)) = 0 THEN 1 ELSE sqrt(list_dot_product(w, w)) END AS nn
      FROM (SELECT section_id, doc_id, section_role, CAST(embedding AS DOUBLE[]) AS w FROM fx_sections))""")

view("fx_authors", """
SELECT a.doc_id, a.emp_id,
  CASE WHEN a.doc_id % 5 < 2 THEN 'proposer' WHEN a.doc_id % 5 > 2 THEN 'poster'
       WHEN a.ln = 0 THEN 'lead' WHEN a.ln % 3 = 0 THEN 'owner' ELSE 'member' END AS role,
  CASE WHEN (a.doc_id + a.emp_id) % 10 = 0 THEN (e.dept_id + 1) % 25 ELSE e.dept_id END AS dept_id_at_time
FROM (SELECT doc_id, emp_id, min(ln) AS ln FROM (
        SELECT o_orderkey AS doc_id, o_custkey AS emp_id, 0 AS ln FROM orders
        UNION ALL SELECT l_orderkey, l_partkey % (SELECT count(*) FROM customer), l_linenumber FROM lineitem)
      GROUP BY doc_id, emp_id) a JOIN fx_employees e ON e.emp_id = a.emp_id""")

view("fx_terms", r"""
SELECT section_id, doc_id, term, count(*) AS n FROM (
  SELECT section_id, doc_id, unnest(string_split_regex(lower(body), '[^\p{L}\p{N}]+')) AS term FROM fx_sections_base) t
WHERE length(term) >= 2 GROUP BY section_id, doc_id, term""")

view("fx_keywords", """
SELECT doc_id, term AS keyword, n AS count FROM (
  SELECT doc_id, term, sum(n) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sum(n) DESC, term) AS rn
  FROM fx_terms WHERE length(term) >= 4 GROUP BY doc_id, term) WHERE rn <= 5""")

view("fx_queries", """
SELECT b.item_id AS query_id, b.text, (b.item_id * 11) % n AS src, (b.item_id * 13) % m AS searcher, v.embedding AS qvec
FROM benchmark b CROSS JOIN (SELECT count(*) AS n FROM embeddings) CROSS JOIN (SELECT count(*) AS m FROM customer)
JOIN embeddings v ON v.vec_id = (b.item_id * 11) % n""")

view("fx_query_unit", """
SELECT query_id, list_transform(w, lambda x: x / nn) AS u FROM (SELECT *, sqrt(list_dot_product(w, w)) AS nn
      FROM (SELECT query_id, CAST(qvec AS DOUBLE[]) AS w FROM fx_queries))""")

view("fx_gold_docs", """
SELECT DISTINCT query_id, doc_id, expected FROM (
  SELECT q.query_id, s.doc_id, true AS expected FROM fx_sections_base s CROSS JOIN (SELECT count(*) AS n FROM embeddings) c
  JOIN fx_queries q ON q.src = s.section_id % c.n
  UNION ALL
  SELECT q.query_id, s.doc_id, false FROM fx_sections_base s CROSS JOIN (SELECT count(*) AS n FROM embeddings) c
  JOIN fx_queries q ON q.src = (s.section_id + c.n // 2) % c.n)""")

view("fx_gold_people", """
SELECT DISTINCT g.query_id, a.emp_id FROM fx_gold_docs g JOIN fx_authors a USING (doc_id) WHERE g.expected""")

view("fx_role_weight", """
SELECT role, CAST(w AS DOUBLE) AS w FROM (VALUES ('proposer', 1.0), ('poster', 1.0), ('lead', 1.0), ('member', 0.6), ('owner', 0.3)) t(role, w)""")

# Mean vectors: renormalised mean of unit section vectors per document, then role-weighted per person.
view("fx_doc_vec", """
SELECT doc_id, list_transform(m, lambda x: x / (CASE WHEN nn = 0 THEN 1 ELSE nn END)) AS u FROM (
  SELECT doc_id, m, sqrt(list_dot_product(m, m)) AS nn FROM (
    SELECT doc_id, list(x ORDER BY i) AS m FROM (
      SELECT doc_id, i, avg(x) AS x FROM (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM fx_unit)
      GROUP BY doc_id, i) GROUP BY doc_id))""")

view("fx_profiles", """
SELECT emp_id, list_transform(m, lambda x: x / (CASE WHEN nn = 0 THEN 1 ELSE nn END)) AS u FROM (
  SELECT emp_id, m, sqrt(list_dot_product(m, m)) AS nn FROM (
    SELECT emp_id, list(x ORDER BY i) AS m FROM (
      SELECT emp_id, i, sum(x * w) / sum(w) AS x FROM (
        SELECT a.emp_id, CAST(r.w AS DOUBLE) AS w, unnest(d.u) AS x, generate_subscripts(d.u, 1) AS i
        FROM fx_authors a JOIN fx_doc_vec d USING (doc_id) JOIN fx_role_weight r USING (role))
      GROUP BY emp_id, i) GROUP BY emp_id))""")

view("fx_career", """
SELECT lpad(CAST(emp_key AS VARCHAR), 5, '0') AS emp_no, conv_id,
  max_by(text, turn) FILTER (turn % 3 = 0) AS current_job, max_by(text, turn) FILTER (turn % 3 = 1) AS future_wish,
  max_by(text, turn) FILTER (turn % 3 = 2) AS effort, '2026-04-01' AS updated_at
FROM (SELECT *, conv_id * 3 % (SELECT count(*) FROM customer) AS emp_key FROM conversations) GROUP BY emp_key, conv_id""")

view("in_documents", """
SELECT doc_id AS file_id, name AS file_name,
  concat(split_part(doc_code, '-', 1), '-', CASE WHEN o_totalprice < 10000 THEN '26-' ELSE '2026-' END, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')) AS doc_code,
  doc_type, CASE WHEN o_totalprice < 30000 THEN '  ' WHEN o_totalprice > 480000 THEN repeat(concat(title, ' '), 10) ELSE title END AS title,
  CASE WHEN o_orderstatus = 'P' AND submitted_at IS NOT NULL THEN concat(year(submitted_at), '年', month(submitted_at), '月', day(submitted_at), '日') ELSE CAST(submitted_at AS VARCHAR) END AS submitted_at,
  CASE WHEN o_totalprice >= 200000 AND o_totalprice < 210000 AND proposal_area IS NOT NULL THEN 'misc' ELSE proposal_area END AS proposal_area,
  result, CAST(decided_at AS VARCHAR) AS decided_at, result_reason, pj_status, CAST(started_at AS VARCHAR) AS started_at,
  CAST(planned_end_at AS VARCHAR) AS planned_end_at, CAST(ended_at AS VARCHAR) AS ended_at,
  CASE WHEN doc_type = 'project' THEN concat('D', lpad(CAST(o_custkey % 27 AS VARCHAR), 3, '0')) END AS owner_dept,
  CASE WHEN o_totalprice >= 20000 THEN CAST(updated_at AS VARCHAR) END AS updated_at, name AS source_file
FROM (SELECT d.*, o.o_custkey, o.o_totalprice, o.o_orderstatus,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN concat('~$file', doc_id, '.docx')
       WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN concat('file', doc_id, '.xlsx') ELSE concat('file', doc_id, '.docx') END AS name
  FROM fx_documents d JOIN orders o ON o.o_orderkey = d.doc_id)""")

view("in_authors", """
SELECT l_orderkey AS file_id, CASE l_linenumber % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'lead' WHEN 2 THEN 'member' ELSE 'proposer' END AS role,
  lpad(CAST(l_partkey AS VARCHAR), 5, '0') AS emp_no,
  concat('Customer#', lpad(CAST(CASE WHEN l_returnflag = 'A' THEN l_partkey ELSE l_suppkey END AS VARCHAR), 9, '0')) AS name,
  concat('D', lpad(CAST(l_suppkey % 27 AS VARCHAR), 3, '0')) AS dept_code FROM lineitem""")

view("in_sections", """
SELECT doc_id // 4 AS file_id, CAST(doc_id % 4 + 1 AS INT) AS section_no,
  (['current_state','issue','proposal','expected_effect','obstacle','background','purpose','work','outcome','misc'])[CAST(n_chars % 10 AS INT) + 1] AS section_name,
  text AS body FROM documents""")
