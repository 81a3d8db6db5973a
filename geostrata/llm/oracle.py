"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

# later copies of runs of at least 50 words: every run of lines that starts or ends as short as possible
LINE_DEDUP = r"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents WHERE text IS NOT NULL),
  l AS (SELECT doc_id, r, line, len(list_filter(string_split_regex(line, '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '')) AS w FROM raw),
  p AS (SELECT doc_id, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS pos, sum(w) OVER (PARTITION BY doc_id ORDER BY r) AS upto FROM l WHERE w > 0),
  win AS (
    SELECT a.doc_id, a.pos, min(b.pos) AS fin FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.w + 50 GROUP BY ALL
    UNION
    SELECT b.doc_id, max(a.pos) AS pos, b.pos AS fin FROM p b JOIN p a ON a.doc_id = b.doc_id AND a.pos <= b.pos AND b.upto >= a.upto - a.w + 50 GROUP BY b.doc_id, b.pos),
  named AS (SELECT win.doc_id, win.pos, win.fin, string_agg(p.line, chr(10) ORDER BY p.pos) AS run FROM win JOIN p ON p.doc_id = win.doc_id AND p.pos BETWEEN win.pos AND win.fin GROUP BY ALL),
  copies AS (SELECT doc_id, pos, fin FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM named) WHERE k > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(pos, fin + 1)) AS pos FROM copies),
  k AS (SELECT l.doc_id, l.r, l.line, CASE WHEN w > 0 THEN sum((w > 0)::INT) OVER (PARTITION BY l.doc_id ORDER BY r) - 1 END AS pos FROM l),
  left_over AS (SELECT k.doc_id, string_agg(k.line, chr(10) ORDER BY r) FILTER (gone.pos IS NULL) AS t FROM k LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.pos = k.pos GROUP BY k.doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM p WHERE p.doc_id = d.doc_id), 0) AS n_lines, coalesce(g.n, 0) AS n_deleted, coalesce(g.list, '') AS deleted, sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS list FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

_CONTAM = _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_CONTAM} AS w FROM benchmark), d AS (SELECT doc_id, {_CONTAM} AS w FROM documents),
  bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  n AS (SELECT DISTINCT n FROM bw),
  dw AS (SELECT doc_id, i, n.n, array_to_string(w[i:i + n.n - 1], ' ') AS gram FROM n, (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE i + n.n - 1 <= len(w)),
  hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
  words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
  edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9::DOUBLE * a.n * b.n WHERE a.n > 0 AND b.n > 0),
  reach(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.a WHERE reach.c < edge.b),
  comp AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM edge WHERE edge.a = v.vec_id) AS n_links, comp.c AS component_id, comp.c = v.vec_id AS kept FROM v JOIN comp ON comp.a = v.vec_id"""

_NEAR = _WORDS.format(r"[^\x20\x09-\x0D]+")
MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_NEAR} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.a WHERE reach.c < edge.b),
  comp AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id, comp.c = d.doc_id AS kept FROM d JOIN comp ON comp.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

ORACLE_SQL = {"op1_line_dedup": LINE_DEDUP, "op2_decontamination": DECONTAMINATION, "op3_embedding_dedup": EMBEDDING_DEDUP, "op7_minhash": MINHASH}
