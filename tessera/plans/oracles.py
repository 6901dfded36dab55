"""The same queries in DuckDB SQL."""

from __future__ import annotations

from tessera.operators.graph import prompt_tokens
from tessera.operators.search import B, K1, query_terms
from tessera.plans.queries import BUDGET, PROMPT, SEARCH_TEXT

_WORDS = "regexp_extract_all({}, '[A-Za-z0-9]+')"
_APART = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
_CODE = "flatten(list_transform(" + _WORDS + ", lambda x: CASE WHEN " + _APART.format("x") + " <> x THEN list_concat([x], string_split(" + _APART.format("x") + ", ' ')) ELSE [x] END))"


def _code(text: str) -> str:
    return _CODE.format(text)


def _bm25_sql() -> str:
    terms = query_terms(SEARCH_TEXT)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0::DOUBLE ELSE 0 END)::DOUBLE AS df{i}" for i in range(len(terms)))
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN log10((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * (tf{i} * {K1 + 1}::DOUBLE / (tf{i} + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * l / a))) ELSE 0 END" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""tok AS (SELECT doc_id, list_transform({_code('text')}, lambda x: lower(x)) AS t FROM documents WHERE text IS NOT NULL),
tfs AS (SELECT doc_id, len(t)::DOUBLE AS l, {tf} FROM tok),
st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {df} FROM tfs),
bm AS (SELECT doc_id, round({parts}, 8) AS bm25 FROM tfs, st WHERE {some})"""


_NEAR = """near AS (SELECT vec_id, similarity FROM (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 8) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE similarity >= 0.1)"""


def _hybrid(boost: str, where: str) -> str:
    return f"""WITH {_bm25_sql()}, {_NEAR},
rt AS (SELECT doc_id, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS r FROM bm),
rv AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM near),
f AS (SELECT doc_id, sum(0.5::DOUBLE / (60 + r)) AS s FROM (SELECT * FROM rv UNION ALL SELECT * FROM rt) GROUP BY doc_id)
SELECT d.doc_id, d.lang, d.source, round(s * {boost}, 10) AS rrf FROM f JOIN documents d USING (doc_id) {where} ORDER BY rrf DESC, doc_id LIMIT 20"""


_GRAPH = r"""files AS (SELECT s_suppkey, 'src/' || s_name AS path FROM supplier),
uses AS (SELECT l_suppkey AS s_suppkey, p_brand AS name, max(l_quantity) AS q, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
named AS (SELECT * FROM uses JOIN files USING (s_suppkey)),
defs AS (SELECT path, name, CASE WHEN name LIKE '%1' THEN 'private' ELSE 'public' END AS visibility FROM named WHERE q >= 50),
refs AS (SELECT path, name FROM named WHERE n >= 2),
dn AS (SELECT name, count(DISTINCT path) AS n_defs, max_by(visibility, path) AS visibility FROM defs GROUP BY name),
rn AS (SELECT name, count(DISTINCT path) AS n_refs FROM refs GROUP BY name),
raw_w AS (SELECT name, n_defs, n_refs,
  (CASE WHEN coalesce(n_defs, 0) > 0 THEN round((least(len(list_filter(string_split(regexp_replace(substr(name, 1, 1) || regexp_replace(substr(name, 2), '([A-Z])', '_\1', 'g'), '^$', ''), '_'), lambda x: x <> '')) / 6.0::DOUBLE, 1) + least(length(name) / 30.0::DOUBLE, 1)) / 2, 4) * 4
   * CASE WHEN visibility IN ('private', 'protected') THEN 0.1::DOUBLE ELSE 1 END ELSE 1 END)
  * CASE WHEN coalesce(n_defs, 0) >= 5 THEN 0.1::DOUBLE ELSE 1 END * CASE WHEN coalesce(n_refs, 0) > 0 THEN ln(1 + n_refs::DOUBLE) ELSE 1 END AS w
  FROM dn FULL JOIN rn USING (name)),
nw AS (SELECT name, CASE WHEN w > 0 THEN w ELSE 1e-9 END AS w FROM raw_w),
e0 AS (SELECT path AS src, 'sym::' || name AS dst, w FROM (SELECT DISTINCT path, name FROM refs) JOIN nw USING (name)
 UNION ALL SELECT path, 'sym::' || name, w * 3 FROM (SELECT DISTINCT path, name FROM defs) JOIN nw USING (name)
 UNION ALL SELECT 'sym::' || name, path, w * 3 FROM (SELECT DISTINCT path, name FROM defs) JOIN nw USING (name)),
e1 AS (SELECT src, dst, sum(w) AS w FROM e0 GROUP BY src, dst),
allnodes AS (SELECT path AS node FROM files UNION SELECT dst FROM e1),
edges AS (SELECT src, dst, w FROM e1 UNION ALL SELECT node, node, 0.3 FROM allnodes WHERE node NOT IN (SELECT src FROM e1))"""


def _rank(home: str) -> str:
    return f"""WITH RECURSIVE {_GRAPH},
home AS (SELECT node, {home} AS m FROM allnodes),
base AS (SELECT node, m / (SELECT sum(m) FROM home) AS h FROM home),
steps AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM edges UNION ALL SELECT node, node, 0 FROM allnodes),
moves AS (SELECT src, dst, p, h FROM (SELECT src, dst, sum(p) AS p FROM steps GROUP BY src, dst) JOIN base ON dst = node),
pr(i, node, r) AS (SELECT 0, node, 1.0::DOUBLE / (SELECT count(*) FROM allnodes) FROM allnodes
 UNION ALL SELECT i + 1, dst, 0.15::DOUBLE * any_value(h) + 0.85::DOUBLE * sum(r * p) FROM pr JOIN moves ON node = src WHERE i < 20 GROUP BY i, dst)"""


_TURNS = "turns AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id FROM (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, conv_id, turn, role FROM conversations))"
_URL_OWNERS = "owners AS (SELECT DISTINCT owner FROM (SELECT regexp_replace(url, '/[^/]*$', '') AS owner FROM pages UNION ALL SELECT regexp_extract(url, '^([a-z]+://[^/]+)', 1) FROM pages))"

ORACLES = {
    "full_scan": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7 LIMIT 1",
    "multi_lookup": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34, -1)",
    "equality_filters": "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1')",
    "name_ignoring_case": "SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) = lower('BRAND#13')",
    "in_subquery_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "not_in_anti": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40 AND l_partkey IS NOT NULL)",
    "left_join_null_fill": "SELECT s_suppkey, coalesce(n, 0) AS n_lines FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON s_suppkey = l_suppkey",
    "tri_state_null": "WITH j AS (SELECT quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'present' AS state, count(*) AS n FROM j WHERE quality IS NOT NULL UNION ALL SELECT 'absent', count(*) FROM j WHERE quality IS NULL UNION ALL SELECT 'either', count(*) FROM j",
    "fullouter_diff": """WITH o AS (SELECT o_custkey, o_orderpriority, max(o_orderstatus) AS status, year(o_orderdate) AS y FROM orders GROUP BY 1, 2, 4)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.o_orderpriority, a.o_orderpriority) AS o_orderpriority,
CASE WHEN a.y IS NULL THEN 'created' WHEN b.y IS NULL THEN 'deleted' WHEN a.status IS NOT DISTINCT FROM b.status THEN 'same' ELSE 'updated' END AS change
FROM (SELECT * FROM o WHERE y = 1995) a FULL JOIN (SELECT * FROM o WHERE y = 1996) b ON a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority""",
    "code_tokens": f"SELECT p_partkey, array_to_string({_code('t')}, ' ') AS tokens FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || replace(p_type, ' ', '') AS t FROM part)",
    "word_tokens_stopwords": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter({_WORDS.format('text')}, lambda x: lower(x) NOT IN ('the', 'and', 'der', 'la', 'de', 'en')) AS t FROM documents WHERE text IS NOT NULL)",
    "trigram_index": "SELECT DISTINCT page_id, substring(lower(url), i, 3) AS trigram FROM (SELECT page_id, url, unnest(range(1, length(url) - 1)) AS i FROM pages WHERE length(url) >= 3)",
    "filename_complete": """SELECT page_id, url, round(CASE WHEN regexp_full_match(lower(string_split(url, '/')[-1]), '(?s).*e.*x.*a.*1.*2.*') THEN 20.0 ELSE 0 END + 10.0
+ 2.0 * ((lower(url) LIKE '%exa%')::INT + (lower(url) LIKE '%xa1%')::INT + (lower(url) LIKE '%a12%')::INT) - length(url) / 100.0, 6)::DOUBLE AS score
FROM pages WHERE regexp_full_match(lower(url), '(?s).*e.*x.*a.*1.*2.*') ORDER BY score DESC, url LIMIT 5""",
    "glob_list": "SELECT page_id, url FROM pages WHERE url GLOB '*1?' OR url GLOB 'http*/*[579]'",
    "virtual_paths": """SELECT doc_id, CASE WHEN source = 'src0' THEN f ELSE '.virtual-path/' || source || '/' || f END AS virtual_path,
CASE WHEN source <> 'src3' THEN source END AS repo, CASE WHEN source <> 'src3' THEN f END AS path FROM (SELECT doc_id, source, 'lib/' || lang || '/' || doc_id::VARCHAR AS f FROM documents)""",
    "collect_defs_refs": f"WITH {_GRAPH} SELECT name, coalesce(n_defs, 0) AS n_defs, def_paths, coalesce(n_refs, 0) AS n_refs FROM (SELECT name, count(DISTINCT path) AS n_defs, string_agg(DISTINCT path, ',' ORDER BY path) AS def_paths FROM defs GROUP BY name) FULL JOIN rn USING (name)",
    "edge_weights": f"WITH {_GRAPH} SELECT src, dst, round(w, 6) AS weight FROM edges",
    "pagerank_uniform": _rank("1.0::DOUBLE") + " SELECT node, round(r, 8) AS score FROM pr WHERE i = 20",
    "pagerank_seeded": _rank("CASE WHEN node IN ('sym::Brand#13', 'sym::Brand#22', 'nowhere') THEN 1.0::DOUBLE ELSE 0 END") + " SELECT node AS path, round(r, 8) AS score FROM pr WHERE i = 20 AND node NOT LIKE 'sym::%' ORDER BY r DESC, node LIMIT 20",
    "prompt_mining": "SELECT DISTINCT name FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part) WHERE lower(name) IN ({})".format(", ".join(f"'{t}'" for t in prompt_tokens(PROMPT))),
    "token_budget_prefix": f"""SELECT doc_id, cost, running::BIGINT AS running FROM (SELECT doc_id, cost, sum(cost) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS running
FROM (SELECT doc_id, n_chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS cost FROM documents WHERE text IS NOT NULL ORDER BY n_chars, doc_id LIMIT 500)) WHERE running <= {BUDGET}""",
    "fts_needle_weights": f"""SELECT p_partkey, array_to_string(list_concat(list_concat(list_concat(list_concat(a, a), a), list_concat(b, b)), c), ' ') AS needle
FROM (SELECT p_partkey, {_code('p_name')} AS a, {_code('p_brand')} AS b, {_code('p_type')} AS c FROM part)""",
    "bm25_topk": f"WITH {_bm25_sql()} SELECT doc_id, bm25 FROM bm ORDER BY bm25 DESC, doc_id LIMIT 20",
    "bm25_rank": f"WITH {_bm25_sql()} SELECT doc_id, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM bm",
    "cosine_topk": f"WITH {_NEAR} SELECT vec_id, similarity FROM near ORDER BY similarity DESC, vec_id LIMIT 20",
    "hybrid_search_rrf": _hybrid("CASE WHEN lang = 'en' THEN 1.1::DOUBLE ELSE 1 END", "WHERE source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')"),
    "rrf_repo_boost": _hybrid("CASE WHEN source = 'src0' THEN 1.1::DOUBLE ELSE 1 END", ""),
    "search_unranked": "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') ORDER BY source, doc_id LIMIT 20 OFFSET 5",
    "hierarchy_children": f"WITH {_TURNS} SELECT parent_id AS parent, id AS child FROM turns WHERE parent_id IN (SELECT id FROM turns WHERE role = 'user')",
    "ancestor_chain": f"""WITH RECURSIVE {_TURNS}, up(id, ancestor, depth) AS (SELECT id, parent_id, 1 FROM turns WHERE id NOT IN (SELECT parent_id FROM turns WHERE parent_id IS NOT NULL) AND parent_id IS NOT NULL
UNION ALL SELECT u.id, t.parent_id, u.depth + 1 FROM up u JOIN turns t ON u.ancestor = t.id WHERE t.parent_id IS NOT NULL) SELECT id, ancestor, depth FROM up""",
    "topk_offset_overfetch": f"""WITH {_TURNS}, page AS (SELECT * FROM turns ORDER BY conv_id, turn LIMIT 20 OFFSET 10)
SELECT id, conv_id, turn FROM page WHERE id NOT IN (SELECT parent_id FROM page WHERE parent_id IS NOT NULL) ORDER BY conv_id, turn LIMIT 10""",
    "longest_prefix_parent": f"WITH {_URL_OWNERS} SELECT page_id, max_by(owner, length(owner)) AS owner FROM pages LEFT JOIN owners ON starts_with(url, owner || '/') GROUP BY page_id",
    "lru_trim": """SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY last DESC NULLS LAST, user_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n
FROM (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY 1, 2)) WHERE nth <= CASE WHEN n > 50 THEN least(50, n - 5) ELSE n END""",
    "cache_hit_miss": """WITH d AS (SELECT doc_id, lang, sha256(text) AS hash FROM documents WHERE text IS NOT NULL), s AS (SELECT hash, max(doc_id) AS vector FROM d WHERE lang <> 'en' GROUP BY hash)
SELECT doc_id, vector IS NOT NULL AS hit, coalesce(vector, -1) AS vector FROM d LEFT JOIN s USING (hash)""",
    "change_detection": """WITH d AS (SELECT lang, doc_id::VARCHAR AS path, n_chars::DOUBLE AS mtime, md5(coalesce(text, '')) AS hash FROM documents),
s AS (SELECT path, CASE WHEN lang IN ('fr', 'de') THEN mtime - 1 ELSE mtime END AS mtime, CASE WHEN lang = 'fr' THEN 'old' ELSE hash END AS hash FROM d WHERE lang <> 'es'),
f AS (SELECT path, mtime, hash FROM d WHERE lang <> 'en' OR mtime > 300)
SELECT coalesce(f.path, s.path) AS path, CASE WHEN f.path IS NULL THEN 'gone' WHEN s.path IS NULL THEN 'new' WHEN f.mtime IS NOT DISTINCT FROM s.mtime THEN 'same' WHEN f.hash IS NOT DISTINCT FROM s.hash THEN 'touched' ELSE 'changed' END AS change
FROM s FULL JOIN f ON s.path = f.path""",
    "upsert_snapshot": """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), f AS (SELECT o_orderkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 100000000 END AS o_orderkey, 'N' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P')
SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f) UNION ALL SELECT * FROM f""",
    "patch_rows": "SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "insert_ignore": "SELECT p_partkey, CASE WHEN p_size <= 25 THEN p_brand END AS p_brand FROM part WHERE p_size <= 25 OR p_brand LIKE 'Brand#1%'",
    "stale_rows": "SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "import_resolution": """WITH p AS (SELECT CASE WHEN n_regionkey < 3 THEN 'v.' || n_nationkey END AS v, 'p/' || n_nationkey AS path FROM nation)
SELECT c_custkey, coalesce(a.path, CASE WHEN c_mktsegment <> 'MACHINERY' THEN b.path END) AS to_package FROM customer
LEFT JOIN p a ON c_mktsegment <> 'BUILDING' AND a.v = 'v.' || c_nationkey LEFT JOIN p b ON c_acctbal > 0 AND b.path = 'p/' || c_nationkey""",
    "method_adoption": """SELECT 'n' || n_nationkey AS id, NULL::VARCHAR AS parent_id FROM nation UNION ALL
SELECT 'c' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'known' WHEN c_mktsegment <> 'FURNITURE' THEN 'n' || n_nationkey END FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "reference_resolution": "SELECT l_orderkey, l_linenumber, CASE WHEN s_acctbal > 0 THEN 'n/' || s_nationkey END AS package_path FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
    "bm25_index_topk": f"WITH {_bm25_sql()} SELECT doc_id, bm25 FROM bm ORDER BY bm25 DESC, doc_id LIMIT 20",
    "search_boosted": f"""WITH {_bm25_sql()}, rt AS (SELECT doc_id, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS r FROM bm)
SELECT doc_id, source, round(0.5::DOUBLE / (60 + r) * CASE WHEN source = 'src1' THEN 1.8::DOUBLE ELSE 1 END, 10) AS rrf FROM rt JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY rrf DESC, doc_id LIMIT 20""",
    "children_without_literals": f"WITH {_TURNS} SELECT p.id AS parent, c.id AS child FROM turns p JOIN turns c ON c.parent_id = p.id WHERE p.role <> 'assistant'",
    "ancestors_below_literals": f"""WITH RECURSIVE {_TURNS},
up(id, ancestor, depth) AS (SELECT id, parent_id, 1 FROM turns WHERE parent_id IN (SELECT id FROM turns WHERE turn <> 2)
 UNION ALL SELECT up.id, t.parent_id, depth + 1 FROM up JOIN turns t ON t.id = up.ancestor WHERE t.parent_id IN (SELECT id FROM turns WHERE turn <> 2))
SELECT id, ancestor, depth FROM up""",
    "chunk_tiling": "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest, true AS numbered FROM documents WHERE text IS NOT NULL AND length(text) > 0",
    "vectors_of_a_width": "SELECT vec_id, 100 AS n_long, 5 AS n_short, round(embedding[5]::DOUBLE, 6) AS fifth, CASE WHEN len(embedding) >= 100 THEN round(embedding[100]::DOUBLE, 6) ELSE 0 END AS last FROM embeddings",
    "module_paths": """SELECT page_id, 'pkg.' || regexp_replace(url, '[^a-z0-9]+', '_', 'g') AS module, 'python' AS language, 'private' AS visibility FROM pages""",
    "suffix_stats": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "sliding_token_windows": """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 65, 0) + 1, 64)) AS start FROM t WHERE len(w) > 0)
SELECT doc_id, (start // 64)::INT AS window_no, start::INT AS start, len(w[start + 1:start + 128])::INT AS n, md5(array_to_string(w[start + 1:start + 128], ' ')) AS digest FROM s""",
    "mean_pool_vectors": "SELECT label, (k - 1)::INT AS \"at\", round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY label, k",
    "name_properties": r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '__' WHEN 1 THEN '_' ELSE '' END || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), '') || CASE WHEN p_partkey % 6 = 0 THEN '__' ELSE '' END AS name FROM part)
SELECT p_partkey, round((least(len(list_filter(string_split(substr(name, 1, 1) || regexp_replace(substr(name, 2), '([A-Z])', '_\1', 'g'), '_'), lambda x: x <> '')) / 6.0::DOUBLE, 1) + least(length(name) / 30.0::DOUBLE, 1)) / 2, 4) AS descriptiveness,
CASE WHEN starts_with(name, '__') AND NOT ends_with(name, '__') THEN 'private' WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END AS visibility, regexp_matches(name, '^[A-Z][A-Z0-9_]*$') AS is_constant FROM n""",
    "vector_pairs": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], head::DOUBLE[]), 6) AS similarity FROM embeddings JOIN (SELECT label, min_by(embedding, vec_id) AS head FROM embeddings GROUP BY label) USING (label)",
    "html_section_nodes": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS heads FROM pages WHERE html IS NOT NULL),
r AS (SELECT page_id, (k - 1)::INT AS spot, heads[k] AS head, regexp_extract(heads[k], '(?i)^<h([1-6])', 1)::INT AS level FROM (SELECT *, unnest(range(1, len(heads) + 1)) AS k FROM h))
SELECT page_id, spot AS "at", level, trim(regexp_replace(regexp_replace(head, '(?is)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title,
CASE level {levels} END AS parent_at FROM r WINDOW w AS (PARTITION BY page_id ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""".replace(
        "{levels}", " ".join(f"WHEN {k} THEN max(CASE WHEN level < {k} THEN spot END) OVER w" for k in range(2, 7))
    ),
}
