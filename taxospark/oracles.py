"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

import re

_PC = "'pc:' || p_type || '|' || p_brand"
GEO = """
tax AS (SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation
  UNION SELECT 'region:' || r_regionkey, 'geo' FROM region),
inst AS (SELECT DISTINCT 'customer:' || c_custkey AS instance, 'nation:' || c_nationkey AS concept FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""
PRODUCT_TAX = f"""
SELECT {_PC} AS child, 'type:' || p_type AS parent FROM part UNION SELECT {_PC}, 'brand:' || p_brand FROM part
  UNION SELECT 'type:' || p_type, 'product' FROM part UNION SELECT 'brand:' || p_brand, 'product' FROM part"""
PRODUCT = f"""
tax AS ({PRODUCT_TAX}),
inst AS (SELECT DISTINCT 'part:' || p_partkey AS instance, {_PC} AS concept FROM part)"""
TRADE = f"""
tax AS (SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation
  UNION SELECT 'region:' || r_regionkey, 'geo' FROM region UNION {PRODUCT_TAX}),
inst AS (SELECT 'line:' || l_orderkey || '-' || l_linenumber AS instance, {_PC} AS concept FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION SELECT 'line:' || l_orderkey || '-' || l_linenumber, 'nation:' || s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""
#: Concepts, and the edges of the expanded graph.
DUAL = """
con AS (SELECT child AS c FROM tax UNION SELECT parent FROM tax UNION SELECT concept FROM inst),
dual AS MATERIALIZED (SELECT 'abstract:' || c AS src, 'extension:' || c AS dst, 'hasExtension' AS relation FROM con
  UNION ALL SELECT 'extension:' || parent, 'extension:' || child, 'supersetOf' FROM tax
  UNION ALL SELECT 'abstract:' || child, 'abstract:' || parent, 'subClassOf' FROM tax
  UNION ALL SELECT 'extension:' || concept, instance, 'hasElement' FROM inst)"""
_DRAW = "md5(concat_ws('|', {seed}, src, dst, relation))"
_NAME = "regexp_replace({x}, '^(abstract|extension):', '')"


def removed(where: str, rho: float, seed: str = "'7'") -> str:
    """Exactly k edges of each relation that the condition takes, by draw."""
    return f"""
removed AS MATERIALIZED (SELECT src, dst, relation FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY {_DRAW.format(seed=seed)}, src, dst, relation) AS r,
  count(*) OVER (PARTITION BY relation) AS n FROM dual WHERE {where}) WHERE r <= round_even({rho} * n, 0)),
e AS MATERIALIZED (SELECT * FROM dual EXCEPT SELECT * FROM removed)"""


SO, MIX = "relation = 'supersetOf'", "relation IN ('hasExtension', 'supersetOf', 'hasElement')"
WHOLE = "e AS (SELECT * FROM dual)"
#: On edges e: closure of the taxonomy, expected pairs, threads.
WALKS = f"""
txo AS (SELECT DISTINCT {_NAME.format(x='src')} AS c, {_NAME.format(x='dst')} AS p FROM e WHERE relation = 'subClassOf'),
clo(d, a) AS (SELECT c, p FROM txo UNION SELECT clo.d, txo.p FROM clo JOIN txo ON txo.c = clo.a),
own AS (SELECT dst AS instance, {_NAME.format(x='src')} AS concept FROM e WHERE relation = 'hasElement'),
exp AS MATERIALIZED (SELECT instance, concept FROM own UNION SELECT o.instance, k.a FROM own o JOIN clo k ON k.d = o.concept),
down(s, t) AS (SELECT dst, dst FROM e WHERE relation = 'hasExtension' UNION SELECT down.s, e.dst FROM down JOIN e ON e.src = down.t AND e.relation = 'supersetOf'),
reach AS MATERIALIZED (SELECT DISTINCT {_NAME.format(x='h.src')} AS concept, d.t AS node FROM e h JOIN down d ON d.s = h.dst WHERE h.relation = 'hasExtension'),
thr AS MATERIALIZED (SELECT DISTINCT r.concept, x.dst AS instance FROM reach r JOIN e x ON x.src = r.node AND x.relation = 'hasElement')"""
REPORT = "rep AS MATERIALIZED (SELECT x.instance, x.concept, t.instance IS NOT NULL AS is_valid FROM {expected} x LEFT JOIN thr t USING (instance, concept))"
#: Expected pairs of the whole graph.
FROZEN = """
fclo(d, a) AS (SELECT child, parent FROM tax UNION SELECT fclo.d, tax.parent FROM fclo JOIN tax ON tax.child = fclo.a),
frozen AS MATERIALIZED (SELECT instance, concept FROM inst UNION SELECT i.instance, k.a FROM inst i JOIN fclo k ON k.d = i.concept)"""
#: Shortest, then smallest paths up a taxonomy txo.
PATHS = """
walk(s, t, path) AS (SELECT c, p, [c, p] FROM txo UNION SELECT w.s, x.p, list_append(w.path, x.p) FROM walk w JOIN txo x ON x.c = w.t WHERE NOT list_contains(w.path, x.p)),
best AS MATERIALIZED (SELECT s, t, first(path ORDER BY len(path), array_to_string(path, chr(1))) AS path FROM walk GROUP BY s, t)"""
#: Proposals on e for broken pairs of rep, without skipped cases: leaves, routes, edges.
PROPOSE = f"""
broken AS (SELECT instance, concept FROM rep WHERE NOT is_valid),
bare AS (SELECT DISTINCT instance FROM broken WHERE instance NOT IN (SELECT instance FROM own)),
leaf AS MATERIALIZED (SELECT DISTINCT o.instance, o.concept AS leaf FROM own o WHERE o.instance IN (SELECT instance FROM broken)
  UNION SELECT x.instance, x.concept FROM rep x JOIN bare USING (instance) WHERE NOT EXISTS (SELECT 1 FROM rep y JOIN clo k ON k.d = y.concept
    WHERE y.instance = x.instance AND k.a = x.concept AND k.d <> k.a) AND x.concept IN (SELECT c FROM txo UNION SELECT p FROM txo)),
route AS MATERIALIZED (SELECT b.instance, b.concept, l.leaf, coalesce(p.path, [l.leaf]) AS path FROM broken b JOIN leaf l USING (instance)
  LEFT JOIN best p ON p.s = l.leaf AND p.t = b.concept WHERE p.path IS NOT NULL OR l.leaf = b.concept),
steps AS (SELECT DISTINCT unnest(list_transform(range(1, len(path)), lambda i: {{'c': path[i], 'p': path[i+1]}})) AS s FROM route WHERE len(path) > 1),
raw AS (SELECT DISTINCT 'abstract:' || concept AS src, 'extension:' || concept AS dst, 'hasExtension' AS relation, 1.0::DOUBLE AS base_confidence FROM route
  UNION SELECT 'extension:' || s.p, 'extension:' || s.c, 'supersetOf', 0.9::DOUBLE FROM steps
  UNION SELECT DISTINCT 'extension:' || leaf, instance, 'hasElement', 0.55::DOUBLE FROM route),
prop AS MATERIALIZED (SELECT r.* FROM raw r ANTI JOIN e ON e.src = r.src AND e.dst = r.dst AND e.relation = r.relation)"""


def q(*ctes: str) -> str:
    """WITH RECURSIVE of all but the last part, which is the query."""
    return "WITH RECURSIVE " + ",\n".join(ctes[:-1]) + "\n" + ctes[-1]


#: The product taxonomy with every type and brand also below its lowest class, each pair judged by reach and by the
#: distance of its ends from the root: kept are pairs on no cycle and those that lead towards the root.
UNTANGLED = """
e AS MATERIALIZED (SELECT child AS s, parent AS d FROM tax UNION SELECT parent, min(child) FROM tax WHERE child LIKE 'pc:%' GROUP BY parent),
r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON e.s = r.d),
far(id, n) AS (SELECT 'product', 0 UNION SELECT e.s, far.n + 1 FROM far JOIN e ON e.d = far.id WHERE far.n < 5),
rank AS (SELECT id, min(n) AS n FROM far GROUP BY id),
left_over AS MATERIALIZED (SELECT e.s AS src, e.d AS dst FROM e LEFT JOIN r ON r.s = e.d AND r.d = e.s JOIN rank a ON a.id = e.s JOIN rank b ON b.id = e.d
  WHERE r.s IS NULL OR (b.n, b.id) < (a.n, a.id))"""


def broken(where: str = SO, expected: str = "frozen") -> tuple[str, ...]:
    return PRODUCT, DUAL, FROZEN, removed(where, 0.2), WALKS, REPORT.format(expected=expected)


CURVE = """c AS (SELECT o_orderpriority AS dataset, month(o_orderdate) / 12.0::DOUBLE AS theta, (o_orderkey % 97) / 96.0::DOUBLE AS r, (o_custkey % 89) / 88.0::DOUBLE AS p FROM orders),
pts AS MATERIALIZED (SELECT dataset, theta, round_even(avg(r), 4) AS recall, round_even(avg(p), 4) AS precision FROM c GROUP BY 1, 2)"""
_APPLIED = "app AS (SELECT src, dst, relation FROM prop WHERE base_confidence >= {theta})"


#: The graph with what is proposed at 0.75 or more, its threads and its report.
REPAIRED = (PATHS, PROPOSE, _APPLIED.format(theta=0.75), "e_2 AS MATERIALIZED (SELECT * FROM e UNION SELECT * FROM app)", re.sub(r"\b(txo|clo|own|exp|down|reach|thr)\b", r"\1_2", re.sub(r"\be(?=\.| )", "e_2", WALKS)),
    "rep_2 AS (SELECT x.instance, x.concept, t.instance IS NOT NULL AS is_valid FROM exp_2 x LEFT JOIN thr_2 t USING (instance, concept))")
#: Abstract nodes numbered by id; a drawn number below their count.
NUMBERED = "numbered AS (SELECT 'abstract:' || c AS id, row_number() OVER (ORDER BY 'abstract:' || c) - 1 AS number, count(*) OVER () AS n FROM con)"
#: Numbers of the abstract nodes that a node's edges lead to; the free number of a rank, given the sorted blocked ones.
TARGETS = "targets AS MATERIALIZED (SELECT src, list(DISTINCT number) AS there FROM e JOIN numbered ON id = dst GROUP BY 1)"
_FREE = "list_reduce(list_concat([{rank}], {blocked}), lambda w, x: CASE WHEN x <= w THEN w + 1 ELSE w END)"


def oracle_sql() -> dict[str, str]:
    return {
        "expand_edges": q(PRODUCT, DUAL, "SELECT DISTINCT src, dst, relation FROM dual"),
        "expand_nodes": q(PRODUCT, DUAL, "SELECT 'abstract:' || c AS id, 'abstract' AS kind, c AS concept FROM con UNION ALL SELECT 'extension:' || c, 'extension', c FROM con UNION ALL SELECT DISTINCT instance, 'instance', NULL FROM inst"),
        "expand_partial": q(GEO, "sel AS (SELECT DISTINCT parent AS c FROM tax)", """SELECT 'abstract:' || c AS src, 'extension:' || c AS dst, 'hasExtension' AS relation FROM sel
            UNION SELECT 'extension:' || parent, CASE WHEN child IN (SELECT c FROM sel) THEN 'extension:' || child ELSE child END, 'supersetOf' FROM tax
            UNION SELECT 'abstract:' || child, 'abstract:' || parent, 'subClassOf' FROM tax WHERE child IN (SELECT c FROM sel)
            UNION SELECT concept, instance, 'hasElement' FROM inst"""),
        "dual_pairs": q(PRODUCT, DUAL, "SELECT c AS concept, 'abstract:' || c AS abstract, 'extension:' || c AS extension FROM con"),
        "taxonomy_closure": q(PRODUCT, FROZEN, "SELECT d AS src, a AS dst FROM fclo WHERE d <> a"),
        "host_closure": q("h AS (SELECT DISTINCT string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS t FROM pages WHERE url LIKE '%://%')",
            "p AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: {'c': array_to_string(t[i:], '.'), 'p': array_to_string(t[i+1:], '.')})) AS s FROM h)",
            "tax AS (SELECT DISTINCT s.c AS child, s.p AS parent FROM p)",
            "k(d, a) AS (SELECT child, parent FROM tax UNION SELECT k.d, tax.parent FROM k JOIN tax ON tax.child = k.a)", "SELECT d AS src, a AS dst FROM k WHERE d <> a"),
        "expected_pairs": q(TRADE, FROZEN, "SELECT instance, concept FROM frozen"),
        "thread_pairs": q(PRODUCT, DUAL, removed(SO, 0.2), WALKS, "SELECT concept, instance FROM thr"),
        "validate_damaged": q(*broken(expected="exp"), "SELECT instance, concept, is_valid FROM rep"),
        "validate_frozen": q(*broken(MIX), "SELECT instance, concept, is_valid FROM rep"),
        "trade_coverage": q(TRADE, DUAL, removed(SO, 0.05), WALKS, REPORT.format(expected="exp"), "SELECT concept, count(*) AS n_expected, count_if(is_valid)::BIGINT AS n_valid FROM rep GROUP BY 1"),
        "coverage_metrics": q(*broken(expected="exp"), """SELECT count(*) AS n_expected, count_if(is_valid)::BIGINT AS n_valid, count_if(NOT is_valid)::BIGINT AS n_broken,
            (SELECT count(DISTINCT instance) FROM inst) AS n_instances, count_if(is_valid)::DOUBLE / count(*) AS coverage, count_if(is_valid)::DOUBLE / (SELECT count(DISTINCT instance) FROM inst) AS avg_valid FROM rep"""),
        "flat_direct": q(GEO, "SELECT instance FROM inst WHERE concept = 'nation:3'"),
        "flat_transitive": q(GEO, FROZEN, "SELECT instance FROM frozen WHERE concept = 'region:1'"),
        "query_comparison": q(GEO, DUAL, FROZEN, WHOLE, WALKS, "d AS (SELECT instance FROM inst WHERE concept = 'region:1'), f AS (SELECT instance FROM frozen WHERE concept = 'region:1'), t AS (SELECT instance FROM thr WHERE concept = 'region:1')",
            "x AS (SELECT instance, instance IN (SELECT instance FROM d) AS direct, instance IN (SELECT instance FROM f) AS transitive, instance IN (SELECT instance FROM t) AS threaded FROM (SELECT * FROM d UNION SELECT * FROM f UNION SELECT * FROM t))",
            "SELECT *, transitive AND NOT direct AS missed_by_direct FROM x"),
        "graph_summary": q(PRODUCT, DUAL, "SELECT 'relation' AS what, relation AS name, count(*) AS n FROM dual GROUP BY 2 UNION ALL SELECT 'kind', k, n FROM (SELECT unnest(['abstract', 'extension']) AS k, (SELECT count(*) FROM con) AS n) UNION ALL SELECT 'kind', 'instance', count(DISTINCT instance) FROM inst"),
        "redundancy": q(PRODUCT, FROZEN, "h AS (SELECT DISTINCT t.child, k.a, t.parent AS nb FROM tax t JOIN (SELECT d, a FROM fclo UNION SELECT parent, parent FROM tax) k ON k.d = t.parent WHERE k.a <> t.child)",
            "n AS (SELECT count(*) AS n FROM h GROUP BY child, a)", "SELECT count(*) AS n_pairs, count_if(n > 1)::BIGINT AS n_redundant, count_if(n > 1)::DOUBLE / count(*) AS redundancy FROM n"),
        "multi_parent": q(PRODUCT, "SELECT child AS id, count(*) AS n_parents FROM tax GROUP BY 1 HAVING count(*) > 1"),
        "damage_k": q(PRODUCT, DUAL, removed(SO, 0.2), "SELECT * FROM removed"),
        "damage_mix": q(PRODUCT, DUAL, removed(MIX, 0.2), "SELECT * FROM removed"),
        "node_removal": q(PRODUCT, DUAL, "x AS (SELECT id FROM (SELECT 'extension:' || c AS id, row_number() OVER (ORDER BY md5(concat_ws('|', '7', 'extension:' || c)), c) AS r, count(*) OVER () AS n FROM con) WHERE r <= round_even(0.2 * n, 0))",
            "SELECT DISTINCT src, dst, relation FROM dual WHERE src IN (SELECT id FROM x) OR dst IN (SELECT id FROM x)"),
        "guidance_removal": q(PRODUCT, DUAL, removed("relation = 'hasExtension'", 0.1), removed("relation = 'subClassOf'", 0.3, "'7g'").replace("removed AS", "cut AS").replace("EXCEPT SELECT * FROM removed", "EXCEPT SELECT * FROM cut").replace("\ne AS", "\ne2 AS"), "SELECT * FROM removed UNION ALL SELECT * FROM cut"),
        "distractors": q(PRODUCT, DUAL, removed("relation = 'hasExtension'", 0.1), NUMBERED, TARGETS,
            "f AS (SELECT m.id, m.number AS own, m.n - 1 - len(coalesce(list_filter(t.there, lambda x: x <> m.number), [])) AS free, coalesce(t.there, []) AS there FROM numbered m LEFT JOIN targets t ON t.src = m.id)",
            "s AS MATERIALIZED (SELECT *, sum(free) OVER (ORDER BY own)::BIGINT - free AS start FROM f)",
            "w AS (SELECT round_even(0.2 * greatest(count(*), 1), 0)::BIGINT AS n, (SELECT sum(free) FROM s)::BIGINT AS total FROM e WHERE relation = 'subClassOf')",
            "a AS (SELECT ('0x' || substr(md5(concat_ws('|', '7', 'd', i)), 1, 12))::BIGINT % total AS rank, min(i) AS i FROM w, range(0, 2 * w.n + 16) r(i) GROUP BY 1)",
            "k AS (SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY i) AS r FROM a) WHERE r <= (SELECT n FROM w))",
            f"d AS (SELECT id AS src, {_FREE.format(rank='rank - start', blocked='list_sort(list_distinct(list_append(there, own)))')} AS number FROM k JOIN s ON rank >= start AND rank < start + free)",
            "SELECT d.src, m.id AS dst, 'subClassOf' AS relation FROM d JOIN numbered m USING (number)"),
        "rewire": q(PRODUCT, DUAL, removed("relation = 'hasExtension'", 0.1), NUMBERED, TARGETS,
            "cut AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '7w', src, dst, relation)), src, dst, relation) AS r, count(*) OVER () AS n FROM e WHERE relation = 'subClassOf') WHERE r <= round_even(0.3 * n, 0))",
            "step AS MATERIALIZED (SELECT c.src, m.number AS old, l.lot, row_number() OVER (PARTITION BY c.src ORDER BY l.lot) AS k FROM (SELECT src, dst, md5(concat_ws('|', '7', 'to', src, dst)) AS lot FROM cut) l JOIN cut c USING (src, dst) JOIN numbered m ON m.id = c.dst)",
            f"""walk(src, k, there, new) AS (SELECT DISTINCT src, 0::BIGINT, t.there, NULL::BIGINT FROM step JOIN targets t USING (src) UNION ALL
              SELECT src, k, CASE WHEN new IS NULL THEN there ELSE list_append(there, new) END, new FROM (SELECT src, k, there,
                CASE WHEN len(b) < n THEN {_FREE.format(rank="('0x' || substr(lot, 1, 12))::BIGINT % (n - len(b))", blocked='b')} END AS new FROM (SELECT w.src, s.k, s.lot, m.n,
                  list_filter(w.there, lambda x: x <> s.old) AS there, list_sort(list_distinct(list_concat(list_filter(w.there, lambda x: x <> s.old), [s.old, m.number]))) AS b
                  FROM walk w JOIN step s ON s.src = w.src AND s.k = w.k + 1 JOIN numbered m ON m.id = w.src)))""",
            "SELECT w.src, m.id AS dst, 'subClassOf' AS relation FROM walk w JOIN numbered m ON m.number = w.new"),
        "targeted_spine": q(PRODUCT, DUAL, "so AS (SELECT DISTINCT src, dst FROM dual WHERE relation = 'supersetOf')", "ids AS (SELECT src AS id FROM so UNION SELECT dst FROM so)",
            "walk(s, t, d, via) AS (SELECT id, id, 0, [id] FROM ids UNION ALL SELECT w.s, so.dst, w.d + 1, list_append(w.via, so.dst) FROM walk w JOIN so ON so.src = w.t)",
            "near AS MATERIALIZED (SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY s, t) AS low, FROM walk) WHERE d = low AND d > 0)", "many AS (SELECT s, t, count(*) AS n FROM near GROUP BY 1, 2)",
            "over AS (SELECT via[i] AS src, via[i + 1] AS dst, 1.0::DOUBLE / m.n AS part FROM near JOIN many m USING (s, t), range(1, 10) r(i) WHERE i <= near.d)",
            "score AS (SELECT src, dst, sum(part) / ((SELECT count(*) FROM ids) * ((SELECT count(*) FROM ids) - 1))::DOUBLE AS score FROM over GROUP BY 1, 2)",
            "SELECT src, dst, 'supersetOf' AS relation FROM (SELECT *, row_number() OVER (ORDER BY round_even(score, 12) DESC, src, dst) AS r FROM score) WHERE r <= round_even(0.1 * (SELECT count(*) FROM so), 0)"),
        "holdout": q(PRODUCT, FROZEN, "SELECT instance, concept, row_number() OVER (ORDER BY md5(concat_ws('|', '7', instance, concept)), instance, concept) <= round_even(0.3 * count(*) OVER (), 0) AS held FROM frozen"),
        "flat_preimage": q(PRODUCT, DUAL, removed(MIX, 0.2), f"SELECT DISTINCT {_NAME.format(x='dst')} AS src, {_NAME.format(x='src')} AS dst, CASE relation WHEN 'hasElement' THEN 'instanceOf' ELSE 'subClassOf' END AS relation FROM removed WHERE relation <> 'hasExtension'"),
        "single_node_valid": q(PRODUCT, DUAL, FROZEN, removed(MIX, 0.2), f"gone AS (SELECT {_NAME.format(x='dst')} AS a, {_NAME.format(x='src')} AS b FROM removed WHERE relation <> 'hasExtension')",
            "tx AS (SELECT child AS c, parent AS p FROM tax EXCEPT SELECT a, b FROM gone)", "ins AS (SELECT instance, concept FROM inst EXCEPT SELECT a, b FROM gone)",
            "k(d, a) AS (SELECT c, p FROM tx UNION SELECT k.d, tx.p FROM k JOIN tx ON tx.c = k.a)", "SELECT instance, concept FROM ins UNION SELECT i.instance, k.a FROM ins i JOIN k ON k.d = i.concept"),
        "repair_leaves": q(*broken(MIX), PATHS, PROPOSE, "SELECT instance, leaf FROM leaf"),
        "repair_proposals": q(*broken(MIX), PATHS, PROPOSE, "SELECT src, dst, relation, base_confidence FROM prop"),
        "repair_applied": q(*broken(MIX), PATHS, PROPOSE, "r AS (SELECT *, row_number() OVER (ORDER BY base_confidence DESC, src, dst, relation) AS n FROM prop)",
            "SELECT src, dst, relation, base_confidence AS confidence, base_confidence >= 0.75 AND n <= 20 AS applied, CASE WHEN base_confidence < 0.75 THEN 'confidence 0.55 < min_confidence 0.75' WHEN n > 20 THEN 'max_new_edges cap (20) reached' END AS skip_reason FROM r"),
        "enforcement_delta": q(*broken(expected="exp"), *REPAIRED, """b AS (SELECT count_if(is_valid)::DOUBLE / count(*) AS c, count_if(NOT is_valid)::BIGINT AS n, count_if(is_valid)::BIGINT AS v FROM rep),
            a AS (SELECT count_if(is_valid)::DOUBLE / count(*) AS c, count_if(NOT is_valid)::BIGINT AS n, count_if(is_valid)::BIGINT AS v FROM rep_2)""",
            "SELECT b.c AS coverage_before, b.n AS n_broken_before, b.v AS n_valid_before, a.c AS coverage_after, a.n AS n_broken_after, a.v AS n_valid_after, a.c - b.c AS coverage_gain, a.v - b.v AS repaired_pairs FROM a, b"),
        "recovery": q(*broken(expected="exp"), *REPAIRED, "b AS (SELECT count_if(is_valid)::DOUBLE / count(*) AS c FROM rep), a AS (SELECT count_if(is_valid)::DOUBLE / count(*) AS c FROM rep_2)",
            "SELECT b.c AS coverage_before, a.c AS coverage_after, CASE WHEN b.c < 1 THEN (a.c - b.c) / (1.0 - b.c) END AS recovery FROM a, b"),
        "ap_advantage": q("c AS (SELECT o_orderpriority AS dataset, CASE WHEN o_orderkey % 2 = 0 THEN 'prior' ELSE 'corroboration' END AS s, month(o_orderdate) / 12.0::DOUBLE AS theta, (o_orderkey % 97) / 96.0::DOUBLE AS r, (o_custkey % 89) / 88.0::DOUBLE AS p FROM orders)",
            "pts AS MATERIALIZED (SELECT DISTINCT dataset, s, round_even(avg(r), 4) AS recall, round_even(avg(p), 4) AS precision FROM c GROUP BY dataset, s, theta)", "t AS (SELECT dataset, s, max(recall) AS top FROM pts GROUP BY 1, 2)",
            "g AS (SELECT t.dataset, t.s, t.top, i, coalesce(max(p.precision), 0.0) AS b FROM t CROSS JOIN range(0, 101) r(i) LEFT JOIN pts p ON p.dataset = t.dataset AND p.s = t.s AND p.recall >= t.top * i / 100.0::DOUBLE - 1e-9 GROUP BY 1, 2, 3, 4)",
            "ap AS (SELECT x.dataset, x.s, sum((x.b + y.b) / 2.0 * (x.top / 100.0)) AS ap FROM g x JOIN g y ON y.dataset = x.dataset AND y.s = x.s AND y.i = x.i + 1 GROUP BY 1, 2)",
            "v AS (SELECT dataset, coalesce(max(ap) FILTER (s = 'prior'), 0.0) AS a, coalesce(max(ap) FILTER (s = 'corroboration'), 0.0) AS b FROM ap GROUP BY 1)",
            "SELECT dataset, round_even(a, 9) AS ap_prior, round_even(b, 9) AS ap_corroboration, round_even(b - a, 9) AS advantage FROM v"),
        "newly_valid": q(*broken(expected="exp"), *REPAIRED, "SELECT instance, concept, instance || '~' || concept AS label FROM (SELECT instance, concept FROM rep_2 WHERE is_valid EXCEPT SELECT instance, concept FROM rep WHERE is_valid)"),
        "edge_quality": q(*broken(MIX), PATHS, PROPOSE, _APPLIED.format(theta=0.5), "t AS (SELECT count(*) AS n, (SELECT count(*) FROM app SEMI JOIN dual USING (src, dst, relation)) AS k FROM app)",
            "SELECT n AS n_added, k AS n_true, k::DOUBLE / n AS edge_precision, 1 - k::DOUBLE / n AS hallucination FROM t"),
        "closure_quality": q(*broken(MIX), PATHS, PROPOSE, _APPLIED.format(theta=0.5), f"""t AS (SELECT count(*) AS n, count_if(CASE relation WHEN 'supersetOf' THEN EXISTS (SELECT 1 FROM fclo WHERE d = {_NAME.format(x='dst')} AND a = {_NAME.format(x='src')})
            WHEN 'hasElement' THEN EXISTS (SELECT 1 FROM frozen f WHERE f.instance = dst AND f.concept = {_NAME.format(x='src')}) ELSE {_NAME.format(x='src')} = {_NAME.format(x='dst')} END)::BIGINT AS k FROM app)""",
            "SELECT n AS n_added, k AS n_true, k::DOUBLE / n AS closure_precision, 1 - k::DOUBLE / n AS closure_hallucination FROM t"),
        "recall_of_repair": q(*broken(MIX), PATHS, PROPOSE, _APPLIED.format(theta=0.75), "t AS (SELECT count(*) AS n, (SELECT count(*) FROM removed SEMI JOIN app USING (src, dst, relation)) AS k FROM removed)",
            "SELECT n AS n_recoverable, k AS n_recovered, k::DOUBLE / n AS edge_recall FROM t"),
        "corroboration": q(*broken(), PATHS, PROPOSE, f"""sup AS (SELECT {_NAME.format(x='src')} AS p, {_NAME.format(x='dst')} AS c FROM e WHERE relation = 'supersetOf')""",
            "sclo(a, d) AS (SELECT p, c FROM sup UNION SELECT s.a, x.c FROM sclo s JOIN sup x ON x.p = s.d)",
            f"m AS (SELECT *, {_NAME.format(x='src')} AS pc, {_NAME.format(x='dst')} AS cc FROM prop)",
            "k AS (SELECT *, least(5, (SELECT count(*) FROM txo WHERE txo.c = cc AND txo.p <> pc AND EXISTS (SELECT 1 FROM clo WHERE clo.d = txo.p AND clo.a = pc)) + (SELECT count(*) FROM sup WHERE sup.p = pc AND sup.c <> cc AND EXISTS (SELECT 1 FROM sclo WHERE sclo.a = sup.c AND sclo.d = cc))) AS k FROM m)",
            "SELECT src, dst, relation, round_even(CASE relation WHEN 'supersetOf' THEN base_confidence * (1.0 - 1.0 / (1.0 + k)) ELSE base_confidence END, 9)::DOUBLE AS confidence FROM k"),
        "false_memberships": q(PRODUCT, DUAL, FROZEN, "w AS (SELECT (SELECT min(child) FROM tax WHERE child LIKE 'brand:%') AS b, (SELECT min(child) FROM tax WHERE child LIKE 'type:%') AS t)",
            "m AS (SELECT DISTINCT f.instance FROM frozen f, w WHERE f.concept = w.t)", "SELECT m.instance, w.b AS concept FROM m, w WHERE NOT EXISTS (SELECT 1 FROM frozen f WHERE f.instance = m.instance AND f.concept = w.b)"),
        "slice_depth": q(PRODUCT, "SELECT child || '_' || i AS instance, child AS concept FROM tax, range(1, 3) r(i) WHERE parent = 'product'"),
        "slice_budget": q(PRODUCT, "s AS (SELECT child AS id FROM tax WHERE parent = 'product' ORDER BY child LIMIT 4)", "f AS (SELECT child, parent FROM tax WHERE parent = 'product' UNION SELECT child, parent FROM tax WHERE parent IN (SELECT id FROM s))",
            "c AS (SELECT child AS id FROM f UNION SELECT parent FROM f)", "SELECT child, parent FROM tax WHERE child IN (SELECT id FROM c) AND parent IN (SELECT id FROM c)"),
        "members_topk": q(GEO, "SELECT instance, concept FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY instance) AS n FROM inst) WHERE n <= 5"),
        "labels": q(GEO, "SELECT DISTINCT t.child AS id, coalesce(n.n_name, t.child) AS label FROM tax t LEFT JOIN nation n ON 'nation:' || n.n_nationkey = t.child"),
        "uri_parts": "SELECT page_id, string_split(url, '/')[-1] AS part FROM pages",
        "root_component": q(GEO, "SELECT child AS id FROM tax UNION SELECT parent FROM tax"),
        "break_cycles": q(PRODUCT, "SELECT child AS src, parent AS dst FROM tax"),
        "clean_slice": q(PRODUCT, "SELECT instance, concept FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY instance) AS n FROM inst) WHERE n <= 2"),
        "shortest_paths": q(PRODUCT, "txo AS (SELECT child AS c, parent AS p FROM tax)", PATHS, "SELECT s AS src, t AS dst, array_to_string(path, '>') AS path FROM best"),
        "thread_paths": q(*broken(), "w(s, t, path) AS (SELECT dst, dst, [dst] FROM e WHERE relation = 'hasExtension' UNION SELECT w.s, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.t AND e.relation = 'supersetOf')",
            f"full_ AS (SELECT {_NAME.format(x='h.src')} AS concept, x.dst AS instance, [h.src] || w.path || [x.dst] AS path FROM e h JOIN w ON w.s = h.dst JOIN e x ON x.src = w.t AND x.relation = 'hasElement' WHERE h.relation = 'hasExtension')",
            "b AS (SELECT concept, instance, first(array_to_string(path, '>') ORDER BY len(path), array_to_string(path, chr(1))) AS path FROM full_ GROUP BY 1, 2)", "SELECT f.instance, f.concept, b.path FROM frozen f LEFT JOIN b USING (instance, concept)"),
        "has_thread": q(*broken(MIX), "SELECT instance, concept FROM rep WHERE is_valid"),
        "strong_components": q(PRODUCT, "e AS MATERIALIZED (SELECT child AS s, parent AS d FROM tax UNION SELECT parent, min(child) FROM tax WHERE child LIKE 'pc:%' GROUP BY parent)",
            "r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON e.s = r.d)",
            "SELECT a.s AS id, min(a.d) AS component FROM r a JOIN r b ON b.s = a.d AND b.d = a.s GROUP BY a.s"),
        "fallback_pairs": q(PRODUCT, DUAL, f"ext AS (SELECT {_NAME.format(x='dst')} AS child, {_NAME.format(x='src')} AS parent FROM dual WHERE relation = 'supersetOf')",
            "up(d, a) AS (SELECT child, parent FROM ext UNION SELECT up.d, ext.parent FROM up JOIN ext ON ext.child = up.a)", "SELECT instance, concept FROM inst UNION SELECT i.instance, up.a FROM inst i JOIN up ON up.d = i.concept"),
        "cycles_broken": q(PRODUCT, UNTANGLED, "SELECT src, dst FROM left_over"),
        "clean_slice_overlap": q(PRODUCT, UNTANGLED, "listed AS (SELECT instance, concept FROM inst UNION SELECT s, d FROM e)",
            "SELECT instance, concept FROM listed WHERE concept IN (SELECT src FROM left_over) AND concept NOT IN (SELECT dst FROM left_over) AND instance NOT IN (SELECT src FROM left_over UNION SELECT dst FROM left_over)"),
        "components": q(GEO, f"t AS (SELECT child AS s, parent AS d FROM tax UNION {PRODUCT_TAX} UNION SELECT 'customer:' || c_custkey, 'segment:' || c_nationkey || ':' || c_mktsegment FROM customer)",
            "b AS (SELECT s, d FROM t UNION SELECT d, s FROM t)", "r(id, o) AS (SELECT s, s FROM b UNION SELECT r.id, b.d FROM r JOIN b ON b.s = r.o)", "SELECT id, min(o) AS component FROM r GROUP BY 1"),
        "rank_sums": q("d AS (SELECT l_returnflag || '-' || l_linestatus AS dataset, l_discount::DOUBLE AS a, l_tax::DOUBLE AS b FROM lineitem)",
            "s AS (SELECT dataset, abs(a - b) AS size, count(*) AS t, count_if(a - b > 0) AS plus, count_if(abs(a - b) > 1e-8::DOUBLE + 1e-5::DOUBLE * abs(b)) AS far FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2)",
            "r AS (SELECT *, sum(t) OVER (PARTITION BY dataset ORDER BY size) - (t - 1) / 2.0::DOUBLE AS rank FROM s WHERE size > 0)",
            """SELECT x.dataset, x.n_pairs, coalesce(n, 0)::BIGINT AS n, n_zero, coalesce(n_sizes, 0)::BIGINT AS n_sizes, coalesce(y.plus, 0)::DOUBLE AS plus, coalesce(ties, 0)::DOUBLE AS ties, x.far FROM
            (SELECT dataset, sum(t)::BIGINT AS n_pairs, sum(CASE WHEN size = 0 THEN t ELSE 0 END)::BIGINT AS n_zero, sum(far)::BIGINT AS far FROM s GROUP BY 1) x
            LEFT JOIN (SELECT dataset, sum(t) AS n, count(*) AS n_sizes, sum(plus * rank) AS plus, sum(t::DOUBLE * t * t - t) AS ties FROM r GROUP BY 1) y USING (dataset)"""),
        "pr_points": q(CURVE, "SELECT dataset, theta, recall, precision FROM pts"),
        "average_precision": q(CURVE, "t AS (SELECT dataset, max(recall) AS top FROM pts GROUP BY 1)",
            "g AS (SELECT t.dataset, t.top, i, coalesce(max(p.precision), 0.0) AS b FROM t CROSS JOIN range(0, 101) r(i) LEFT JOIN pts p ON p.dataset = t.dataset AND p.recall >= t.top * i / 100.0::DOUBLE - 1e-9 GROUP BY 1, 2, 3)",
            "SELECT x.dataset, round_even(sum((x.b + y.b) / 2.0 * (x.top / 100.0)), 9) AS ap FROM g x JOIN g y ON y.dataset = x.dataset AND y.i = x.i + 1 GROUP BY 1"),
        "pareto_front": q(CURVE, "SELECT dataset, recall, precision FROM (SELECT *, max(precision) OVER (PARTITION BY dataset ORDER BY recall DESC, precision DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT dataset, recall, precision FROM pts)) WHERE m IS NULL OR precision > m + 1e-9"),
        "mean_ci": q(CURVE, "SELECT dataset, count(r) AS n, round_even(avg(r), 9) AS mean, round_even(coalesce(1.96 * stddev_samp(r) / sqrt(count(r)), 0.0), 9) AS half FROM c GROUP BY 1"),
        "holm": q(CURVE, "t AS (SELECT dataset, round_even(min(r + 0.004) * avg(p), 6) AS p FROM c GROUP BY 1)", "x AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, dataset) + 1) * p AS a FROM t)",
            "SELECT dataset, p, round_even(least(max(a) OVER (ORDER BY p, dataset ROWS UNBOUNDED PRECEDING), 1.0), 9) AS holm_p, least(max(a) OVER (ORDER BY p, dataset ROWS UNBOUNDED PRECEDING), 1.0) < 0.05 AS significant FROM x"),
    }
