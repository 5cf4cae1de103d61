"""DuckDB SQL for the catalogue's queries. Trees are built here by plain window functions, apart from the Spark code."""

from __future__ import annotations

_ITEMS = r"""
  SELECT tree_id, turn, line, 0 AS item, {level} AS depth, 2 AS kind, CAST(NULL AS VARCHAR) AS text, TRUE AS is_node, 'node' AS storage FROM cut
  UNION ALL
  SELECT tree_id, turn, line, i, {level} + 1,
         CASE WHEN t = chr(10) THEN 7 WHEN regexp_matches(t, '^[ \t\r]') THEN 6 WHEN regexp_matches(t, '^[0-9]') THEN 5 ELSE 4 END, t, FALSE, CASE WHEN t = chr(10) THEN 'static' ELSE 'interned' END
  FROM (SELECT tree_id, turn, line, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM (SELECT *, regexp_extract_all(s, '\n|[ \t\r]+|[0-9]+|[^ \t\r\n0-9]+') AS toks FROM cut))
  UNION ALL
  SELECT tree_id, turn, line, 1000000000, {level} + 1, 7, '', FALSE, 'missing' FROM cut WHERE s NOT LIKE '%' || chr(10)
"""


def _tree(name: str, source: str, turns: bool) -> str:
    level = 2 if turns else 1
    turn_rows = f"UNION ALL SELECT tree_id, turn, 0, 0, 1, 3, NULL, TRUE, 'node' FROM {name}_s" if turns else ""
    return rf"""
{name}_s AS ({source}),
{name}_cut AS (SELECT tree_id, turn, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls FROM {name}_s)),
{name}_items AS ({_ITEMS.format(level=level).replace("FROM cut", f"FROM {name}_cut")}
  {turn_rows}
  UNION ALL SELECT DISTINCT tree_id, CAST(NULL AS BIGINT), -1, 0, 0, 1, NULL, TRUE, 'node' FROM {name}_s),
{name}_1 AS (SELECT *, row_number() OVER o - 1 AS pre, coalesce(strlen(text), 0) AS size, sum(coalesce(strlen(text), 0)) OVER o - coalesce(strlen(text), 0) AS start
  FROM {name}_items WINDOW o AS (PARTITION BY tree_id ORDER BY turn NULLS FIRST, line, item)),
{name}_2 AS (SELECT *, {" ".join(["CASE depth"] + [f"WHEN {d} THEN max(CASE WHEN depth = {d - 1} THEN pre END) OVER u" for d in range(1, level + 2)] + ["END"])} AS parent_pre,
  {" ".join(["CASE depth"] + [f"WHEN {d} THEN min(CASE WHEN depth <= {d} THEN pre END) OVER a" for d in range(level + 1)] + ["END"])} AS next_pre,
  max(pre) OVER t AS top, sum(size) OVER t AS total
  FROM {name}_1 WINDOW u AS (PARTITION BY tree_id ORDER BY pre ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY tree_id ORDER BY pre DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY tree_id)),
{name}_3 AS (SELECT x.*, CASE WHEN x.is_node THEN coalesce(x.next_pre - 1, x.top) ELSE x.pre END AS last,
  CASE WHEN x.is_node THEN coalesce(y.start, x.total) ELSE x.start + x.size END AS "end"
  FROM {name}_2 x LEFT JOIN {name}_1 y ON x.tree_id = y.tree_id AND x.next_pre = y.pre),
{name}_k AS (SELECT tree_id, parent_pre AS pre, count(*) AS cc, count(*) FILTER (is_node) AS nc FROM {name}_2 WHERE parent_pre IS NOT NULL GROUP BY ALL),
{name} AS MATERIALIZED (SELECT x.tree_id, x.pre, x.last, x.parent_pre, CASE WHEN x.parent_pre IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY x.tree_id, x.parent_pre ORDER BY x.pre) - 1 END AS slot,
  CASE WHEN x.is_node AND x.parent_pre IS NOT NULL THEN count(*) FILTER (x.is_node) OVER (PARTITION BY x.tree_id, x.parent_pre ORDER BY x.pre ROWS UNBOUNDED PRECEDING) - 1 END AS node_slot,
  x.depth, x.is_node, x.kind, CAST(x.start AS BIGINT) AS start, CAST(x."end" AS BIGINT) AS "end", coalesce(k.cc, 0) AS child_count, coalesce(k.nc, 0) AS node_child_count, x.storage, x.text
  FROM {name}_3 x LEFT JOIN {name}_k k ON x.tree_id = k.tree_id AND x.pre = k.pre)"""


E = "WITH " + _tree("e", "SELECT doc_id AS tree_id, CAST(0 AS BIGINT) AS turn, coalesce(text, '') AS text FROM documents", False)
C = "WITH " + _tree("c", "SELECT conv_id AS tree_id, CAST(turn AS BIGINT) AS turn, coalesce(text, '') AS text FROM conversations", True)
NAME = "CASE {k} WHEN 1 THEN 'root' WHEN 2 THEN 'line' WHEN 3 THEN 'turn' WHEN 4 THEN 'word' WHEN 5 THEN 'number' WHEN 6 THEN 'space' WHEN 7 THEN 'newline' WHEN 8 THEN 'missing' WHEN 9 THEN 'error' ELSE 'kind' || {k} END"
SUMS = "SELECT tree_id, count(*) AS n, {s} FROM {t} GROUP BY tree_id"


def _sums(t: str, *names: str) -> str:
    return SUMS.format(t=t, s=", ".join(f'CAST(coalesce(sum("{x}"), 0) AS BIGINT) AS "{x}"' for x in names))


RANGES = """, q AS (SELECT tree_id, i AS query, CAST(floor("end" * i / 5.0::DOUBLE) AS BIGINT) AS q_start, least("end", CAST(floor("end" * i / 5.0::DOUBLE) AS BIGINT) + 7 * (i - 1)) AS q_end, "end" AS len
  FROM e, (SELECT unnest([1, 2, 3]) AS i) WHERE parent_pre IS NULL)"""
INCLUDES = "CASE WHEN {x}.start = {x}.\"end\" THEN q.q_start <= {x}.start AND {x}.start < q.q_end ELSE q.q_start < {x}.\"end\" AND {x}.start < q.q_end END"
EDITS = """ed AS (SELECT doc_id AS tree_id, i AS seq, strlen(left(t, a)) AS e_start, strlen(left(t, a + i - 1)) AS e_end, repeat('é', i) AS replacement, t
  FROM (SELECT doc_id, coalesce(text, '') AS t, i, CAST(floor(length(coalesce(text, '')) * i / 10.0::DOUBLE) AS INTEGER) AS a FROM documents, (SELECT unnest([1, 4, 7]) AS i)))"""
REUSE = f""", {EDITS}, req AS (SELECT tree_id, node_slot AS request, start, kind FROM e WHERE kind = 2),
  offers AS (SELECT r.tree_id, r.request, min(x.pre) AS pre, arg_min(x.start, x.pre) AS start, arg_min(x."end", x.pre) AS "end" FROM req r JOIN e x ON x.tree_id = r.tree_id AND x.start = r.start AND x.kind = r.kind AND x.is_node
   WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.tree_id = x.tree_id AND NOT (x."end" <= ed.e_start OR ed.e_end <= x.start)) GROUP BY ALL)"""
CALC = """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS tree_id, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q, CAST(l_tax AS DECIMAL(12,2)) AS t, CAST(l_discount AS DECIMAL(12,2)) AS d, l_partkey AS p, l_suppkey AS s FROM lineitem)"""


def statements() -> dict[str, str]:
    return {
        "token_census": f"{E} SELECT d.lang, {NAME.format(k='kind')} AS kind, count(*) AS n, CAST(sum(strlen(e.text)) AS BIGINT) AS bytes, count(DISTINCT e.text) AS different FROM e JOIN documents d ON e.tree_id = d.doc_id WHERE NOT is_node AND storage <> 'missing' GROUP BY ALL",
        "kinds_table": f"{E} SELECT 'text' AS language_id, CAST(kind AS BIGINT) AS kind, {NAME.format(k='kind')} AS name, CASE WHEN kind = 7 THEN 1 ELSE 0 END AS static_length, kind IN (6, 7) AS is_trivia, kind <= 3 AS is_node, kind > 3 AS is_token, count(*) AS n FROM e GROUP BY ALL",
        "unknown_kinds": f"{E} SELECT CASE WHEN kind * 3 <= 9 THEN {NAME.format(k='(kind * 3)')} ELSE 'error' END AS name, {NAME.format(k='(kind * 3)')} AS shown, count(*) AS n FROM e GROUP BY ALL",
        "lossless_roundtrip": "SELECT TRUE AS same, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents",
        "elements_summary": f"{E} {_sums('e', 'pre', 'last', 'parent_pre', 'slot', 'node_slot', 'depth', 'start', 'end', 'child_count', 'node_child_count')}",
        "conversation_summary": f"{C} {_sums('c', 'pre', 'last', 'parent_pre', 'slot', 'node_slot', 'depth', 'start', 'end', 'child_count', 'node_child_count')}",
        "invariants": f"{E} SELECT CAST(kind AS BIGINT) AS kind, count(*) AS nodes, count(*) AS good FROM e WHERE is_node GROUP BY ALL",
        "line_spans": f'{E} SELECT tree_id, node_slot, start, "end", CAST(child_count AS INTEGER) AS child_count FROM e WHERE kind = 2',
        "parents": f'{E} SELECT CAST(p.kind AS BIGINT) AS parent_kind, CAST(x.kind AS BIGINT) AS kind, count(*) AS n, CAST(sum(p.start) AS BIGINT) AS starts, CAST(sum(p."end") AS BIGINT) AS ends FROM e x JOIN e p ON x.tree_id = p.tree_id AND x.parent_pre = p.pre GROUP BY ALL',
        "first_last_children": f"""{E}, f AS (SELECT tree_id, parent_pre AS pre, arg_min(pre, slot) AS first, arg_max(pre, slot) AS last_child, arg_min(pre, slot) FILTER (is_node) AS first_node, arg_max(pre, slot) FILTER (is_node) AS last_node FROM e WHERE parent_pre IS NOT NULL GROUP BY ALL)
            {_sums('f', 'pre', 'first', 'last_child', 'first_node', 'last_node')}""",
        "nth_children": f"""{E}, n AS (SELECT *, max(slot) OVER (PARTITION BY tree_id, parent_pre) AS m FROM e WHERE parent_pre IS NOT NULL)
            SELECT w.which, CAST(n.kind AS BIGINT) AS kind, count(*) AS n, CAST(sum(n.start) AS BIGINT) AS starts FROM n JOIN (SELECT unnest(['second', 'last', 'third_node']) AS which) w
            ON (w.which = 'second' AND slot = 1) OR (w.which = 'last' AND slot = m) OR (w.which = 'third_node' AND node_slot = 2) GROUP BY ALL""",
        "siblings_next_prev": f"""{E}, s AS (SELECT tree_id, pre, lag(pre) OVER o AS previous, lead(pre) OVER o AS next,
              max(CASE WHEN is_node THEN pre END) OVER (PARTITION BY tree_id, parent_pre ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_node,
              min(CASE WHEN is_node THEN pre END) OVER (PARTITION BY tree_id, parent_pre ORDER BY slot DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next_node
              FROM e WHERE parent_pre IS NOT NULL WINDOW o AS (PARTITION BY tree_id, parent_pre ORDER BY slot)) {_sums('s', 'pre', 'previous', 'next', 'previous_node', 'next_node')}""",
        "sibling_sets": f"""{C} SELECT a.tree_id, a.pre AS anchor, count(*) AS n, CAST(sum((a.slot - b.slot) * b.pre) AS BIGINT) AS weighted FROM c a JOIN c b ON a.tree_id = b.tree_id AND a.parent_pre = b.parent_pre AND b.slot <= a.slot WHERE a.kind = 3 GROUP BY ALL""",
        "ancestors_of_tokens": f"""{C} SELECT t.tree_id, CAST(t.depth - 1 - a.depth AS INTEGER) AS step, count(*) AS n, CAST(sum(a.pre) AS BIGINT) AS places FROM c t JOIN c a ON t.tree_id = a.tree_id AND a.is_node AND a.pre < t.pre AND t.pre <= a.last WHERE t.kind = 4 GROUP BY ALL""",
        "descendants": f"""{C} SELECT a.tree_id, a.pre AS anchor, count(*) AS n, CAST(sum(d.pre) AS BIGINT) AS places, CAST(count(*) FILTER (d.is_node) AS BIGINT) AS nodes FROM c a JOIN c d ON a.tree_id = d.tree_id AND d.pre > a.pre AND d.pre <= a.last WHERE a.kind IN (2, 3) GROUP BY ALL""",
        "walk_events": f"""{C}, w AS (SELECT tree_id, 'enter' AS what, 2 * pre - depth AS event, pre FROM c UNION ALL SELECT tree_id, 'leave', 2 * last - depth + 1, pre FROM c)
            SELECT tree_id, what, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, CAST(sum(event * pre) AS BIGINT) AS weighted FROM w GROUP BY ALL""",
        # Nodes of a document in order are the root and its lines, so the walk is written out.
        "walk_nodes": f"""{E}, w AS (SELECT tree_id, 'enter' AS what, CASE depth WHEN 0 THEN 0 ELSE 2 * node_slot + 1 END AS event, pre FROM e WHERE is_node UNION ALL
            SELECT tree_id, 'leave', CASE depth WHEN 0 THEN 2 * node_child_count + 1 ELSE 2 * node_slot + 2 END, pre FROM e WHERE is_node)
            SELECT tree_id, what, count(*) AS n, CAST(sum(event * pre) AS BIGINT) AS weighted FROM w GROUP BY ALL""",
        "visit_control": f"""{E}, l AS (SELECT tree_id, pre, last FROM e WHERE kind = 2 AND child_count > 40),
            v AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tree_id = e.tree_id AND l.pre < e.pre AND e.pre <= l.last)),
            s AS (SELECT tree_id, min(pre) AS stop FROM v WHERE kind = 5 GROUP BY tree_id), seen AS (SELECT v.* FROM v LEFT JOIN s ON v.tree_id = s.tree_id WHERE s.stop IS NULL OR v.pre <= s.stop) {_sums('seen', 'pre')}""",
        "tokens_in_range": f"""{E}{RANGES} SELECT t.tree_id, q.query, count(*) AS n, CAST(sum(t.pre) AS BIGINT) AS places FROM e t JOIN q ON t.tree_id = q.tree_id JOIN e l ON l.tree_id = t.tree_id AND l.pre = t.parent_pre JOIN e r ON r.tree_id = t.tree_id AND r.pre = 0
            WHERE NOT t.is_node AND {INCLUDES.format(x='t')} AND {INCLUDES.format(x='l')} AND {INCLUDES.format(x='r')} GROUP BY ALL""",
        "token_at_offset": f"""{E}{RANGES}, hit AS (SELECT q.tree_id, q.query, min(t.pre) FILTER (t.start <= q_start AND (q_start < t."end" OR t.start = t."end" AND t.start = q_start)) AS r,
              min(t.pre) FILTER (q_start > 0 AND t.start <= q_start - 1 AND (q_start - 1 < t."end" OR t.start = t."end" AND t.start = q_start - 1)) AS l
              FROM q JOIN e t ON t.tree_id = q.tree_id AND NOT t.is_node GROUP BY ALL)
            , named AS (SELECT q.tree_id, q.query, q.q_start AS "offset", l, r, (SELECT "end" FROM e WHERE e.tree_id = h.tree_id AND e.pre = h.l) AS l_end, (SELECT start FROM e WHERE e.tree_id = h.tree_id AND e.pre = h.r) AS r_start, (SELECT "end" FROM e WHERE e.tree_id = h.tree_id AND e.pre = h.r) AS r_end
              FROM q LEFT JOIN hit h ON q.tree_id = h.tree_id AND q.query = h.query)
            SELECT tree_id, query, "offset", CASE WHEN coalesce(l, r) IS NULL THEN 'none' WHEN r_start < r_end AND l <> r AND l_end = "offset" AND r_start = "offset" THEN 'between' ELSE 'single' END AS outcome,
              CASE WHEN r_start < r_end AND l <> r AND l_end = "offset" AND r_start = "offset" THEN l ELSE coalesce(r, l, -1) END AS "left", coalesce(r, l, -1) AS "right" FROM named""",
        "covering_element": f"""{E}{RANGES}, cov AS (SELECT q.query, x.* FROM q JOIN e x ON x.tree_id = q.tree_id AND x.start <= q.q_start AND q.q_end <= x."end"),
            chain AS (SELECT *, min(last) OVER (PARTITION BY tree_id, query ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lim FROM cov)
            SELECT tree_id, query, max(pre) AS pre, CAST(arg_max(kind, pre) AS BIGINT) AS kind, arg_max(start, pre) AS start, arg_max("end", pre) AS "end" FROM chain WHERE lim IS NULL OR lim >= pre GROUP BY ALL""",
        "find_bytes": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, contains(t, 'the ') AS has, CASE WHEN instr(t, '. ') > 0 THEN strlen(left(t, instr(t, '. ') - 1)) ELSE -1 END AS first, CASE WHEN instr(t, 'é') > 0 THEN strlen(left(t, instr(t, 'é') - 1)) ELSE -1 END AS s,
            CASE WHEN instr(t, 'é') > 0 THEN strlen(left(t, instr(t, 'é') - 1)) + 2 ELSE -1 END AS e, strlen(t) AS bytes FROM d""",
        "slice_bytes": """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents)
            SELECT doc_id, substr(h, 2 * CAST(floor(n / 3.0::DOUBLE) AS BIGINT) + 1, 40) AS bytes, TRUE AS outside FROM d""",
        "dictionary": f"{E} SELECT text, count(*) AS uses FROM e WHERE storage = 'interned' GROUP BY text",
        "dictionary_roundtrip": f"{E} SELECT storage, count(*) AS n, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM e GROUP BY storage",
        "dedup_stats": f"""{E}, t AS (SELECT is_node, kind, count(DISTINCT (storage, text)) AS different, count(*) AS occurrences FROM e WHERE NOT is_node GROUP BY ALL),
            l AS (SELECT TRUE, 2, count(DISTINCT s), count(*) FROM e_cut),
            r AS (SELECT TRUE, 1, count(DISTINCT text), count(*) FROM e_s)
            SELECT is_node, CAST(kind AS BIGINT) AS kind, different, occurrences, occurrences - different AS hits FROM (SELECT * FROM t UNION ALL SELECT * FROM l UNION ALL SELECT * FROM r)""",
        "map_ranges": f"""{E}, {EDITS}, m AS (SELECT x.tree_id, ed.seq, CASE WHEN x."end" <= e_start THEN 'unchanged' WHEN e_end <= x.start THEN 'shifted' ELSE 'invalidated' END AS outcome, x.start AS s, x."end" AS n, strlen(replacement) - (e_end - e_start) AS delta FROM e x JOIN ed ON x.tree_id = ed.tree_id WHERE x.kind = 2)
            SELECT tree_id, seq, outcome, count(*) AS n, CAST(sum(CASE outcome WHEN 'unchanged' THEN s WHEN 'shifted' THEN s + delta ELSE 0 END) AS BIGINT) AS starts, CAST(sum(CASE outcome WHEN 'unchanged' THEN n WHEN 'shifted' THEN n + delta ELSE 0 END) AS BIGINT) AS ends FROM m GROUP BY ALL""",
        "apply_edit": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(floor(length(coalesce(text, '')) * 4 / 10.0::DOUBLE) AS INTEGER) AS a FROM documents), n AS (SELECT doc_id, left(t, a) || 'éééé' || substr(t, a + 4) AS t FROM d)
            SELECT doc_id AS tree_id, sha256(t) AS sha, strlen(t) AS bytes FROM n""",
        "reuse_candidates": f"{E}{REUSE} {_sums('offers', 'request', 'pre', 'start', 'end')}",
        "reuse_counters": f"""{E}{REUSE} SELECT r.tree_id, count(*) AS queries, count(o.pre) AS hits, CAST(coalesce(sum(o."end" - o.start), 0) AS BIGINT) AS hit_bytes FROM req r LEFT JOIN offers o ON r.tree_id = o.tree_id AND r.request = o.request GROUP BY ALL""",
        "classify_paths": f"""{C}, p AS (SELECT x.tree_id, x.depth, CASE x.depth WHEN 1 THEN x.slot WHEN 2 THEN u.slot WHEN 3 THEN uu.slot END AS a, CASE x.depth WHEN 2 THEN x.slot WHEN 3 THEN u.slot END AS b
              FROM c x LEFT JOIN c u ON u.tree_id = x.tree_id AND u.pre = x.parent_pre LEFT JOIN c uu ON uu.tree_id = x.tree_id AND uu.pre = u.parent_pre)
            SELECT tree_id, CASE WHEN depth = 0 OR depth = 1 AND a = 1 THEN 'ancestor' WHEN a <> 1 OR depth > 1 AND b <> 0 THEN 'unchanged' WHEN depth = 2 THEN 'replaced_root' ELSE 'deleted' END AS outcome, count(*) AS n FROM p GROUP BY ALL""",
        "resolve_path": f"""{E}, top AS (SELECT tree_id, pre, slot, start, kind FROM e WHERE depth = 1)
            SELECT tree_id, CAST(slot AS VARCHAR) AS path, pre, start, CAST(kind AS BIGINT) AS kind FROM top WHERE slot = 0
            UNION ALL SELECT x.tree_id, p.slot || '/' || x.slot, x.pre, x.start, CAST(x.kind AS BIGINT) FROM top p JOIN e x ON x.tree_id = p.tree_id AND x.parent_pre = p.pre WHERE p.slot = 1 AND x.slot = 2
            UNION ALL SELECT x.tree_id, p.slot || '/' || x.slot, x.pre, x.start, CAST(x.kind AS BIGINT) FROM top p JOIN e x ON x.tree_id = p.tree_id AND x.parent_pre = p.pre WHERE p.slot = 9 AND x.slot = 0""",
        "replace_line": "WITH "
        + _tree("e", r"SELECT doc_id AS tree_id, CAST(0 AS BIGINT) AS turn, CASE WHEN coalesce(text, '') = '' THEN '' ELSE 'NEW 1' || chr(10) || regexp_replace(text, '^([^\n]*\n|[^\n]+)', '') END AS text FROM documents", False)
        + """ SELECT e.tree_id, count(*) AS n, CAST(sum(pre) AS BIGINT) AS pre, CAST(sum(last) AS BIGINT) AS last, CAST(coalesce(sum(parent_pre), 0) AS BIGINT) AS parent_pre, CAST(sum(start) AS BIGINT) AS start, CAST(sum("end") AS BIGINT) AS "end", CAST(sum(depth) AS BIGINT) AS depth, any_value(sha256(s.text)) AS sha
            FROM e JOIN e_s s ON e.tree_id = s.tree_id GROUP BY e.tree_id""",
        "diagnostics_by_severity": """SELECT severity, message, count(*) AS n FROM (SELECT 0 AS severity, 'empty text' AS message FROM documents WHERE coalesce(length(text), 0) = 0 UNION ALL SELECT 1, 'long text' FROM documents WHERE length(text) > 5000
            UNION ALL SELECT 2, 'tab' FROM documents WHERE contains(text, chr(9))) GROUP BY ALL""",
        "metadata_typed": f"""{E} SELECT tree_id, count(*) AS n, CAST(sum(CASE WHEN node_slot % 2 = 0 THEN -1 ELSE "end" - start END) AS BIGINT) AS total, CAST(0 AS BIGINT) AS wrong FROM e WHERE kind = 2 GROUP BY tree_id""",
        "cache_translate": f"""{C}, ln AS (SELECT x.tree_id, p.slot AS turn, x.slot, x.pre, x."end" - x.start AS value FROM c x JOIN c p ON p.tree_id = x.tree_id AND p.pre = x.parent_pre WHERE x.kind = 2),
            m AS (SELECT b.tree_id, b.pre, a.value FROM ln a JOIN ln b ON a.tree_id = b.tree_id AND a.turn = 0 AND b.turn = 1 AND a.slot = b.slot) {_sums('m', 'pre', 'value')}""",
        "cache_evict": f"""{C}, k AS (SELECT x.tree_id, CASE WHEN r.node_child_count > 4 THEN x."end" - x.start ELSE 0 END AS value FROM c x JOIN c r ON r.tree_id = x.tree_id AND r.pre = 0 WHERE x.kind = 3) {_sums('k', 'value')}""",
        "typed_overlay": f"""{E}, o AS (SELECT l.tree_id, l.pre AS node, arg_min(k.pre, k.slot) FILTER (k.kind = 4) AS word, arg_min(k.pre, k.slot) FILTER (k.kind = 5) AS number, arg_min(k.pre, k.slot) FILTER (k.kind = 7) AS newline
            FROM e l LEFT JOIN e k ON k.tree_id = l.tree_id AND k.parent_pre = l.pre WHERE l.kind = 2 GROUP BY ALL) {_sums('o', 'node', 'word', 'number', 'newline')}""",
        "dumps": f"""{C} SELECT tree_id, string_agg(repeat('  ', depth) || {NAME.format(k='kind')} || ' ' || start || '..<' || "end", chr(10) ORDER BY pre) AS dump FROM c WHERE is_node GROUP BY tree_id""",
        "calc_eval": f"""{CALC} SELECT tree_id, 'real' AS value_kind, round(CAST(n + q AS DOUBLE) * CAST(t AS DOUBLE) - CAST(round(d) AS DOUBLE), 6) AS value, '' AS error, 9 AS calls, 3 AS forks FROM x""",
        "calc_errors": f"""{CALC} SELECT tree_id, CASE WHEN n > 1 THEN p * -n + s // (n - 1) ELSE 0 END AS int_value, CASE WHEN n = 1 THEN 'division_by_zero' ELSE '' END AS error FROM x""",
        "calc_fold": f"""{CALC} SELECT tree_id, CASE WHEN n > 1 THEN CAST(p * -n + s // (n - 1) AS VARCHAR) ELSE CAST(p * -n AS VARCHAR) || ' + ' || s || ' / 0' END AS folded, CASE WHEN n > 1 THEN 3 ELSE 1 END AS fold_steps FROM x""",
        "calc_diagnostics": "SELECT 2 AS severity, 'expected expression' AS message, count(*) AS n FROM lineitem",
        "calc_dictionary": f"{CALC}, t AS (SELECT unnest([CAST(p AS VARCHAR), CAST(n AS VARCHAR), CAST(s AS VARCHAR), CAST(n - 1 AS VARCHAR), ' ']) AS t FROM x) SELECT 10 * (SELECT count(*) FROM x) AS dynamic_tokens, count(DISTINCT t) AS different FROM t",
        "session_batch": r"""WITH v AS (SELECT conv_id AS doc_id, turn AS version, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM conversations), w AS (SELECT *, coalesce(lag(lines) OVER (PARTITION BY doc_id ORDER BY version), []) AS old FROM v),
            k AS (SELECT *, list_filter(lines, lambda x: list_contains(old, x)) AS kept FROM w)
            SELECT doc_id, version, len(lines) AS queries, len(kept) AS hits, CAST(coalesce(list_sum(list_transform(kept, lambda x: strlen(x))), 0) AS BIGINT) AS hit_bytes FROM k""",
        "builder_events": f"{E} {_sums('e', 'pre', 'last', 'parent_pre', 'slot', 'node_slot', 'depth', 'start', 'end', 'child_count', 'node_child_count')}",
        "builder_errors": r"""WITH d AS (SELECT len(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+')) AS k FROM documents), m AS (SELECT 'extra_finish' AS mistake, 'finish_without_node' AS error FROM d
            UNION ALL SELECT 'open_root', 'unbalanced_start_nodes' FROM d UNION ALL SELECT 'unknown_mark', 'invalid_checkpoint' FROM d UNION ALL SELECT 'no_static_text', 'static_text_unavailable' FROM d
            UNION ALL SELECT 'static_as_token', 'static_kind_requires_static_token' FROM d UNION ALL SELECT 'no_root', CASE WHEN k = 0 THEN 'no_root' WHEN k = 1 THEN '' ELSE 'multiple_roots' END FROM d
            UNION ALL SELECT 'token_alone', CASE WHEN k = 0 THEN 'no_root' ELSE 'multiple_roots' END FROM d) SELECT mistake, error, count(*) AS n FROM m GROUP BY ALL""",
        "range_arithmetic": f"""{E}, r AS (SELECT tree_id, "end" - start AS length, 0 AS empty, 1 AS "range", 0 AS reversed, start + 100 AS moved_start, "end" + 100 AS moved_end, start + "end" AS added, "end" - start AS taken,
            CASE WHEN start >= 50 THEN 1 ELSE 0 END AS "offset", 1 AS at_end, 0 AS inside_end FROM e WHERE kind = 2) {_sums('r', 'length', 'empty', 'range', 'reversed', 'moved_start', 'moved_end', 'added', 'taken', 'offset', 'at_end', 'inside_end')}""",
        "text_equality": "SELECT doc_id, NOT contains(coalesce(text, ''), chr(233)) AS decomposed, coalesce(text, '') = lower(coalesce(text, '')) AS lower FROM documents",
        "sibling_tokens": f"""{E}, f AS (SELECT tree_id, min(pre) AS pre FROM e WHERE kind = 4 GROUP BY tree_id)
            SELECT f.tree_id, f.pre AS anchor, count(*) AS n, CAST(sum((b.slot - a.slot) * b.pre) AS BIGINT) AS weighted FROM f JOIN e a ON a.tree_id = f.tree_id AND a.pre = f.pre JOIN e b ON b.tree_id = a.tree_id AND b.parent_pre = a.parent_pre AND b.slot > a.slot GROUP BY ALL""",
        "dumps_with_tokens": f"""{C}, l AS (SELECT *, repeat('  ', depth) || {NAME.format(k='kind')} || ' ' || start || '..<' || "end" || CASE WHEN is_node THEN '' ELSE ' "' || replace(replace(replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"' END AS line FROM c)
            SELECT tree_id, sha256(string_agg(line, chr(10) ORDER BY pre)) AS sha FROM l GROUP BY tree_id""",
        # A line of the new text is an old line or the new first one; its first old place counts, and the root stays only if nothing changed.
        "reuse_witness": f"""{E}, ln AS (SELECT x.tree_id, x.pre, x.node_slot, x.child_count, s.s FROM e x JOIN e_cut s ON s.tree_id = x.tree_id AND s.line = x.node_slot + 1 WHERE x.kind = 2),
            old AS (SELECT tree_id, s, min(pre) AS old_pre FROM ln GROUP BY ALL), z AS (SELECT tree_id, 4 - child_count AS by, s AS was FROM ln WHERE node_slot = 0),
            new AS (SELECT tree_id, 'NEW 1' || chr(10) AS s, 1 AS new_pre FROM z UNION ALL SELECT ln.tree_id, ln.s, ln.pre + z.by FROM ln JOIN z ON z.tree_id = ln.tree_id WHERE ln.node_slot > 0),
            w AS (SELECT new.tree_id, old_pre, new_pre FROM new JOIN old ON new.tree_id = old.tree_id AND new.s = old.s
              UNION ALL SELECT x.tree_id, 0, 0 FROM e x LEFT JOIN z ON z.tree_id = x.tree_id WHERE x.kind = 1 AND (z.was IS NULL OR z.was = 'NEW 1' || chr(10))) {_sums('w', 'old_pre', 'new_pre')}""",
        "fnv1a": """SELECT doc_id, lower(lpad(hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS HUGEINT))),
            lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT)), 16, '0')) AS fnv FROM documents""",
        "snapshot_roundtrip": "SELECT TRUE AS same, count(*) AS n FROM documents",
        "snapshot_corrupt": "SELECT 'truncated_input' AS error, count(*) AS n FROM documents",
    }
