"""DuckDB SQL twins of the registered queries (the independent correctness oracle).

Each string runs on views named after the input tables. Computed columns carry the same
names and roundings as the Spark side.
"""

from __future__ import annotations

SQL: dict[str, str] = {}


def _reg(name: str, sql: str) -> None:
    SQL[name] = sql.strip()


# ----------------------------------------------------------------------------- bindings

PAIRS = """
SELECT o_orderkey AS pair_id,
       'How many orders did customer ' || CAST(o_custkey AS VARCHAR) || ' place with status '
         || o_orderstatus || ' and priority ' || o_orderpriority || '?' AS nlq,
       'SELECT COUNT(*) AS order_count FROM orders WHERE o_custkey = ' || CAST(o_custkey AS VARCHAR)
         || ' AND o_orderstatus = ''' || o_orderstatus || ''' AND o_orderpriority = '''
         || o_orderpriority || '''' AS sql
FROM orders
"""

DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

EX_SCORES = f"""
SELECT q.vec_id AS query_id, c.vec_id AS id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
"""

ASOF_SCORES = f"""
SELECT q.vec_id AS query_id, c.vec_id AS id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc
FROM embeddings q JOIN embeddings c
  ON c.label < q.label OR (c.label = q.label AND c.vec_id < q.vec_id)
"""

LESSON_CORPUS = """
x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings),
m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY label, pos),
n AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM m GROUP BY label),
lc AS (SELECT CAST(m.label AS BIGINT) AS lesson_id,
              list(CASE WHEN n.nrm > 0 THEN m.m / n.nrm ELSE 0.0 END ORDER BY m.pos) AS v
       FROM m JOIN n ON m.label = n.label GROUP BY m.label)
"""


def _topk(scores_cte: str, k: int) -> str:
    return f"""
s AS ({scores_cte}),
r AS (SELECT query_id, id, sc,
             row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM s),
t AS (SELECT * FROM r WHERE rank <= {k})
"""


_reg("topk_examples", f"""
WITH {_topk(EX_SCORES, 5)}
SELECT query_id, rank, id, round(sc, 6) AS score FROM t
""")

_reg("topk_lessons", f"""
WITH {LESSON_CORPUS},
{_topk("SELECT q.vec_id AS query_id, lc.lesson_id AS id, list_inner_product(CAST(q.embedding AS DOUBLE[]), lc.v) AS sc FROM embeddings q CROSS JOIN lc", 3)}
SELECT query_id, rank, id, round(sc, 6) AS score FROM t
""")

_reg("topk_lessons_asof", f"""
WITH {_topk(ASOF_SCORES, 3)}
SELECT query_id, rank, id, round(sc, 6) AS score FROM t
""")

_reg("topk_examples_cells", SQL["topk_examples"])
_reg("topk_lessons_ranges", SQL["topk_lessons_asof"])

_reg("retrieval_confidence", f"""
WITH ex AS (WITH {_topk(EX_SCORES, 5)} SELECT query_id, avg(sc) AS m, count(*) AS n FROM t GROUP BY query_id),
     ls AS (WITH {_topk(ASOF_SCORES, 3)} SELECT query_id, avg(sc) AS m, count(*) AS n FROM t GROUP BY query_id)
SELECT e.vec_id AS query_id,
       round(coalesce(ex.m, 0.0), 6) AS confidence, coalesce(ex.n, 0) AS n_examples,
       round(coalesce(ls.m, 0.0), 6) AS lesson_confidence, coalesce(ls.n, 0) AS n_lessons
FROM embeddings e LEFT JOIN ex ON ex.query_id = e.vec_id LEFT JOIN ls ON ls.query_id = e.vec_id
""")

_reg("l2_normalize", """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM v),
u AS (SELECT vec_id, nrm,
             CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm)
                  ELSE list_transform(v, lambda x: 0.0) END AS u FROM n)
SELECT vec_id AS id, round(nrm, 6) AS norm_in,
       round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm_out,
       round(u[1], 6) AS first
FROM u
""")

_reg("kb_counts", """
SELECT count(*) AS example_count, count(DISTINCT label) AS lesson_count FROM embeddings
""")

_reg("hits_to_records", f"""
WITH {_topk(EX_SCORES, 5)}, p AS ({PAIRS})
SELECT t.query_id, t.rank, t.id, round(t.sc, 6) AS score, p.nlq, p.sql
FROM t JOIN p ON p.pair_id = t.id
""")


# ----------------------------------------------------------------------------- SQL text
# DuckDB expressions built from the same regex constants as tessera.functions.sqltext.

from tessera.functions import sqltext as _st  # noqa: E402


# RE2 neither recurses nor backtracks, so the plain forms do here. The rendered inputs nest no
# deeper than the passes below; deep nesting is covered by unit tests.
_QUOTED = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\""
_COMMENT_OR_QUOTED = r"(--[^\n]*|/\*[\s\S]*?\*/)|(" + _QUOTED + ")"
_TOKEN = _QUOTED + _st.TOKEN.removeprefix(_st.QUOTED)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, {_lit(f'^{_st.WS}+|{_st.WS}+$')}, '', 'g')"


def d_tokens(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), "
            f"{_lit(_st.WS + '+')}), lambda t: t <> ''))")


def d_token_sim(a: str, b: str) -> str:
    ta, tb = d_tokens(a), d_tokens(b)
    u = f"len(list_distinct(list_concat({ta}, {tb})))"
    i = f"len(list_intersect({ta}, {tb}))"
    return f"(CASE WHEN {u} = 0 THEN 0.0 ELSE CAST({i} AS DOUBLE) / {u} END)"


def d_strip_fences(x: str) -> str:
    t = d_strip(f"coalesce({x}, '')")
    t = f"regexp_replace({t}, {_lit(_st.FENCE_HEAD)}, '')"
    t = f"regexp_replace({t}, {_lit(_st.FENCE_TAIL)}, '')"
    return d_strip(t)


def d_extract_json(x: str) -> str:
    return f"nullif(regexp_extract(coalesce({x}, ''), {_lit(_st.JSON_OBJECT)}, 0), '')"


def d_depth0(x: str) -> str:
    t = x
    for _ in range(12):
        t = f"regexp_replace({t}, {_lit(r"\([^()]*\)")}, ' ', 'g')"
    return t


def _case_map(x: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in table.items())
    return f"(CASE {x} {whens} END)"


def validate_ctes(src: str, id_col: str, sql_col: str, prefix: str = "v") -> str:
    """CTEs ending in ``{prefix}_out(id, parse_ok, valid, reason)`` for a text column."""
    ws = _st.WS
    ws_inner = ws.strip("[]")
    p = prefix
    return f"""
{p}_a AS (SELECT {id_col} AS id, {d_strip(f"coalesce({sql_col}, '')")} AS s FROM {src}),
{p}_b AS (SELECT id, s, regexp_replace(regexp_replace(s, {_lit(_COMMENT_OR_QUOTED)}, ' \\2 ', 'g'),
                                  {_lit(_QUOTED)}, ' _lit_ ', 'g') AS masked FROM {p}_a),
{p}_c AS (SELECT id, s, masked, string_split(masked, ';') AS pieces FROM {p}_b),
{p}_d AS (SELECT id, s, masked, pieces, pieces[1] AS first_stmt,
             regexp_matches(masked, {_lit(chr(39) + '["' + chr(39) + ']|/\\*')}) AS open_quote,
             (length(masked) - length(replace(masked, '(', ''))) <> (length(masked) - length(replace(masked, ')', '')))
               OR regexp_matches({d_depth0('masked')}, '[()]') AS unbalanced,
             len(pieces) - CASE WHEN regexp_matches(pieces[-1], {_lit(f'^{ws}*$')}) AND len(pieces) > 1
                                THEN 1 ELSE 0 END AS n_stmt
          FROM {p}_c),
{p}_e AS (SELECT *, upper(regexp_extract(first_stmt, {_lit(f'^{ws}*([A-Za-z_]+)')}, 1)) AS lead,
             regexp_matches(first_stmt, {_lit(f'^{ws}*' + chr(92) + '(')}) AS starts_paren,
             upper(coalesce(string_split({d_depth0('masked')}, ';')[1], '')) AS flat_first
          FROM {p}_d),
{p}_f AS (SELECT *, {_case_map('lead', _st.STATEMENT_KINDS)} AS kind,
             regexp_extract(flat_first, {_lit(r'\b(UNION|INTERSECT|EXCEPT)\b')}, 1) AS set_op,
             regexp_extract(flat_first, {_lit(r'^[^;]*?\bWITH\b[\s\S]*?\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\b')}, 1) AS with_write
          FROM {p}_e),
{p}_g AS (SELECT *,
             CASE WHEN starts_paren THEN 'Subquery'
                  WHEN set_op <> '' THEN {_case_map('set_op', _st.SET_OPERATIONS)}
                  WHEN lead = 'WITH' AND with_write <> '' AND with_write <> 'SELECT'
                       THEN {_case_map('with_write', _st.WRITE_AFTER_WITH)}
                  ELSE kind END AS top_kind,
             CASE WHEN open_quote THEN 'SQL parse error: unterminated quoted text or comment.'
                  WHEN unbalanced THEN 'SQL parse error: unbalanced parentheses.'
                  WHEN NOT starts_paren AND kind IS NULL
                       THEN 'SQL parse error: unexpected token ''' ||
                            regexp_extract(first_stmt, {_lit(f'^{ws}*([^{ws_inner}]*)')}, 1) || '''.'
             END AS parse_err
          FROM {p}_f),
{p}_out AS (SELECT id, (s <> '' AND parse_err IS NULL) AS parse_ok,
             CASE WHEN s = '' THEN 'SQL is empty.'
                  WHEN parse_err IS NOT NULL THEN parse_err
                  WHEN n_stmt > 1 THEN 'Multiple statements detected (' || CAST(n_stmt AS VARCHAR)
                       || '). Only a single SELECT or WITH is allowed.'
                  WHEN top_kind IS NULL OR top_kind NOT IN ('Select', 'With')
                       THEN 'Unsafe statement type: ' || top_kind || '. Only SELECT and WITH are allowed.'
             END AS reason
          FROM {p}_g)
"""


def canonical_ctes(src: str, id_col: str, sql_col: str, prefix: str = "k") -> str:
    """CTEs ending in ``{prefix}_out(id, canonical)``."""
    p = prefix
    kw = "[" + ", ".join(_lit(w) for w in _st.CANON_KEYWORDS) + "]"
    allw = "[" + ", ".join(_lit(w) for w in _st.CANON_UPPER) + "]"
    return f"""
{p}_a AS (SELECT {id_col} AS id,
             regexp_extract_all(regexp_replace(coalesce({sql_col}, ''), {_lit(_COMMENT_OR_QUOTED)}, ' \\2 ', 'g'),
                                {_lit(_TOKEN)}, 0) AS toks FROM {src}),
{p}_b AS (SELECT id, list_transform(toks, lambda t: CASE WHEN t = '!=' THEN '<>'
                 WHEN list_contains({allw}, upper(t)) THEN upper(t) ELSE t END) AS m FROM {p}_a),
{p}_c AS (SELECT id, CASE WHEN m[-1] = ';' THEN m[1:len(m) - 1] ELSE m END AS tr FROM {p}_b),
{p}_out AS (SELECT id, array_to_string(list_transform(range(1, len(tr) + 1), lambda i:
               tr[i] || CASE WHEN coalesce(tr[i + 1], '') IN ('', ',', ')') OR tr[i] = '('
                   OR (tr[i + 1] = '(' AND regexp_matches(tr[i], '^[A-Za-z_]') AND NOT list_contains({kw}, tr[i]))
                 THEN '' ELSE ' ' END), '') AS canonical FROM {p}_c)
"""


SQL_TEXTS = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 12
    WHEN 0 THEN 'SELECT COUNT(*) FROM orders WHERE o_orderstatus = ''' || o_orderstatus || ''''
    WHEN 1 THEN 'WITH t AS (SELECT o_custkey FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR) || ') SELECT * FROM t'
    WHEN 2 THEN 'SELECT * FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority = ''' || o_orderpriority || ''') sub'
    WHEN 3 THEN 'DROP TABLE orders_' || CAST(o_orderkey AS VARCHAR)
    WHEN 4 THEN 'INSERT INTO orders (o_orderkey) VALUES (' || CAST(o_orderkey AS VARCHAR) || ')'
    WHEN 5 THEN 'SELECT ' || CAST(o_orderkey AS VARCHAR) || '; DROP TABLE orders'
    WHEN 6 THEN '   ' || chr(10) || chr(9) || '  '
    WHEN 7 THEN 'SELET ' || CAST(o_orderkey AS VARCHAR)
    WHEN 8 THEN 'update orders set o_orderstatus = ''x'' where o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
    WHEN 9 THEN '-- count it' || chr(10) || 'select count(*) from orders where o_comment = ''a;b'' and o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
    WHEN 10 THEN 'SELECT o_orderkey FROM orders WHERE (o_totalprice > ' || CAST(o_orderkey AS VARCHAR)
    ELSE 'SELECT 1 UNION SELECT ' || CAST(o_orderkey AS VARCHAR)
  END AS sql
FROM orders
"""

PREDICTIONS = """
SELECT o_orderkey AS id,
  'select  count(*)  from orders where o_orderstatus  =  ''' ||
    CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END || '''' AS pred_sql,
  'SELECT COUNT(*) FROM orders WHERE o_orderstatus = ''' || o_orderstatus || '''' AS gold_sql
FROM orders
"""

RESPONSES = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 5
    WHEN 0 THEN '```sql' || chr(10) || b || chr(10) || '```'
    WHEN 1 THEN '```' || chr(10) || b || chr(10) || '```'
    WHEN 2 THEN '```SQL' || chr(10) || b || chr(10) || '```'
    WHEN 3 THEN b
    ELSE '  ' || chr(10) || b || chr(10) || chr(10) || '  '
  END AS text
FROM (SELECT o_orderkey, 'SELECT COUNT(*) FROM orders WHERE o_custkey = ' || CAST(o_custkey AS VARCHAR) AS b FROM orders)
"""

LESSON_TEXTS = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 7
    WHEN 0 THEN good
    WHEN 1 THEN 'Here is the lesson:' || chr(10) || good
    WHEN 2 THEN good || chr(10) || 'Hope this helps.'
    WHEN 3 THEN '{''title'': ''x' || CAST(o_orderkey AS VARCHAR) || '''}'
    WHEN 4 THEN '{"title": "t' || CAST(o_orderkey AS VARCHAR) || '", "trigger": "g"}'
    WHEN 5 THEN 'I could not produce a lesson for order ' || CAST(o_orderkey AS VARCHAR)
    ELSE '{"title": ' || CAST(o_orderkey AS VARCHAR) || ', "trigger": "g", "diagnosis": "d", "fix_rule": "f", "error_category": "other", "example": "e"}'
  END AS text
FROM (SELECT o_orderkey,
        '{"title": "Lesson ' || CAST(o_orderkey AS VARCHAR) || '", "trigger": "questions about priority '
        || o_orderpriority || '", "diagnosis": "wrong status", "fix_rule": "Always filter on '
        || o_orderstatus || '", "error_category": "'
        || ['date_handling', 'join_logic', 'aggregation', 'filter', 'other'][CAST(o_custkey % 5 + 1 AS INTEGER)]
        || '", "example": "{\\"nlq\\": \\"q\\"}"}' AS good
      FROM orders)
"""

_reg("validate_sql_texts", f"""
WITH src AS ({SQL_TEXTS}), {validate_ctes('src', 'id', 'sql')}
SELECT id, reason IS NULL AS valid, reason FROM v_out
""")

_reg("strip_fences", f"""
SELECT id, {d_strip_fences('text')} AS text FROM ({RESPONSES})
""")

_reg("token_similarity", f"""
SELECT id, round({d_token_sim('pred_sql', 'gold_sql')}, 6) AS token_sim FROM ({PREDICTIONS})
""")

_reg("sql_canonical", f"""
WITH src AS ({PREDICTIONS}), {canonical_ctes('src', 'id', 'pred_sql', 'kp')}, {canonical_ctes('src', 'id', 'gold_sql', 'kg')}
SELECT kp_out.id, kp_out.canonical AS pred_canonical, kg_out.canonical AS gold_canonical
FROM kp_out JOIN kg_out ON kp_out.id = kg_out.id
""")

_reg("sql_compare", f"""
WITH src AS ({PREDICTIONS}),
{validate_ctes('src', 'id', 'pred_sql', 'vp')}, {validate_ctes('src', 'id', 'gold_sql', 'vg')},
{canonical_ctes('src', 'id', 'pred_sql', 'kp')}, {canonical_ctes('src', 'id', 'gold_sql', 'kg')}
SELECT src.id, (vp_out.parse_ok AND vg_out.parse_ok AND kp_out.canonical = kg_out.canonical) AS ast_match,
       round({d_token_sim('src.pred_sql', 'src.gold_sql')}, 6) AS token_sim
FROM src JOIN vp_out ON vp_out.id = src.id JOIN vg_out ON vg_out.id = src.id
         JOIN kp_out ON kp_out.id = src.id JOIN kg_out ON kg_out.id = src.id
""")

# What DuckDB's own parser makes of both texts, without the places in them.
_VARIANT = ("'SELECT c.o_custkey AS k, MEDIAN(c.o_totalprice) AS m FROM orders AS c JOIN customer AS d ON c.o_custkey = d.c_custkey WHERE c.o_orderkey <> '"
            " || CAST({k} AS VARCHAR) || ' GROUP BY c.o_custkey'")
_reg("sql_variants", f"""
WITH t AS (SELECT o_orderkey AS id, {_VARIANT.format(k='o_orderkey')} AS gold, {_VARIANT.format(k='o_orderkey + 1')} AS other FROM orders),
v AS (SELECT id, gold, CASE id % 12 WHEN 0 THEN replace(gold, 'MEDIAN', 'median') WHEN 1 THEN replace(gold, ' AS ', ' ') WHEN 2 THEN replace(gold, 'JOIN', 'INNER JOIN')
    WHEN 3 THEN replace(gold, '<>', '!=') WHEN 4 THEN other WHEN 5 THEN replace(gold, 'AS m', 'AS n')
    WHEN 6 THEN replace(replace(replace(gold, 'SELECT', 'select -- what' || chr(10) || ' '), 'FROM', chr(9) || 'from'), 'GROUP BY', 'group  by')
    WHEN 7 THEN gold || ' HAVING' WHEN 8 THEN gold || ' ORDER' WHEN 9 THEN replace(gold, '<> ', '<> = ') WHEN 10 THEN gold || ' LIMIT'
    ELSE replace(gold, 'SELECT c.o_custkey', 'SELECT (c.o_custkey') || ')' END AS pred FROM t),
j AS (SELECT id, regexp_replace(json_serialize_sql(pred), '"query_location(_length)?":[0-9]+', '', 'g') AS p,
             regexp_replace(json_serialize_sql(gold), '"query_location(_length)?":[0-9]+', '', 'g') AS g FROM v)
SELECT id, p NOT LIKE '{{"error":true%' AS valid, p = g AS ast_match FROM j
""")

_reg("extract_json", f"""
SELECT id, {d_extract_json('text')} AS json FROM ({LESSON_TEXTS})
""")

_LESSON_FIELDS_SQL = ", ".join(
    f"CASE WHEN reason IS NULL THEN json_extract_string(js, '$.{f}') END AS {f}" for f in _st.LESSON_FIELDS)
_LESSON_OK_SQL = " AND ".join(f"coalesce(json_type(js, '$.{f}') = 'VARCHAR', false)" for f in _st.LESSON_FIELDS)

_reg("parse_lessons", f"""
WITH a AS (SELECT id, {d_extract_json('text')} AS js FROM ({LESSON_TEXTS})),
b AS (SELECT id, js, CASE WHEN js IS NULL THEN 'no_json'
                          WHEN NOT json_valid(js) THEN 'bad_json'
                          WHEN NOT (json_type(js) = 'OBJECT' AND {_LESSON_OK_SQL}) THEN 'invalid_lesson' END AS reason
      FROM a)
SELECT id, reason IS NULL AS ok, reason, {_LESSON_FIELDS_SQL} FROM b
""")


# ----------------------------------------------------------------------------- workload

_CUST = "(SELECT c_custkey, c_name, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)"

_reg("wl_customer_count", "SELECT count(*) AS customer_count FROM customer")
_reg("wl_customers_in_nation", f"SELECT count(*) AS customer_count FROM {_CUST} c WHERE country = 'NATION_7'")
_reg("wl_customer_names", "SELECT c_name AS name FROM customer")
_reg("wl_distinct_nations", f"SELECT DISTINCT country FROM {_CUST} c ORDER BY country")
_reg("wl_order_count", "SELECT count(*) AS order_count FROM orders")
_reg("wl_order_totals", """
SELECT round(sum(o_totalprice), 2) AS total_revenue, round(avg(o_totalprice), 2) AS avg_order_value,
       round(max(o_totalprice), 2) AS max_order_value, round(min(o_totalprice), 2) AS min_order_value
FROM orders""")
_reg("wl_orders_by_status", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS completed_count,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS pending_count FROM orders""")
_reg("wl_part_stats", "SELECT count(*) AS product_count, round(avg(p_retailprice), 2) AS avg_price FROM part")
_reg("wl_parts_in_brand", "SELECT count(*) AS product_count FROM part WHERE p_brand = 'Brand#13'")
_reg("wl_revenue_by_nation", f"""
SELECT c.country, round(sum(o.o_totalprice), 2) AS total_revenue
FROM {_CUST} c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.country ORDER BY total_revenue DESC""")
_reg("wl_orders_per_customer", """
SELECT c.c_name AS name, count(o.o_orderkey) AS order_count
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name ORDER BY order_count DESC""")
_reg("wl_frequent_customers", """
SELECT c.c_name AS name, count(o.o_orderkey) AS order_count
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name HAVING count(o.o_orderkey) > 2""")
_reg("wl_qty_per_part", """
SELECT p.p_name AS name, round(sum(l.l_quantity), 2) AS total_qty
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY p.p_partkey, p.p_name ORDER BY total_qty DESC""")
_reg("wl_revenue_by_brand", """
SELECT p.p_brand AS category, round(sum(l.l_quantity * (l.l_extendedprice / l.l_quantity)), 2) AS revenue
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY p.p_brand ORDER BY revenue DESC""")
_reg("wl_distinct_parts", "SELECT count(DISTINCT l_partkey) AS distinct_products FROM lineitem")
_reg("wl_large_orders", """
SELECT l_orderkey AS order_id, round(sum(l_quantity), 2) AS total_items FROM lineitem
GROUP BY l_orderkey HAVING sum(l_quantity) > 3""")
_reg("wl_completed_revenue", "SELECT round(sum(o_totalprice), 2) AS total_revenue FROM orders WHERE o_orderstatus = 'F'")
_reg("wl_spend_per_customer", """
SELECT c.c_name AS name, round(sum(o.o_totalprice), 2) AS total_spent
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name ORDER BY total_spent DESC""")
_reg("wl_orders_in_year", "SELECT count(*) AS order_count FROM orders WHERE year(o_orderdate) = 1998")
_reg("wl_top_price_per_brand", """
SELECT p_brand AS category, p_name AS name, p_retailprice AS price FROM part p1
WHERE p_retailprice = (SELECT max(p_retailprice) FROM part p2 WHERE p2.p_brand = p1.p_brand)
ORDER BY category""")
_reg("date_functions", """
SELECT CAST(m AS DATE) AS month, year(m) AS order_year, CAST(m + INTERVAL '1 month' AS DATE) AS next_month,
       date_diff('day', CAST(m AS DATE), CAST(m + INTERVAL '1 month' AS DATE)) AS days_in_month,
       n_orders, revenue
FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
      FROM orders GROUP BY 1)""")


# ----------------------------------------------------------------------------- records

EVAL_ITEMS = """
SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS run_id, o_orderkey AS item_id,
  o_orderstatus = 'F' AS pass1,
  (o_orderstatus <> 'F' AND o_orderstatus = 'O') AS pass2,
  (o_orderstatus <> 'F' AND NOT (o_orderstatus = 'O')) AS hard_failure,
  o_orderstatus <> 'F' AS retried,
  (o_orderstatus <> 'F' AND o_custkey % 4 <> 0) AS had_lessons,
  CAST(o_orderkey % 1000 AS DOUBLE) / 1000.0 AS sim1,
  CASE WHEN o_orderstatus = 'F' THEN NULL
       WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 100 AS DOUBLE) / 100.0 ELSE 0.0 END AS sim2,
  CAST(floor(o_totalprice) AS DOUBLE) AS latency_ms
FROM orders
"""


def metrics_sql(items: str, keys: list[str]) -> str:
    """CTE body giving the ten metrics (unrounded) per key."""
    sel = ", ".join(keys + [""]) if keys else ""
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
SELECT {sel} total, p1 AS pass1_count, p2 AS pass2_count, hf AS hard_failure_count,
  CASE WHEN total > 0 THEN (p1 + p2) / total ELSE 0.0 END AS overall_pass_rate,
  CASE WHEN total = 0 THEN 0.0 WHEN total - p1 > 0 THEN p2 / (total - p1) ELSE 1.0 END AS kb_recovery_rate,
  CASE WHEN r > 0 THEN h / r ELSE 0.0 END AS lesson_utilization,
  coalesce(s1, 0.0) AS avg_sim1, coalesce(s2, 0.0) AS avg_sim2, coalesce(lat, 0.0) AS avg_latency_ms
FROM (SELECT {sel} count(*) AS total, count(*) FILTER (WHERE pass1) AS p1, count(*) FILTER (WHERE pass2) AS p2,
             count(*) FILTER (WHERE hard_failure) AS hf, count(*) FILTER (WHERE retried) AS r,
             count(*) FILTER (WHERE had_lessons) AS h, avg(sim1) AS s1, avg(sim2) AS s2, avg(latency_ms) AS lat
      FROM ({items}) {grp})
"""


_ROUND6 = ("overall_pass_rate", "kb_recovery_rate", "lesson_utilization", "avg_sim1", "avg_sim2", "avg_latency_ms")
_M_ROUNDED = ("total, pass1_count, pass2_count, hard_failure_count, "
              + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUND6))

_reg("eval_metrics", f"SELECT {_M_ROUNDED} FROM ({metrics_sql(EVAL_ITEMS, [])})")
_reg("eval_metrics_by_run", f"SELECT run_id, {_M_ROUNDED} FROM ({metrics_sql(EVAL_ITEMS, ['run_id'])})")


def _pct(x: str) -> str:
    return f"printf('%.1f%%', round({x} * 100, 1))"


def report_sql(m: str) -> str:
    def count_line(label: str, c: str) -> str:
        return (f"CASE WHEN total > 0 THEN printf('{label}%d  (%s)', {c}, {_pct(f'{c} / total')}) "
                f"ELSE '{label}0' END")
    heavy = _lit("═" * 50)
    light = _lit("  " + "─" * 46)
    parts = [heavy, "'  Evaluation Report'", heavy,
             "printf('  Total items:          %d', total)",
             count_line("  pass@1:               ", "pass1_count"),
             count_line("  pass@2:               ", "pass2_count"),
             count_line("  Hard failures:        ", "hard_failure_count"),
             f"printf('  Overall pass rate:    %s', {_pct('overall_pass_rate')})",
             light,
             f"printf('  KB recovery rate:     %s   (%d of %d failures recovered)', {_pct('kb_recovery_rate')}, pass2_count, total - pass1_count)",
             f"printf('  Lesson utilization:   %s', {_pct('lesson_utilization')})",
             light,
             "printf('  Avg retrieval sim:    %.3f', round(avg_sim1, 3))",
             "printf('  Avg lesson sim:       %.3f', round(avg_sim2, 3))",
             "printf('  Avg latency:          %.0f ms', round(avg_latency_ms, 0))",
             heavy]
    return f"SELECT run_id, concat_ws(chr(10), {', '.join(parts)}) AS report FROM ({m})"


_reg("metrics_report", report_sql(metrics_sql(EVAL_ITEMS, ["run_id"])))

def _json_metrics_expr() -> str:
    ints = ("total", "pass1_count", "pass2_count", "hard_failure_count")
    parts = []
    for i, c in enumerate(ints + _ROUND6):
        sep = "{" if i == 0 else ","
        val = f"CAST({c} AS VARCHAR)" if c in ints else f"CAST(round({c}, 6) AS VARCHAR)"
        parts.append(f"'{sep}\"{c}\":' || {val}")
    return " || ".join(parts) + " || '}'"


_reg("metrics_json", f"""
SELECT run_id, {_json_metrics_expr()} AS metrics FROM ({metrics_sql(EVAL_ITEMS, ['run_id'])})
""")

SPLIT = """
p AS (SELECT o_orderkey AS pair_id FROM orders),
n AS (SELECT count(*) AS n FROM p),
c AS (SELECT least(greatest(1, CAST(floor(CAST(n AS DOUBLE) * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)), n - 1) AS cut FROM n),
r AS (SELECT pair_id, row_number() OVER (ORDER BY md5('42:' || CAST(pair_id AS VARCHAR)), pair_id) AS rn FROM p),
sp AS (SELECT pair_id, CASE WHEN rn <= cut THEN 'train' ELSE 'eval' END AS split FROM r, c)
"""

_reg("train_eval_split", f"WITH {SPLIT} SELECT pair_id, split FROM sp")
_reg("split_leakage_check", f"""
WITH {SPLIT}
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'eval') AS n_eval,
       (SELECT count(*) FROM sp a JOIN sp b ON a.pair_id = b.pair_id AND a.split = 'train' AND b.split = 'eval') AS n_overlap
FROM sp""")
_reg("backfill_union", f"""
WITH {SPLIT}, pr AS ({PAIRS})
SELECT pr.pair_id, pr.nlq, pr.sql, CASE WHEN sp.split = 'train' THEN 'train' ELSE 'backfill' END AS origin
FROM pr JOIN sp ON sp.pair_id = pr.pair_id""")
_reg("kb_upsert", "SELECT o_orderkey AS pair_id, e.vec_id FROM orders LEFT JOIN embeddings e ON e.vec_id = o_orderkey")
_reg("kb_append", f"""
WITH pr AS ({PAIRS}),
p AS (SELECT pr.*, o.o_orderstatus, o.o_orderpriority FROM pr JOIN orders o ON o.o_orderkey = pr.pair_id),
ex AS (SELECT * FROM p WHERE o_orderstatus = 'F'),
bk AS (SELECT md5(nlq || chr(31) || sql) AS k, min(pair_id) AS pair_id FROM p WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT pair_id, 'existing' AS origin FROM ex
UNION ALL
SELECT pair_id, 'appended' AS origin FROM bk WHERE k NOT IN (SELECT md5(nlq || chr(31) || sql) FROM ex)""")

RUN_EVENTS = """
SELECT user_id AS run_id,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS status,
       ts AS event_time, event_id FROM events
"""

_reg("kb_append_stored", f"""
WITH k AS (SELECT pair_id, md5(nlq || chr(31) || sql) AS k, o_orderstatus = 'F' AS old, o_orderpriority = '1-URGENT' AS batch
           FROM ({PAIRS}) p JOIN orders ON o_orderkey = pair_id),
d AS (SELECT k, substr(k, 1, 2) AS bucket, bool_or(old) AS old, bool_or(batch) AS batch, count(*) FILTER (old) AS n_old, count(*) FILTER (batch) AS n_batch FROM k GROUP BY k),
n AS (SELECT sum(n_old) AS offered1, sum(n_batch) AS offered2, count(*) FILTER (old) AS added1, count(*) FILTER (batch AND NOT old) AS added2,
             count(DISTINCT bucket) FILTER (old) AS t1, count(DISTINCT bucket) FILTER (batch) AS t2, count(DISTINCT bucket) FILTER (old AND batch) AS r2 FROM d)
SELECT CAST(step AS INTEGER) AS step, CAST(CASE step WHEN 1 THEN offered1 ELSE offered2 END AS BIGINT) AS n_offered, CASE step WHEN 1 THEN added1 WHEN 2 THEN added2 ELSE 0 END AS n_added,
       CASE step WHEN 1 THEN added1 ELSE added1 + added2 END AS n_after, CAST(CASE step WHEN 1 THEN t1 ELSE t2 END AS INTEGER) AS buckets_touched,
       CAST(CASE step WHEN 1 THEN 0 WHEN 2 THEN r2 ELSE t2 END AS INTEGER) AS buckets_read, added1 + added2 AS n_stored, added1 + added2 AS n_embedded
FROM n CROSS JOIN (SELECT unnest(range(1, 4)) AS step)
""")

_reg("stream_lessons", "SELECT min(id) AS lesson_id, " + ", ".join(_st.LESSON_FIELDS)
     + f" FROM ({SQL['parse_lessons']}) WHERE ok GROUP BY " + ", ".join(_st.LESSON_FIELDS))

_reg("run_status_latest", f"""
SELECT run_id, status, event_time AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_time DESC, event_id DESC) AS rn FROM ({RUN_EVENTS}))
WHERE rn = 1""")

LESSONS_OK = f"""
la AS (SELECT id, {d_extract_json('text')} AS js FROM ({LESSON_TEXTS})),
lessons_ok AS (SELECT id AS lesson_id, js FROM la WHERE js IS NOT NULL AND json_valid(js)
               AND json_type(js) = 'OBJECT' AND {_LESSON_OK_SQL})
"""

_reg("fk_orphans", f"""
WITH i AS ({EVAL_ITEMS}), {LESSONS_OK}
SELECT item_id AS result_id, 'lesson' AS ref_kind, item_id AS ref_id FROM i
WHERE retried AND item_id NOT IN (SELECT lesson_id FROM lessons_ok)
UNION ALL
SELECT item_id AS result_id, 'run' AS ref_kind, run_id AS ref_id FROM i
WHERE run_id NOT IN (SELECT DISTINCT user_id FROM events)""")

_reg("hash_embed", f"""
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), {_lit(_st.WS + '+')}),
                                             lambda x: x <> '')) AS tok FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS bucket, count(*) AS c FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(c * c)) AS nrm FROM b GROUP BY 1)
SELECT b.doc_id AS id, b.bucket, round(b.c / n.nrm, 6) AS weight FROM b JOIN n ON n.doc_id = b.doc_id""")


# ----------------------------------------------------------------------------- workflow

from tessera.functions import prompts as _pr  # noqa: E402

GOLD = ("'SELECT COUNT(*) AS order_count FROM orders WHERE o_custkey = ' || CAST(o_custkey AS VARCHAR)"
        " || ' AND o_orderstatus = ''' || o_orderstatus || ''' AND o_orderpriority = ''' || o_orderpriority || ''''")

RECORDED = f"""
WITH g AS (SELECT o_orderkey, o_custkey, {GOLD} AS gold FROM orders),
h AS (SELECT *, regexp_replace(gold, 'o_orderstatus = ''[A-Z]''', 'o_orderstatus = ''X''', 'g') AS wrong,
             regexp_replace(gold, '^SELECT COUNT\\(\\*\\) AS order_count FROM orders WHERE',
                            'select count(*) as order_count from orders where') AS low,
             '```sql' || chr(10) || gold || chr(10) || '```' AS fenced,
             CAST(o_orderkey % 97 AS DOUBLE) * 10.0 AS base_ms FROM g)
SELECT o_orderkey AS id, 'sql1' AS call,
       CASE o_orderkey % 6 WHEN 0 THEN gold WHEN 1 THEN fenced WHEN 2 THEN wrong WHEN 3 THEN 'SELET 1'
                           WHEN 4 THEN NULL ELSE low END AS text,
       CASE WHEN o_orderkey % 6 = 4 THEN 'timeout' END AS error, base_ms + 1 AS elapsed_ms FROM h
UNION ALL
SELECT o_orderkey, 'sql2', CASE o_orderkey % 4 WHEN 0 THEN gold WHEN 1 THEN wrong WHEN 2 THEN NULL ELSE fenced END,
       CASE WHEN o_orderkey % 4 = 2 THEN 'overloaded' END, base_ms + 2 FROM h
UNION ALL
SELECT o_orderkey, 'critic', CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE '1. Wrong filter value on o_orderstatus.' END,
       CASE WHEN o_orderkey % 5 = 4 THEN 'timeout' END, base_ms + 3 FROM h
UNION ALL
SELECT h.o_orderkey, 'lesson', lt.text, NULL, base_ms + 4 FROM h JOIN ({LESSON_TEXTS}) lt ON lt.id = h.o_orderkey
UNION ALL
SELECT o_orderkey, 'nlq', CASE WHEN o_orderkey % 9 = 0 THEN NULL
                               ELSE 'How many orders did customer ' || CAST(o_custkey AS VARCHAR) || ' place?' END,
       CASE WHEN o_orderkey % 9 = 0 THEN 'timeout' END, base_ms + 5 FROM h
"""

def embed_ctes(src: str, id_col: str, text: str, prefix: str, dim: int = 64) -> str:
    """CTEs ending in ``{prefix}_v(id, embedding)``: the hashed bag of words, unit length."""
    p = prefix
    return f"""
{p}_b AS (SELECT {id_col} AS id, list_transform(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), {_lit(_st.WS + '+')}),
                 lambda t: t <> ''), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) AS b FROM {src}),
{p}_c AS (SELECT id, list_transform(range({dim}), lambda i: len(list_filter(b, lambda z: z = i))) AS c FROM {p}_b),
{p}_n AS (SELECT id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS nrm FROM {p}_c),
{p}_v AS (SELECT id, list_transform(c, lambda x: CASE WHEN nrm > 0 THEN CAST(CAST(x / nrm AS FLOAT) AS DOUBLE) ELSE 0.0::DOUBLE END)
                     AS embedding FROM {p}_n)
"""


QUESTIONS = f"""
WITH pq AS (SELECT p.*, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS run_id FROM ({PAIRS}) p JOIN orders ON o_orderkey = p.pair_id),
{embed_ctes('pq', 'pair_id', 'nlq', 'qe')}
SELECT pq.pair_id AS id, qe_v.embedding, pq.run_id, pq.pair_id AS ordinal, pq.nlq, pq.sql AS gold_sql FROM pq JOIN qe_v ON qe_v.id = pq.pair_id
"""
ITEMS = QUESTIONS


def _answer_cte(name: str, src: str, call: str) -> str:
    """``name(id, {name}_text, {name}_error, {name}_ms)``: recorded answer, cleaned."""
    return f"""
{name}_raw AS (SELECT s.id, r.text AS t, r.error AS e, r.elapsed_ms AS ms, r.id IS NOT NULL AS hit
               FROM {src} s LEFT JOIN resp r ON r.id = s.id AND r.call = '{call}'),
{name} AS (SELECT id,
             CASE WHEN hit AND e IS NULL AND t IS NOT NULL THEN {d_strip_fences('t')} END AS {name}_text,
             CASE WHEN NOT hit THEN 'no recorded response' WHEN e IS NOT NULL THEN e
                  WHEN t IS NULL THEN 'response had no text' END AS {name}_error,
             coalesce(ms, 0.0) AS {name}_ms FROM {name}_raw)
"""


def _judge_ctes(name: str, text_src: str, text_col: str) -> str:
    """``{name}_pass(id, pass)`` for a relation with ``id``, a text column and ``gold_sql``."""
    return f"""
{validate_ctes(text_src, 'id', text_col, name + 'vp')},
{validate_ctes(text_src, 'id', 'gold_sql', name + 'vg')},
{canonical_ctes(text_src, 'id', text_col, name + 'kp')},
{canonical_ctes(text_src, 'id', 'gold_sql', name + 'kg')},
{name}_pass AS (SELECT s.id, (s.{text_col} IS NOT NULL AND vp.reason IS NULL AND vp.parse_ok AND vg.parse_ok
                              AND kp.canonical = kg.canonical) AS pass
                FROM {text_src} s JOIN {name}vp_out vp ON vp.id = s.id JOIN {name}vg_out vg ON vg.id = s.id
                JOIN {name}kp_out kp ON kp.id = s.id JOIN {name}kg_out kg ON kg.id = s.id)
"""


def _topk_rel(name: str, scores: str, k: int) -> str:
    """``{name}(query_id, id, sc, rank)``: the k best of ``scores`` per query, ties to the smaller id."""
    return f"""
{name}_s AS (SELECT query_id, max({{'s': sc, 'n': -id}}, {k}) AS best FROM ({scores}) GROUP BY query_id),
{name} AS (SELECT query_id, -b.n AS id, b.s AS sc, rank FROM (SELECT query_id, unnest(best) AS b, unnest(range(1, len(best) + 1)) AS rank FROM {name}_s))
"""


_reg("topk_turns", f"""
WITH u AS (SELECT conv_id * {1 << 20} + turn AS id, text FROM conversations WHERE role = 'user'),
{embed_ctes('u', 'id', 'text', 'ue')},
{_topk_rel('ex', f"SELECT q.id AS query_id, c.id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc FROM ue_v q JOIN ue_v c ON q.id <> c.id", 5)}
SELECT query_id, rank, id, round(sc, 6) AS score FROM ex""")

_reg("retry_gate", f"""
WITH items AS MATERIALIZED ({ITEMS}),
{_topk_rel('ex', f"SELECT q.id AS query_id, c.id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc FROM items q JOIN items c ON q.id <> c.id", 5)},
conf AS (SELECT i.id AS query_id, coalesce(avg(ex.sc), 0.0) AS c FROM items i LEFT JOIN ex ON ex.query_id = i.id GROUP BY i.id),
src AS ({SQL_TEXTS}), {validate_ctes('src', 'id', 'sql')}
SELECT conf.query_id, round(conf.c, 6) AS confidence, v_out.reason IS NULL AS valid,
       (conf.c < 0.75 OR v_out.reason IS NOT NULL) AS retry
FROM conf JOIN v_out ON v_out.id = conf.query_id""")


def eval_sql(prelude: str, corpus: bool = False, trigger: bool = False) -> str:
    """``trigger``: a lesson's vector is that of its trigger text, not its item's."""
    ex_from = ("FROM items q CROSS JOIN corpus c" if corpus else "FROM items q JOIN items c ON q.id <> c.id")
    lesson_vector, trigger_ctes, trigger_join = "i.embedding", "", ""
    if trigger:
        lesson_vector, trigger_join = "tr_v.embedding", "JOIN tr_v ON tr_v.id = lp.id"
        trigger_ctes = embed_ctes("lp", "id", "CASE WHEN json_valid(js) THEN json_extract_string(js, '$.trigger') END", "tr") + ","
    return f"""
WITH {prelude}, resp AS ({RECORDED}),
{_topk_rel('ex', f"SELECT q.id AS query_id, c.id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc {ex_from}", 5)},
sim1 AS (SELECT i.id, coalesce(avg(ex.sc), 0.0) AS sim1 FROM items i LEFT JOIN ex ON ex.query_id = i.id GROUP BY i.id),
{_answer_cte('a1', 'items', 'sql1')},
a1g AS (SELECT a1.*, i.gold_sql FROM a1 JOIN items i ON i.id = a1.id),
{_judge_ctes('j1', 'a1g', 'a1_text')},
failed AS (SELECT i.* FROM items i JOIN j1_pass p ON p.id = i.id WHERE NOT p.pass),
{_answer_cte('cr', 'failed', 'critic')},
crok AS (SELECT f.id FROM failed f JOIN cr ON cr.id = f.id WHERE cr.cr_error IS NULL),
{_answer_cte('ls', 'crok', 'lesson')},
lp AS (SELECT id, {d_extract_json('ls_text')} AS js FROM ls WHERE ls_error IS NULL),
{trigger_ctes}
lessons AS (SELECT i.id AS lesson_id, i.run_id, i.ordinal, {lesson_vector} AS embedding
            FROM lp JOIN items i ON i.id = lp.id {trigger_join} WHERE js IS NOT NULL AND json_valid(js) AND json_type(js) = 'OBJECT' AND {_LESSON_OK_SQL}),
{_topk_rel('lh', f"SELECT q.id AS query_id, c.lesson_id AS id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc FROM failed q JOIN lessons c ON c.run_id < q.run_id OR (c.run_id = q.run_id AND c.ordinal < q.ordinal)", 3)},
sim2 AS (SELECT f.id, coalesce(avg(lh.sc), 0.0) AS sim2, count(lh.id) AS n_lessons FROM failed f LEFT JOIN lh ON lh.query_id = f.id GROUP BY f.id),
{_answer_cte('a2', 'failed', 'sql2')},
a2g AS (SELECT a2.*, i.gold_sql FROM a2 JOIN items i ON i.id = a2.id),
{_judge_ctes('j2', 'a2g', 'a2_text')}
SELECT i.run_id, i.id AS item_id, j1.pass AS pass1, coalesce(j2.pass, false) AS pass2,
       (NOT j1.pass AND NOT coalesce(j2.pass, false)) AS hard_failure, NOT j1.pass AS retried,
       (NOT j1.pass AND coalesce(s2.n_lessons, 0) > 0) AS had_lessons,
       round(s1.sim1, 6) AS sim1, CASE WHEN NOT j1.pass THEN round(s2.sim2, 6) END AS sim2,
       a1.a1_ms + CASE WHEN NOT j1.pass THEN coalesce(a2.a2_ms, 0.0) + coalesce(cr.cr_ms, 0.0) + coalesce(ls.ls_ms, 0.0) ELSE 0.0 END AS latency_ms,
       l.lesson_id AS used_lesson_id, a1.a1_text AS pred_sql_1, a2.a2_text AS pred_sql_2
FROM items i JOIN a1 ON a1.id = i.id JOIN j1_pass j1 ON j1.id = i.id JOIN sim1 s1 ON s1.id = i.id
LEFT JOIN j2_pass j2 ON j2.id = i.id LEFT JOIN a2 ON a2.id = i.id LEFT JOIN sim2 s2 ON s2.id = i.id
LEFT JOIN cr ON cr.id = i.id LEFT JOIN ls ON ls.id = i.id LEFT JOIN lessons l ON l.lesson_id = i.id
"""


EVAL_ATTEMPTS = eval_sql(f"items AS MATERIALIZED ({ITEMS})", trigger=True)

_reg("eval_attempts", EVAL_ATTEMPTS)
_reg("eval_run_metrics", f"SELECT run_id, {_M_ROUNDED} FROM ({metrics_sql(EVAL_ATTEMPTS, ['run_id'])})")

ANSWERS = f"""
WITH items AS MATERIALIZED ({ITEMS}), resp AS ({RECORDED}),
{LESSONS_OK},
{embed_ctes('lessons_ok', 'lesson_id', "json_extract_string(js, '$.trigger')", 'tr')},
lessons AS (SELECT id AS lesson_id, embedding FROM tr_v),
{_topk_rel('ex', f"SELECT q.id AS query_id, c.id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc FROM items q JOIN items c ON q.id <> c.id", 5)},
sim1 AS (SELECT i.id, coalesce(avg(ex.sc), 0.0) AS sim1 FROM items i LEFT JOIN ex ON ex.query_id = i.id GROUP BY i.id),
{_answer_cte('a1', 'items', 'sql1')},
{validate_ctes('a1', 'id', 'a1_text', 'v1')},
retry AS (SELECT i.* FROM items i JOIN a1 ON a1.id = i.id JOIN v1_out v ON v.id = i.id JOIN sim1 s ON s.id = i.id
          WHERE a1.a1_error IS NULL AND (s.sim1 < 0.75 OR v.reason IS NOT NULL)),
{_topk_rel('lh', f"SELECT q.id AS query_id, c.lesson_id AS id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc FROM retry q CROSS JOIN lessons c", 3)},
nl AS (SELECT r.id, count(lh.id) AS n_lessons FROM retry r LEFT JOIN lh ON lh.query_id = r.id GROUP BY r.id),
{_answer_cte('a2', 'retry', 'sql2')}
SELECT i.id AS question_id,
       CASE WHEN a1.a1_error IS NOT NULL THEN '' WHEN nl.id IS NOT NULL AND a2.a2_error IS NULL THEN a2.a2_text
            ELSE a1.a1_text END AS sql,
       CASE WHEN a1.a1_error IS NOT NULL THEN 0.0 ELSE round(s.sim1, 6) END AS confidence,
       (a1.a1_error IS NULL AND nl.id IS NOT NULL AND nl.n_lessons > 0) AS used_lesson
FROM items i JOIN a1 ON a1.id = i.id JOIN sim1 s ON s.id = i.id LEFT JOIN nl ON nl.id = i.id LEFT JOIN a2 ON a2.id = i.id
"""

_reg("answer_questions", ANSWERS)


def _sql_lit_long(s: str) -> str:
    return _lit(s)


_HUMAN_HEAD = _lit("### Schema\n" + _pr.SCHEMA + "\n### Examples\n")

EXAMPLE_BLOCKS = f"""
items AS MATERIALIZED ({ITEMS}),
{_topk_rel('ex', f"SELECT q.id AS query_id, c.id, {DOT.format(a='q.embedding', b='c.embedding')} AS sc FROM items q JOIN items c ON q.id <> c.id", 5)},
exr AS (SELECT ex.query_id, ex.rank, ex.sc, p.nlq, p.sql FROM ex JOIN ({PAIRS}) p ON p.pair_id = ex.id),
exn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM exr),
blocks AS (SELECT query_id,
                  string_agg(printf({_lit(_pr.EXAMPLE_LINE.replace(chr(10), '~NL~'))}, i, round(sc, 2), nlq, sql), '~SEP~' ORDER BY i) AS b0,
                  count(*) AS n_examples
           FROM exn GROUP BY query_id),
blk AS (SELECT query_id, replace(replace(b0, '~NL~', chr(10)), '~SEP~', chr(10) || chr(10)) AS examples_block, n_examples FROM blocks)
"""

_reg("prompt_blocks", f"WITH {EXAMPLE_BLOCKS} SELECT query_id, examples_block, n_examples FROM blk")

_reg("sql_prompts", f"""
WITH {EXAMPLE_BLOCKS}
SELECT i.id AS query_id, CAST(1 AS BIGINT) AS attempt, CAST(0.0 AS DOUBLE) AS temperature,
       {_HUMAN_HEAD} || coalesce(blk.examples_block, {_lit(_pr.NO_EXAMPLES)}) || {_lit(chr(10) * 2 + '### Question' + chr(10))} || i.nlq AS human
FROM items i LEFT JOIN blk ON blk.query_id = i.id
""")

_reg("nlq_prompts", f"""
SELECT pair_id, {_lit(_pr.NLQ_GEN_LEAD + '### Schema' + chr(10) + _pr.SCHEMA + chr(10) + '### SQL' + chr(10))} || sql AS human
FROM ({PAIRS})
""")


def _critic_expr(nlq: str, pred: str, gold: str) -> str:
    nl = chr(10)
    return (f"{_lit(_pr.CRITIC_LEAD + '### Question' + nl)} || {nlq} || {_lit(nl * 2 + '### Predicted SQL (wrong)' + nl)}"
            f" || {pred} || {_lit(nl * 2 + '### Gold SQL (correct)' + nl)} || {gold} || {_lit(_pr.CRITIC_TAIL)}")


def _lesson_expr(nlq: str, pred: str, gold: str, errors: str) -> str:
    nl = chr(10)
    return (f"{_lit(_pr.LESSON_LEAD + '### Question' + nl)} || {nlq} || {_lit(nl * 2 + '### Predicted SQL (wrong)' + nl)}"
            f" || {pred} || {_lit(nl * 2 + '### Gold SQL (correct)' + nl)} || {gold}"
            f" || {_lit(nl * 2 + '### Errors identified' + nl)} || {errors} || {_lit(_pr.LESSON_TAIL)}")


_reg("critic_prompts", f"""
SELECT p.id, {_critic_expr('q.nlq', 'p.pred_sql', 'p.gold_sql')} AS human
FROM ({PREDICTIONS}) p JOIN ({PAIRS}) q ON q.pair_id = p.id
""")

_reg("lesson_prompts", f"""
SELECT p.id, {_lesson_expr('q.nlq', 'p.pred_sql', 'p.gold_sql', _lit('1. Wrong filter value on o_orderstatus.'))} AS human
FROM ({PREDICTIONS}) p JOIN ({PAIRS}) q ON q.pair_id = p.id
""")

_reg("model_responses", f"""
WITH items AS ({ITEMS}), resp AS ({RECORDED}), {_answer_cte('a1', 'items', 'sql1')}
SELECT id, a1_text AS text, a1_error AS error, a1_ms AS elapsed_ms FROM a1
""")


# ----------------------------------------------------------------------------- repair

CANDIDATES = """
SELECT o_orderkey AS id, it.iteration,
  CASE it.iteration
    WHEN 1 THEN CASE o_orderkey % 5 WHEN 0 THEN good WHEN 4 THEN '  ' ELSE bad END
    WHEN 2 THEN CASE o_orderkey % 5 WHEN 0 THEN good WHEN 1 THEN '```sql' || chr(10) || good || chr(10) || '```'
                     WHEN 2 THEN 'DELETE FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
                     WHEN 3 THEN 'GIVE_UP' ELSE bad END
    ELSE CASE o_orderkey % 5 WHEN 2 THEN 'SELECT (o_orderkey FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
                             WHEN 4 THEN '```' || chr(10) || good || chr(10) || '```' ELSE good END
  END AS text
FROM (SELECT o_orderkey, 'SELECT COUNT(*) FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR) AS good,
             'SELET COUNT(*) FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR) AS bad FROM orders) o
CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS iteration) it
"""

REPAIR_BASE = f"""
src AS ({SQL_TEXTS}), {validate_ctes('src', 'id', 'sql', 'vj')},
jobs AS (SELECT s.id, p.nlq, s.sql AS broken_sql FROM src s JOIN vj_out v ON v.id = s.id JOIN ({PAIRS}) p ON p.pair_id = s.id
         WHERE v.reason IS NOT NULL),
cand0 AS (SELECT id, iteration, {d_strip_fences('text')} AS clean FROM ({CANDIDATES}) WHERE iteration BETWEEN 1 AND 3),
{validate_ctes('cand0', 'id * 10 + iteration', 'clean', 'vc')},
cand AS (SELECT c.id, c.iteration, c.clean, v.reason,
                CASE WHEN c.clean = 'GIVE_UP' THEN 'give_up' WHEN v.reason IS NULL THEN 'fixed' ELSE 'invalid' END AS kind
         FROM cand0 c JOIN vc_out v ON v.id = c.id * 10 + c.iteration),
term AS (SELECT id, min(iteration) AS t FROM cand WHERE kind <> 'invalid' GROUP BY id)
"""

_reg("repair_outcome", f"""
WITH {REPAIR_BASE},
last AS (SELECT id, max(iteration) AS li FROM cand GROUP BY id)
SELECT j.id,
  CASE WHEN t.t IS NOT NULL THEN CASE WHEN ft.kind = 'give_up' THEN NULL ELSE ft.clean END
       WHEN l.li IS NOT NULL THEN lc.clean ELSE j.broken_sql END AS fixed_sql,
  (t.t IS NOT NULL AND ft.kind = 'fixed') AS success,
  CAST(CASE WHEN t.t IS NOT NULL THEN t.t WHEN l.li IS NOT NULL THEN l.li ELSE 0 END AS BIGINT) AS iterations
FROM jobs j LEFT JOIN term t ON t.id = j.id LEFT JOIN cand ft ON ft.id = j.id AND ft.iteration = t.t
LEFT JOIN last l ON l.id = j.id LEFT JOIN cand lc ON lc.id = j.id AND lc.iteration = l.li
""")

_reg("repair_history", f"""
WITH {REPAIR_BASE}
SELECT c.id, CAST(c.iteration AS BIGINT) AS step,
  CASE c.kind WHEN 'give_up' THEN printf('iteration %d: agent gave up', c.iteration)
              WHEN 'fixed' THEN printf('iteration %d: fixed SQL validated successfully', c.iteration)
              ELSE printf('iteration %d: candidate SQL still invalid — %s', c.iteration, c.reason) END AS line
FROM cand c LEFT JOIN term t ON t.id = c.id
WHERE c.id IN (SELECT id FROM jobs) AND (t.t IS NULL OR c.iteration <= t.t)
UNION ALL
SELECT c.id, CAST(max(c.iteration) + 1 AS BIGINT), 'max iterations (3) reached without a valid fix'
FROM cand c WHERE c.id IN (SELECT id FROM jobs) GROUP BY c.id HAVING count(*) FILTER (WHERE c.kind <> 'invalid') = 0
""")

_reg("repair_observations", f"""
WITH {REPAIR_BASE}
SELECT c.id, CAST(c.iteration AS BIGINT) AS iteration,
  '{{"valid": ' || CASE WHEN c.reason IS NULL THEN 'true' ELSE 'false' END || ', "error": '
    || CASE WHEN c.reason IS NULL THEN 'null'
            ELSE '"' || replace(replace(replace(replace(c.reason, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"' END
    || '}}' AS validation_json,
  CASE WHEN c.kind = 'invalid' THEN {_critic_expr("CASE WHEN c.reason IS NULL THEN j.nlq ELSE j.nlq || chr(10) || chr(10) || 'Validation error: ' || c.reason END", 'j.broken_sql', 'j.broken_sql')} END AS critic_human
FROM cand c JOIN jobs j ON j.id = c.id
""")


# The outcome in closed form: a first turn of tools (key mod 7 < 3) shifts the candidates by one turn,
# and the first of these ends a job: the critic's failure in that turn, the failure of turn 2, a
# terminal candidate, the third candidate.
_reg("repair_rounds", f"""
WITH {REPAIR_BASE},
s AS (SELECT id, CASE WHEN id % 7 <= 2 THEN 1 ELSE 0 END AS shift, id % 7 = 1 AND id % 5 = 4 AS critic_failed, id % 11 = 10 AS call_failed FROM jobs),
e AS (SELECT s.*, coalesce(t.t, 3) AS last, t.t FROM s LEFT JOIN term t ON t.id = s.id),
f AS (SELECT *, CASE WHEN critic_failed THEN 0 WHEN call_failed AND last + shift >= 2 THEN 1 - shift ELSE last END AS iterations,
             CASE WHEN critic_failed THEN 1 WHEN call_failed AND last + shift >= 2 THEN 2 ELSE last + shift END AS turns,
             CASE WHEN critic_failed OR call_failed AND last + shift >= 2 THEN 'timeout' END AS error FROM e),
g AS (SELECT f.id, string_agg(CASE c.kind WHEN 'give_up' THEN printf('iteration %d: agent gave up', c.iteration)
                                   WHEN 'fixed' THEN printf('iteration %d: fixed SQL validated successfully', c.iteration)
                                   ELSE printf('iteration %d: candidate SQL still invalid — %s', c.iteration, c.reason) END, chr(10) ORDER BY c.iteration) AS lines
      FROM f JOIN cand c ON c.id = f.id AND c.iteration <= f.iterations GROUP BY f.id)
SELECT f.id, CASE WHEN error IS NULL AND c.kind <> 'give_up' THEN c.clean END AS fixed_sql, error IS NULL AND c.kind = 'fixed' AS success,
       CAST(f.iterations AS BIGINT) AS iterations, CAST(f.turns AS BIGINT) AS turns, f.error,
       concat_ws(chr(10), CASE WHEN critic_failed OR shift = 0 THEN NULL WHEN f.id % 7 = 0 THEN 'iteration 1: called tools [''validate_sql'']'
                               WHEN f.id % 7 = 1 THEN 'iteration 1: called tools [''validate_sql'', ''analyze_errors'']' ELSE 'iteration 1: called tools [''run_sql'']' END,
                 g.lines, CASE WHEN error IS NULL AND f.t IS NULL THEN 'max iterations (3) reached without a valid fix' END) AS history
FROM f LEFT JOIN g ON g.id = f.id LEFT JOIN cand c ON c.id = f.id AND c.iteration = f.iterations
""")

# ----------------------------------------------------------------------------- ingest

from tessera.sources.pairs import MISSING_MARKERS as _NA  # noqa: E402

PAIR_CSV_ROWS = f"""
SELECT pair_id,
  CASE pair_id % 8 WHEN 1 THEN '' WHEN 2 THEN '  ' || nlq || chr(9) WHEN 4 THEN 'NA' ELSE nlq END AS nlq,
  CASE pair_id % 8 WHEN 2 THEN chr(10) || ' ' || sql || ' ' || chr(10) WHEN 3 THEN ''
                   WHEN 5 THEN sql || chr(10) || '-- second line' WHEN 6 THEN '   ' ELSE sql END AS sql
FROM ({PAIRS})
"""


def _na(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} IN ({', '.join(_lit(x) for x in _NA)}) THEN '' ELSE {c} END"


INGESTED = f"""
SELECT pair_id, nlq, sql FROM (
  SELECT pair_id, {d_strip(_na('nlq'))} AS nlq, {d_strip(_na('sql'))} AS sql FROM ({PAIR_CSV_ROWS}))
WHERE length(sql) > 0
"""

_reg("ingest_pairs", INGESTED)

_reg("fill_missing_nlq", f"""
WITH p AS ({INGESTED}), resp AS ({RECORDED}),
need AS (SELECT pair_id AS id, sql FROM p WHERE nlq = ''),
{_answer_cte('f', 'need', 'nlq')}
SELECT pair_id, nlq, sql FROM p WHERE nlq <> ''
UNION ALL
SELECT n.id AS pair_id, f.f_text AS nlq, n.sql FROM need n JOIN f ON f.id = n.id WHERE f.f_error IS NULL
""")

_reg("stream_ingest_pairs", f"SELECT DISTINCT nlq, sql FROM ({INGESTED})")


_FILLED = f"""
WITH p AS ({INGESTED}), resp AS ({RECORDED}),
need AS (SELECT pair_id AS id, sql FROM p WHERE nlq = ''),
{_answer_cte('f', 'need', 'nlq')}
SELECT pair_id, nlq, sql FROM p WHERE nlq <> ''
UNION ALL
SELECT n.id AS pair_id, f.f_text AS nlq, n.sql FROM need n JOIN f ON f.id = n.id WHERE f.f_error IS NULL
"""

_CYCLE_PRELUDE = f"""
fp AS ({_FILLED}),
{embed_ctes('fp', 'pair_id', 'nlq', 'qe')},
ia AS (SELECT fp.pair_id AS id, qe_v.embedding,
              CAST(('0x' || substr(md5('42:' || CAST(fp.pair_id AS VARCHAR)), 1, 15)) AS BIGINT) AS run_id,
              fp.pair_id AS ordinal, fp.nlq, fp.sql AS gold_sql
       FROM fp JOIN qe_v ON qe_v.id = fp.pair_id),
nn AS (SELECT count(*) AS n FROM ia),
cc AS (SELECT least(greatest(1, CAST(floor(CAST(n AS DOUBLE) * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)), n - 1) AS cut FROM nn),
rr AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM ia),
sp AS (SELECT rr.id, CASE WHEN rn <= cut THEN 'train' ELSE 'eval' END AS split FROM rr, cc),
items AS (SELECT ia.* FROM ia JOIN sp ON sp.id = ia.id WHERE sp.split = 'eval'),
corpus AS (SELECT ia.id, ia.embedding, ia.nlq, ia.gold_sql AS sql FROM ia JOIN sp ON sp.id = ia.id WHERE sp.split = 'train')
"""

_reg("training_cycle_metrics", f"""
WITH ev AS ({eval_sql(_CYCLE_PRELUDE, corpus=True, trigger=True)}),
m AS ({metrics_sql('SELECT CAST(1 AS BIGINT) AS run_id, * EXCLUDE (run_id) FROM ev', ['run_id'])}),
sz AS (WITH {_CYCLE_PRELUDE} SELECT count(*) FILTER (WHERE split = 'train') AS n_train,
                                    count(*) FILTER (WHERE split = 'eval') AS n_eval, count(*) AS n_all FROM sp)
SELECT m.run_id, 'done' AS status, sz.n_train, sz.n_eval, sz.n_all AS n_examples_after_backfill,
       m.total, m.pass1_count, m.pass2_count, m.hard_failure_count,
       {', '.join(f'round(m.{c}, 6) AS {c}' for c in _ROUND6)}
FROM m, sz
""")

# A stored run gives what the same cycle in memory gives.
_reg("training_run_stored", SQL["training_cycle_metrics"])
