import pytest

from conftest import one_col
from pyspark.sql import functions as F
from tessera.functions import sqltext as st


def _validate(spark, texts):
    df = one_col(spark, texts).select("id", st.validate_sql("v").alias("r"))
    rows = {r["id"]: (r["r"]["valid"], r["r"]["reason"]) for r in df.collect()}
    return [rows[i] for i in range(len(texts))]


def test_one_query_is_valid(spark):
    texts = ["select o_orderkey, sum(o_totalprice) from orders group by o_orderkey having sum(o_totalprice) > 1e5",
             "with late as (select * from lineitem where l_shipdate > l_commitdate) select count(*) from late;",
             "-- first line\nSELECT l_comment /* ; */ FROM lineitem WHERE l_comment = 'a;b''c' AND \"odd;name\" = 2",
             "SELECT (SELECT max(l_tax) FROM lineitem WHERE l_orderkey = o_orderkey) AS top FROM orders"]
    assert _validate(spark, texts) == [(True, None)] * len(texts)


def test_reasons(spark):
    texts = ["\n \t", "SELECT l_tax FROM lineitem WHERE (l_tax > 1", "SELECT l_tax) FROM (lineitem", "SELECT 'open FROM orders",
             "SELECT 1 /* open", "FETCH orders", "SELECT 1 FROM orders; SELECT 2 FROM orders; ", "TRUNCATE orders",
             "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem", "(SELECT * FROM orders)",
             "WITH gone AS (SELECT 1) DELETE FROM orders", "MERGE INTO orders USING lineitem ON true"]
    got = [r for _, r in _validate(spark, texts)]
    assert got[0] == "SQL is empty."
    assert all(r.startswith("SQL parse error: ") for r in got[1:6])
    assert got[6].startswith("Multiple statements detected (2).")
    kinds = ["TruncateTable", "Except", "Subquery", "Delete", "Merge"]
    assert got[7:] == [f"Unsafe statement type: {k}. Only SELECT and WITH are allowed." for k in kinds]


def test_incomplete_clauses(spark):
    broken = ["SELECT FROM WHERE", "SELECT l_tax FROM lineitem WHERE", "SELECT l_tax FROM lineitem WHERE l_tax > 1 AND",
              "SELECT * FORM lineitem", "select l_tax from lineitem where order by l_tax", "SELECT count(*) FROM",
              "SELECT l_tax FROM lineitem WHERE l_tax IN (SELECT l_tax FROM lineitem WHERE)"]
    assert [r for _, r in _validate(spark, broken)] == ["SQL parse error: incomplete clause."] * len(broken)
    whole = ["SELECT * EXCEPT (l_tax) FROM lineitem", "SELECT * FROM lineitem", "select l_tax * l_discount from lineitem",
             "SELECT l_tax FROM lineitem WHERE l_tax BETWEEN 1 AND 2 OR NOT l_tax IS DISTINCT FROM 3",
             "SELECT 'x AND', \"FROM\" FROM lineitem", "SELECT t.by FROM lineitem t", "SELECT extract(year FROM l_shipdate) FROM lineitem",
             "SELECT count(*) FILTER (WHERE l_tax > 1) OVER (PARTITION BY l_orderkey ORDER BY l_tax) FROM lineitem -- WHERE",
             "SELECT CASE WHEN l_tax > 1 THEN 'FROM WHERE' ELSE 'b' END FROM lineitem"]
    assert _validate(spark, whole) == [(True, None)] * len(whole)
    both = "SELECT * EXCEPT (l_tax) FROM lineitem EXCEPT SELECT * FROM orders"
    assert _validate(spark, [both])[0][1].startswith("Unsafe statement type: Except.")


def test_long_and_deep_texts(spark):
    texts = ["SELECT '" + "x" * 1_000_000 + "' FROM orders", "SELECT '" + "''" * 50_000 + "' FROM orders",
             'SELECT "' + '""' * 50_000 + '" FROM orders', "SELECT '" + "''" * 50_000 + " FROM orders"]
    texts += ["SELECT " + "(" * n + "1" + ")" * n + " FROM orders" for n in (13, 100, 1000)]
    texts += ["SELECT " + "(" * 100 + "1" + ")" * 99, "SELECT " + "(1) + " * 2000 + "1", "SELECT (a UNION b)" + "()" * 20 + " UNION SELECT 1"]
    got = _validate(spark, texts)
    assert [ok for ok, _ in got] == [True, True, True, False, True, True, True, False, True, False]
    assert got[-1][1].startswith("Unsafe statement type: Union.")
    df = one_col(spark, texts[:3]).select(st.ast_match("v", "v").alias("m"))
    assert all(r.m for r in df.collect())


def _pairs(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a string, b string")
    out = df.select("id", st.ast_match("a", "b").alias("m"), st.token_similarity("a", "b").alias("s"))
    rows = {r["id"]: (r["m"], r["s"]) for r in out.collect()}
    return [rows[i] for i in range(len(pairs))]


def test_canonical_match(spark):
    same = [("select sum( l_tax ) from lineitem", "SELECT  SUM(l_tax)\nFROM lineitem ;"),
            ("SELECT o_orderkey FROM orders WHERE o_custkey != 7", "select o_orderkey from orders -- note\nwhere o_custkey <> 7")]
    differ = [("SELECT l_tax FROM lineitem WHERE l_returnflag = 'R'", "SELECT l_tax FROM lineitem WHERE l_returnflag = 'r'"),
              ("SELECT min(l_tax) FROM lineitem", "SELECT max(l_tax) FROM lineitem"),
              ("SELECT l_tax AS a FROM lineitem", "SELECT l_tax AS b FROM lineitem"),
              ("SELECT 1 FROM orders", "SELECT 1 FROM lineitem"), ("LOOK orders", "LOOK orders"), ("", "")]
    assert [m for m, _ in _pairs(spark, same + differ)] == [True] * len(same) + [False] * len(differ)


def test_token_similarity(spark):
    got = [s for _, s in _pairs(spark, [("select l_tax from lineitem", "SELECT l_tax FROM lineitem"), ("a b c", "d e"), ("a b c d", "c d e f"),
                                        ("", ""), ("a a a", "a"), ("a", None)])]
    assert got == [1.0, 0.0, pytest.approx(2 / 6), 0.0, 1.0, 0.0]


def test_strip_fences(spark):
    texts = ["```sql\nSELECT 1\n```", "```\nSELECT 1\n```", "```SQL\nSELECT 1\n```", "SELECT 1",
             "  \n SELECT 1 \n  "]
    df = one_col(spark, texts).select("id", st.strip_fences("v").alias("t"))
    assert [r["t"] for r in df.orderBy("id").collect()] == ["SELECT 1"] * 5


def test_extract_and_parse_lessons(spark):
    good = ('{"title": "T", "trigger": "g", "diagnosis": "d", "fix_rule": "Always x", '
            '"error_category": "filter", "example": "{}"}')
    texts = [good, "Here is the lesson:\n" + good, good + "\nThanks", good.replace(", ", ",\n"),
             "{'title': 'x'}", '{"title": "t"}', "no json here", good.replace('"T"', "5")]
    df = one_col(spark, texts).select("id", st.parse_lesson("v").alias("p"))
    rows = [r["p"] for r in df.orderBy("id").collect()]
    assert [r["ok"] for r in rows] == [True, True, True, True, False, False, False, False]
    assert [r["reason"] for r in rows[4:]] == ["bad_json", "invalid_lesson", "no_json", "invalid_lesson"]
    assert rows[0]["title"] == "T" and rows[1]["fix_rule"] == "Always x"


def test_canonical_text(spark):
    df = one_col(spark, ["select count( * ) from t where a != 'x' ;"]).select(st.canonical_sql("v").alias("c"))
    assert df.first()["c"] == "SELECT COUNT(*) FROM t WHERE a <> 'x'"


def test_canonical_spacing_cases(spark):
    texts = ["select f ( g ( x ) ) , a from t where b in ( 1 , 2 )", "SELECT COUNT(*) AS n FROM (SELECT 1) s",
             "with c as (select 1) select * from c", "select x.y from t limit 5"]
    df = one_col(spark, texts).select("id", st.canonical_sql("v").alias("c"))
    got = [r["c"] for r in df.orderBy("id").collect()]
    assert got == ["SELECT F(G(x)), a FROM t WHERE b IN (1, 2)", "SELECT COUNT(*) AS n FROM (SELECT 1) AS s",
                   "WITH c AS (SELECT 1) SELECT * FROM c", "SELECT x . y FROM t LIMIT 5"]


def test_canonical_keeps_literals(spark):
    df = one_col(spark, ["select 'a , b ( c )' , f (x) from t"]).select(st.canonical_sql("v").alias("c"))
    assert df.first()["c"] == "SELECT 'a , b ( c )', F(x) FROM t"


def test_strip_is_linear(spark):
    """A run of blanks of any length, inside or around, costs no more than reading it."""
    import time

    texts = ["a" + " " * 1_000_000 + "b", " " * 1_000_000 + "x", "\u3000\x1c\n y\u2009\x85", "```sql\n" + "z" + " " * 1_000_000 + "z\n```"]
    df = one_col(spark, texts)
    df.select(st.py_strip("v"), st.strip_fences("v")).collect()
    start = time.perf_counter()
    got = [tuple(r) for r in df.orderBy("id").select(st.py_strip("v"), st.strip_fences("v")).collect()]
    assert time.perf_counter() - start < 5
    assert got == [(texts[0], texts[0]), ("x", "x"), ("y", "y"), (texts[3], "z" + " " * 1_000_000 + "z")]


def test_broken_clauses(spark):
    bad = ["SELECT a, FROM t", "SELECT a FROM t,", "SELECT * FROM t LIMIT", "SELECT count(*) FROM t ORDER", "SELECT a FROM t WHERE x = = 1", "SELECT (a FROM t)",
           "SELECT a FROM t WHERE x =", "SELECT a FROM (SELECT b, FROM u) v", "SELECT a FROM t GROUP x", "SELECT f(a, (b FROM t)) FROM u", "SELECT a FROM t WHERE (x >) AND y"]
    good = ["SELECT a, b FROM t, u LIMIT 3 OFFSET 2", "SELECT EXTRACT(year FROM d), TRIM(BOTH 'x' FROM s) FROM t", "SELECT a FROM t WHERE a IS DISTINCT FROM b",
            "SELECT count(*) FILTER (WHERE x >= 1) OVER (PARTITION BY a ORDER BY b) FROM t", "WITH c AS (SELECT 1 AS a) SELECT (SELECT max(a) FROM c) AS m FROM c",
            "SELECT t.order, t.group, t.limit FROM t", "FROM t SELECT a", "SELECT * FROM (FROM t) u WHERE x <> -1", "SELECT quantile_cont(0.5) WITHIN GROUP (ORDER BY x) FROM t",
            "SELECT a FROM t WHERE s = 'x, FROM' AND b IN (SELECT c FROM u ORDER BY c LIMIT 1) GROUP BY a, b HAVING count(*) > 1 ORDER BY 1 DESC"]
    got = _validate(spark, bad + good)
    assert [ok for ok, _ in got] == [False] * len(bad) + [True] * len(good)
    assert all("incomplete clause" in why for ok, why in got if not ok)


def test_other_ways_to_write_it(spark):
    pairs = [("SELECT MEDIAN(a) FROM t", "select median(a) from t", True), ("SELECT COUNT(*) n FROM t u", "SELECT COUNT(*) AS n FROM t AS u", True),
             ("SELECT a FROM t INNER JOIN u ON t.i = u.i", "SELECT a FROM t JOIN u ON t.i = u.i", True), ("SELECT a x, 1 y, 's' z FROM (SELECT 2 b) q", "SELECT a AS x, 1 AS y, 's' AS z FROM (SELECT 2 AS b) AS q", True),
             ("SELECT CASE WHEN a THEN 1 END c FROM t", "SELECT CASE WHEN a THEN 1 END AS c FROM t", True), ("SELECT d + INTERVAL '1' month FROM t", "SELECT d + INTERVAL '1' month FROM t", True),
             ("SELECT t.a FROM t", "SELECT t.A FROM t", False), ("SELECT 'median' FROM t", "SELECT 'MEDIAN' FROM t", False), ("SELECT a b FROM t", "SELECT a AS c FROM t", False),
             ("SELECT a FROM t LEFT JOIN u ON t.i = u.i", "SELECT a FROM t JOIN u ON t.i = u.i", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "id long, a string, b string")
    got = {r.id: r.m for r in st.with_comparison(df, "a", "b", "c").select("id", "c_match").toDF("id", "m").collect()}
    assert [got[i] for i in range(len(pairs))] == [m for *_, m in pairs]


def test_clauses_without_a_fold(spark):
    """Only a FROM that may stand in an expression is left to the fold, and the canonical form is taken
    by the batch: a plan of comparisons folds no tokens but those."""
    texts = ["SELECT a . . LIMIT )", "SELECT a.limit FROM t", "SELECT 1LIMIT", "SELECT a FROM (SELECT b FROM (SELECT c FROM u) v) w",
             "SELECT (f(a) FROM t)", "SELECT (SELECT max(a) FROM c) FROM t", "SELECT f((a IS DISTINCT FROM b)) FROM t", "SELECT ((a) FROM t"]
    df = one_col(spark, texts)
    rows = df.select("id", st.clause_row(st.mask_sql("v")).alias("row")).withColumn("outside", st.clause_outside(F.col("row"))) \
        .select("id", "row", st.clause_fault(F.col("row"), F.col("outside")).alias("bad")).orderBy("id").collect()
    assert rows[0].row == " SELECT A . name LIMIT ) $ " and rows[1].row == " SELECT A . name FROM T $ "
    assert [r.bad for r in rows] == [True, False, True, False, True, False, False, True]
    plan = st.with_comparison(df, "v", "v", "c").select("c_match")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "transform(" not in plan and "zip_with(" not in plan
