"""Bindings: the record tables of the question-to-SQL workflow, derived from the input tables.

Every frame here is computed by Spark from the given tables, so its size grows with them:

* ``pairs``: one (question, SQL) pair per order, ``pair_id = o_orderkey``.
* ``predictions``: a model-like answer per pair (lower-cased, spacing changed; a wrong
  status literal on every third key), for comparison with the gold SQL.
* ``sql_texts``: one statement per order, of a kind chosen by the key (valid select, CTE,
  subquery, unsafe write, multi-statement, empty, misspelt, fenced ...), for validation.
* ``lesson_texts``: lesson-like model output per order (clean JSON, prose around it,
  broken JSON, missing field, number instead of text, no JSON at all).
* ``eval_items``: per-item outcome flags of an evaluation, one run per order priority.
* ``vector_items``: the ``embeddings`` table as the retrieval corpus / questions, with the
  label as run and the vector id as ordinal for as-of lesson visibility.

Each binding has an SQL twin in :mod:`tessera.plans.oracle` that DuckDB evaluates on the
same parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.embed import hash_embed_batch
from tessera.session import spread
from tessera.sources.tables import table


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("pair_id"),
        F.concat(F.lit("How many orders did customer "), F.col("o_custkey").cast("string"),
                 F.lit(" place with status "), F.col("o_orderstatus"),
                 F.lit(" and priority "), F.col("o_orderpriority"), F.lit("?")).alias("nlq"),
        F.concat(F.lit("SELECT COUNT(*) AS order_count FROM orders WHERE o_custkey = "),
                 F.col("o_custkey").cast("string"),
                 F.lit(" AND o_orderstatus = '"), F.col("o_orderstatus"),
                 F.lit("' AND o_orderpriority = '"), F.col("o_orderpriority"), F.lit("'")).alias("sql"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold SQL next to a prediction: lower-cased with doubled spaces around ``=``; every
    third key names a wrong status literal."""
    o = spread(table(spark, sf_dir, "orders"))
    status = F.when(F.col("o_orderkey") % 3 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    gold = F.concat(F.lit("SELECT COUNT(*) FROM orders WHERE o_orderstatus = '"),
                    F.col("o_orderstatus"), F.lit("'"))
    pred = F.concat(F.lit("select  count(*)  from orders where o_orderstatus  =  '"),
                    status, F.lit("'"))
    return o.select(F.col("o_orderkey").alias("id"), pred.alias("pred_sql"), gold.alias("gold_sql"))


# Statement kinds rendered into sql_texts, chosen by o_orderkey % 12.
def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    key, st, pr = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    ks = key.cast("string")
    m = key % 12
    text = (
        F.when(m == 0, F.concat(F.lit("SELECT COUNT(*) FROM orders WHERE o_orderstatus = '"), st, F.lit("'")))
        .when(m == 1, F.concat(F.lit("WITH t AS (SELECT o_custkey FROM orders WHERE o_orderkey = "), ks,
                               F.lit(") SELECT * FROM t")))
        .when(m == 2, F.concat(F.lit("SELECT * FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority = '"),
                               pr, F.lit("') sub")))
        .when(m == 3, F.concat(F.lit("DROP TABLE orders_"), ks))
        .when(m == 4, F.concat(F.lit("INSERT INTO orders (o_orderkey) VALUES ("), ks, F.lit(")")))
        .when(m == 5, F.concat(F.lit("SELECT "), ks, F.lit("; DROP TABLE orders")))
        .when(m == 6, F.lit("   \n\t  "))
        .when(m == 7, F.concat(F.lit("SELET "), ks))
        .when(m == 8, F.concat(F.lit("update orders set o_orderstatus = 'x' where o_orderkey = "), ks))
        .when(m == 9, F.concat(F.lit("-- count it\nselect count(*) from orders where o_comment = 'a;b' and o_orderkey = "), ks))
        .when(m == 10, F.concat(F.lit("SELECT o_orderkey FROM orders WHERE (o_totalprice > "), ks))
        .otherwise(F.concat(F.lit("SELECT 1 UNION SELECT "), ks))
    )
    return o.select(key.alias("id"), text.alias("sql"))


def sql_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per order and another way to write it ``(id, pred_sql, gold_sql)``, by key mod 12:
    other case of a function; no AS; INNER JOIN; !=; another literal; another alias; lower case with a
    comment; and five broken ones."""
    o = spread(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    head = "SELECT c.o_custkey AS k, MEDIAN(c.o_totalprice) AS m FROM orders AS c JOIN customer AS d ON c.o_custkey = d.c_custkey WHERE c.o_orderkey <> "
    tail = " GROUP BY c.o_custkey"

    def text(h=head, t=tail, k=key):
        return F.concat(F.lit(h), k.cast("string"), F.lit(t))

    ways = [text(head.replace("MEDIAN", "median")), text(head.replace(" AS ", " ")), text(head.replace("JOIN", "INNER JOIN")), text(head.replace("<>", "!=")),
            text(k=key + 1), text(head.replace("AS m", "AS n")), text(head.replace("SELECT", "select -- what\n ").replace("FROM", "\tfrom"), tail.replace("GROUP BY", "group  by")),
            text(t=tail + " HAVING"), text(t=tail + " ORDER"), text(head.replace("<> ", "<> = ")), text(t=tail + " LIMIT"), text(head.replace("SELECT c.o_custkey", "SELECT (c.o_custkey"), tail + ")")]
    pred = ways[0]
    for n, w in enumerate(ways[1:], 1):
        pred = F.when(key % 12 == n, w).otherwise(pred)
    return o.select(key.alias("id"), pred.alias("pred_sql"), text().alias("gold_sql"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model output per order: fenced, bare-fenced, upper-case tag, plain, padded."""
    o = spread(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    body = F.concat(F.lit("SELECT COUNT(*) FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string"))
    m = key % 5
    text = (F.when(m == 0, F.concat(F.lit("```sql\n"), body, F.lit("\n```")))
            .when(m == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
            .when(m == 2, F.concat(F.lit("```SQL\n"), body, F.lit("\n```")))
            .when(m == 3, body)
            .otherwise(F.concat(F.lit("  \n"), body, F.lit("\n\n  "))))
    return o.select(key.alias("id"), text.alias("text"))


def _lesson_text():
    """Lesson-like model output of an order (column expression over ``orders``)."""
    key = F.col("o_orderkey")
    ks = key.cast("string")
    cat = F.element_at(F.array(*[F.lit(c) for c in ("date_handling", "join_logic", "aggregation",
                                                     "filter", "other")]),
                       (F.col("o_custkey") % 5 + 1).cast("int"))
    good = F.concat(
        F.lit('{"title": "Lesson '), ks, F.lit('", "trigger": "questions about priority '),
        F.col("o_orderpriority"), F.lit('", "diagnosis": "wrong status", "fix_rule": "Always filter on '),
        F.col("o_orderstatus"), F.lit('", "error_category": "'), cat,
        F.lit('", "example": "{\\"nlq\\": \\"q\\"}"}'))
    m = key % 7
    return (F.when(m == 0, good)
            .when(m == 1, F.concat(F.lit("Here is the lesson:\n"), good))
            .when(m == 2, F.concat(good, F.lit("\nHope this helps.")))
            .when(m == 3, F.concat(F.lit("{'title': 'x"), ks, F.lit("'}")))
            .when(m == 4, F.concat(F.lit('{"title": "t'), ks, F.lit('", "trigger": "g"}')))
            .when(m == 5, F.concat(F.lit("I could not produce a lesson for order "), ks))
            .otherwise(F.concat(F.lit('{"title": '), ks,
                                F.lit(', "trigger": "g", "diagnosis": "d", "fix_rule": "f", '
                                      '"error_category": "other", "example": "e"}'))))


def lesson_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    return o.select(F.col("o_orderkey").alias("id"), _lesson_text().alias("text"))


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation outcomes per order; run = the digit of the order priority."""
    o = table(spark, sf_dir, "orders")
    pass1 = F.col("o_orderstatus") == "F"
    retried = ~pass1
    pass2 = retried & (F.col("o_orderstatus") == "O")
    had = retried & (F.col("o_custkey") % 4 != 0)
    sim1 = (F.col("o_orderkey") % 1000).cast("double") / 1000.0
    sim2 = F.when(~retried, F.lit(None).cast("double")).when(
        had, (F.col("o_custkey") % 100).cast("double") / 100.0).otherwise(F.lit(0.0))
    return o.select(
        F.substring("o_orderpriority", 1, 1).cast("long").alias("run_id"),
        F.col("o_orderkey").alias("item_id"),
        pass1.alias("pass1"), pass2.alias("pass2"), (~pass1 & ~pass2).alias("hard_failure"),
        retried.alias("retried"), had.alias("had_lessons"),
        sim1.alias("sim1"), sim2.alias("sim2"),
        F.floor(F.col("o_totalprice")).cast("double").alias("latency_ms"),
    )


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "embeddings"))
    return e.select(F.col("vec_id").alias("id"), "embedding",
                    F.col("label").cast("long").alias("run_id"), F.col("vec_id").alias("ordinal"))


def question_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair as an item to evaluate: its question embedded, the digit of the order's priority as
    run and the key as ordinal."""
    p = pairs(spark, sf_dir).join(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pair_id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("run_id")), "pair_id")
    return spread(p).select(F.col("pair_id").alias("id"), hash_embed_batch("nlq").alias("embedding"), "run_id",
                            F.col("pair_id").alias("ordinal"), "nlq", F.col("sql").alias("gold_sql"))


CALLS = ("sql1", "sql2", "critic", "lesson", "nlq")


def _gold_sql():
    return F.concat(F.lit("SELECT COUNT(*) AS order_count FROM orders WHERE o_custkey = "),
                    F.col("o_custkey").cast("string"),
                    F.lit(" AND o_orderstatus = '"), F.col("o_orderstatus"),
                    F.lit("' AND o_orderpriority = '"), F.col("o_orderpriority"), F.lit("'"))


def recorded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model output per order and call kind: ``(id, call, text, error, elapsed_ms)``.

    sql1 (first attempt), by key mod 6: right; fenced right; wrong status literal; misspelt;
    call error; right with lower-case keywords. sql2 (retry), by key mod 4: right; wrong;
    call error; fenced right. critic: error on key mod 5 = 4. lesson: the lesson text of the
    order. nlq (question for a pair without one): error on key mod 9 = 0.
    """
    o = spread(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    gold = _gold_sql()
    wrong = F.regexp_replace(gold, "o_orderstatus = '[A-Z]'", "o_orderstatus = 'X'")
    lower = F.regexp_replace(gold, r"^SELECT COUNT\(\*\) AS order_count FROM orders WHERE",
                             "select count(*) as order_count from orders where")
    fenced = F.concat(F.lit("```sql\n"), gold, F.lit("\n```"))
    m6, m4, m5, m9 = key % 6, key % 4, key % 5, key % 9
    null = F.lit(None).cast("string")
    sql1 = (F.when(m6 == 0, gold).when(m6 == 1, fenced).when(m6 == 2, wrong)
            .when(m6 == 3, F.lit("SELET 1")).when(m6 == 4, null).otherwise(lower))
    sql1_e = F.when(m6 == 4, F.lit("timeout"))
    sql2 = F.when(m4 == 0, gold).when(m4 == 1, wrong).when(m4 == 2, null).otherwise(fenced)
    sql2_e = F.when(m4 == 2, F.lit("overloaded"))
    critic = F.when(m5 == 4, null).otherwise(F.lit("1. Wrong filter value on o_orderstatus."))
    critic_e = F.when(m5 == 4, F.lit("timeout"))
    nlq = F.when(m9 == 0, null).otherwise(F.concat(F.lit("How many orders did customer "),
                                                   F.col("o_custkey").cast("string"), F.lit(" place?")))
    nlq_e = F.when(m9 == 0, F.lit("timeout"))
    base_ms = (key % 97).cast("double") * 10.0
    calls = [("sql1", sql1, sql1_e, 1), ("sql2", sql2, sql2_e, 2), ("critic", critic, critic_e, 3),
             ("lesson", _lesson_text(), F.lit(None).cast("string"), 4), ("nlq", nlq, nlq_e, 5)]
    arr = F.array(*[F.struct(F.lit(c).alias("call"), t.alias("text"), e.alias("error"),
                             (base_ms + n).alias("elapsed_ms")) for c, t, e, n in calls])
    return (o.select(key.alias("id"), F.explode(arr).alias("r"))
            .select("id", "r.call", "r.text", "r.error", "r.elapsed_ms"))


def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recorded fix attempts per order ``(id, iteration, text)``, by key mod 5:
    valid at once; misspelt then fenced valid; never valid; misspelt then GIVE_UP;
    blank, misspelt, then fenced valid."""
    o = spread(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    ks = key.cast("string")
    good = F.concat(F.lit("SELECT COUNT(*) FROM orders WHERE o_orderkey = "), ks)
    bad = F.concat(F.lit("SELET COUNT(*) FROM orders WHERE o_orderkey = "), ks)
    m = key % 5
    it1 = F.when(m == 0, good).when(m == 4, F.lit("  ")).otherwise(bad)
    it2 = (F.when(m == 0, good).when(m == 1, F.concat(F.lit("```sql\n"), good, F.lit("\n```")))
           .when(m == 2, F.concat(F.lit("DELETE FROM orders WHERE o_orderkey = "), ks))
           .when(m == 3, F.lit("GIVE_UP")).otherwise(bad))
    it3 = (F.when(m == 2, F.concat(F.lit("SELECT (o_orderkey FROM orders WHERE o_orderkey = "), ks))
           .when(m == 4, F.concat(F.lit("```\n"), good, F.lit("\n```"))).otherwise(good))
    arr = F.array(*[F.struct(F.lit(i).alias("iteration"), t.alias("text")) for i, t in ((1, it1), (2, it2), (3, it3))])
    return o.select(key.alias("id"), F.explode(arr).alias("c")).select("id", "c.iteration", "c.text")


def repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of a repair model, turn by turn ``(id, turn, text, error)``: the candidates
    above in order, after a first turn that calls tools for some keys, by key mod 7: validate_sql; that
    and analyze_errors; a tool that does not exist. On key mod 11 = 10 the second turn fails."""
    o = spread(table(spark, sf_dir, "orders"))
    m = F.col("o_orderkey") % 7
    sql = F.concat(F.lit("SELET "), F.col("o_orderkey").cast("string"))

    def call(name, **inputs):
        return F.struct(F.lit(name).alias("name"), F.create_map(*[x for k, v in inputs.items() for x in (F.lit(k), v)]).alias("input"))

    validate = call("validate_sql", sql=sql)
    analyze = call("analyze_errors", broken_sql=sql, error_message=F.lit("not a statement"))
    first = F.when(m == 0, F.array(validate)).when(m == 1, F.array(validate, analyze)).when(m == 2, F.array(call("run_sql", sql=sql)))
    first = o.select(F.col("o_orderkey").alias("id"), first.alias("tool_calls")).where("tool_calls is not null") \
        .select("id", F.lit(1).cast("long").alias("turn"), F.to_json(F.struct("tool_calls")).alias("text"))
    later = repair_candidates(spark, sf_dir).select(
        "id", (F.col("iteration") + F.when(F.col("id") % 7 <= 2, 1).otherwise(0)).cast("long").alias("turn"), "text")
    lost = (F.col("id") % 11 == 10) & (F.col("turn") == 2)
    return first.unionByName(later).select("id", "turn", F.when(~lost, F.col("text")).alias("text"), F.when(lost, F.lit("timeout")).alias("error"))


def pair_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of a pair CSV rendered from ``pairs``, by key mod 8: plain; no question;
    padded with whitespace; empty SQL; question ``NA``; SQL over two lines; blank SQL;
    an extra column."""
    p = spread(pairs(spark, sf_dir))
    m = F.col("pair_id") % 8
    nlq = (F.when(m == 1, F.lit("")).when(m == 2, F.concat(F.lit("  "), F.col("nlq"), F.lit("\t")))
           .when(m == 4, F.lit("NA")).otherwise(F.col("nlq")))
    sql = (F.when(m == 2, F.concat(F.lit("\n "), F.col("sql"), F.lit(" \n"))).when(m == 3, F.lit(""))
           .when(m == 5, F.concat(F.col("sql"), F.lit("\n-- second line"))).when(m == 6, F.lit("   "))
           .otherwise(F.col("sql")))
    note = F.when(m == 7, F.lit("extra, \"quoted\" note"))
    return p.select("pair_id", nlq.alias("nlq"), sql.alias("sql"), note.alias("note"))
