"""Prompt texts and prompt assembly as column expressions.

Prompts are two string columns, ``system`` and ``human``. Example and lesson blocks are
ordered text aggregates over at most k hits per question (bounded groups).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Prompt texts (subject schema, system prompts, section headings) that
# must read exactly as below for a model to see the same prompts.
# ---------------------------------------------------------------------------------------

SCHEMA = """\
-- Database: DuckDB (PostgreSQL-compatible dialect)

customers (
    customer_id  INTEGER PRIMARY KEY,
    name         VARCHAR,
    email        VARCHAR,
    country      VARCHAR,        -- e.g. 'Germany', 'USA', 'UK', 'Spain', 'China', 'Italy', ...
    created_at   DATE
)

products (
    product_id  INTEGER PRIMARY KEY,
    name        VARCHAR,
    category    VARCHAR,         -- values: 'Electronics', 'Books', 'Furniture', 'Clothing'
    price       DECIMAL(10,2)
)

orders (
    order_id      INTEGER PRIMARY KEY,
    customer_id   INTEGER REFERENCES customers(customer_id),
    order_date    DATE,
    total_amount  DECIMAL(10,2),
    status        VARCHAR         -- values: 'completed', 'pending', 'cancelled'
)

order_items (
    item_id     INTEGER PRIMARY KEY,
    order_id    INTEGER REFERENCES orders(order_id),
    product_id  INTEGER REFERENCES products(product_id),
    quantity    INTEGER,
    unit_price  DECIMAL(10,2)
)

-- Notes:
-- orders.total_amount  = pre-computed order-level total (use for order revenue)
-- unit_price * quantity = item-level revenue (use when aggregating by product)
-- For month-level date ops: DATE_TRUNC('month', date_col)  [not MONTH() or STRFTIME]
-- For date differences:    date_diff('day', start_date, end_date)
"""

SQL_GEN_SYSTEM = """\
You are an expert SQL analyst for a DuckDB database.

Rules — follow these exactly:
- Output ONLY the SQL query, nothing else.
- Use SELECT or WITH statements only. Never INSERT, UPDATE, DELETE, DROP, CREATE, or any DDL.
- No markdown fences, no backticks, no explanation, no comments in output.
- Use exact table and column names from the schema — never invent columns.
- Do not add ORDER BY or LIMIT unless the question explicitly asks for ranked or limited results.
- Always alias aggregation columns (e.g., COUNT(*) AS total_count, SUM(price) AS total_revenue).
- Apply these mappings:
    "how many" / "count"      → COUNT(*)
    "total" / "sum of"        → SUM(col)
    "average" / "avg"         → AVG(col)
    "most" / "top" / "highest"→ ORDER BY col DESC LIMIT n
- DuckDB date functions: DATE_TRUNC('month', col), INTERVAL '1 month', date_diff('day', a, b).
- Follow the join and filter patterns from the examples as closely as possible.
- Keep SQL simple — do not over-engineer."""

NLQ_GEN_SYSTEM = """\
You are a data analyst who writes clear, natural English questions about database data.

Rules:
- Output ONLY the natural language question, nothing else.
- The question must be directly answerable by the provided SQL query.
- Write as a business user would ask — plain English, no SQL jargon.
- Do not mention table names, column names, or SQL syntax in the question.
- Keep it concise — one sentence."""

CRITIC_SYSTEM = """\
You are a SQL expert who diagnoses why a generated SQL query produced the wrong result.

Rules:
- Be specific and concise.
- List only actual logical errors — not style preferences.
- Focus on: wrong table, wrong column, wrong filter value, wrong aggregation, wrong join condition.
- Number each error on its own line."""

LESSON_GEN_SYSTEM = """\
You are a SQL teaching expert who creates reusable lessons from SQL generation failures.

A good lesson:
- Captures a GENERAL pattern, not a query-specific fact.
- Has a trigger that describes the NLQ pattern broadly (not the specific question text).
- Has a fix_rule that is a concrete, actionable instruction for future SQL generation.
- Assigns one error category: date_handling | join_logic | aggregation | filter | other

Rules:
- Output ONLY valid JSON — no explanation, no markdown fences, no trailing text.
- The trigger must be general enough to match future similar questions.
- The fix_rule must start with an action verb (e.g., "Always use ...", "Never use ...", "When ... use ...")."""

NO_EXAMPLES = "-- No examples available."
EXAMPLE_LINE = "-- Example %d (similarity: %.2f)\n-- Question: %s\n%s"
LESSON_LINE = "[%d] %s (category: %s)\n    Trigger:  %s\n    Fix rule: %s"
LESSONS_HEADER = ("\n### Lessons Learned\n"
                  "The following lessons were learned from past failures on similar questions.\n"
                  "Apply the relevant fix rules when writing the SQL below.\n\n")
NLQ_GEN_LEAD = "Given this SQL query against our database, write the natural language question it answers.\n\n"
CRITIC_LEAD = ("A SQL query was generated for the following question but produced the wrong result.\n"
               "Identify the specific errors.\n\n")
CRITIC_TAIL = "\n\nList each error on a numbered line. Be specific."
LESSON_LEAD = "Generate a reusable lesson from this SQL generation failure.\n\n"
LESSON_TAIL = (
    "\n\nOutput a JSON object with exactly these fields:\n"
    "{\n"
    '  "title": "short name for this lesson",\n'
    '  "trigger": "what NLQ pattern triggers this lesson (general, not this specific question)",\n'
    '  "diagnosis": "why the predicted SQL was wrong",\n'
    '  "fix_rule": "actionable rule starting with a verb: Always/Never/When X use Y",\n'
    '  "error_category": "date_handling | join_logic | aggregation | filter | other",\n'
    '  "example": "{\\"nlq\\": \\"..\\", \\"pred_sql\\": \\"..\\", \\"gold_sql\\": \\"..\\"}" \n'
    "}")

# ---------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _line(form: str, *values) -> Column:
    """``form`` with its places filled in order, put together from its parts: a formatter that reads
    the form anew for each hit costs more than the rest of the block. A null reads ``null``."""
    parts = re.split(r"%(?:d|s|\.2f)", form)
    filled = [x for v, part in zip(values, parts[1:]) for x in (F.coalesce(v.cast("string"), F.lit("null")), F.lit(part))]
    return F.concat(F.lit(parts[0]), *filled)


def example_blocks(hits: DataFrame, key: str = "query_id", mean_alias: str | None = None) -> DataFrame:
    """``(key, [mean_alias,] examples_block, n_examples)`` from hits left-joined to their
    records (``rank, score, nlq, sql``; record columns null when a hit has no record).

    One grouped aggregate: the mean is over the hits that have records; the block numbers the hits that have
    records in rank order (1, 2, ...), at most k per query. No hit with a record: no block.
    """
    has = F.col("nlq").isNotNull() & F.col("sql").isNotNull()
    aggs = [F.array_sort(F.collect_list(F.when(has, F.struct("rank", "score", "nlq", "sql")))).alias("h")]
    if mean_alias:
        aggs.insert(0, F.avg(F.when(has, F.col("score"))).alias(mean_alias))
    g = hits.groupBy(key).agg(*aggs)
    lines = F.transform("h", lambda e, i: _line(
        EXAMPLE_LINE, i + 1, F.format_string("%.2f", F.round(e["score"], 2)), e["nlq"], e["sql"]))
    return g.select(key, *([mean_alias] if mean_alias else []),
                    F.when(F.size("h") > 0, F.array_join(lines, "\n\n")).alias("examples_block"),
                    F.size("h").cast("long").alias("n_examples"))


def lesson_blocks(hits: DataFrame, key: str = "query_id", mean_alias: str | None = None) -> DataFrame:
    """``(key, [mean_alias,] lessons_section, n_lessons)`` from lesson hits left-joined to
    the lesson records; same shape of computation as :func:`example_blocks`."""
    has = F.col("title").isNotNull()
    aggs = [F.array_sort(F.collect_list(F.when(has, F.struct(
        "rank", "title", "error_category", "trigger", "fix_rule")))).alias("h")]
    if mean_alias:
        aggs.insert(0, F.avg(F.when(has, F.col("score"))).alias(mean_alias))
    g = hits.groupBy(key).agg(*aggs)
    lines = F.transform("h", lambda e, i: _line(
        LESSON_LINE, i + 1, e["title"], e["error_category"], e["trigger"], e["fix_rule"]))
    return g.select(key, *([mean_alias] if mean_alias else []),
                    F.when(F.size("h") > 0, F.concat(F.lit(LESSONS_HEADER), F.array_join(lines, "\n\n")))
                    .alias("lessons_section"),
                    F.size("h").cast("long").alias("n_lessons"))


def sql_gen_human(nlq, examples_block, lessons_section=None) -> Column:
    """Human message of the SQL-generation prompt; no lessons section when none."""
    ex = F.coalesce(_c(examples_block), F.lit(NO_EXAMPLES))
    ls = F.lit("") if lessons_section is None else F.coalesce(_c(lessons_section), F.lit(""))
    return F.concat(F.lit("### Schema\n" + SCHEMA + "\n### Examples\n"), ex, ls,
                    F.lit("\n\n### Question\n"), _c(nlq))


def nlq_gen_human(sql) -> Column:
    return F.concat(F.lit(NLQ_GEN_LEAD + "### Schema\n" + SCHEMA + "\n### SQL\n"), _c(sql))


def critic_human(nlq, pred_sql, gold_sql) -> Column:
    return F.concat(F.lit(CRITIC_LEAD + "### Question\n"), _c(nlq),
                    F.lit("\n\n### Predicted SQL (wrong)\n"), _c(pred_sql),
                    F.lit("\n\n### Gold SQL (correct)\n"), _c(gold_sql), F.lit(CRITIC_TAIL))


def lesson_human(nlq, pred_sql, gold_sql, errors) -> Column:
    return F.concat(F.lit(LESSON_LEAD + "### Question\n"), _c(nlq),
                    F.lit("\n\n### Predicted SQL (wrong)\n"), _c(pred_sql),
                    F.lit("\n\n### Gold SQL (correct)\n"), _c(gold_sql),
                    F.lit("\n\n### Errors identified\n"), _c(errors), F.lit(LESSON_TAIL))


def temperature(attempt) -> Column:
    """0.0 for the first attempt; 0.3 for the retry, even when no lesson was found."""
    return F.when(_c(attempt) == 1, F.lit(0.0)).otherwise(F.lit(0.3))
