"""Native column functions over SQL text and model output.

Everything here but the canonical form is built from Spark SQL expressions (regexes, arrays,
higher-order functions); that takes a batch of texts at a time through Arrow, because a fold that
reads each token's neighbours is interpreted there and some ten times slower. The quoted-text
patterns use possessive quantifiers, so literals of any length neither recurse nor
backtrack; the DuckDB oracle (:mod:`tessera.plans.oracle`) has patterns of its own there.

Validation and canonicalisation are lexical, not a full parser. What they decide:

* empty after stripping -> ``SQL is empty.``
* unterminated quote or block comment, unbalanced parentheses, or a leading word that
  does not start any statement -> ``SQL parse error: ...``
* more than one statement (split on ``;`` outside quotes and comments; one trailing
  ``;`` is allowed) -> ``Multiple statements detected (n). ...``
* a statement other than a plain query: a write or DDL keyword first, a parenthesised
  query, a top-level set operation, or ``WITH`` followed by a write -> ``Unsafe statement
  type: <Kind>. ...``
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------- fixed values
# Whitespace as Python's str.split()/str.strip() see it (str.isspace characters).
WS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# The same characters one by one.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Comments (group 1) or quoted text (group 2), scanned left to right in one pass.
QUOTED = r"'[^']*+(?:''[^']*+)*+'|\"[^\"]*+(?:\"\"[^\"]*+)*+\""
COMMENT_OR_QUOTED = r"(--[^\n]*+|/\*[\s\S]*?\*/)|(" + QUOTED + ")"

# Statement kinds by leading keyword (fixed values: the kind names a SQL parser reports).
STATEMENT_KINDS = {
    "SELECT": "Select", "WITH": "With", "INSERT": "Insert", "UPDATE": "Update",
    "DELETE": "Delete", "DROP": "Drop", "CREATE": "Create", "ALTER": "Alter",
    "MERGE": "Merge", "TRUNCATE": "TruncateTable", "GRANT": "Grant", "REVOKE": "Revoke",
    "SET": "Set", "USE": "Use", "SHOW": "Show", "DESCRIBE": "Describe", "DESC": "Describe",
    "EXPLAIN": "Command", "COPY": "Copy", "PRAGMA": "Pragma", "COMMIT": "Commit",
    "ROLLBACK": "Rollback", "BEGIN": "Transaction", "VALUES": "Values", "CALL": "Command",
    "ATTACH": "Attach", "DETACH": "Detach", "INSTALL": "Command", "LOAD": "Command",
    "VACUUM": "Command", "ANALYZE": "Analyze", "EXPORT": "Export", "IMPORT": "Command",
    "CHECKPOINT": "Command", "SUMMARIZE": "Summarize", "PIVOT": "Pivot", "UNPIVOT": "Pivot",
    "FROM": "Select",
}
SET_OPERATIONS = {"UNION": "Union", "INTERSECT": "Intersect", "EXCEPT": "Except"}
WRITE_AFTER_WITH = {"INSERT": "Insert", "UPDATE": "Update", "DELETE": "Delete", "MERGE": "Merge"}

# Words written in upper case in the canonical form: keywords, then function names
# (a function name is written directly before its parenthesis).
CANON_KEYWORDS = """
SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET AS ON JOIN INNER LEFT RIGHT FULL OUTER
CROSS NATURAL USING AND OR NOT IN IS NULL LIKE ILIKE BETWEEN EXISTS CASE WHEN THEN ELSE END
DISTINCT ALL ANY SOME UNION INTERSECT EXCEPT WITH RECURSIVE ASC DESC NULLS FIRST LAST OVER
PARTITION ROWS RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW WINDOW QUALIFY FILTER WITHIN
TRUE FALSE INTERVAL DATE TIMESTAMP TIME INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE
VIEW DROP ALTER INTEGER INT BIGINT DOUBLE FLOAT VARCHAR TEXT BOOLEAN
""".split()
CANON_FUNCTIONS = """
COUNT SUM AVG MIN MAX ROUND ABS COALESCE NULLIF YEAR MONTH DAY HOUR MINUTE SECOND
DATE_TRUNC DATE_DIFF DATE_PART DATEDIFF STRFTIME NOW CURRENT_DATE CURRENT_TIMESTAMP LOWER
UPPER LENGTH SUBSTRING SUBSTR TRIM CONCAT REPLACE ROW_NUMBER RANK DENSE_RANK LAG LEAD
FIRST_VALUE LAST_VALUE NTILE STRING_AGG LIST ARRAY_AGG GREATEST LEAST IF IFNULL CAST
TRY_CAST EXTRACT DECIMAL
""".split()
CANON_UPPER = CANON_KEYWORDS + CANON_FUNCTIONS

# Token pattern of the canonical form: quoted text, words, numbers, operators, punctuation.
TOKEN = (QUOTED + r"|[A-Za-z_][A-Za-z0-9_$]*"
         r"|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+|<>|!=|<=|>=|\|\||::"
         r"|[^\t\n\x{0B}\f\r A-Za-z0-9_]")

# Clauses of a query that cannot be right: a keyword that needs an operand at the end of the text
# or of a group, a clause directly followed by the next one, a word after SELECT * that no clause
# starts with.
BROKEN_CLAUSES = (
    r"(?i)(?<![.\w])(?:SELECT|FROM|WHERE|AND|OR|NOT|ON|BY|HAVING|JOIN|IN|LIKE|BETWEEN|WHEN|THEN|ELSE|CASE)\s*(?:\)|$)",
    r"(?i)(?<![.\w])(?:SELECT|FROM|WHERE|HAVING|AND|OR|ON|BY)\s+(?:FROM|WHERE|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT|AND|OR)\b",
    r"(?i)\bSELECT\s+\*\s+(?!(?:FROM|EXCLUDE|EXCEPT|REPLACE|RENAME|LIKE|ILIKE|GLOB|SIMILAR|WHERE|UNION|INTERSECT|ORDER|LIMIT)\b)[A-Z_]",
)
# The EXCEPT of a column list, which is no set operation (upper-case text).
STAR_EXCEPT = r"\*\s*EXCEPT\b(?!\s+(?:ALL\s+)?SELECT\b)"

# Tokens of the clause automaton, over masked upper-case text.
CLAUSE_TOKEN = r"[A-Z_][A-Z0-9_$]*|[0-9.]+|<>|!=|<=|>=|\|\||::|\S"
COMPARISONS = ("=", "<>", "!=", "<=", ">=", "<", ">")
# Words that start a clause or end an operand, and words that need something behind them.
CLAUSE_WORDS = ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "QUALIFY", "AND", "OR")
UNFINISHED = (",", *COMPARISONS, "LIMIT", "OFFSET", "ORDER", "GROUP")
# The end of the text as a token.
END = "$"


def _any_of(words) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


# Two tokens that cannot be neighbours, in a row of tokens that each stand between two blanks.
CLAUSE_PAIRS = (f" (?:{_any_of(UNFINISHED)} {_any_of((')', END, *CLAUSE_WORDS))} |{_any_of(COMPARISONS)} {_any_of(COMPARISONS)} "
                r"|ORDER (?!BY )|GROUP (?!BY |\( ))")
# Functions whose arguments may be parted by FROM.
FROM_FUNCTIONS = ("EXTRACT", "SUBSTRING", "SUBSTR", "TRIM", "OVERLAY", "POSITION")

FENCE_HEAD = r"(?i)^```(?:sql)?" + WS + r"*\n?"
FENCE_TAIL = r"\n?```$"  # of a stripped text
JSON_OBJECT = r"(?s)\{.*\}"

LESSON_FIELDS = ("title", "trigger", "diagnosis", "fix_rule", "error_category", "example")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------- basic text


def py_strip(x) -> Column:
    """Strip leading/trailing whitespace like Python's ``str.strip()``, in linear time."""
    return F.btrim(_c(x), F.lit(WS_CHARS))


def tokens(x) -> Column:
    """Lower-cased whitespace tokens as a set (array without duplicates, no empty token)."""
    parts = F.split(F.lower(F.coalesce(_c(x), F.lit(""))), f"{WS}+")
    return F.array_distinct(F.array_remove(parts, ""))


def token_similarity(a, b) -> Column:
    """Jaccard similarity of the token sets; 0.0 when both are empty."""
    ta, tb = tokens(a), tokens(b)
    union = F.size(F.array_union(ta, tb))
    inter = F.size(F.array_intersect(ta, tb))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union)


def strip_fences(x) -> Column:
    """Remove a leading code fence (optional ``sql`` tag, any case), a trailing fence and
    outer whitespace."""
    t = py_strip(F.coalesce(_c(x), F.lit("")))
    t = F.regexp_replace(t, FENCE_HEAD, "")
    t = F.regexp_replace(t, FENCE_TAIL, "")
    return py_strip(t)


def extract_json(x) -> Column:
    """Outermost ``{...}`` across lines (greedy); null when there is none."""
    m = F.regexp_extract(F.coalesce(_c(x), F.lit("")), JSON_OBJECT, 0)
    return F.when(m == "", F.lit(None).cast("string")).otherwise(m)


def _lesson_stages():
    def fields_ok(e):
        ok = F.lit(True)
        for f in LESSON_FIELDS:
            kind = F.schema_of_variant(F.try_variant_get(e["v"], f"$.{f}", "variant"))
            ok = ok & F.coalesce(kind == "STRING", F.lit(False))
        return ok

    return [
        {"js": lambda e: extract_json(e["text"])},
        {"v": lambda e: F.try_parse_json(e["js"])},
        {"is_obj": lambda e: F.startswith(F.schema_of_variant(e["v"]), F.lit("OBJECT")),
         "fields_ok": fields_ok},
        {"reason": lambda e: (F.when(e["js"].isNull(), F.lit("no_json"))
                              .when(e["v"].isNull(), F.lit("bad_json"))
                              .when(~(F.coalesce(e["is_obj"], F.lit(False)) & e["fields_ok"]),
                                    F.lit("invalid_lesson")))},
        {"ok": lambda e: e["reason"].isNull(),
         **{f: (lambda e, f=f: F.when(e["reason"].isNull(), F.try_variant_get(e["v"], f"$.{f}", "string")))
            for f in LESSON_FIELDS}},
    ]


def parse_lesson(x) -> Column:
    """Parse model output into a lesson struct.

    Returns ``struct(ok, reason, title, trigger, diagnosis, fix_rule, error_category,
    example)``. ``reason`` is ``no_json``, ``bad_json`` (not strict JSON) or
    ``invalid_lesson`` (a required field missing or not a string); null when ``ok``.
    Strict parsing uses the variant parser: ``from_json`` would accept single quotes and
    turn numbers into text.
    """
    env = _run_inline(_lesson_stages(), {"text": _c(x)})
    return F.struct(env["ok"].alias("ok"), env["reason"].alias("reason"),
                    *[env[f].alias(f) for f in LESSON_FIELDS])


def with_parsed_lesson(df: DataFrame, text_col: str, prefix: str = "l") -> DataFrame:
    """Add ``{prefix}_ok``, ``{prefix}_reason`` and one column per lesson field; same rules as
    :func:`parse_lesson`, computed in stages (the JSON is parsed once per row)."""
    tmp = f"__{prefix}_"
    out, env = _run_staged(df, _lesson_stages(), {"text": F.col(text_col)}, tmp)
    out = out.withColumns({f"{prefix}_{k}": env[k] for k in ("ok", "reason", *LESSON_FIELDS)})
    return out.drop(*[c for c in out.columns if c.startswith(tmp)])


# ---------------------------------------------------------------------------- validation


def mask_sql(x) -> Column:
    """Comments removed, quoted text replaced by the word ``_lit_``."""
    t = F.regexp_replace(_c(x), COMMENT_OR_QUOTED, " $2 ")
    return F.regexp_replace(t, QUOTED, " _lit_ ")


def paren_fold(masked: Column) -> Column:
    """``struct(depth, low, text)``: final and lowest parenthesis depth, and the text outside any
    parentheses (a blank per group). One pass over the parentheses, whatever the nesting."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"), F.lit("").alias("text"))

    def step(acc, t):
        depth = acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        outside = F.when(acc["depth"] != 0, F.lit("")).when(t == "(", F.lit(" ")).when(t == ")", F.lit("")).otherwise(t)
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"),
                        F.when(outside == "", acc["text"]).otherwise(F.concat(acc["text"], outside)).alias("text"))

    return F.aggregate(F.regexp_extract_all(masked, F.lit("[()]|[^()]+"), F.lit(0)), start, step)


def clause_row(first: Column) -> Column:
    """The tokens of a masked statement in upper case and the end, each between two blanks; a word
    behind a dot is a name, whatever it reads."""
    toks = F.regexp_replace(F.upper(first), rf"\s*({CLAUSE_TOKEN})\s*", "$1 ")
    return F.regexp_replace(F.concat(F.lit(" "), toks, F.lit(f"{END} ")), r" \. [^ ]+", " . name")


def clause_outside(row: Column) -> Column:
    """A row of tokens without its innermost parentheses."""
    return F.regexp_replace(row, r" \( [^()]*\)(?= )", " name")


def clause_fault(row: Column, outside: Column) -> Column:
    """Whether the clauses of a masked statement cannot be right: a pushdown automaton over its tokens
    (``clause_row``; ``outside``: ``clause_outside`` of it).

    The state is the token before and, per open parenthesis, what it holds: a query (SELECT, or FROM
    at its start, was seen), a function that FROM may part, or an expression. Faults: a comma, a
    comparison, LIMIT or OFFSET with nothing behind it (a clause word, a closing parenthesis or the
    end), ORDER or GROUP without BY, two comparisons in a row, FROM in an expression.

    All but the last are pairs of neighbours, which one pattern finds. The fold, which is slow, is left
    to statements in which a FROM follows an open parenthesis that does not start a query, or one that
    holds others.
    """
    held = F.regexp_like(row, F.lit(r" \( (?!SELECT |FROM )(?:[^()]* )?FROM "))
    deep = F.instr(outside, " ( ")
    maybe = held | ((deep > 0) & (F.position(F.lit(" FROM "), outside, deep) > 0))
    return F.regexp_like(row, F.lit(CLAUSE_PAIRS)) | F.when(maybe, _from_in_expression(row)).otherwise(F.lit(False))


def _from_in_expression(row: Column) -> Column:
    start = F.struct(F.lit("").alias("prev"), F.array(F.lit("query")).alias("open"), F.lit(False).alias("bad"))

    def step(acc, t):
        prev, stack = acc["prev"], acc["open"]
        top = F.element_at(stack, -1)
        inner = F.when(F.size(stack) > 1, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1)))).otherwise(stack)
        query = (t == "SELECT") | ((t == "FROM") & (prev == "("))
        then = (F.when(t == "(", F.concat(stack, F.array(F.when(prev.isin(*FROM_FUNCTIONS), F.lit("parted")).otherwise(F.lit("expression")))))
                .when(t == ")", inner)
                .when(query, F.concat(F.when(F.size(stack) > 1, inner).otherwise(F.array().cast("array<string>")), F.array(F.lit("query"))))
                .otherwise(stack))
        bad = (t == "FROM") & (top == "expression") & ~prev.isin("(", "DISTINCT")
        return F.struct(t.alias("prev"), then.alias("open"), (acc["bad"] | bad).alias("bad"))

    return F.aggregate(F.split(F.btrim(row), " "), start, step, lambda acc: acc["bad"])


def _lookup(word: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(m, word)


# Validation as ordered stages of named expressions. Inline (one Column) for small uses, or
# staged as columns of a DataFrame (see ``with_validation``) so every intermediate text is
# computed once per row and generated code stays small.
def _validation_stages():
    ws_inner = WS.strip("[]")
    return [
        {"s": lambda e: py_strip(F.coalesce(e["text"], F.lit("")))},
        {"m": lambda e: mask_sql(e["s"])},
        {"pieces": lambda e: F.split(e["m"], ";"),
         "fold": lambda e: paren_fold(e["m"]),
         "open_quote": lambda e: F.regexp_like(e["m"], F.lit(r"['\"]|/\*"))},
        {"unbalanced": lambda e: (e["fold"]["depth"] != 0) | (e["fold"]["low"] < 0),
         "flat": lambda e: e["fold"]["text"]},
        {"first": lambda e: F.try_element_at(e["pieces"], F.lit(1)),
         "n_stmt": lambda e: F.size(e["pieces"]) - F.when(
             F.coalesce(F.regexp_like(F.try_element_at(e["pieces"], F.lit(-1)), F.lit(f"^{WS}*$")), F.lit(False))
             & (F.size(e["pieces"]) > 1), 1).otherwise(0)},
        {"lead": lambda e: F.upper(F.regexp_extract(e["first"], f"^{WS}*([A-Za-z_]+)", 1)),
         "starts_paren": lambda e: F.regexp_like(e["first"], F.lit(f"^{WS}*\\(")),
         # text of the first statement outside parentheses (its piece of the depth-0 text)
         "flat_first": lambda e: F.upper(F.coalesce(F.try_element_at(F.split(e["flat"], ";"), F.lit(1)), F.lit(""))),
         "first_word": lambda e: F.regexp_extract(e["first"], f"^{WS}*([^{ws_inner}]*)", 1)},
        {"kind": lambda e: _lookup(e["lead"], STATEMENT_KINDS),
         "query": lambda e: e["lead"].isin("SELECT", "WITH", "FROM"),
         "row": lambda e: F.when(e["lead"].isin("SELECT", "WITH", "FROM"), clause_row(e["first"])).otherwise(""),
         "set_op": lambda e: F.regexp_extract(F.regexp_replace(e["flat_first"], STAR_EXCEPT, "*"),
                                              r"\b(UNION|INTERSECT|EXCEPT)\b", 1),
         "with_write": lambda e: F.when(e["lead"] == "WITH", F.regexp_extract(
             e["flat_first"], r"^[^;]*?\bWITH\b[\s\S]*?\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\b", 1)).otherwise("")},
        {"outside": lambda e: clause_outside(e["row"])},
        {"broken": lambda e: F.when(e["query"], reduce(or_, [F.regexp_like(e["first"], F.lit(p)) for p in BROKEN_CLAUSES])
                                    | clause_fault(e["row"], e["outside"])).otherwise(False)},
        {"top_kind": lambda e: (F.when(e["starts_paren"], F.lit("Subquery"))
                                .when(e["set_op"] != "", _lookup(e["set_op"], SET_OPERATIONS))
                                .when((e["lead"] == "WITH") & (e["with_write"] != "") & (e["with_write"] != "SELECT"),
                                      _lookup(e["with_write"], WRITE_AFTER_WITH))
                                .otherwise(e["kind"])),
         "parse_err": lambda e: (F.when(e["open_quote"], F.lit("SQL parse error: unterminated quoted text or comment."))
                                 .when(e["unbalanced"], F.lit("SQL parse error: unbalanced parentheses."))
                                 .when(~e["starts_paren"] & e["kind"].isNull(),
                                       F.concat(F.lit("SQL parse error: unexpected token '"), e["first_word"],
                                                F.lit("'.")))
                                 .when(e["broken"], F.lit("SQL parse error: incomplete clause.")))},
        {"reason": lambda e: (F.when(e["s"] == "", F.lit("SQL is empty."))
                              .when(e["parse_err"].isNotNull(), e["parse_err"])
                              .when(e["n_stmt"] > 1, F.concat(F.lit("Multiple statements detected ("),
                                                              e["n_stmt"].cast("string"),
                                                              F.lit("). Only a single SELECT or WITH is allowed.")))
                              .when(~e["top_kind"].isin("Select", "With"),
                                    F.concat(F.lit("Unsafe statement type: "), e["top_kind"],
                                             F.lit(". Only SELECT and WITH are allowed.")))),
         "parse_ok": lambda e: (e["s"] != "") & e["parse_err"].isNull()},
    ]


def _run_inline(stages, env):
    for stage in stages:
        for name, fn in stage.items():
            env[name] = fn(env)
    return env


def _run_staged(df, stages, env, tmp: str):
    for stage in stages:
        cols = {f"{tmp}{name}": fn(env) for name, fn in stage.items()}
        df = df.withColumns(cols)
        for name in stage:
            env[name] = F.col(f"{tmp}{name}")
    return df, env


def validate_sql(x) -> Column:
    """``struct(parse_ok, valid, reason)`` for a column of SQL text (see module doc)."""
    env = _run_inline(_validation_stages(), {"text": _c(x)})
    return F.struct(env["parse_ok"].alias("parse_ok"), env["reason"].isNull().alias("valid"),
                    env["reason"].alias("reason"))


def with_validation(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_parse_ok, {prefix}_valid, {prefix}_reason``; same rules as
    :func:`validate_sql`, computed in stages."""
    tmp = f"__{prefix}_"
    out, env = _run_staged(df, _validation_stages(), {"text": F.col(text_col)}, tmp)
    out = out.withColumns({f"{prefix}_parse_ok": env["parse_ok"],
                           f"{prefix}_valid": env["reason"].isNull(),
                           f"{prefix}_reason": env["reason"]})
    return out.drop(*[c for c in out.columns if c.startswith(tmp)])


# ---------------------------------------------------------------------------- canonical form


# After these words a name stands before a parenthesis that is no call.
NAMES_FOLLOW = ("INTO", "TABLE", "VIEW", "WITH", "RECURSIVE")
# Keywords that end an expression, so that an alias may follow them.
ENDS = ("END", "NULL", "TRUE", "FALSE", "CURRENT_DATE", "CURRENT_TIMESTAMP")

_TOKENS = re.compile(TOKEN.replace(r"\x{0B}", r"\x0b"))
_KEYWORDS, _UPPER = frozenset(CANON_KEYWORDS), frozenset(CANON_UPPER)
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_ENDING = frozenset("0123456789)]'\"")


def _fold_calls(toks: list[str]) -> list[str]:
    """Keywords and known functions, and any unquoted word before a parenthesis, in upper case; INNER
    before JOIN goes."""
    out, last = [], ""
    for t, n in zip(toks, [*toks[1:], ""]):
        up = t.upper()
        if t == "!=":
            out.append("<>")
        elif up in _UPPER or (n == "(" and t[0] in _WORD and last not in NAMES_FOLLOW):
            if up != "INNER" or n.upper() != "JOIN":
                out.append(up)
        else:
            out.append(t)
        last = up
    return out


def _with_as(toks: list[str]) -> list[str]:
    """The optional AS written out: a name after the end of an expression, or of a table, is an alias."""
    out, two, last = [], "", ""
    for t, n in zip(toks, [*toks[1:], ""]):
        if last and two != "INTERVAL" and t[0] in _WORD and t not in _KEYWORDS and n not in ("(", ".") \
                and (last[0] in _ENDING or (last[0] in _WORD and (last not in _KEYWORDS or last in ENDS))):
            out.append("AS")
        out.append(t)
        two, last = last, t
    return out


def _glued(toks: list[str]) -> str:
    """Tokens joined with one space, except none before "," or ")", none after "(", and none between a
    non-keyword word and its "(". Works token by token, so quoted text is never touched."""
    out = []
    for t, n in zip(toks, [*toks[1:], ""]):
        out.append(t)
        if not (n in ("", ",", ")") or t == "(" or (n == "(" and t[0] in _WORD and t not in _KEYWORDS)):
            out.append(" ")
    return "".join(out)


def _canonical(texts: pa.Array) -> pa.Array:
    """The canonical form of a batch of texts without comments; a null has no tokens."""
    def one(text):
        toks = _with_as(_fold_calls(_TOKENS.findall(text or "")))
        return _glued(toks[:-1] if toks and toks[-1] == ";" else toks)

    return pa.array(map(one, texts.to_pylist()), pa.string())


def canonical_sql(x) -> Column:
    """Canonical text: comments dropped, tokens single-spaced, keywords and called functions
    upper-cased, the optional ``AS`` written, ``INNER JOIN`` as ``JOIN``, ``!=`` as ``<>``, a trailing
    ``;`` dropped. Literals and other identifiers are kept as written."""
    return F.arrow_udf(_canonical, "string")(F.regexp_replace(F.coalesce(_c(x), F.lit("")), COMMENT_OR_QUOTED, " $2 "))


def with_canonical(df: DataFrame, text_col: str, out: str) -> DataFrame:
    return df.withColumn(out, canonical_sql(text_col))


def with_comparison(df: DataFrame, pred_col: str, gold_col: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_valid`` (prediction passes validation), ``{prefix}_match`` (canonical
    match, false when either side does not parse) and ``{prefix}_token_sim``."""
    out = with_validation(df, pred_col, f"{prefix}p")
    # Without a prediction that parses there is no match: its gold text is not looked at.
    out = out.withColumn(f"{prefix}g_text", F.when(F.col(f"{prefix}p_parse_ok"), F.col(gold_col)))
    out = with_validation(out, f"{prefix}g_text", f"{prefix}g")
    both = F.col(f"{prefix}p_parse_ok") & F.col(f"{prefix}g_parse_ok")
    out = out.withColumns({f"{prefix}_cp": canonical_sql(F.when(both, F.col(pred_col))),
                           f"{prefix}_cg": canonical_sql(F.when(both, F.col(gold_col)))})
    out = out.withColumns({
        f"{prefix}_valid": F.col(f"{prefix}p_valid"),
        f"{prefix}_match": F.col(f"{prefix}p_parse_ok") & F.col(f"{prefix}g_parse_ok")
        & (F.col(f"{prefix}_cp") == F.col(f"{prefix}_cg")),
        f"{prefix}_token_sim": token_similarity(pred_col, gold_col)})
    drop = [c for c in out.columns if c.startswith((f"{prefix}p_", f"{prefix}g_"))] + [f"{prefix}_cp", f"{prefix}_cg"]
    return out.drop(*drop)


def ast_match(a, b) -> Column:
    """Canonical forms equal; false when either side does not parse (or is empty)."""
    va, vb = validate_sql(a), validate_sql(b)
    return va["parse_ok"] & vb["parse_ok"] & (canonical_sql(a) == canonical_sql(b))
