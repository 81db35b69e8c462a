"""(question, SQL) pair files: batch and streaming ingest, and the corpus tables.

Reading rules for a pair CSV: every column is text; a missing value is the empty string;
the values a pandas reader treats as missing (list below) are empty too; the ``sql`` column
is required (error otherwise), ``nlq`` defaults to empty; both are stripped of whitespace;
rows whose SQL is empty are dropped; other columns are ignored, except an optional
``pair_id``. A row without one gets an id from its content, the same in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.sqltext import py_strip

# Strings a pandas CSV reader turns into missing values by default.
MISSING_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                   "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                   "nan", "null"]

PAIRS_SCHEMA = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("nlq", T.StringType()),
    T.StructField("sql", T.StringType()),
])


def _csv_reader(spark: SparkSession):
    return (spark.read.option("header", True).option("multiLine", True)
            .option("escape", '"').option("inferSchema", False)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def _as_text(c) -> F.Column:
    col = F.col(c)
    return F.when(col.isNull() | col.isin(MISSING_MARKERS), F.lit("")).otherwise(col)


def clean_pairs(raw: DataFrame) -> DataFrame:
    """Apply the reading rules to a frame of raw CSV columns."""
    if "sql" not in raw.columns:
        raise ValueError(f"CSV must have a 'sql' column. Found: {raw.columns}")
    nlq = py_strip(_as_text("nlq")) if "nlq" in raw.columns else F.lit("")
    pid = F.expr("try_cast(pair_id as long)") if "pair_id" in raw.columns else F.lit(None).cast("long")
    return (raw.select(pid.alias("pair_id"), nlq.alias("nlq"), py_strip(_as_text("sql")).alias("sql"))
            .filter(F.length("sql") > 0).withColumn("pair_id", F.coalesce("pair_id", content_id())))


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_pairs(_csv_reader(spark).csv(path))


def write_pairs_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write a pair frame as CSV with a header (values quoted as needed, quotes doubled), a file
    per partition of the frame unless ``files`` is given."""
    ((df.repartition(files) if files else df).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def content_key(nlq: str = "nlq", sql: str = "sql"):
    return F.md5(F.concat_ws("\u001f", F.col(nlq), F.col(sql)))


def content_id(nlq: str = "nlq", sql: str = "sql"):
    """A positive long from the content key: its first 60 bits."""
    return F.conv(F.substring(content_key(nlq, sql), 1, 15), 16, 10).cast("long")
