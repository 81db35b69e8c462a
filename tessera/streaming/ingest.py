"""Structured Streaming ingest of pair files and lesson files into tables by content key.

Both streams read files as they come, at most ``files_per_batch`` of them in a micro-batch, and
process what is there (``availableNow``). A micro-batch is one commit of its table, named by the
stream's checkpoint and the batch's number: a batch that is replayed does nothing twice, and rows that
an earlier batch or run brought are known by their key. The state of the de-duplication is the
table itself with its filters, so it does not grow in any task's memory.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.embed import hash_embed
from tessera.functions.sqltext import LESSON_FIELDS, with_parsed_lesson
from tessera.sources.corpus import add_lessons
from tessera.sources.keyed import KEY, KeyedTable
from tessera.sources.pairs import PAIRS_SCHEMA, clean_pairs, content_key

FILES_PER_BATCH = 1000


def pairs_table(spark: SparkSession, path: str, digits: int = 2) -> KeyedTable:
    return KeyedTable(spark, path, PAIRS_SCHEMA, digits)


def _run(stream: DataFrame, upsert, checkpoint_path: str) -> None:
    name = hashlib.md5(checkpoint_path.encode()).hexdigest()[:12]
    q = (stream.writeStream.foreachBatch(lambda batch, epoch: upsert(batch, f"{name}-{epoch}"))
         .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_ingest(spark: SparkSession, source_dir: str, table_path: str, checkpoint_path: str,
                  raw_schema: T.StructType | None = None, files_per_batch: int = FILES_PER_BATCH, digits: int = 2) -> KeyedTable:
    """Ingest every CSV file of ``source_dir`` into the table at ``table_path``, which is returned.

    Columns go by the header: ``raw_schema`` names them in file order (by default as the files there
    now do), and a file with another header fails. Of equal pairs of a micro-batch the smallest id stays,
    of equal pairs of several the first batch's.
    """
    if raw_schema is None:
        found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(source_dir).columns
        raw_schema = T.StructType([T.StructField(c, T.StringType()) for c in found])
    if "sql" not in raw_schema.names:
        raise ValueError(f"CSV must have a 'sql' column. Found: {raw_schema.names}")
    table = pairs_table(spark, table_path, digits)
    stream = (spark.readStream.schema(raw_schema).option("header", True).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch)
              .option("escape", '"').option("enforceSchema", False).option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False).csv(source_dir))
    _run(stream, lambda batch, commit: table.append(clean_pairs(batch).withColumn(KEY, content_key()), commit, "pair_id"), checkpoint_path)
    return table


def stream_lessons(spark: SparkSession, source_dir: str, table: KeyedTable, checkpoint_path: str, embed=hash_embed,
                   files_per_batch: int = FILES_PER_BATCH) -> KeyedTable:
    """Ingest lesson files, a JSON object {"id": ..., "text": ...} a line with the model's output as
    text, into a table of lessons: texts that parse, their triggers embedded. Others are left out."""
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", files_per_batch).json(source_dir)

    def upsert(batch: DataFrame, commit: str) -> None:
        parsed = with_parsed_lesson(batch, "text", "p").checkpoint(eager=True).where("p_ok")
        add_lessons(table, parsed.select(F.col("id").alias("lesson_id"), *[F.col(f"p_{f}").alias(f) for f in LESSON_FIELDS]), embed, commit)

    _run(stream, upsert, checkpoint_path)
    return table
