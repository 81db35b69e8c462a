"""tessera: the batch data work of a retrieval-augmented question-to-SQL system on Spark.

Subpackages: ``sources`` (tables, pair files, parquet store), ``functions`` (column
functions over SQL text, prompts, embeddings), ``operators`` (similarity join, metrics,
split, model calls, repair), ``plans`` (the registered queries and their SQL twins) and
``streaming`` (file-stream ingest).
"""

__version__ = "0.1.0"
