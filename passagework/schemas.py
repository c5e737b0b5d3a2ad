"""Schemas of the stored tables.

`file_id` is the key of the source table where there is one, otherwise the md5 of
the path (a 64-bit hash would collide at ten billion files). A chunk is keyed by
(file_id, chunk_no); there is no generated counter.
"""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK_KEY = ["file_id", "chunk_no"]

META = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("written_at", T.TimestampType(), False),
])

CLAUSES = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("group_no", T.IntegerType(), False),
    T.StructField("clause_no", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("form", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
])

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])
