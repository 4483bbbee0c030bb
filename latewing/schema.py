"""Schemas of the tables that the engine keeps."""

from pyspark.sql import types as T

REGISTRY_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("file_path", T.StringType()),
        T.StructField("num_pages", T.IntegerType()),
        T.StructField("embedding_path", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("file_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("num_pages", T.IntegerType()),
        T.StructField("embedding_path", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

#: ``flat`` holds a page's token vectors end to end, row by row, as little-endian 32-bit floats: bytes go from Spark to the
#: scoring kernel without a look at any element.
PAGE_EMBEDDINGS = T.StructType(
    [
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("page_number", T.IntegerType(), False),
        T.StructField("n_tokens", T.IntegerType(), False),
        T.StructField("dim", T.IntegerType(), False),
        T.StructField("flat", T.BinaryType(), False),
    ]
)

#: What the store keeps: a page and the attempt that wrote it; the registry names the attempt that counts.
STORED_PAGES = T.StructType([*PAGE_EMBEDDINGS.fields, T.StructField("attempt", T.StringType())])

HITS = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("total_pages", T.IntegerType()),
    ]
)
