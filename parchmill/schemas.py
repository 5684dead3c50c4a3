"""Fixed schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("publish_date", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

ERROR = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("meta", METADATA),
        T.StructField("error", ERROR),
        T.StructField("cached", T.BooleanType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("full_length", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)

STORE = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("meta", METADATA),
        T.StructField("stored_at", T.TimestampType()),
    ]
)

# One stored document as a JSON file: the names are part of the on-disk format.
STORE_JSON = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("fetchedAt", T.TimestampType()),
        T.StructField("markdown", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("Title", T.StringType()),
                    T.StructField("Author", T.StringType()),
                    T.StructField("PublishDate", T.StringType()),
                    T.StructField("Description", T.StringType()),
                ]
            ),
        ),
    ]
)

FETCH_LOG = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("status_line", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)
