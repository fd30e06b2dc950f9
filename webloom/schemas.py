"""Schemas of the stored tables."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

LINKS = StructType([StructField("id", StringType(), False), StructField("url", StringType(), False), StructField("retrieved_at", TimestampType())])
EDGES = StructType([StructField("id", StringType()), StructField("src", StringType(), False), StructField("dest", StringType(), False), StructField("updated_at", TimestampType())])
DOCUMENTS = StructType(
    [
        StructField("link_id", StringType(), False),
        StructField("url", StringType()),
        StructField("title", StringType()),
        StructField("content", StringType()),
        StructField("page_rank", DoubleType()),
        StructField("indexed_at", TimestampType()),
    ]
)
QUERY = StructType([StructField("type", StringType()), StructField("expression", StringType()), StructField("offset", LongType())])
PAGES = StructType([StructField("link_id", StringType()), StructField("url", StringType()), StructField("status", IntegerType()), StructField("content_type", StringType()), StructField("html", StringType())])
CRAWLED = StructType(
    [
        StructField("link_id", StringType()),
        StructField("url", StringType()),
        StructField("title", StringType()),
        StructField("text", StringType()),
        StructField("links", ArrayType(StringType())),
        StructField("nofollow", ArrayType(StringType())),
    ]
)
VERTICES = StructType([StructField("id", StringType(), False), StructField("active", BooleanType())])
