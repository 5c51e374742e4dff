"""Tables of any kind as archive relations.

dentry(image, path, name, inode, attributes, hash, size) has one row per directory entry, blob(hash, size, refs)
one per content, content(hash, bytes) carries the payload apart, so that queries on names never read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions import content_hash, content_size

FILE, FOLDER = 0x80, 0x10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_entries(docs: DataFrame) -> DataFrame:
    """Documents as files: a source is an image, /<lang>/<doc_id>.txt the path."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("source").alias("image"), F.concat(F.lit("/"), F.col("lang"), F.lit("/"), name).alias("path"), name.alias("name"),
        F.col("doc_id").alias("inode"), F.lit(FILE).cast("long").alias("attributes"), content_hash(text).alias("hash"), content_size(text).alias("size"),
    )


def page_entries(pages: DataFrame) -> DataFrame:
    """Pages as files: a host is an image, the path of the URL (without query and fragment) the path."""
    path = F.concat(F.lit("/"), F.trim(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+", "/"), F.lit("/")))
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("image"), path.alias("path"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"),
        F.col("page_id").alias("inode"), F.lit(FILE).cast("long").alias("attributes"), content_hash(html).alias("hash"), content_size(html).alias("size"),
    )


def order_entries(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Lines of orders as files of a status image; a part is an inode, so that lines of one part are hard links."""
    size = F.col("l_quantity").cast("long")
    return lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_orderstatus").alias("image"),
        F.concat_ws("/", F.lit(""), "o_orderpriority", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"),
        F.col("l_linenumber").cast("string").alias("name"), F.col("l_partkey").alias("inode"), F.lit(FILE).cast("long").alias("attributes"),
        F.sha1(F.concat_ws(":", F.col("l_partkey").cast("string"), size.cast("string")).cast("binary")).alias("hash"), size.alias("size"),
    )


def conversation_streams(turns: DataFrame) -> DataFrame:
    """Conversations as files with a stream per turn: inode, slot, stream name, hash, size."""
    text = F.coalesce("text", F.lit(""))
    return turns.select(F.col("conv_id").alias("inode"), F.col("turn").alias("slot"), F.col("role").alias("stream"), content_hash(text).alias("hash"), content_size(text).alias("size"))


def text_content(df: DataFrame, column: str = "text") -> DataFrame:
    """content(hash, bytes) of a text column, each content once."""
    text = F.coalesce(column, F.lit(""))
    return df.select(content_hash(text).alias("hash"), F.encode(text, "UTF-8").alias("bytes")).dropDuplicates(["hash"])
