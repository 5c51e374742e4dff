"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

An item's word shingles are hashed; its MinHash sketch is its smallest hash values. Items are partitioned by
size: an item of at most u shingles keeps floor((1 - threshold) * u) + 1 values, so a document that contains at
least `threshold` of the item must share one of them at least (the missing shingles are too few to fill the
sketch). Long documents therefore lose nothing to the great difference in size. Documents that share a sketch
value are candidates; exact containment of the shingles themselves decides.

A miss is impossible among shingles, not among words: an item of fewer words than a shingle has is one shingle of its
own length, so it is found only in a document that consists of just these words, never inside a longer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import named, numbered, read, row_key, settle, small, text_of

#: Fixed separators of words: whatever is neither letter nor digit, in either case.
SEPARATOR = r"[^\p{L}\p{N}]+"
WORDS, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR, -1), lambda w: w != "")


def shingles(w: Column, size: int, of) -> Column:
    """`of` applied to each run of `size` words; a shorter text is one shingle, an empty one has none."""
    count = F.size(w) - size
    return (
        F.when(count >= 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(0)) + 1), lambda i: of(F.slice(w, i, size))))
        .when(F.size(w) > 0, F.array(of(w)))
    )


def _joined(run: Column) -> Column:
    return F.array_join(run, " ")


def sketches(items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, item (its distinct shingles), class (its size partition) and sketch (hash values)."""
    own = items.select("item_id", words(text_of()).alias("w"))
    own = own.select("item_id", F.array_distinct(shingles(F.col("w"), size, _joined)).alias("item")).where("item is not null")
    q = F.size("item")
    cls = F.ceil(F.log2(q)).cast("int")
    keep = F.least(q, F.floor(F.lit(1 - threshold + 1e-9) * F.pow(F.lit(2.0), cls)).cast("int") + 1)
    values = F.sort_array(F.transform("item", lambda s: F.xxhash64(s)))
    return own.withColumn("class", cls).withColumn("sketch", F.slice(values, 1, keep))


def contained(docs: DataFrame, items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, __h, item_id, n_item, n_shared, containment) of documents that hold an item.

    __h is the hash of the document's text. Null and empty texts hold nothing and are held by nothing; equal
    rows give one pair; other columns are ignored. All documents and all items are compared.
    """
    known = settle(sketches(items, size, threshold))
    values = known.select("item_id", "class", F.explode("sketch").alias("value"))
    by_value = small(settle(values.select("value", "item_id").distinct()))
    reach = known.agg(F.max(F.array_max("sketch"))).first()[0]  # no sketch has a greater value
    if reach is None:
        return _none(docs, items)
    listed = row_key(docs.select("doc_id", "text")).select("doc_id", "__h", words(text_of()).alias("w"))
    values = F.filter(shingles(F.col("w"), size, lambda run: F.xxhash64(F.array_join(run, " "))), lambda v: v <= reach)
    hashed = listed.select("doc_id", "__h", F.explode(values).alias("value"))
    pairs = settle(hashed.join(by_value, "value").select("doc_id", "__h", "item_id").distinct())
    # Texts of candidates only: a checked broadcast where they are few, else a shuffled join.
    wanted = small(pairs.select("doc_id", "__h").distinct())
    keyed = row_key(docs.select("doc_id", "text"))
    texts = keyed.join(
        wanted.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k")),
        keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["__h"] == F.col("__k")), "left_semi",
    ).dropDuplicates(["doc_id", "__h"])
    texts = texts.select("doc_id", "__h", words(text_of()).alias("w"))
    texts = texts.select("doc_id", "__h", F.array_distinct(shingles(F.col("w"), size, _joined)).alias("own"))
    p = pairs.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k"), "item_id")
    both = texts.join(p, texts["doc_id"].eqNullSafe(p["__id"]) & (texts["__h"] == p["__k"]))
    both = both.join(small(known.select("item_id", "item")), "item_id")
    return (
        both.select("doc_id", "__h", "item_id", F.size("item").cast("long").alias("n_item"), F.size(F.array_intersect("own", "item")).cast("long").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .where(F.col("n_shared") >= F.lit(threshold - 1e-9) * F.col("n_item"))
    )


def _none(docs: DataFrame, items: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    ids = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "item_id": items.schema["item_id"].dataType.simpleString()}
    return spark.createDataFrame([], f"doc_id {ids['doc_id']}, __h bigint, item_id {ids['item_id']}, n_item bigint, n_shared bigint, containment double")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold an item; columns and repeated rows stay."""
    hits = settle(contained(docs, items).select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k")).distinct())
    plain, doc_id, text = numbered(docs)
    keyed = row_key(plain, text)
    kept = keyed.join(small(hits), keyed[doc_id].eqNullSafe(hits["__id"]) & (keyed["__h"] == hits["__k"]), "left_anti")
    return named(kept, docs)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds: sizes and containment."""
    found = contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment")
    )


SQL = {
    "op7_benchmark_decontamination": r"""
    with w as (select 'd' as side, doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
      union all select 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') from benchmark),
    s as (select distinct side, id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
    n as (select id, count(*) as n_item from s where side = 'i' group by id)
    select d.id as doc_id, i.id as item_id, any_value(n_item) as n_item, count(*) as n_shared, count(*) / any_value(n_item)::double as containment
    from s d join s i on d.s = i.s and d.side = 'd' and i.side = 'i' join n on n.id = i.id group by 1, 2 having count(*) >= 0.8 * any_value(n_item)"""
}
QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
