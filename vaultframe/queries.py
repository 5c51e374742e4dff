"""Queries over the given tables, one per operator, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe import functions as fn
from vaultframe.operators import blobs, images, layout, lookup, mutate, properties, select, tree, verify
from vaultframe.sources import adapters as src
from vaultframe.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Relations as SQL, in the same shape as the adapters give them.
_DOC = "select source as image, '/' || lang || '/' || doc_id || '.txt' as path, doc_id || '.txt' as name, doc_id as inode, sha1(coalesce(text, '')) as hash, octet_length(encode(coalesce(text, '')))::bigint as size from documents"
_ITEM = "select sha1(coalesce(text, '')) as hash, octet_length(encode(coalesce(text, '')))::bigint as size, '/' || item_id as path from benchmark"
_LINE = "select o_orderstatus as image, '/' || o_orderpriority || '/' || o_orderkey || '/' || l_linenumber as path, l_linenumber::varchar as name, l_partkey as inode, sha1(l_partkey || ':' || l_quantity::bigint) as hash, l_quantity::bigint as size from lineitem join orders on l_orderkey = o_orderkey"
_PAGE = "select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as image, '/' || trim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/') as path, page_id as inode from pages"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return src.document_entries(src.table(spark, d, "documents"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return src.table(spark, d, "benchmark").select(fn.content_hash(text).alias("hash"), fn.content_size(text).alias("size"), F.concat(F.lit("/"), F.col("item_id").cast("string")).alias("path"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return src.order_entries(src.table(spark, d, "orders"), src.table(spark, d, "lineitem"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return src.page_entries(src.table(spark, d, "pages"))


@query(f"select hash, size, count(*) as refs, min(path) as first_path from ({_DOC}) group by 1, 2")
def blob_table(spark, d):
    return blobs.blob_table(_docs(spark, d))


@query(f"select hash, size, count(*) as refs from (select hash, size from ({_DOC}) union all select hash, size from ({_ITEM})) group by 1, 2")
def blob_union(spark, d):
    return blobs.merged_blobs(blobs.blob_table(_docs(spark, d)), blobs.blob_table(_items(spark, d)))


@query(f"select distinct hash, size from ({_ITEM}) where hash not in (select hash from ({_DOC}))")
def missing_blobs(spark, d):
    return blobs.missing_in(_items(spark, d).select("hash", "size"), _docs(spark, d))


@query(f"select hash, any_value(size) as size, min(source) as source from (select hash, size, 0 as source from ({_ITEM}) union all select hash, size, 1 from ({_DOC}) where image <> 'src0') where hash not in (select hash from ({_DOC}) where image = 'src0') group by hash")
def referenced_blobs(spark, d):
    docs = _docs(spark, d)
    return blobs.referenced_from(docs.where("image = 'src0'"), [_items(spark, d), docs.where("image <> 'src0'")])


@query(f"select distinct hash, size from ({_DOC}) where hash in (select hash from ({_DOC}) where image = 'src1')")
def blobs_in_use(spark, d):
    docs = _docs(spark, d)
    return blobs.in_use(docs.select("hash", "size").distinct(), docs.where("image = 'src1'"))


@query(f"select inode as id, size, count(*) over (partition by size) > 1 as early from ({_DOC})")
def size_collisions(spark, d):
    return blobs.worth_hashing(_docs(spark, d).select(F.col("inode").alias("id"), "size"))


@query("select case when turn % 2 = 0 then sha1(coalesce(text, '')) else 'id:' || conv_id end as key, min('/' || conv_id || '/' || turn) as path, max(octet_length(encode(coalesce(text, '')))::bigint) as size, count(*) as refs from conversations group by 1")
def merged_streams(spark, d):
    s = src.conversation_streams(src.table(spark, d, "conversations"))
    return blobs.merged_streams(s.select(F.when(F.col("slot") % 2 == 0, F.col("hash")).alias("hash"), F.col("inode").alias("identity"), F.concat_ws("/", F.lit(""), F.col("inode").cast("string"), F.col("slot").cast("string")).alias("path"), "size"))


@query("select doc_id as id, doc_id as identity, sha1(coalesce(text, '')) as hash from documents")
def deferred_hashes(spark, d):
    docs = src.table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    streams = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("identity"), F.when(F.col("doc_id") % 2 == 0, fn.content_hash(text)).alias("hash"))
    return blobs.resolved_hashes(streams, docs.select(F.col("doc_id").alias("identity"), F.encode(text, "UTF-8").alias("bytes")))


@query("select greatest(count(distinct source), 1)::bigint as parts from documents")
def source_parts(spark, d):
    return blobs.source_parts(src.table(spark, d, "documents").select(F.col("source").alias("origin")))


@query("select l_orderkey as file, l_linenumber::bigint as ordinal, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber desc) - 1 as \"left\" from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by 1, 2)")
def remaining_uses(spark, d):
    lines = src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("ordinal")).agg(F.min("l_partkey").alias("l_partkey"))
    return blobs.remaining_uses(lines)


@query(f"select distinct hash, case when size >= 90 then sha1(encode(t)[11:90]) end as part_hash from (select sha1(coalesce(text, '')) as hash, octet_length(encode(coalesce(text, ''))) as size, coalesce(text, '') as t from documents)")
def blob_range(spark, d):
    return blobs.byte_range(src.text_content(src.table(spark, d, "documents")), 10, 90).select("hash", F.sha1("part").alias("part_hash"))


@query(
    f"""with e as ({_LINE}), dirs as (select image, count(*) as dir_count from (select distinct image, unnest(['', '/' || split_part(path, '/', 2), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) from e) group by 1),
    f as (select *, row_number() over (partition by image, inode order by path, size) as n from e)
    select image, dir_count, count(*) as file_count, sum(size)::bigint as total_bytes, coalesce(sum(size) filter (n > 1), 0)::bigint as hardlink_bytes from f join dirs using (image) group by 1, 2"""
)
def image_stats(spark, d):
    return images.image_stats(_lines(spark, d))


@query(f"select path, hash, image, case image when 'src3' then 1 else 2 end as image_id from ({_DOC}) where image in ('src3', 'src1')")
def select_images(spark, d):
    return images.selected(_docs(spark, d), ["src3", "src1"]).select("path", "hash", "image", "image_id")


@query("select r_regionkey + 1 - (r_name > 'ASIA' and r_regionkey > (select r_regionkey from region where r_name = 'ASIA'))::int - (r_name <= 'ASIA' and r_regionkey > (select r_regionkey from region where r_name = 'ASIA'))::int as image_id, r_name as image from region where r_name <> 'ASIA'")
def delete_image(spark, d):
    regions = src.table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("image_id"), F.col("r_name").alias("image"))
    return images.without_image(regions, "ASIA")


@query(f"select image, path, hash from ({_DOC}) where image in ('src1', 'src2', 'src5')")
def export_union(spark, d):
    docs = _docs(spark, d).select("image", "path", "hash")
    return images.exported(docs.where("image = 'src1'"), docs.where("image <> 'src1'"), ["src2", "src5"])


@query(f"select hash, part, path, size from (select hash, (inode % 3 + 1)::int as part, path, size, row_number() over (partition by hash order by inode % 3, path) as n from ({_DOC})) where n = 1")
def join_parts(spark, d):
    docs = _docs(spark, d)
    heads = [{"guid": "g", "part_number": n, "total_parts": 3} for n in (2, 1, 3)]
    return images.joined_parts(heads, [docs.where(F.col("inode") % 3 + 1 == h["part_number"]).select("hash", "path", "size") for h in heads])


_LAYER = "select doc_id % 4 as layer, '/' || (doc_id // 4) as path, doc_id // 4 % 20 = 0 and doc_id % 4 = 1 as is_dir, doc_id from (select * from documents)"


def _layers(spark, d):
    """Four layers over paths that grow in number with the documents; one path in twenty is a directory in one layer and a file in the others."""
    i, place = F.col("doc_id"), F.floor(F.col("doc_id") / 4)
    docs = src.table(spark, d, "documents")
    return docs.select((i % 4).alias("layer"), F.concat(F.lit("/"), place.cast("string")).alias("path"), ((place % 20 == 0) & (i % 4 == 1)).alias("is_dir"), "doc_id")


@query(f"with l as ({_LAYER}), c as (select path from l group by 1 having min(is_dir) = max(is_dir)) select path, layer, is_dir, doc_id from (select *, row_number() over (partition by path order by layer desc, is_dir desc, doc_id desc) as n from l where path in (select path from c)) where n = 1")
def overlay_merge(spark, d):
    return images.overlay(_layers(spark, d))[0]


@query(f"select path, 'directory and file' as clash from ({_LAYER}) group by path having min(is_dir) <> max(is_dir)")
def overlay_clashes(spark, d):
    return images.overlay(_layers(spark, d))[1]


@query(
    f"""with a as (select name, min(hash) as hash, max(size) as size from ({_DOC}) where inode % 10 <> 3 group by 1), b as (select name, min(case when inode % 10 = 5 then 'x' else hash end) as hash, max(size) as size from ({_DOC}) where inode % 10 <> 4 group by 1)
    select name, case when b.hash is null then 'only_first' when a.hash is null then 'only_second' else 'changed' end as kind from a full join b using (name) where a.hash is null or b.hash is null or a.hash <> b.hash or a.size <> b.size"""
)
def image_diff(spark, d):
    docs = _docs(spark, d)
    last = F.col("inode") % 10
    a = docs.where(last != 3).groupBy("name").agg(F.min("hash").alias("hash"), F.max("size").alias("size"))
    b = docs.where(last != 4).groupBy("name").agg(F.min(F.when(last == 5, "x").otherwise(F.col("hash"))).alias("hash"), F.max("size").alias("size"))
    return images.difference(a, b, ["name"], ["hash", "size"])


@query("select c_nationkey as image, c_custkey as sd_id, dense_rank() over (order by c_mktsegment) - 1 as new_id from customer")
def descriptor_remap(spark, d):
    return images.remapped_descriptors(src.table(spark, d, "customer").select(F.col("c_nationkey").alias("image"), F.col("c_custkey").alias("sd_id"), F.col("c_mktsegment").alias("bytes")))


@query(
    f"""with e as ({_LINE}), b as (select distinct hash from e where inode % 7 <> 0)
    select image, path, name, '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) as parent, 3::bigint as depth, count(*) over (partition by image, inode) as links, e.hash, size, b.hash is null as missing from e left join b using (hash)"""
)
def dir_entries(spark, d):
    e = _lines(spark, d)
    return tree.dir_entries(e, e.where(F.col("inode") % 7 != 0).select("hash", "size"))


@query(f"select image, path from (select distinct image, unnest([ '/', '/' || split_part(path, '/', 2)]) as path from ({_DOC}))")
def implied_folders(spark, d):
    return images.folders(_docs(spark, d))


@query(f"select image, path from (select distinct image, '/' || split_part(path, '/', 2) as path from ({_DOC}))")
def subtree_children(spark, d):
    return tree.subtree(images.folders(_docs(spark, d)).unionByName(_docs(spark, d).select("image", "path")), "/", children=True)


@query(f"select image, path, hash from ({_DOC}) where path like '/en/%'")
def subtree_recursive(spark, d):
    return tree.subtree(_docs(spark, d), "/en", recursive=True).select("image", "path", "hash")


@query(f"select image, path, min(path) over w as canonical, count(*) over w as names from ({_LINE}) window w as (partition by image, inode, hash)")
def hardlink_groups(spark, d):
    return tree.hardlink_groups(_lines(spark, d))


@query(
    """select 'r' || r_regionkey as node, '/' || r_name as path from region union all select 'n' || n_nationkey, '/' || r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey
    union all select 'c' || c_custkey, '/' || r_name || '/' || n_name || '/' || c_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey union all select 'root', '/'"""
)
def node_paths(spark, d):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r, n, c = (src.table(spark, d, t) for t in ("region", "nation", "customer"))
    nodes = (
        r.select(key("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.col("r_name").alias("name"))
        .unionByName(n.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
        .unionByName(c.select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
        .unionByName(r.limit(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("name")))
    )
    return tree.reachable(nodes)


@query(
    """with i as (select r_regionkey + 1 as image_id, r_name as image from region), s as (select unnest(['all', '*', '', '2', ' +03', '0', 'ASIA', 'asia', '99', '99999999999999999999']) as selector union all select n_name from nation)
    select selector, coalesce(case when selector = '' then 0 when lower(selector) in ('all', '*') then -1 when regexp_matches(selector, '^ *\\+?[0-9]+$') and coalesce(try_cast(trim(selector) as bigint), -1) <> 0
      then case when coalesce(try_cast(trim(selector) as bigint), 99) <= 5 then trim(selector)::bigint else 0 end else (select min(image_id) from i where image = selector) end, 0)::bigint as image_id from s"""
)
def resolve_images(spark, d):
    regions = src.table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("image_id"), F.col("r_name").alias("image"))
    fixed = spark.createDataFrame([(x,) for x in ("all", "*", "", "2", " +03", "0", "ASIA", "asia", "99", "99999999999999999999")], "selector string")
    return select.resolved_images(fixed.unionByName(src.table(spark, d, "nation").select(F.col("n_name").alias("selector"))), regions)


@query("select c_mktsegment as selector, c_mktsegment in (select 'BUILDING') as used from customer")
def names_in_use(spark, d):
    known = spark.createDataFrame([("BUILDING",), ("",)], "image string")
    return select.name_in_use(src.table(spark, d, "customer").select(F.col("c_mktsegment").alias("selector")), known)


@query(f"with e as (select distinct path from ({_DOC})), w as (select distinct case when inode % 2 = 0 then upper(path) else path end as path from ({_DOC})) select w.path, coalesce((select e.path from e where e.path = w.path), (select min(e.path) from e where upper(e.path) = upper(w.path))) as found from w")
def literal_lookup(spark, d):
    docs = _docs(spark, d)
    wanted = docs.select(F.when(F.col("inode") % 2 == 0, F.upper("path")).otherwise(F.col("path")).alias("path")).distinct()
    return select.literal_matches(wanted, docs.select("path").distinct(), ignore_case=True)


@query("select image, folded, names from (select c_nationkey as image, upper(case when c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end) as folded, count(distinct case when c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end) as names from customer group by 1, 2) where names > 1")
def ambiguous_paths(spark, d):
    name = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return select.ambiguous(src.table(spark, d, "customer").select(F.col("c_nationkey").alias("image"), name.alias("path")))


@query(f"select image, path, inode from ({_PAGE}) where regexp_matches(path, '^/[^/]/[^/]*1[^/]*$') or regexp_matches(path, '^/e[^/]/[^/]*2$') or regexp_matches(path, '^/de/[^/]*$')")
def glob_match(spark, d):
    return select.glob_matches(_pages(spark, d), ["/?/*1*", "/e?/*2", "/de/*"]).select("image", "path", "inode")


@query(f"with e as (select distinct path from ({_LINE}) union select '/5-LOW' union select '/1-URGENT'), r as (select distinct path from e where path like '%/1') select distinct path from e where path in (select path from r) or path like '/5-LOW/%' or path in ('/5-LOW') or exists(select 1 from r where starts_with(r.path, e.path || '/'))")
def selection(spark, d):
    fixed = lambda *names: spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("path"))
    paths = _lines(spark, d).select("path").unionByName(fixed("/5-LOW", "/1-URGENT")).distinct()
    roots = paths.where(F.col("path").like("%/1")).unionByName(fixed("/5-LOW"))
    return select.normalised_selection(paths, roots)


@query(f"select image, path from ({_DOC}) where not ((starts_with(path, '/de/') or regexp_matches(name, '^1.*\\.txt$')) and not path = '/de/7.txt' and not regexp_matches(name, '^19[^/]\\.txt$')) and not (starts_with(path, '/de/'))")
def exclude_paths(spark, d):
    return select.captured(_docs(spark, d), ["/de", "1*.txt"], ["19?.txt"]).select("image", "path")


@query(f"select distinct hash, size from ({_DOC}) where hash in (select hash from ({_DOC}) where path like '/fr/%')")
def needed_blobs(spark, d):
    docs = _docs(spark, d)
    return select.needed(docs.select("hash", "size").distinct(), tree.subtree(docs, "/fr", recursive=True))


_BLOB = f"(select hash, any_value(size) as size, min(inode) as first from ({_DOC}) group by hash)"


def _blobs(spark, d):
    return _docs(spark, d).groupBy("hash").agg(F.max("size").alias("size"), F.min("inode").alias("first"))


@query(f"select hash, size, first, (sum(size) over (order by first rows unbounded preceding) - size)::bigint as \"offset\" from {_BLOB}")
def solid_offsets(spark, d):
    return layout.running_offsets(_blobs(spark, d), ["first"])


@query(f"select hash, first_path, name from (select hash, min(path) over (partition by hash) as first_path, name, row_number() over (partition by hash order by length(name), path, name) as n from ({_DOC})) where n = 1")
def solid_names(spark, d):
    return layout.solid_order(_docs(spark, d)).select("hash", "first_path", "name")


@query("select p_partkey as hash, row_number() over (order by p_size % 4 > 0, case when p_size % 4 = 2 then upper(p_brand) else '' end, case when p_size % 4 > 0 then upper(p_name || case when p_size % 4 = 2 then '.' || p_brand else '' end) else '' end, p_partkey) as position from (select p_partkey, p_name, p_brand, case when p_size % 4 = 2 then 2 when p_size % 4 > 0 then 1 else 0 end as p_size from part)")
def solid_positions(spark, d):
    has = F.col("p_size") % 4
    name = F.when(has == 2, F.concat("p_name", F.lit("."), "p_brand")).when(has > 0, F.col("p_name")).otherwise("")
    rows = src.table(spark, d, "part").select(F.col("p_partkey").alias("hash"), name.alias("name"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"))
    ordered = layout.solid_order(rows).withColumn("one", F.lit(1).cast("long"))
    return layout.running_offsets(ordered, ["key"], "one").select("hash", (F.col("offset") + 1).alias("position"))


@query(
    f"""with recursive b as (select *, row_number() over (order by first) as n from {_BLOB}),
    w as (select n, hash, size, first, size as held, 1::bigint as part from b where n = 1 union all
      select b.n, b.hash, b.size, b.first, case when w.held <> 0 and w.held + b.size >= 100000 then b.size else w.held + b.size end, case when w.held <> 0 and w.held + b.size >= 100000 then w.part + 1 else w.part end from w join b on b.n = w.n + 1)
    select hash, size, first, part from w"""
)
def split_parts(spark, d):
    return layout.split_parts(_blobs(spark, d), ["first"], 100_000)


@query(f"select hash as resource, 100 // 512 as first_chunk, (least(size, 5000) - 1) // 512 as last_chunk, (least(((least(size, 5000) - 1) // 512 + 1) * 512, size) - (100 // 512) * 512)::bigint as decoded from {_BLOB} where size > 100")
def chunk_ranges(spark, d):
    r = _blobs(spark, d).select(F.col("hash").alias("resource"), "size", F.lit(512).alias("chunk_size"))
    return layout.chunks_for(r, F.lit(100), F.least(F.col("size"), F.lit(5000)))


@query(f"with o as (select hash, (sum(size) over (order by first rows unbounded preceding) - size)::bigint as pos from {_BLOB}) select hash, pos // 65536 as resource, pos % 65536 as \"inner\" from o")
def interval_assign(spark, d):
    at = layout.running_offsets(_blobs(spark, d), ["first"])
    spans = at.select(F.explode(F.sequence(F.floor(F.col("offset") / 65536), F.floor(F.col("offset") / 65536))).alias("resource")).distinct()
    spans = spans.select("resource", (F.col("resource") * 65536).alias("low"), ((F.col("resource") + 1) * 65536).alias("high"))
    return layout.assigned_resources(at.select("hash", "offset"), spans, 50_000)


@query("select owner, low, high, reach from (select l_suppkey as owner, l_partkey as low, l_partkey + l_quantity::bigint as high, max(l_partkey + l_quantity::bigint) over (partition by l_suppkey order by l_partkey, l_partkey + l_quantity::bigint rows between unbounded preceding and 1 preceding) as reach from lineitem) where low < reach")
def span_overlaps(spark, d):
    low = F.col("l_partkey")
    return layout.overlaps(src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), low.alias("low"), (low + F.col("l_quantity").cast("long")).alias("high")))


@query(f"select hash, size, count(*) as targets, sum(names - 1)::bigint as links, min(path) as first_path from (select image, inode, hash, size, min(path) as path, count(*) as names from ({_LINE}) group by 1, 2, 3, 4) group by 1, 2")
def extraction_targets(spark, d):
    return layout.targets_by_content(_lines(spark, d))


@query(f"select image, path, hash from ({_DOC}) where hash not in (select hash from ({_DOC}) where inode % 5 <> 0)")
def verify_missing(spark, d):
    docs = _docs(spark, d)
    return verify.missing_content(docs, docs.where(F.col("inode") % 5 != 0)).select("image", "path", "hash")


@query("select doc_id::varchar as hash, sha1(coalesce(text, '')) as actual from documents where doc_id % 9 = 0")
def verify_corrupt(spark, d):
    text = F.coalesce("text", F.lit(""))
    content = src.table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, F.col("doc_id").cast("string")).otherwise(fn.content_hash(text)).alias("hash"), F.encode(text, "UTF-8").alias("bytes"))
    return verify.corrupt_content(content)


_CHUNK = "select doc_id as file, i::int as idx, length(p)::bigint as length, sha1(p) as digest from (select doc_id, i, (encode(coalesce(text, '')))[208 + i * 512 + 1 : 208 + (i + 1) * 512] as p from (select doc_id, text, unnest(range(0, ((octet_length(encode(coalesce(text, ''))) - 208 + 511) // 512)::bigint)) as i from documents where octet_length(encode(coalesce(text, ''))) > 208))"


def _files(spark, d):
    return src.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))


@query(_CHUNK.replace("length(p)", "octet_length(p)"))
def integrity_chunks(spark, d):
    return verify.integrity_chunks(_files(spark, d), 512)


@query("select doc_id as file, case when octet_length(encode(coalesce(text, ''))) <= 208 or doc_id % 6 = 5 then 'nonexistent' when doc_id % 4 = 1 then 'mismatch' else 'ok' end as status, case when octet_length(encode(coalesce(text, ''))) > 208 and doc_id % 6 <> 5 and doc_id % 4 = 1 then 0 end::int as first_bad from documents")
def integrity_status(spark, d):
    f = _files(spark, d)
    stored = verify.integrity_chunks(f.where(F.col("file") % 6 != 5), 512)
    stored = stored.withColumn("digest", F.when((F.col("file") % 4 == 1) & (F.col("idx") == 0), "changed").otherwise(F.col("digest")))
    return verify.integrity_status(f, stored, 512)


@query(f"with s as (select doc_id as file, octet_length(encode(coalesce(text, '')))::bigint as size from documents), n as (select file, unnest(range(0, (size + 100 - 208 + 511) // 512)) as idx, size + 100 as size from s where size + 100 > 208), o as ({_CHUNK.replace('length(p)', 'octet_length(p)')}) select n.file, n.idx::int as idx, least(512, n.size - 208 - n.idx * 512)::bigint as length, case when o.length = least(512, n.size - 208 - n.idx * 512) then o.digest end as digest from n left join o on n.file = o.file and n.idx = o.idx")
def integrity_reuse(spark, d):
    f = _files(spark, d)
    return verify.reused_chunks(f.select("file", (F.octet_length("bytes").cast("long") + 100).alias("size")), verify.integrity_chunks(f, 512), 512)


@query("select path, reused, case when reused then 'old' else 'new' end as digest from (select '/' || doc_id as path, doc_id % 3 <> 0 and doc_id % 5 <> 0 and doc_id % 7 <> 0 as reused from documents)")
def template_reuse(spark, d):
    i = F.col("doc_id")

    def tree_of(tag, odd):
        stream = F.struct(F.lit("").alias("name"), (F.col("n_chars") + (F.when(i % 5 == 0, 1).otherwise(0) if odd else 0)).alias("size"), F.lit(tag).alias("hash"))
        return docs.select(
            F.concat(F.lit("/"), i.cast("string")).alias("path"), i.alias("created"), (i + (F.when(i % 3 == 0, 1).otherwise(0) if odd else 0)).alias("written"),
            (i - (F.when(i % 7 == 0, 1).otherwise(0) if odd else 0)).alias("accessed"), F.lit(False).alias("reparse"), F.array(stream).alias("streams"),
        )

    docs = src.table(spark, d, "documents")
    return verify.reused_digests(tree_of("new", True), tree_of("old", False)).select("path", "reused", F.col("streams")[0]["hash"].alias("digest"))


@query(
    """with n as (select c_custkey as node, c_custkey - 1 - c_nationkey as parent, upper(c_mktsegment) as folded, c_custkey % 2 = 0 as is_dir, c_custkey % 50 = 7 as encrypted, c_nationkey as file_id, c_custkey // 100 as content from customer)
    select 'sibling_names' as rule, max(node) as node from n group by parent, folded having count(*) > 1
    union all select 'parent', n.node from n left join n p on n.parent = p.node where not coalesce(n.parent < n.node and p.is_dir, false)
    union all select 'alias_streams', max(node) from n group by file_id having count(distinct {'a': content, 'b': encrypted}) > 1 union all select 'encrypted', node from n where encrypted"""
)
def manifest_faults(spark, d):
    key = F.col("c_custkey")
    nodes = src.table(spark, d, "customer").select(
        key.alias("node"), (key - 1 - F.col("c_nationkey")).alias("parent"), F.col("c_mktsegment").alias("name"), (key % 2 == 0).alias("is_dir"),
        (key % 50 == 7).alias("encrypted"), F.col("c_nationkey").alias("file_id"), F.floor(key / 100).alias("content"),
    )
    return verify.manifest_faults(nodes)


@query(f"select image, path from ({_DOC}) where not starts_with(path, '/de/')")
def delete_path(spark, d):
    return mutate.deleted(_docs(spark, d).select("image", "path"), "\\de\\", recursive=True)


@query(f"select image, case when starts_with(path, '/de/') then '/german' || substr(path, 4) else path end as path from ({_DOC})")
def rename_path(spark, d):
    return mutate.renamed(_docs(spark, d).select("image", "path", F.lit(False).alias("is_dir")), "/de", "/german").select("image", "path")


@query(f"select path, inode from (select case when starts_with(path, '/fr/') then '/x' || substr(path, 4) else path end as path, inode from ({_DOC}) where not starts_with(path, '/de/') union all select '/new' || path, inode from ({_DOC}) where path like '/es/%')")
def update_batch(spark, d):
    e = _docs(spark, d).select("path", F.lit(False).alias("is_dir"), "inode")
    return mutate.updated(e, [("delete", "/de", {"recursive": True}), ("rename", "/fr", "/x"), ("add", e.where("path like '/es/%'"), "/new")]).select("path", "inode")


@query("select s_suppkey, s_name || ' & <co>' as name, s_nationkey::bigint as nation, case when s_suppkey % 3 = 0 then 'x' || s_suppkey end as second from supplier")
def property_lookup(spark, d):
    part = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    text = lambda c: F.col(c).cast("string")
    places = F.concat(part("P", text("s_nationkey")), F.when(F.col("s_suppkey") % 3 == 0, part("P", F.concat(F.lit("x"), text("s_suppkey")))).otherwise(F.lit("")))
    xml = part("IMAGE", F.concat(part("NAME", fn.xml_escape(F.concat("s_name", F.lit(" & <co>")))), part("PLACES", places)))
    return src.table(spark, d, "supplier").select(
        "s_suppkey", fn.property_of(xml, "NAME").alias("name"), fn.number_of(fn.property_of(xml, "PLACES/P")).alias("nation"), fn.property_of(xml, "PLACES/P[2]").alias("second")
    )


@query("select o_orderkey, (epoch_us(o_orderdate) + 11644473600000000) * 10 as ticks, o_orderdate as at from orders")
def ticks_round_trip(spark, d):
    ticks = fn.ticks_of(F.col("o_orderdate").cast("timestamp"))
    return src.table(spark, d, "orders").select("o_orderkey", ticks.alias("ticks"), fn.timestamp_of(ticks).cast("timestamp_ntz").alias("at"))


@query("select o_orderkey, case when o_orderkey & 2 = 0 then 'NONE' when o_orderkey & 4 <> 0 then 'LZX' when o_orderkey & 8 <> 0 then 'XPRESS' when o_orderkey & 16 <> 0 then 'LZMS' end as codec from orders")
def codec_of_flags(spark, d):
    k = F.col("o_orderkey")
    bit = lambda n, to: F.when(k.bitwiseAND(n) != 0, F.lit(to)).otherwise(F.lit(0)).cast("long")
    flags = bit(2, fn.COMPRESSED) + bit(4, fn.LZX) + bit(8, fn.XPRESS_ALT) + bit(16, fn.LZMS)
    return src.table(spark, d, "orders").select("o_orderkey", fn.compression_of(flags).alias("codec"))


@query("select p_partkey, case when p_size = 1 then p_name || '.swm' else p_name || p_size || '.swm' end as file, p_name || '.swm' as name, 'swm' as ext from part")
def part_names(spark, d):
    name = F.concat("p_name", F.lit(".swm"))
    return src.table(spark, d, "part").select("p_partkey", fn.part_name(name, F.col("p_size")).alias("file"), name.alias("name"), fn.extension(name).alias("ext"))


@query(f"select hash, size, first as \"offset\", size // 2 as stored, 1::bigint as part, (first % 5)::bigint as refs, (first % 17)::bigint as flags from {_BLOB}")
def lookup_records(spark, d):
    b = _blobs(spark, d).select("hash", "size", F.col("first").alias("offset"), F.floor(F.col("size") / 2).alias("stored"), F.lit(1).alias("part"), (F.col("first") % 5).alias("refs"), (F.col("first") % 17).alias("flags"))
    tables = b.select(F.col("hash").alias("archive"), files.encoded_lookup(b).alias("content"))
    return files.lookup_rows(tables).select("hash", "size", "offset", "stored", "part", "refs", "flags")


@query("select conv_id as inode, turn as slot, case when conv_id % 3 = 0 then (case when role <> 'assistant' and turn = (select min(turn) from conversations y where y.conv_id = x.conv_id and y.role <> 'assistant') then 'encrypted' else 'unknown' end) when role = 'assistant' then 'data' else (case when row_number() over (partition by conv_id, role = 'assistant' order by turn) = 1 then (case when conv_id % 3 = 1 then 'reparse' else 'data' end) when row_number() over (partition by conv_id, role = 'assistant' order by turn) = 2 and conv_id % 3 = 1 then 'data' else 'unknown' end) end as kind from conversations x")
def stream_kinds(spark, d):
    s = src.conversation_streams(src.table(spark, d, "conversations"))
    k = F.col("inode") % 3
    s = s.select("inode", "slot", F.when(F.col("stream") == "assistant", "answer").otherwise("").alias("stream"), "hash", F.when(k == 0, 0x4000).when(k == 1, 0x400).otherwise(0x20).cast("long").alias("attributes"))
    return tree.preferred_stream_kinds(s).select("inode", "slot", "kind")


_NODE = "select o_orderstatus as image, '/' || o_orderpriority || '/' || o_orderkey || '/' || l_linenumber as path, o_orderkey * 10 + l_linenumber as node, l_partkey % 40 as group_id, sha1((l_quantity::bigint)::varchar) as hash, l_linenumber = 7 as is_dir from lineitem join orders on l_orderkey = o_orderkey"


@query(
    f"""with e as ({_NODE}), s as (select image, node, hash from e union all select image, node, sha1('named' || (node % 5)) from e where node % 2 = 0),
    c as (select *, case when group_id <> 0 and not is_dir then first_value(node) over (partition by image, group_id, hash, is_dir order by string_split(upper(path), '/')) else node end as own from e)
    select s.hash, count(*) as refs from c join s on c.image = s.image and c.own = s.node group by 1"""
)
def canonical_counts(spark, d):
    k = F.col("l_partkey")
    lines = src.table(spark, d, "lineitem").join(src.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = lines.select(
        F.col("o_orderstatus").alias("image"), F.concat_ws("/", F.lit(""), "o_orderpriority", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("node"), (k % 40).alias("group_id"), F.sha1(F.col("l_quantity").cast("long").cast("string").cast("binary")).alias("hash"), (F.col("l_linenumber") == 7).alias("is_dir"),
    )
    named = F.when(F.col("node") % 2 == 0, F.sha1(F.concat(F.lit("named"), (F.col("node") % 5).cast("string")).cast("binary")))
    return tree.canonical_counts(e, e.select("image", "node", F.explode(F.array("hash", named)).alias("hash")))


_RECORD = "select doc_id as row, case when doc_id % 17 = 5 then null else sha1(coalesce(text, '')) end as hash, case when doc_id % 20 in (0, 3) then 4294967296 when doc_id % 13 = 2 then 0 else octet_length(encode(coalesce(text, '')))::bigint end as size, case when doc_id % 20 < 6 then 16 when doc_id % 50 = 19 then 2 else 0 end::bigint as flags, 1 + (doc_id % 30 = 29)::bigint as part, (doc_id % 20 - 1) * 450 as \"offset\" from documents"


def _records(spark, d):
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    size = F.when((i % 20).isin(0, 3), lookup.MARKER).when(i % 13 == 2, 0).otherwise(fn.content_size(text)).cast("long")
    return src.table(spark, d, "documents").select(
        i.alias("row"), F.when(i % 17 != 5, fn.content_hash(text)).alias("hash"), size.alias("size"),
        F.when(i % 20 < 6, lookup.SOLID).when(i % 50 == 19, lookup.METADATA).otherwise(0).cast("long").alias("flags"), (1 + (i % 30 == 29).cast("long")).alias("part"), ((i % 20 - 1) * 450).alias("offset"),
    )


@query(f"select hash, row, size, flags from (select *, row_number() over (partition by hash order by row) as n from ({_RECORD}) where hash is not null and size > 0 and part = 1 and flags <> 2 and size <> 4294967296) where n = 1")
def lookup_contents(spark, d):
    return lookup.data_rows(_records(spark, d)).select("hash", "row", "size", "flags")


@query(f"select row, row_number() over (order by row) as image_id from ({_RECORD}) where flags = 2 order by row limit 9")
def lookup_images(spark, d):
    return lookup.metadata_rows(_records(spark, d), 9).select("row", "image_id")


@query(f"select row, size, case when \"offset\" < 1000 then row // 20 * 20 else row // 20 * 20 + 3 end as resource, \"offset\" % 1000 as \"inner\" from ({_RECORD}) where flags = 16 and size <> 4294967296")
def lookup_solid(spark, d):
    rows = _records(spark, d)
    sizes = rows.where(F.col("size") == lookup.MARKER).select("row", F.lit(1000).cast("long").alias("resource_size"))
    return lookup.solid_rows(rows, sizes).select("row", "size", "resource", "inner")


@query("select o_orderkey, o_orderkey % 7 = 3 as refused from orders where o_orderkey % 7 = 3 and o_orderkey % 3 > 0")
def lookup_faults(spark, d):
    i = F.col("o_orderkey")
    rows = src.table(spark, d, "orders").select("o_orderkey", F.lit(100).alias("size"), F.when(i % 7 == 3, 99).otherwise(100).alias("stored"), F.when(i % 3 == 0, lookup.COMPRESSED).otherwise(0).cast("long").alias("flags"))
    return lookup.faults(rows).select("o_orderkey", (F.col("stored") != F.col("size")).alias("refused"))


@query("select p_partkey, case when p_size = 1 then 'invalid_header' when p_size = 2 then 'unknown_version' when p_size = 3 then 'invalid_part_number' when p_size = 4 then 'not_an_archive' end as fault, case when p_size <> 4 then p_partkey % 30 end as image_count, case when p_size = 4 then '00' when p_partkey % 2 = 0 then '574C50574D000000' else '4D5357494D000000' end as magic from part")
def header_records(spark, d):
    i, n = F.col("p_partkey"), F.col("p_size")
    h = src.table(spark, d, "part").select(
        "p_partkey", "p_size", F.when(n == 1, 100).otherwise(files.HEADER).alias("header_size"), F.when(n == 2, 1).otherwise(files.VERSIONS[0]).alias("version"), F.lit(2).alias("flags"),
        F.lit(1 << 15).alias("chunk_size"), F.when(n == 3, 4).otherwise(2).alias("part_number"), F.lit(3).alias("total_parts"), (i % 30).alias("image_count"), F.md5(i.cast("string").cast("binary")).alias("guid"),
    )
    whole = files.encoded_header(h, i % 2 == 0)
    # A sequential archive begins with a header that is not complete and ends with one that is.
    content = F.when(n == 4, F.unhex(F.lit("00"))).when(i % 2 == 0, F.concat(F.substring(whole, 1, 8), F.unhex(F.lit("00" * 300)), whole)).otherwise(F.concat(whole, F.unhex(F.lit("00" * 50))))
    return files.header_rows(h.select(i.alias("path"), content.alias("content"))).select(F.col("path").alias("p_partkey"), "fault", "image_count", "magic")


@query("select 'n' || n_nationkey as id, r.step || '/' || 'NATION' || case when row_number() over (partition by n_regionkey order by n_nationkey) > 1 then '[' || row_number() over (partition by n_regionkey order by n_nationkey) || ']' else '' end as path, n_name as value from nation join (select r_regionkey, 'REGION' || case when r_regionkey > 0 then '[' || (r_regionkey + 1) || ']' else '' end as step from region) r on r_regionkey = n_regionkey")
def property_tree(spark, d):
    return properties.property_paths(_elements(spark, d)).where("tag = 'NATION'").select("id", "path", "value")


def _elements(spark, d):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r, n = src.table(spark, d, "region"), src.table(spark, d, "nation")
    root = spark.createDataFrame([("root", None, 0, "WIM", None)], "id string, parent string, ordinal int, tag string, value string")
    regions = r.select(key("r", "r_regionkey").alias("id"), F.lit("root").alias("parent"), F.col("r_regionkey").cast("int").alias("ordinal"), F.lit("REGION").alias("tag"), F.col("r_name").alias("value"))
    return root.unionByName(regions).unionByName(n.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"), F.col("n_nationkey").alias("ordinal"), F.lit("NATION").alias("tag"), F.col("n_name").alias("value")))


@query("select 'r' || n_regionkey as parent, row_number() over (partition by n_regionkey order by n_nationkey) as position, 'NATION' as tag, n_name as value from nation union all select 'root', r_regionkey + 1, 'REGION', r_name from region")
def child_elements(spark, d):
    return properties.children(_elements(spark, d))


@query("select c_nationkey::varchar as image, 'NAME' as path, c_name as value from customer where c_custkey % 2 = 0 and c_nationkey <> 3 union all select '3', 'NAME', 'new'")
def set_property(spark, d):
    held = src.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_nationkey").cast("string").alias("image"), F.lit("NAME").alias("path"), F.col("c_name").alias("value"))
    return mutate.with_property(held, "3", "NAME", "new")


@query("select r_regionkey + 1 as image_id, case when r_name = 'ASIA' then 'ORIENT' else r_name end as image from region")
def set_name(spark, d):
    regions = src.table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("image_id"), F.col("r_name").alias("image"))
    return properties.with_name(regions, regions.where("image = 'ASIA'").first()["image_id"], "ORIENT")


@query("select case when n_regionkey = 0 then n_name else '' end as image, 'd' || n_nationkey as description, sha1(n_name) as digest from nation")
def export_without_names(spark, d):
    n = src.table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("image"), F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("description"), F.sha1(F.col("n_name").cast("binary")).alias("digest"))
    return images.exported_images(n.where("n_regionkey = 0").drop("n_regionkey"), n.where("n_regionkey <> 0").drop("n_regionkey"), no_names=True, gift=True)[0]


@query("select o_orderkey, 'changed' as kind from orders where o_orderkey % 5 = 4 or o_orderkey % 3 = 2")
def diff_within(spark, d):
    i = F.col("o_orderkey")
    a = src.table(spark, d, "orders").select("o_orderkey", F.lit(0x20).cast("long").alias("attributes"), i.alias("written"))
    b = a.select("o_orderkey", F.when(i % 3 == 2, 0x24).when(i % 3 == 1, 0xA0).otherwise(0x20).cast("long").alias("attributes"), (i + i % 5).alias("written"))
    return images.difference(a, b, ["o_orderkey"], ["attributes", "written"], {"written": 3}, ignored_bits=0x80)


@query("select c_nationkey as image, c_custkey % 70 as sd_id, c_custkey, case when c_custkey % 70 < 50 then 'sd' || (c_custkey % 70) end as descriptor from customer")
def entry_descriptors(spark, d):
    c = src.table(spark, d, "customer")
    e = c.select(F.col("c_nationkey").alias("image"), (F.col("c_custkey") % 70).alias("sd_id"), "c_custkey")
    held = e.where("sd_id < 50").select("image", "sd_id", F.concat(F.lit("sd"), F.col("sd_id").cast("string")).alias("bytes")).distinct()
    return tree.with_descriptors(e, held)


@query("select o_orderkey, case when o_orderkey % 4 > 0 then repeat('x', (o_orderkey % 9)::int + 4) end as data from orders")
def tagged_items(spark, d):
    i = F.col("o_orderkey")
    item = lambda tag, data: F.struct(F.lit(tag).alias("tag"), data.alias("data"))
    items = F.array(item(1, F.lit("abcdefgh")), item(2, F.lit("abc")), item(2, F.when(i % 4 > 0, F.repeat(F.lit("x"), (i % 9).cast("int") + 4)).otherwise("x")), item(2, F.when(i % 4 > 0, F.lit("last one")).otherwise("y")))
    return src.table(spark, d, "orders").select("o_orderkey", fn.tagged_item(items, 2, 4)["data"].alias("data"))


@query(f"select path, '/EN' as prefix from (select distinct path from ({_DOC})) where path like '/en/%'")
def ambiguous_levels(spark, d):
    docs = _docs(spark, d).select("path")
    levels = docs.unionByName(images.folders(_docs(spark, d)).select("path")).unionByName(spark.createDataFrame([("/EN",)], "path string"))
    return select.ambiguous_on_the_way(docs.distinct(), levels)


@query("select c_custkey, c_mktsegment as name from customer where c_custkey % 5 > 1 qualify row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) = 1")
def visible_names(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.lit("..")).when(k % 5 == 1, F.lit("a\0b")).otherwise(F.col("c_mktsegment"))
    return tree.visible(src.table(spark, d, "customer").select("c_custkey", F.lit("1").alias("image"), F.col("c_nationkey").alias("parent"), name.alias("name"), k.alias("ordinal"))).select("c_custkey", "name")


@query(f"select image, path, row_number() over (order by string_split(upper(path[2:]), '/'), string_split(path[2:], '/')) as position from ({_DOC})")
def preorder_positions(spark, d):
    walked = tree.preorder(_docs(spark, d).select("image", "path")).withColumn("one", F.lit(1).cast("long"))
    return layout.running_offsets(walked, ["walk"], "one").select("image", "path", (F.col("offset") + 1).alias("position"))


@query("select p_partkey, regexp_replace(hex(encode(upper(p_name))), '(..)', '00\\1', 'g') as folded, regexp_replace(hex(encode(p_name)), '(..)', '00\\1', 'g') as exact from part")
def collation_keys(spark, d):
    key = fn.collation_key(F.col("p_name"))
    return src.table(spark, d, "part").select("p_partkey", key["folded"].alias("folded"), key["exact"].alias("exact"))


@query("select p_partkey, (p_partkey + 7) // 8 * 8 as aligned, p_size in (4, 8, 16, 32) as chunk_fits, '/' || p_partkey || '/x' as path, replace(replace(p_name, 'a', '&amp;'), 'e', '&lt;') as escaped, replace(replace(p_name, 'a', '&'), 'e', '<') as again, least(p_partkey + (p_partkey * 3) // 100, p_partkey * 3) as report from part")
def column_functions(spark, d):
    i, size = F.col("p_partkey"), F.col("p_size")
    odd = F.replace(F.replace(F.col("p_name"), F.lit("a"), F.lit("&")), F.lit("e"), F.lit("<"))
    return src.table(spark, d, "part").select(
        "p_partkey", fn.aligned(i).alias("aligned"), fn.valid_chunk(F.lit("XPRESS"), size * 1024).alias("chunk_fits"), fn.canonical_path(F.concat(i.cast("string"), F.lit("\\\\x//"))).alias("path"),
        fn.xml_escape(odd).alias("escaped"), fn.xml_unescape(fn.xml_escape(odd)).alias("again"), fn.next_report(i, i * 3).alias("report"),
    )


@query("select c_custkey, case c_custkey % 4 when 0 then c_name when 1 then c_name when 2 then c_name end as path from customer")
def listed_paths(spark, d):
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    line = F.when(k == 0, F.concat(F.lit("  "), name, F.lit("\t"))).when(k == 1, F.concat(F.lit(' "'), name, F.lit('" '))).when(k == 2, F.concat(F.lit("'"), name, F.lit("'"))).otherwise(F.concat(F.lit("; "), name))
    return src.table(spark, d, "customer").select("c_custkey", files.listed_path(line).alias("path"))


@query("select doc_id, coalesce(text, '') as text from documents")
def decoded_texts(spark, d):
    k, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    marked = lambda mark, coding: F.concat(F.unhex(F.lit(mark)), F.encode(text, coding))
    content = F.when(k == 0, marked("FFFE", "UTF-16LE")).when(k == 1, marked("FEFF", "UTF-16BE")).when(k == 2, marked("EFBBBF", "UTF-8")).otherwise(F.encode(text, "UTF-8"))
    return src.table(spark, d, "documents").select("doc_id", files.decoded_text(content).alias("text"))


@query(f"select path, hash, size, case when inode % 4 <> 1 then hash end as hash_now, case when inode % 4 <> 1 then size + 1 end as size_now from ({_DOC}) where inode % 4 < 2")
def concurrent_changes(spark, d):
    docs, i = _docs(spark, d), F.col("inode")
    now = docs.where(i % 4 != 1).select("path", "hash", (F.col("size") + F.when(i % 4 == 0, 1).otherwise(0)).alias("size"))
    return verify.concurrent_changes(docs, now)


@query(f"select hash, part, \"offset\", (sum(size) over (order by part, \"offset\" rows unbounded preceding) - size)::bigint as written from (select hash, size, first % 3 as part, first * 7 % 1009 * 1000 + first as \"offset\" from {_BLOB})")
def physical_order(spark, d):
    b = _blobs(spark, d).select("hash", "size", (F.col("first") % 3).alias("part"), (F.col("first") * 7 % 1009 * 1000 + F.col("first")).alias("place"))
    return layout.running_offsets(b, ["part", "place"]).select("hash", "part", F.col("place").alias("offset"), F.col("offset").alias("written"))
