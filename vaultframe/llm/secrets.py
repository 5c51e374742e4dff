"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong parts (an assignment, an access identifier, a long hexadecimal run) are reported by themselves.
Weak parts (a client name, an opaque token, a service endpoint) are reported only where complementary
parts lie within the same scope: the same document, at most `scope` code points away.

Each text is scanned once. Its parts leave the scan as (kind, gap, length) rows, their offsets are running
sums over those rows, and the interval join of parts is a pair of sorted sweeps (nearest part before, nearest
part after), so its cost grows with the number of parts and not with the number of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.llm.common import named, numbered, row_key, text_of

#: Fixed patterns: (kind, pattern, group that is tested, least length of that group).
STRONG = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("client", r"""(?i:client_?id|user_?name|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 1, 3),
    ("opaque", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
    ("endpoint", r"(?:https?|ftp|ssh|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._@:-]+", 0, 9),
)
KINDS = STRONG + WEAK
#: Most code points between two parts of one credential.
SCOPE = 300


def _parts(text: Column, number: int) -> Column:
    """Array of (kind, i, gap, length, ok): what lies before each match, the match, and whether it holds."""
    kind, pattern, group, least = KINDS[number]
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    # Zipped first, so that each array is made once per text; the piece after the last match has no match.
    zipped = F.filter(F.arrays_zip(between.alias("gap"), whole.alias("match"), tested.alias("value")), lambda z: z["match"].isNotNull())

    def part(z: Column, i: Column) -> Column:
        value = z["value"]
        ok = F.length(value) >= least
        if kind == "opaque":
            ok = ok & value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
        return F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["match"]).alias("size"), ok.alias("ok")
        )

    empty = F.expr("array()").cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>")
    return F.when(text.rlike(pattern), F.transform(zipped, part)).otherwise(empty)


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, __h (hash of the text) and spans, sorted by start and then kind.

    A span is (start, rank, end, kind, weak, clear), in code points, end exclusive; clear is the greatest end of
    the spans before it, 0 for the first. Null texts count as empty,
    repeated rows each get their row, rows with one doc_id and other texts are other documents, and other
    columns of docs are ignored.
    """
    key = ["doc_id", "__h"]
    text = text_of()
    found = row_key(docs.select("doc_id", "text")).select(
        *key, F.concat(*[_parts(text, n) for n in range(len(KINDS))]).alias("parts")
    )
    # Equal rows meet here before anything is exploded; parts are a small part of the text.
    once = found.groupBy(*key).agg(F.first("parts").alias("parts"), F.count("*").alias("copies"))
    rows = once.select(*key, "copies", F.explode_outer("parts").alias("p")).select(*key, "copies", "p.*")
    by_kind = Window.partitionBy(*key, "kind").orderBy("i")
    rows = (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(by_kind))
        .withColumn("start", F.col("end") - F.col("size"))
        .select(*key, "copies", "kind", "start", "end", F.coalesce("ok", F.lit(False)).alias("ok"))
    )
    rows = _linked(rows, key, scope)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    span = F.struct(
        "start", F.col("kind").alias("rank"), "end", F.get(names, F.col("kind")).alias("kind"), (F.col("kind") >= len(STRONG)).alias("weak"), "clear"
    )
    spans = rows.groupBy(*key, "copies").agg(F.sort_array(F.collect_list(F.when(F.col("keep"), span))).alias("spans"))
    return spans.select(*key, "spans", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")


def _linked(rows: DataFrame, key: list[str], scope: int) -> DataFrame:
    """Adds keep: strong parts that hold, and weak ones beside complementary parts."""
    number = {k[0]: i for i, k in enumerate(KINDS)}
    up = Window.partitionBy(*key).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def near(which: Column, most: int) -> Column:
        before = F.col("start") - F.max(F.when(which, F.col("end"))).over(up)
        after = F.min(F.when(which, F.col("start"))).over(down) - F.col("end")
        return F.coalesce(before <= most, F.lit(False)) | F.coalesce(after <= most, F.lit(False))

    strong = F.col("ok") & (F.col("kind") < len(STRONG))
    client, opaque, endpoint = (F.col("kind") == number[k] for k in ("client", "opaque", "endpoint"))
    # Distance below 0 is overlap: a weak part inside a stronger one is not a part of its own.
    rows = rows.withColumn("in_strong", near(strong, -1)).withColumn("in_client", near(F.col("ok") & client, -1))
    rows = rows.withColumn(
        "ok", F.col("ok") & (strong | endpoint | (client & ~F.col("in_strong")) | (opaque & ~F.col("in_strong") & ~F.col("in_client")))
    )
    name = F.col("ok") & (client | (F.col("kind") == number["access"]))
    secret = F.col("ok") & (opaque | F.col("kind").isin(number["assign"], number["hex"]))
    rows = rows.withColumn("by_name", near(name, scope)).withColumn("by_secret", near(secret, scope))
    linked = (
        (opaque & F.col("by_name")) | (client & F.col("by_secret")) | (endpoint & F.col("by_name") & F.col("by_secret"))
    )
    rows = rows.withColumn("keep", F.col("ok") & (strong | linked))
    return rows.withColumn("clear", F.coalesce(F.max(F.when(F.col("keep"), F.col("end"))).over(up), F.lit(0)).cast("long"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Every document: counts of strong parts, the digest of their spans, and all spans with the linked ones."""
    spans = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: ~s["weak"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id", *[count(k[0]).alias(f"n_{k[0]}") for k in STRONG],
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with each reported span replaced by <SECRET:kind>; overlapping spans are merged, n_chars follows the text.

    Rows keep their other columns; a null text stays null.
    """
    plain, doc_id, text = numbered(docs)
    keyed = row_key(plain, text)
    spans = scan_secrets(docs, scope).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k"), "spans")
    spans = spans.groupBy("__id", "__k").agg(F.first("spans").alias("__spans"))
    joined = keyed.join(spans, keyed[doc_id].eqNullSafe(spans["__id"]) & (keyed["__h"] == spans["__k"]), "left")
    pieces = F.transform(
        "__spans",
        lambda c: F.when(
            c["start"] >= c["clear"],
            F.concat(
                F.col(text).substr((c["clear"] + 1).cast("int"), (c["start"] - c["clear"]).cast("int")), F.lit("<SECRET:"), c["kind"], F.lit(">")
            ),
        ).otherwise(F.lit("")),
    )
    last = F.array_max(F.transform("__spans", lambda c: c["end"])).cast("int")
    clean = F.concat(F.array_join(pieces, ""), F.col(text).substr(last + 1, F.length(text)))
    found = F.col("__spans").isNotNull()
    out = joined.withColumn("__clean", F.when(found, clean))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n, F.when(found, F.length("__clean").cast("long")).otherwise(F.col(n)))
    return named(out.withColumn(text, F.coalesce("__clean", text)), docs)


def _sql() -> str:
    parts = []
    for n, (kind, pattern, group, least) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        ok = f"length(value) >= {least}"
        if kind == "opaque":
            ok += " and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]')"
        parts.append(
            f"""select r, {n} as kind, i, length(gap) + length(match) as step, length(match) as size, {ok} as ok from (
              select r, unnest(range(1, len(m) + 1)) as i, unnest(list_slice(g, 1, len(m))) as gap, unnest(m) as match, unnest(v) as value from (
                select r, string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {group}) as v from d))"""
        )
    names = "[" + ",".join(f"'{k[0]}'" for k in KINDS) + "]"
    near = lambda which, most: f"exists(select 1 from {{t}} y where y.r = x.r and (y.s, y.kind) <> (x.s, x.kind) and {which} and y.s - x.e <= {most} and x.s - y.e <= {most})"
    return f"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    raw as ({' union all '.join(parts)}),
    placed as (select r, kind, ok, sum(step) over (partition by r, kind order by i) as e, size from raw),
    p as (select r, kind, e - size as s, e from placed where ok),
    q as (select * from p x where kind in (0, 1, 2, 5)
      or (kind = 3 and not {near('y.kind < 3', -1).format(t='p')})
      or (kind = 4 and not {near('y.kind <= 3', -1).format(t='p')})),
    z as (select x.*, kind < 3 or (kind = 4 and {near('y.kind in (1, 3)', SCOPE).format(t='q')})
      or (kind = 3 and {near('y.kind in (0, 2, 4)', SCOPE).format(t='q')})
      or (kind = 5 and {near('y.kind in (1, 3)', SCOPE).format(t='q')} and {near('y.kind in (0, 2, 4)', SCOPE).format(t='q')}) as keep from q x),
    g as (select r, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
      string_agg({names}[kind + 1] || ':' || s::bigint || ':' || e::bigint, ',' order by s, kind) filter (kind < 3) as base,
      string_agg({names}[kind + 1] || ':' || s::bigint || ':' || e::bigint, ',' order by s, kind) as spans
      from z where keep group by r)
    select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (r)"""


SQL = {"op1_secret_scans": _sql()}
QUERIES = {"op1_secret_scans": op1_secret_scans}
