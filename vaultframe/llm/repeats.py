"""What finding repeated passages has in common, whether of words or of bytes.

A passage is a window of `size` units of one document. In each window the gram (a shorter run of units) of least hash
is its anchor, so equal windows have equal anchors at equal places, and only one gram in many is an anchor. Grams that
are anchors once cannot lie in a repeated window; they are counted with map-side sums and never leave the scan with
their text. Occurrences of the others leave it with the units around them and are grouped by gram, the first prefix,
into groups that fit in a task's memory; an operator compares a group by its own method.

A gram with more occurrences than a group holds is grown: each window around it becomes a suffix of its own, equal
ones of a text in one row, and is dealt by ever longer prefixes (Kind.steps). A prefix that occurs once leaves, one that fits goes to a group, and one
that is frequent even as a whole window is a node without a tree below, whose least leaf is found with map-side minima.

Units of a group are compared as they are, words as hashes of 64 bits; whole windows that no group holds are named by
128 bits. Equal texts are one text throughout: only the first row of each is searched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import arrays as A
from vaultframe.llm.common import settle, small, text_of

LAST_ID = (1 << 63) - 1
#: Bytes around the occurrences in a group of grams; a gram with more of them is grown.
GROUP_BYTES = 16_000_000
#: Bytes of text that are searched for anchors at once, so that the arrays made of them stay in a core's cache.
SCANNED = 1 << 18
#: End of a span that stands for a whole text.
WHOLE = 1 << 40


@dataclass(frozen=True)
class Kind:
    """size and gram in units; words: units are words (else bytes); marks: which of equal windows are reported."""

    size: int
    gram: int
    words: bool
    marks: str  # "later": all but the first; "all"; "across": all, if several documents have them
    group: int = 0  # occurrences in a group; 0: as GROUP_BYTES allows

    def __post_init__(self):
        if not 0 < self.gram <= self.size < 1 << 15:
            raise ValueError("a gram is at most a window, and a window less than 32768 units")
        if self.marks not in ("later", "all", "across"):
            raise ValueError(self.marks)
        if not self.group:
            object.__setattr__(self, "group", GROUP_BYTES // (self.item * (2 * self.size - self.gram)))

    @property
    def item(self) -> int:
        return 8 if self.words else 1

    @property
    def steps(self) -> list[int]:
        """Lengths of the prefixes of a window by which frequent grams are grown; the whole window comes after them."""
        return sorted({self.gram + (self.size - self.gram) * k // 3 for k in (1, 2)} - {self.gram, self.size})

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a batch's units, and the n + 1 offsets of its rows in them."""
        if not self.words:
            return data, offsets
        start, end, row = A.word_spans(data, offsets)
        code = A.Rolling(data).of(start, end)
        return code, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))]).astype(np.int64)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, from running minima of blocks."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    rest = -len(x) % w
    block = np.concatenate([x, np.full(rest, x.max(), x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(code: np.ndarray, offsets: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """gram, row, place of the anchor, first and last start of its windows (places within the row)."""
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    windows = np.maximum(0, np.diff(offsets) - kind.size + 1)
    held = np.flatnonzero(windows)
    if not len(held):
        return none
    gram = A.Rolling(code).runs(kind.gram)
    key = gram & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(gram), dtype=np.uint64)
    least = sliding_least(key, kind.size - kind.gram + 1)
    # Windows of one anchor follow each other: cut where it changes and where the windows of a row begin and end.
    begin, stop = offsets[:-1][held], (offsets[:-1] + windows)[held]
    cuts = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begin, stop]))
    first, last = cuts[:-1], cuts[1:] - 1
    own = np.searchsorted(begin, first, "right") - 1
    inside = (own >= 0) & (first < stop[own])
    first, last, own = first[inside], last[inside], own[inside]
    place, row = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), held[own]
    base = offsets[row]
    return gram[place], row, place - base, first - base, last - base


def _scan(texts: DataFrame, kind: Kind) -> DataFrame:
    """d, h, g and p of every text with windows: the grams of its anchors and, as one number each (32, 16 and 15 bits),
    their places and how far before them their windows begin at most and at least.

    A text's anchors are one row of two plain lists, since they are many.
    """

    def per_batch(batches):
        for batch in batches:
            data, offsets = A.column_bytes(batch.column("text"))
            d, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "h"))
            for a, b in A.slices(offsets, SCANNED):
                g, row, place, s1, s2 = anchors(*kind.units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), kind)
                p = place << 31 | (place - s1) << 15 | (place - s2)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                own, ends = row[first], np.append(first, len(row)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (A.signed(g), p)]
                yield pa.record_batch([pa.array(d[a:b][own]), pa.array(h[a:b][own]), *lists], ["d", "h", "g", "p"])

    return texts.mapInArrow(A.tidy(per_batch), "d bigint, h bigint, g array<bigint>, p array<bigint>")


def _of_hits(found: DataFrame, kind: Kind, rows_of: Callable, schema: str) -> DataFrame:
    """rows_of(codes, first code of each hit's text, g, d, h, place, s1, s2) over texts with a list of hits (g, p)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def per_batch(batches):
        for batch in batches:
            data, offsets = A.column_bytes(batch.column("text"))
            d, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "h"))
            ends, flat = batch.column("hits").offsets.to_numpy(), batch.column("hits").values
            for a, b in A.slices(offsets):
                code, at = kind.units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                own = flat.slice(ends[a], ends[b] - ends[a])
                g, p = (own.field(c).to_numpy(zero_copy_only=False) for c in ("g", "p"))
                row, place = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), p >> 31
                for n in range(0, len(row), 20_000):
                    k = slice(n, n + 20_000)
                    hit = g[k], d[a:b][row[k]], h[a:b][row[k]], place[k], (place - (p >> 15 & 0xFFFF))[k], (place - (p & 0x7FFF))[k]
                    yield pa.record_batch(rows_of(code, at[row[k]], *hit), names)

    return found.mapInArrow(A.tidy(per_batch), schema)


def _surroundings(found: DataFrame, kind: Kind) -> DataFrame:
    """Of texts with their hits: a row per hit with the units around it, to the right from its place, to the left backwards."""
    right, left = kind.size, kind.size - kind.gram

    def rows_of(code, begin, g, d, h, place, s1, s2):
        padded = np.concatenate([np.zeros(left, code.dtype), code, np.zeros(right, code.dtype)])
        around = np.empty((len(g), right + left), code.dtype)
        around[:, :right] = sliding_window_view(padded, right)[left + begin + place]
        around[:, right:] = sliding_window_view(padded, left)[begin + place][:, ::-1] if left else 0
        # Units beyond the windows of a hit are left out: as zeros they cost little.
        around[:, :right][np.arange(right) >= (s2 + kind.size - place)[:, None]] = 0
        around[:, right:][np.arange(left) >= (place - s1)[:, None]] = 0
        ends = (np.arange(len(g) + 1) * around.shape[1] * around.itemsize).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(ends), pa.py_buffer(around)])
        return [pa.array(g), pa.array(d), pa.array(h), *[pa.array(x.astype(np.int32)) for x in (place, s1, s2)], packed]

    return _of_hits(found, kind, rows_of, "g bigint, d bigint, h bigint, place int, s1 int, s2 int, around binary")


def _windows(found: DataFrame, kind: Kind) -> DataFrame:
    """Of texts with their hits: a row per text and distinct window around them.

    It has the starts, the spans that the windows cover, all of them (spans) and all but the first (rest), and ids:
    hashes of the window's growing prefixes and two of the whole.
    """

    def rows_of(code, begin, g, d, h, place, s1, s2):
        many = s2 - s1 + 1
        which = np.repeat(np.arange(len(g)), many)
        start = s1[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        at = begin[which] + start
        one, two = A.Rolling(code), A.Rolling(A.mix(code.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
        ids = np.stack([*[one.of(at, at + n) for n in (*kind.steps, kind.size)], two.of(at, at + kind.size)], axis=1)
        order = np.lexsort((start, ids[:, -1], ids[:, -2], begin[which]))
        which, start, ids = which[order], start[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (ids[1:, -2:] != ids[:-1, -2:]).any(axis=1) | (begin[which][1:] != begin[which][:-1])
        first = np.flatnonzero(new)
        ends = np.append(first, len(order)).astype(np.int32)

        def covered(take: np.ndarray) -> pa.Array:
            """Joined spans of the windows that `take` marks, as a list for each row."""
            s, row = start[take], (np.cumsum(new) - 1)[take]
            apart = np.ones(len(s), bool)
            apart[1:] = (s[1:] > s[:-1] + kind.size) | (row[1:] != row[:-1])
            k = np.flatnonzero(apart)
            last = np.append(k[1:], len(s)) - 1
            lists = np.concatenate([[0], np.cumsum(np.bincount(row[k], minlength=len(first)))]).astype(np.int32)
            span = pa.StructArray.from_arrays([pa.array(s[k]), pa.array(s[last] + kind.size if len(s) else s)], ["start", "end"])
            return pa.ListArray.from_arrays(pa.array(lists), span)

        keys = pa.FixedSizeListArray.from_arrays(pa.array(A.signed(np.ascontiguousarray(ids[first]).ravel())), ids.shape[1]).cast(pa.list_(pa.int64()))
        starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(start))
        return [pa.array(d[which[first]]), pa.array(h[which[first]]), starts, covered(np.ones(len(order), bool)), covered(~new), keys]

    span = "array<struct<start:bigint,end:bigint>>"
    return _of_hits(found, kind, rows_of, f"d bigint, h bigint, starts array<bigint>, spans {span}, rest {span}, ids array<bigint>")


def _grown(windows: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """(hits, spans): of windows of frequent grams, those whose prefix fits in a group, and what repeats beyond that."""
    hits, left, several = [], windows, F.sum(F.size("starts")).alias("n")
    for k in range(len(kind.steps)):
        left = left.withColumn("g", F.get("ids", F.lit(k)))
        left = settle(left.join(small(settle(left.groupBy("g").agg(several).where("n > 1"))), "g"))
        fit = left.where(F.col("n") <= kind.group).select("g", "d", "h", F.explode("starts").alias("start"))
        hits.append(fit.select("g", "d", "h", F.shiftleft("start", 31).alias("p")))
        left = left.where(F.col("n") > kind.group).drop("g", "n")
    left = left.withColumns({"w1": F.get("ids", F.lit(len(kind.steps))), "w2": F.get("ids", F.lit(len(kind.steps) + 1)), "doc": F.struct("d", "h")})
    left = left.withColumn("place", F.struct("d", "h", F.get("starts", F.lit(0))))
    # Settled, so that occurrences of a frequent window are not dealt by it: few windows are sent, many are a join that Spark can split.
    nodes = left.groupBy("w1", "w2").agg(F.min("place").alias("least"), several, (F.min("doc") != F.max("doc")).alias("several")).where("n > 1")
    again = left.join(small(settle(nodes)), ["w1", "w2"])
    own = F.col("spans")
    if kind.marks == "later":
        own = F.when(F.col("place") == F.col("least"), F.col("rest")).otherwise(own)
    elif kind.marks == "across":
        again = again.where("several")
    spans = again.select("d", "h", F.explode(own).alias("s")).select("d", "h", "s.start", "s.end")
    none = windows.select(F.lit(0).cast("long").alias("g"), "d", "h", F.lit(0).cast("long").alias("p")).where("false")
    return reduce(DataFrame.unionByName, hits, none), spans


class Subtrees:
    """Suffix trees of groups of suffixes, in array form: the leaves in order and the depth that neighbours share.

    An internal node is a run of leaves whose neighbours share at least its depth; cut at a depth, the trees fall into
    the nodes that are at least so deep.
    """

    def __init__(self, order: np.ndarray, suffixes: np.ndarray, group: np.ndarray):
        self.order, x = order, suffixes[order]
        self.shared = np.full(len(x), -1, np.int64)  # -1: another tree begins
        if len(x) > 1:
            other = x[1:] != x[:-1]
            self.shared[1:] = np.where(other.any(axis=1), other.argmax(axis=1), x.shape[1])
            self.shared[1:][group[order][1:] != group[order][:-1]] = -1

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix, the number of the node of at least that depth in which it lies; leaves alone are nodes too."""
        node = np.empty(len(self.order), np.int64)
        node[self.order] = np.cumsum(self.shared < depth)
        return node


def _compared(table: pa.Table, kind: Kind, sort: Callable) -> pa.Table:
    """d, h, start and end of what a group's occurrences have in repeated windows.

    A window that begins o units before a hit is equal to another one if both hits lie in one node of depth size - o to
    the right and in one of depth o to the left.
    """
    col = lambda c: table.column(c).to_numpy()
    g, d, h, place = col("g"), col("d"), col("h"), col("place").astype(np.int64)
    far, near = place - col("s1"), place - col("s2")
    raw = table.column("around").combine_chunks()
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    code = np.frombuffer(raw.buffers()[2], np.uint64 if kind.words else np.uint8).reshape(-1, 2 * kind.size - kind.gram)
    begin = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset] // (code.shape[1] * kind.item)
    code = code[begin : begin + len(g)]
    right, left = (Subtrees(sort(x, g), x, g) for x in (code[:, : kind.size], code[:, kind.size :]))
    doc = np.unique(np.stack([d, h], axis=1), axis=0, return_inverse=True)[1].ravel().astype(np.int64)
    rank = (doc << 32) | place
    low, high = np.full(len(g), 1 << 40), np.full(len(g), -1)
    for o in range(int(near.min()), int(far.max()) + 1):
        held = np.flatnonzero((near <= o) & (o <= far))
        if len(held) < 2:
            continue
        both = right.nodes(kind.size - o)[held] << 32 | left.nodes(o)[held]
        order = np.lexsort((rank[held], both)) if kind.marks != "all" else np.argsort(both, kind="stable")
        held, both = held[order], both[order]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        if kind.marks == "later":
            marked = rank[held] != rank[held[first]][run]
        elif kind.marks == "across":
            marked = (doc[held[first]] != doc[held[np.append(first[1:], len(held)) - 1]])[run]
        else:
            marked = ~(new & np.append(new[1:], True))
        hit = held[marked]
        low[hit], high[hit] = np.minimum(low[hit], o), np.maximum(high[hit], o)
    hit = np.flatnonzero(high >= 0)
    return pa.table({"d": d[hit], "h": h[hit], "start": (place - high)[hit], "end": (place - low)[hit] + kind.size})


def keyed(docs: DataFrame) -> DataFrame:
    """d (doc_id, null last), h and h2 (hashes of the text) of each row, before its columns."""
    text = text_of()
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.select(d.alias("d"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2"), "*")


def same(a: DataFrame, b: DataFrame):
    return (a["d"] == b["kd"]) & (a["h"] == b["kh"])


@dataclass(frozen=True)
class Texts:
    """rows: keyed(docs); copies: rows (d, h) whose text another row has, and whether that is an earlier one."""

    rows: DataFrame
    copies: DataFrame

    @classmethod
    def of(cls, docs: DataFrame) -> Texts:
        rows = keyed(docs.select("doc_id", "text"))
        classes = settle(rows.groupBy("h", "h2").agg(F.min("d").alias("least"), F.count("*").alias("copies")).where("copies > 1"))
        own = rows.select("d", "h", "h2").join(small(classes), ["h", "h2"])
        return cls(rows, settle(own.select("d", "h", (F.col("d") > F.col("least")).alias("later")).distinct()))


def repeated_spans(texts_: Texts, kind: Kind, sort: Callable) -> DataFrame:
    """d, h and spans, a list of (start, end) in units, of documents with repeated windows.

    A span may run past the end of a document that is a copy of another one as a whole.
    """
    rows, copies = texts_.rows, texts_.copies
    away = small(copies.where("later").select(F.col("d").alias("kd"), F.col("h").alias("kh")))
    texts = rows.select("d", "h", text_of().alias("text"))
    texts = texts.join(away, same(texts, away), "left_anti")

    places = settle(_scan(texts, kind))  # read twice, and a scan is dear
    several = settle(places.select(F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    number, frequent = several.agg(F.coalesce(F.sum(F.when(F.col("n") <= kind.group, F.col("n"))), F.lit(0)), F.coalesce(F.max("n") > kind.group, F.lit(False))).first()
    hits = places.select("d", "h", F.inline(F.arrays_zip("g", "p"))).join(several, "g")
    hits = settle(hits.select("g", "d", "h", "p", (F.col("n") > kind.group).alias("frequent")))
    del places, several

    def looked_up(part: DataFrame) -> DataFrame:
        """The texts of some hits, with these; only texts that have any are shuffled."""
        wanted = small(settle(part.select(F.col("d").alias("kd"), F.col("h").alias("kh")).distinct()))
        near = texts.join(wanted, same(texts, wanted), "left_semi")
        own = part.groupBy("d", "h").agg(F.collect_list(F.struct("g", "p")).alias("hits"))
        return near.join(own, ["d", "h"]).select("d", "h", "text", "hits")

    spans = None
    if frequent:
        grown, spans = _grown(settle(_windows(looked_up(hits.where("frequent")), kind)), kind)
        grown = settle(grown)
        number += grown.count()
        hits = hits.where("not frequent").drop("frequent").unionByName(grown)
    parts = max(1, ceil(number / kind.group))
    grouped = _surroundings(looked_up(hits), kind).withColumn("part", F.pmod(F.xxhash64("g", F.lit(3)), F.lit(parts)))
    found = grouped.repartition(parts, "part").groupBy("part").applyInArrow(
        lambda table: _compared(table, kind, sort), "d bigint, h bigint, start bigint, end bigint"
    )
    whole = copies.where("later") if kind.marks == "later" else copies
    found = found.unionByName(whole.select("d", "h", F.lit(0).cast("long").alias("start"), F.lit(WHOLE).alias("end")))
    found = found if spans is None else found.unionByName(spans)
    del hits
    return settle(found.groupBy("d", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def joined_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of touching or overlapping spans."""
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > top[:-1]]))
    return start[new], top[np.append(new[1:], len(top)) - 1]


def with_spans(texts_: Texts, marks: DataFrame, cut: Callable, doc_id: str, schema: str, types: list[pa.DataType]) -> DataFrame:
    """A row per row of docs: doc_id (of that type) and what cut(text bytes, *spans) gives, the spans (starts, ends) of each further column of marks."""
    lists = [c for c in marks.columns if c not in ("d", "h")]
    names = [f.split()[0] for f in schema.split(", ")]
    none = F.expr("array()").cast("array<struct<start:bigint,end:bigint>>")
    texts = texts_.rows.select("doc_id", "d", "h", text_of().alias("text"))
    ids = small(marks.select(F.col("d").alias("kd"), F.col("h").alias("kh")))
    plain = texts.join(ids, same(texts, ids), "left_anti").withColumns({c: none for c in lists})
    cutup = texts.join(ids, same(texts, ids), "left_semi").join(marks, ["d", "h"])

    def per_batch(batches):
        for batch in batches:
            data, offsets = A.column_bytes(batch.column("text"))
            own = []
            for c in lists:
                flat = batch.column(c).fill_null([]) if batch.column(c).null_count else batch.column(c)
                own.append((flat.offsets.to_numpy(), *(flat.values.field(x).to_numpy() for x in ("start", "end"))))
            for a, b in A.slices(offsets, 1 << 22):
                out = [cut(data[offsets[i] : offsets[i + 1]], *[(s[n[i] : n[i + 1]], e[n[i] : n[i + 1]]) for n, s, e in own]) for i in range(a, b)]
                columns = [batch.column("doc_id").slice(a, b - a), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]]
                yield pa.record_batch(columns, ["doc_id", *names])

    form, wanted = f"doc_id {doc_id}, {schema}", ["doc_id", "text", *lists]
    return plain.select(*wanted).mapInArrow(A.tidy(per_batch), form).unionByName(cutup.select(*wanted).mapInArrow(A.tidy(per_batch), form))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def clipped(spans: tuple[np.ndarray, np.ndarray], n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the spans of a document of n units; a copy as a whole counts if it has a window at all."""
    start, end = spans
    whole = end > n
    if whole.any() and n < window:
        start, end = start[~whole], end[~whole]
    return joined_spans(start, np.minimum(end, n)) if len(start) else (start, end)
