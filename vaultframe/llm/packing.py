"""Packing along a space-filling curve.

Each document's tokens give a hashed, normalised count vector, which is projected to three dimensions; the cell
there has a position on a Hilbert curve. Documents are range-sorted by that position, so that a sequence holds
neighbours, and each range is cut into sequences of the full length; what remains at its end is cut into
sequences whose lengths are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from math import ceil, erf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import arrays as A
from vaultframe.llm.common import read, row_key, settle, text_of

LENGTH, END = 2048, 1
#: Dimensions of hashed vectors; of the curve; bits of each of these.
HASHED, DIMENSIONS, BITS = 256, 3, 10
#: Fixed pattern that splits a text before merges (byte-level BPE).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beyond ASCII, in UTF-8: next to it a space is no safe place to cut.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are encoded at once.
_SLICE = 1 << 20
#: Ids of one range, and ranges at most: beyond these a range is longer, as it is sorted on disk and cut as a stream.
RANGE, RANGES = 4_000_000, 100_000


def tokenizer_path() -> str:
    """The public byte-level vocabulary, where the environment keeps it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as the tokenizers library gives them without added special tokens.

    A text is cut where white space follows other characters, which no token crosses. The distinct pieces of a batch
    are encoded end to end, as the same holds where they meet; a piece that begins without white space, ends with it or
    holds a special token is encoded by itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(kept)]
        byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.marks = re.compile(b"|".join(re.escape(t.encode()) for t in self.special)) if self.special else None
        self.kind = np.uint16 if self.bpe.n_vocab <= 1 << 16 else np.uint32
        #: Bytes of each id's token.
        self.width = np.zeros(self.bpe.n_vocab, np.int64)
        self.width[list(ranks.values())] = [len(t) for t in ranks]

    def _one(self, piece: bytes) -> np.ndarray:
        text = piece.decode()
        return np.array(self.bpe.encode(text, allowed_special="all") if b"<" in piece else self.bpe.encode_ordinary(text), self.kind)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that may be encoded end to end, and how many each has."""
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        raw = pieces.buffers()[2][at[0] : at[-1]].to_pybytes()
        ids = np.array(self.bpe.encode_ordinary(raw.decode()), self.kind)
        ends = np.cumsum(self.width[ids])
        upto = np.searchsorted(ends, at[1:] - at[0], "right")
        if not np.array_equal(ends[upto - 1], at[1:] - at[0]):
            raise RuntimeError("a token crosses a cut: the vocabulary's pattern is not the one that texts are cut for")
        return ids, np.diff(upto, prepend=0)

    def _distinct(self, pieces: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each one's begin and how many they are; odd: pieces to encode by themselves."""
        begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        ids, held = [], 0
        if not odd.all():
            got, many = self._joined(pieces.filter(pa.array(~odd)))
            size[~odd], begin[~odd], held = many, np.cumsum(many) - many, len(got)
            ids.append(got)
        for k in np.flatnonzero(odd).tolist():
            got = self._one(pieces[k].as_py())
            size[k], begin[k], held = len(got), held, held + len(got)
            ids.append(got)
        return np.concatenate(ids), begin, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text's."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(rows, np.int64)
        space = _SPACE[data]
        cut, whole = np.zeros(len(data), bool), np.zeros(rows, bool)
        cut[1:] = space[1:] & ~space[:-1]
        raw = data.tobytes()
        for pattern in (_WIDE_SPACE, self.marks):
            for m in pattern.finditer(raw) if pattern else ():
                row = np.searchsorted(offsets, m.start(), "right") - 1
                whole[row], cut[offsets[row] : offsets[row + 1]] = True, False
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        start = np.flatnonzero(cut)
        ends, row = np.append(start[1:], len(data)), np.searchsorted(offsets, start, "right") - 1
        # Pieces are made distinct by their bytes.
        places = pa.py_buffer(np.append(start, len(data)).astype(np.int32))
        found = pa.Array.from_buffers(pa.binary(), len(start), [None, places, pa.py_buffer(raw)]).dictionary_encode()
        which = found.indices.to_numpy()
        odd = np.zeros(len(found.dictionary), bool)
        odd[which[whole[row] | ~space[start] | space[ends - 1]]] = True
        ids, begin, size = self._distinct(found.dictionary, odd)
        many = size[which]
        total = np.cumsum(many)
        at = np.repeat(begin[which] - (total - many), many) + np.arange(total[-1])
        return ids[at], np.bincount(row, many, rows).astype(np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of cells (n, dimensions): the bits of an axis are undone from the top, then Gray-coded."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Hilbert keys of documents from their tokens: hashed counts, square roots, unit length, fixed projection."""
    slot = (A.mix(ids.astype(np.uint64)) % np.uint64(HASHED)).astype(np.int64)
    v = np.sqrt(np.bincount(row * HASHED + slot, minlength=rows * HASHED).reshape(rows, HASHED))
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    z = v @ np.random.default_rng(5).normal(size=(HASHED, DIMENSIONS))
    share = 0.5 * (1 + np.vectorize(erf)(z / 2**0.5)) if rows else z
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokens(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, __h, ids (packed), n and at (curve position) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def per_batch(batches):
        encoder = _encoder(path)
        for batch in batches:
            data, offsets = A.column_bytes(batch.column("text"))
            for a, b in A.slices(offsets, _SLICE):
                ids, size = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = np.repeat(np.arange(b - a), size)
                keys = curve_keys(ids, row, b - a)
                ids = np.insert(ids, np.cumsum(size), end)
                size = size + 1
                width = ids.itemsize
                ends = np.concatenate([[0], np.cumsum(size) * width]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), batch.column("__h").slice(a, b - a), packed, pa.array(size), pa.array(keys)],
                    ["doc_id", "__h", "ids", "n", "at"],
                )

    return row_key(docs.select("doc_id", text_of().alias("text"))).mapInArrow(A.tidy(per_batch), f"doc_id {kind}, __h bigint, ids binary, n bigint, at bigint")


class Run:
    """Ids under way in a range: the pieces of documents that hold them, end to end."""

    def __init__(self, doc: pa.Array, first: np.ndarray, size: np.ndarray, total: np.ndarray, ids: np.ndarray):
        self.doc, self.first, self.size, self.total, self.ids = doc, first, size, total, ids
        self.at = np.cumsum(size) - size

    def then(self, other: Run) -> Run:
        both = [np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("first", "size", "total", "ids")]
        return Run(pa.concat_arrays([self.doc, other.doc]), *both)

    def after(self, place: int) -> Run:
        """What lies from a place on."""
        k = max(0, int(np.searchsorted(self.at, place, "right")) - 1)
        skip = max(0, place - int(self.at[k])) if len(self.at) else 0
        if len(self.size) and skip >= self.size[k]:
            k, skip = k + 1, 0
        first, size = self.first[k:].copy(), self.size[k:].copy()
        first[:1] += skip
        size[:1] -= skip
        return Run(self.doc.slice(k), first, size, self.total[k:], self.ids[place:].copy())

    def pieces(self, bounds: np.ndarray, number: int) -> pa.RecordBatch:
        """Rows of the sequences between bounds, the first of which is `number`."""
        cuts = np.unique(np.concatenate([self.at[self.at < bounds[-1]], bounds[:-1]]))
        ends = np.append(cuts[1:], bounds[-1])
        own, seq = np.searchsorted(self.at, cuts, "right") - 1, np.searchsorted(bounds, cuts, "right") - 1
        raw = pa.py_buffer(np.ascontiguousarray(self.ids[: bounds[-1]], "<u4"))
        ids = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, bounds[-1]).astype(np.int32) * 4), raw])
        columns = [self.first[own] + cuts - self.at[own], ends - cuts, ids, self.total[own], number + seq, cuts - bounds[seq]]
        return pa.record_batch([self.doc.take(pa.array(own)), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], PIECE)


PIECE = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def sequences(batches, length: int, width: type, first: int):
    """Pieces of a sorted range of documents (doc_id, ids), batch by batch; sequences are numbered from `first`."""
    held, number = None, first
    for batch in batches:
        column = batch.column("ids")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        flat, ends = np.frombuffer(column.buffers()[2], width), ends // np.dtype(width).itemsize
        for a, b in A.slices(ends - ends[0], _SLICE):
            size = np.diff(ends[a : b + 1])
            run = Run(batch.column("doc_id").slice(a, b - a), np.zeros(b - a, np.int64), size, size, flat[ends[a] : ends[b]])
            run = held.then(run) if held else run
            whole = len(run.ids) // length * length
            if whole:
                yield run.pieces(np.arange(0, whole + 1, length), number)
                number += whole // length
            held = run.after(whole)
    if held and (rest := len(held.ids)):
        powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        yield held.pieces(np.cumsum([0, *powers]), number)


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document is its ids and then `end`; null and empty texts are `end` alone. Every id lies in one piece.
    Equal rows are packed each; other columns of docs are ignored. An empty table gives no rows.
    """
    path = path or os.path.realpath(tokenizer_path())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        yield from sequences(batches, length, _encoder(path).kind, TaskContext.get().partitionId() << 32)

    # Settled, as range bounds are sampled first: else each text would be encoded twice. The number of ranges follows
    # the number of ids; a last key parts rows that are equal.
    coded = settle(tokens(docs, path, end)).withColumn("__t", F.monotonically_increasing_id())
    total = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys = ("at", "doc_id", "__h", "__t")
    ordered = coded.repartitionByRange(min(RANGES, ceil(total / RANGE) or 1), *keys).sortWithinPartitions(*keys)
    return ordered.select("doc_id", "ids").mapInArrow(
        A.tidy(cut), f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces, with a checksum of their ids."""
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op6_packing": op6_packing}
