"""Suffix-array dedup of bytes by bucket-pointer refinement.

Suffixes are taken at the anchors of 400-byte windows (see repeats). Grams are the buckets that Spark deals out. In a
group each bucket is parted by the q-grams that its members begin with, and then refined: members are sorted by the
bucket identifiers of what stands at a later offset, members alone in their bucket leave, and the identifiers of those
that stay are refined in the same way, so that the next pass looks twice as far. The order that results gives the
depths shared by neighbours, to either side of the anchors, and with them the repeated windows.

Passages of words that several documents share, which may be shorter than a window of bytes, are found alike over word
codes and only counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import arrays as A
from vaultframe.llm.common import read, settle
from vaultframe.llm.repeats import SPANS, Kind, Texts, clipped, repeated_spans, with_spans

WINDOW, GRAM, RUN = 400, 64, 8
#: Words of a passage (over 50) and of its grams.
PASSAGE, PASSAGE_GRAM = 51, 16


def _parted(bucket: np.ndarray, members: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Parts the buckets of the members by key, in place; returns those that are not alone afterwards.

    A bucket's identifier is the place of its first member in the order, and all members of a bucket are given.
    """
    order = np.lexsort((key, bucket[members]))
    members, key = members[order], key[order]
    own, nth = bucket[members], np.arange(len(members))
    other = np.ones(len(members), bool)
    other[1:] = own[1:] != own[:-1]
    place = own + nth - np.maximum.accumulate(np.where(other, nth, 0))
    other[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(other)
    run = np.cumsum(other) - 1
    bucket[members] = place[first][run]
    return members[(np.diff(np.append(first, len(members))) > 1)[run]]


def _alike(pointer: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row a row that equals it, group included: the first of those with its hash, or itself if that one differs."""
    weight = A.mix(np.arange(1, pointer.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    total = A.mix(group.astype(np.int64).view(np.uint64))
    for k in range(pointer.shape[1]):
        total += pointer[:, k] * weight[k]
    first, run = np.unique(total, return_index=True, return_inverse=True)[1:]
    same = first[run.ravel()]
    differs = (group != group[same]) | (pointer != pointer[same]).any(axis=1)
    return np.where(differs, np.arange(len(group)), same)


def refined_order(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of rows by group and then units, by bucket-pointer refinement; equal rows share a bucket from the start."""
    if rows.dtype == np.uint8:
        wide = np.zeros((len(rows), -(-rows.shape[1] // RUN) * RUN), np.uint8)
        wide[:, : rows.shape[1]] = rows
        pointer = wide.view(">u8").astype(np.uint64)  # a q-gram is its bucket's identifier
    else:
        pointer = rows
    same = _alike(pointer, group)
    one = np.flatnonzero(same == np.arange(len(rows)))
    pointer, group = pointer[one], group[one]
    bucket = np.zeros(len(one), np.int64)
    left = _parted(bucket, np.arange(len(one)), group)
    left = _parted(bucket, left, pointer[left, 0]) if pointer.shape[1] else left
    pointer, depth = pointer[left], 1
    while len(left) and depth < rows.shape[1]:
        # Of the rest, identifiers of what stands at every depth-th place; the next pass reuses them.
        pointer = np.unique(pointer, return_inverse=True)[1].reshape(pointer.shape).astype(np.int64)
        if pointer.shape[1] < 2:
            break
        at = np.empty(len(bucket), np.int64)
        at[left] = np.arange(len(left))
        stay = _parted(bucket, left, pointer[:, 1])
        pointer, left = pointer[at[stay]], stay
        if pointer.shape[1] % 2:
            pointer = np.concatenate([pointer, np.full((len(pointer), 1), -1, np.int64)], axis=1)
        pointer, depth = pointer[:, ::2] << 32 | (pointer[:, 1::2] + 1), 2 * depth
    return np.argsort(bucket[np.searchsorted(one, same)], kind="stable")


def _cut(window: int, passage: int, data: np.ndarray, spans: tuple[np.ndarray, np.ndarray], passages: tuple[np.ndarray, np.ndarray]):
    n, shared = len(data), 0
    if len(passages[0]):
        words = len(A.word_spans(data, np.array([0, n]))[0])
        a, b = clipped(passages, words, passage)
        shared = int((b - a).sum())
    a, b = clipped(spans, n, window)
    if not len(a):
        return n, 0, [], data.tobytes(), shared
    keep = np.ones(n, bool)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        keep[x:y] = False
    return n, int((b - a).sum()), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], data[keep].tobytes(), shared


def without_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int | None = None, passage: int = PASSAGE) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans (removed runs, from 0, end exclusive), kept (binary), n_shared_words.

    Every occurrence of a repeated window is removed, the first one too. Null and empty texts have no bytes. Equal
    rows are each other's copies, and so are equal texts; documents shorter than a window keep all. n_shared_words
    counts the words in passages of `passage` words that other documents (or copies) hold too, removed or not.
    Other columns are ignored.
    """
    texts = Texts.of(docs)
    marks = repeated_spans(texts, Kind(window, gram, False, "all", group or 0), refined_order)
    shared = repeated_spans(texts, Kind(passage, min(PASSAGE_GRAM, passage), True, "across", group or 0), refined_order)
    both = settle(marks.join(shared.withColumnRenamed("spans", "passages"), ["d", "h"], "full"))
    schema = "n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, n_shared_words bigint"
    types = [pa.int64(), pa.int64(), SPANS, pa.binary(), pa.int64()]
    return with_spans(texts, both, lambda t, s, p: _cut(window, passage, t, s, p), docs.schema["doc_id"].dataType.simpleString(), schema, types)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's removed bytes and what is left; the words in passages that other documents share follow."""
    out = without_repeated_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words")


QUERIES = {"op9_suffix_array_dedup": op9_suffix_array_dedup}
