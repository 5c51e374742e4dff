"""Substring dedup of words: suffix trees over prefix partitions.

Suffixes are taken at the anchors of windows (see repeats) and split by prefixes of variable length into groups that
fit in memory: by eight words first, and for a prefix that is too frequent by ever more words from the start of each
window, up to the whole of it. The suffixes of a group are sorted into suffix trees in array form, to either side of
the anchor. Deep internal nodes are the maximal repeats: a node as deep as a window's part to the right, together with
one as deep as its part to the left, is a repeated window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import DataFrame

from vaultframe.llm.common import read
from vaultframe.llm.repeats import SPANS, Kind, Texts, clipped, repeated_spans, with_spans

WINDOW, PREFIX = 20, 8


def suffix_order(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The leaves of the trees of all groups in order."""
    return np.lexsort((*[rows[:, k] for k in range(rows.shape[1] - 1, -1, -1)], group))


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (removed runs of words, from 0, end exclusive), kept (text).

    A window of `window` words stays where its words start first (by doc_id, then place) and is removed elsewhere.
    Null and empty texts have no words. Equal rows are one document and get the same result; a null doc_id comes
    last; of rows with one doc_id and other texts the smaller hash of the text comes first. Other columns are ignored.
    """
    texts = Texts.of(docs)
    marks = repeated_spans(texts, Kind(window, prefix, True, "later", group or 0), suffix_order)
    schema = "n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
    return with_spans(texts, marks, lambda t, s: _cut(window, t, s), docs.schema["doc_id"].dataType.simpleString(), schema, [pa.int64(), pa.int64(), SPANS, pa.string()])


def _cut(window: int, data: np.ndarray, spans: tuple[np.ndarray, np.ndarray]):
    words = data.tobytes().split()
    n = len(words)
    a, b = clipped(spans, n, window)
    if not len(a):
        return n, 0, [], b" ".join(words).decode()
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        kept += words[at:x]
        at = y
    kept += words[at:]
    return n, int((b - a).sum()), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], b" ".join(kept).decode()


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's removed words and what is left."""
    out = without_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
