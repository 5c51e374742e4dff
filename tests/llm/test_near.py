"""Near-duplicates of texts and vectors against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents, key_of, none_of, prose
from pyspark.sql import functions as F

from vaultframe.llm import near_text, near_vectors
from vaultframe.llm.common import components, extended, settle


def shingle_weights(text):
    w = (text or "").encode().replace(b"\x0b", b" ").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows):
    """Least doc_id by (doc_id, text), from all pairs."""
    nodes = sorted({(key_of(i), t or "") for i, t in rows})
    sets, up = [shingle_weights(t) for _, t in nodes], list(range(len(nodes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            both = (sets[a] & sets[b]).total()
            if sets[a] and (sets[a] == sets[b] or both >= 0.8 * (sets[a] | sets[b]).total() - 1e-9):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {n: nodes[find(k)][0] for k, n in enumerate(nodes)}


def crowd(n=60, seed=5):
    """Copies of one text with ever more edits, so that some reach the threshold only through others."""
    r = random.Random(seed)
    base = prose(r, 150).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(["qq", "rr", f"u{k}"])
        out.append((1000 + k, " ".join(w)))
    return out


def test_classes_equal_all_pairs(spark):
    docs, rows = documents(spark, more=crowd())
    want = classes(rows)
    got = near_text.near_duplicates(docs).select("doc_id", "__h", "class_id", "kept").join(docs.select(F.col("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h2"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("__h") == F.col("__h2")))
    seen = {(key_of(r["doc_id"]), r["text"] or ""): (key_of(r["class_id"]), r["kept"]) for r in got.collect()}
    assert {n: c for n, (c, _) in seen.items()} == want
    assert near_text.near_duplicates(docs).count() == len(rows)
    kept = near_text.one_of_each(docs)
    nodes = [(key_of(r["doc_id"]), r["text"] or "") for r in kept.select("doc_id", "text").collect()]
    assert kept.columns == docs.columns and len(nodes) == len(set(nodes)) == sum(k for _, k in seen.values())


def test_weights_decide(spark):
    """Alike as sets, unlike by weight: a line that is there once, and one that is there many times."""
    r = random.Random(8)
    line, rest = prose(r, 12), prose(r, 60)
    texts = [f"{rest} {line}", f"{rest} " + " ".join([line] * 30), f"{rest} " + " ".join([line] * 29)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows)
    got = {(r["doc_id"]): r["class_id"] for r in near_text.near_duplicates(docs).collect()}
    assert got == {i: want[i, t] for i, t in rows} == {0: 0, 1: 1, 2: 1}


def test_components_of_chains_stars_and_further_edges(spark):
    """A chain, a star, chance edges, repeats and loops; then edges that join components, new nodes, and nothing new."""
    r = random.Random(4)
    first = [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(5, 5), (101, 100)]
    more = [(115, 230), (259, 90), (120, 110), (500, 501), (501, 320), (230, 115)]
    frame = lambda e: spark.createDataFrame(e, "u long, v long")

    def least(edges):
        up = {x: x for e in edges if e[0] != e[1] for x in e}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = sorted((find(a), find(b)))
                up[b] = a
        return {x: find(x) for x in up}

    def rows(df):
        out = [tuple(x) for x in df.select("id", "component").collect()]
        assert len(out) == len(dict(out))
        return dict(out)

    comps = settle(components(frame(first)))
    assert rows(comps) == least(first)
    assert rows(extended(comps, frame(more))) == least(first + more)
    assert rows(extended(comps, frame([(101, 100)]))) == least(first)
    assert rows(components(frame([]))) == {}


def test_no_documents(spark):
    docs, _ = documents(spark)
    assert near_text.near_duplicates(none_of(docs)).count() == 0 and near_text.one_of_each(none_of(docs)).count() == 0


@pytest.mark.parametrize("counted", [False, True])
def test_darts_estimate_weighted_similarity(counted):
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 300).astype(np.uint64)
    wa, wb = r.integers(1, 6, 300).astype(float), r.integers(1, 6, 300).astype(float)
    if not counted:
        wa, wb = (r.random(300) < 0.8).astype(float), (r.random(300) < 0.8).astype(float)
    a, b = wa > 0, wb > 0
    elements, weights = np.concatenate([h[a], h[b]]), np.concatenate([wa[a], wb[b]])
    row = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
    s = near_text.dart_signatures(elements, weights, row, 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04
    assert (s != 0).mean() > 0.99


def test_vectors_equal_all_pairs(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(6, 16))
    v = [centers[i % 6] + r.normal(size=16) * r.choice([0.1, 0.3]) for i in range(300)]
    v = [x.astype(np.float32).tolist() for x in v] + [v[0].astype(np.float32).tolist(), [0.0] * 16, [1.0, float("nan")] + [0.0] * 14, [1.0, None] + [1.0] * 14, None, [], [1.0, 2.0], [2.0, 4.0], (np.array(v[3], np.float32) * 8).tolist()]
    rows = [(i, x) for i, x in enumerate(v)] + [(7, v[7]), (None, v[9]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("v", F.lit(2)).withColumn("d", F.lit(3)).repartition(3)
    sound = [x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x) for _, x in rows]
    unit = [np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64)) if ok else None for (_, x), ok in zip(rows, sound, strict=True)]
    n, links, up = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if sound[a] and sound[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a in range(n):
        least[find(a)] = min(least.get(find(a), key_of(None)), key_of(rows[a][0]))
    want = sorted((key_of(rows[a][0]), links[a], least[find(a)]) for a in range(n))
    for tile, kind in ((40, "array<float>"), (7, "array<double>")):
        got = near_vectors.similar_vectors(df.withColumn("embedding", F.col("embedding").cast(kind)), tile=tile).collect()
        assert sorted((key_of(r["vec_id"]), r["n_links"], key_of(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sum(links) > 1000 and near_vectors.similar_vectors(none_of(df)).count() == 0
