"""Word and byte repeats against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents, key_of, none_of, prose

from vaultframe.llm import arrays, byte_repeats, repeats, word_repeats


@pytest.mark.parametrize("group", [None, 3])
def test_words(spark, group):
    docs, rows = documents(spark)
    nodes = sorted({(key_of(i), t or "") for i, t in rows if i not in (None, 4)})  # which of those ids' texts comes first is a hash's choice
    docs = docs.where("doc_id <> 4")
    seen, want = {}, {}
    for i, t in nodes:
        w = t.encode().split()
        gone = bytearray(len(w))
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = b"\1" * 20
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = word_repeats.without_repeats(docs, group=group).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
    assert len(got) == sum(i not in (None, 4) for i, _ in rows) and sum(x[1] for x in want.values()) > 300
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert word_repeats.without_repeats(none_of(docs)).count() == 0


@pytest.mark.parametrize("group", [None, 3])
def test_bytes(spark, group):
    docs, rows = documents(spark)
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want.append((key_of(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    words = [b.split() for _, b in raw]
    holders = {}
    for n, w in enumerate(words):
        for k in range(len(w) - 50):
            holders.setdefault(tuple(w[k : k + 51]), set()).add(n)
    shared = []
    for n, w in enumerate(words):
        hit = bytearray(len(w))
        for k in range(len(w) - 50):
            if len(holders[tuple(w[k : k + 51])]) > 1:
                hit[k : k + 51] = b"\1" * 51
        shared.append(sum(hit))
    got = byte_repeats.without_repeated_bytes(docs, group=group).collect()
    assert sorted((key_of(r["doc_id"]), r["n_bytes"], r["n_shared_words"]) for r in got) == sorted((key_of(i), len(b), x) for (i, b), x in zip(raw, shared, strict=True))
    assert 0 < sum(x > 0 for x in shared) < len(shared)
    assert sorted((key_of(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == sorted(want)
    assert sum(x[2] for x in want) > 1000 and byte_repeats.without_repeated_bytes(none_of(docs)).count() == 0


def test_words_alike_in_half_a_hash_differ(spark):
    data = np.frombuffer(b"".join(b"%06d" % i for i in range(400_000)), np.uint8)
    start = np.arange(400_000) * 6
    half = arrays.Rolling(data).of(start, start + 6) >> np.uint64(32)
    order = np.argsort(half, kind="stable")
    at = np.flatnonzero(half[order][1:] == half[order][:-1])
    assert len(at)
    before, after = " ".join(f"a{i}" for i in range(15)), " ".join(f"b{i}" for i in range(15))
    texts = [f"{before} {order[k]:06d} {after}" for k in (at[0], at[0] + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (None, 1):
        got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in word_repeats.without_repeats(docs, group=group).collect()}
        assert got == {i: (0, t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_refinement_sorts(kind):
    r = np.random.default_rng(2)
    for n, width, letters in ((1, 40, 2), (400, 40, 2), (300, 400, 3), (200, 13, 2), (50, 1, 3), (0, 16, 2)):
        rows, group = r.integers(0, letters, (n, width)).astype(kind), r.integers(0, 5, n)
        if n > 10:  # long common beginnings, and equal rows
            rows[: n // 2] = rows[0]
            rows[: n // 4, -1] = r.integers(0, 3, n // 4)
        order = byte_repeats.refined_order(rows, group)
        assert sorted(order) == list(range(n))
        seen = [(group[k], tuple(rows[k])) for k in order]
        assert seen == sorted(seen)


def test_rows_alike_in_hash_differ():
    weight = [int(x) for x in arrays.mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)]
    step = 3 * weight[1] * pow(weight[0], -1, 1 << 64)
    rows = np.array([[5 + step & (1 << 64) - 1, 6, 7], [5, 9, 7], [5, 9, 7], [5 + step & (1 << 64) - 1, 6, 7], [5, 9, 7]], np.uint64)
    group = np.zeros(5, np.int64)
    assert len(set((rows * np.array(weight, np.uint64)).sum(axis=1).tolist())) == 1
    assert byte_repeats._alike(rows, group).tolist() == [0, 1, 2, 0, 4]
    seen = [tuple(rows[k]) for k in byte_repeats.refined_order(rows, group)]
    assert seen == sorted(seen)


def test_equal_rows_are_refined_once(monkeypatch):
    rows = np.repeat(np.random.default_rng(3).integers(0, 2, (7, 400)).astype(np.uint8), 300, axis=0)
    rows[:, :350] = 1
    given, parted = [], byte_repeats._parted
    monkeypatch.setattr(byte_repeats, "_parted", lambda bucket, members, key: given.append(len(members)) or parted(bucket, members, key))
    order = byte_repeats.refined_order(rows, np.zeros(len(rows), np.int64))
    seen = [rows[k].tobytes() for k in order]
    assert seen == sorted(seen) and max(given) == 7


def test_a_text_is_scanned_once(spark, tmp_path, monkeypatch):
    r, log, anchors = random.Random(6), str(tmp_path / "scanned"), repeats.anchors
    rows = [(i, prose(r, 120)) for i in range(12)] + [(i, prose(r, 30)) for i in range(12, 15)]
    docs = spark.createDataFrame(rows + [(i + 20, t) for i, t in rows[:4]], "doc_id long, text string")

    def logged(code, offsets, kind):
        with open(log, "a") as f:
            f.write(f"{len(offsets) - 1}\n")
        return anchors(code, offsets, kind)

    monkeypatch.setattr(repeats, "anchors", logged)
    found = repeats.repeated_spans(repeats.Texts.of(docs), repeats.Kind(400, 64, False, "all"), byte_repeats.refined_order)
    assert found.count() == 8 and sum(int(x) for x in open(log).read().split()) == len(rows)


def test_anchors_of_each_window():
    r = np.random.default_rng(5)
    size = np.array([0, 13, 5, 12, 80, 0, 3, 200, 11])
    offsets = np.concatenate([[0], np.cumsum(size)])
    code, kind = r.integers(0, 2, offsets[-1]).astype(np.uint8), repeats.Kind(12, 4, False, "all")
    gram = {k: int(arrays.Rolling(code).of(np.array([k]), np.array([k + 4]))[0]) for k in range(len(code) - 3)}
    want = {}
    for row, n in enumerate(size.tolist()):
        for s in range(n - 11):
            at = int(offsets[row])
            place = min(range(s, s + 9), key=lambda k: (gram[at + k] >> 32, k))  # noqa: B023
            want.setdefault((gram[at + place], row, place), []).append(s)
    got = [x.tolist() for x in repeats.anchors(code, offsets, kind)]
    assert list(zip(*got, strict=True)) == [(*k, min(s), max(s)) for k, s in want.items()]
    assert not len(repeats.anchors(code[:11], np.array([0, 11]), kind)[0])


def test_subtrees_cut_at_a_depth():
    rows = np.array([[1, 2, 3], [1, 2, 4], [1, 5, 5], [2, 2, 2], [1, 2, 3]], np.uint64)
    group = np.zeros(5, int)
    tree = repeats.Subtrees(word_repeats.suffix_order(rows, group), rows, group)
    alike = lambda depth: [[k for k in range(5) if tree.nodes(depth)[k] == x] for x in sorted(set(tree.nodes(depth)))]
    assert alike(1) == [[0, 1, 2, 4], [3]] and alike(2) == [[0, 1, 4], [2], [3]] and alike(3) == [[0, 4], [1], [2], [3]]


def test_frequent_prefixes_grow(spark):
    """One passage in most documents, with beginnings and endings of their own, and grams that are frequent in other company."""
    r = random.Random(4)
    common = prose(r, 45).split()
    texts = []
    for i in range(60):
        a, b = r.choice([(0, 45), (5, 40), (0, 12), (20, 33)])
        texts.append(" ".join([*prose(r, r.randint(0, 30)).split(), *common[a:b], *(w for w in prose(r, r.randint(0, 30)).split())]))
    texts += [prose(r, 7) + " same line" * n for n in (40, 60, 11)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, want = {}, {}
    for i, t in rows:
        w = t.encode().split()
        gone = bytearray(len(w))
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = b"\1" * 20
        want[i] = sum(gone)
    for group in (1, 8):
        got = {r["doc_id"]: r["n_removed"] for r in word_repeats.without_repeats(docs, group=group).collect()}
        assert got == want
    assert sum(want.values()) > 500
