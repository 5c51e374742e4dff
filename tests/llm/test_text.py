"""Page text, packing, the quality network and the pipeline."""

import os
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from conftest import DATA
from helpers import documents, none_of
from pyspark.sql import functions as F

from vaultframe.llm import html_text, labelled_pages, packing, quality

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def test_field_on_pages_not_seen():
    field, wrong, total = html_text.trained(), 0, 0
    for page in labelled_pages.pages(150, seed=77):
        feats, y = html_text.example(page)
        if feats:
            wrong += sum(a != b for a, b in zip(field.decode(feats), y, strict=True))
            total += len(y)
    assert wrong <= 0.02 * total


def test_decoding_is_the_best_of_all_labellings():
    r = np.random.default_rng(0)
    for _ in range(30):
        field = html_text.Field({"a": r.normal(), "b": r.normal(), "bias": r.normal()}, r.normal(size=(2, 2)))
        feats = [tuple(x for x in "ab" if r.random() < 0.5) for _ in range(6)]

        def score(y, field=field, feats=feats):
            s = sum(sum(field.weights[f] for f in {*own, "bias"}) for own, k in zip(feats, y, strict=True) if k)
            return s + sum(field.pairs[p][q] for p, q in zip(y, y[1:]))

        best = max(([(n >> k) & 1 for k in range(6)] for n in range(64)), key=score)
        assert abs(score(field.decode(feats)) - score(best)) < 1e-9
    assert html_text.Field({}, np.zeros((2, 2))).decode([]) == []


PAGES = [
    ("<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>Fo<b>u</b>r\n  five<br>six &lt;x&gt;</article><footer>&copy; me</footer>", "A & B Four five six <x>"),
    ('<div class="sidebar"><p>other</p></div><main><p>one<p>two<script>if (a<b) x("<p>no</p>")</script><style>p{}</style><!-- <p>no</p> --></main><div class="comments"><div class="comment"><p>nice</p></div></div>', "one two"),
    ('<div class="cookie-notice"><p>We use cookies</p></div><article><p>text</p><form><label>Name</label><button>Go</button></form></article>', "text"),
    ("<article><p>Take <math><mi>x</mi><mo>+</mo><mn>1</mn></math> apples</p><p>and <svg width=1/> pears</p><p>or <svg><title>icon</title><style>a{}</style><text>plums</text></svg></p></article>", "Take x+1 apples and pears or plums"),
    ('<article><h1>One</h1><div class="ad"/><title/><p>two</p><img src=x/><p>three</p></article>', "One two three"),
    ("<article><h1>Long</h1>" + "<p>A sentence of words. </p>" * 5000 + "</article>", "Long" + " A sentence of words." * 5000),
    ("", ""), (None, ""), ("<p", ""), ("<!-- only", ""), ("<nav><a href=x>y</a></nav>", ""),
]


def test_extracted_pages(spark):
    rows = [(i, "http://x", h, 1) for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], 1), (0, "http://x", PAGES[0][0], 1)]
    web = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(web).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: t for i, (_, t) in enumerate(PAGES)} | {None: PAGES[0][1]}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(none_of(web)).count() == 0


class Article(HTMLParser):
    """The text of the article of a given page, read with Python's own parser: what stands in boxes of other roles is left out."""

    OTHER = ("nav", "header", "footer", "aside", "form", "script", "style", "button")
    INLINE = ("b", "i", "em", "strong", "a", "span", "code", "sub", "sup", "small", "u")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.out.append(" ")
        if tag not in ("br", "img", "hr", "meta", "input", "link", "p", "li", "b"):
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            self.open.append((tag, tag in self.OTHER or bool(re.search(r"\b(ad|ads|comments?|sidebar|cookie|notice|share|related|menu)\b", named))))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.out.append(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(other for _, other in self.open):
            self.out.append(data)


def test_given_pages_have_their_article(spark):
    data = DATA.replace("0.001", "0.01")
    web = spark.read.parquet(f"{data}/pages.parquet")
    want = {}
    for r in web.select("page_id", "html").collect():
        reader = Article()
        reader.feed(r["html"])
        reader.close()
        want[r["page_id"]] = " ".join("".join(reader.out).split())
    got = {r["page_id"]: r["text"] for r in html_text.op5_html_extraction(spark, data).collect()}
    assert len(got) > 200 and all(want.values()) and [i for i in want if got[i] != want[i]] == []


def test_encoder_is_the_tokenizers():
    from tokenizers import Tokenizer

    own, other = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    texts = ["a b  c\n\n d <|endoftext|> x", "", "  lead", "don't we'll  é\t\tü ", "  a　 b   c", "x" * 5000, "漢字 😀  <", "1 22  333 !!! ?"]
    r = random.Random(6)
    odd = [" ", "  ", "\n", "\t", "\x0b", "\xa0", "\u2003", "\u3000", "a", "Bc", "7", "12", "'s", "'", "!", "<", "<|endoftext|>", "é", "漢", "😀", "\u0301", "."]
    texts += ["".join(r.choice(odd) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, size = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_tokens_alike_in_six_bits_have_other_keys():
    slot = packing.A.mix(np.arange(2000, dtype=np.uint64))
    same = np.flatnonzero((slot % np.uint64(64) == slot[0] % np.uint64(64)) & (slot % np.uint64(256) != slot[0] % np.uint64(256)))
    keys = packing.curve_keys(np.array([0, same[0]]), np.array([0, 1]), 2)
    assert keys[0] != keys[1]


def test_pieces_hold_every_id(spark):
    from tokenizers import Tokenizer

    docs, rows = documents(spark)
    other = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(docs, length=256).collect()
    want = sorted([*other.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
    held = {}
    for p in pieces:
        held.setdefault(p["sequence_id"], []).append(p)
    ids_of = lambda p: np.frombuffer(bytes(p["ids"]), "<u4").tolist()
    for own in held.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        size = sum(p["length"] for p in own)
        assert size <= 256 and size & (size - 1) == 0
    ordered = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    got = []
    for p in ordered:  # pieces of a document follow each other along the order
        if p["start"] == 0:
            got.append([])
        got[-1] += ids_of(p)
        assert p["length"] == len(ids_of(p))
    assert sorted(got) == want
    assert packing.pack(none_of(docs)).count() == 0


def test_network_gradients_and_texts():
    net, texts = quality.Network(), ["good words here " * 50, "BAD!! " * 200, "", "short"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    data, offsets = np.concatenate(raw), np.cumsum([0, *map(len, raw)])
    y = np.array([1, 0, 1, 0], np.float32)
    net.training = True
    grad = net.gradients(*quality.chunked(data, offsets), y)
    net.training = False

    def loss():
        p = np.clip(net.scores(data, offsets), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, at in (("v", 3), ("b", 5), ("c", 0), ("w", (4, 2))):
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-2
        up = loss()
        net.p[name][at] = kept - 1e-2
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3
    # A chunk covers the end of a text as well as its beginning.
    tail = np.frombuffer(("a" * 5000 + "Z#").encode(), np.uint8)
    assert net.scores(tail, np.array([0, len(tail)]))[0] != net.scores(tail[:-2], np.array([0, len(tail) - 2]))[0]


@pytest.fixture(scope="module")
def scores(spark):
    return quality.op10_quality_classifier(spark, DATA.replace("0.001", "0.01")).cache()


def test_held_out_accuracy(spark, scores):
    labels = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet")
    got = scores.join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scores.collect())
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.88


def test_quality_edges(spark):
    docs, rows = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality.trained(docs, none)
    assert net.scores(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [0.5]
    out = quality.good_only(docs, none, cut=0.5)
    assert out.columns == docs.columns and out.count() == len(rows) and quality.good_only(none_of(docs), none).count() == 0


def test_quality_of_long_documents_only(spark):
    r = np.random.default_rng(3)
    words = {1: "river stone quiet morning letter".split(), 0: "$$$ WIN!! click 4U FREE".split()}
    long = lambda q: " ".join(["word"] * 5000 + [words[q][k] for k in r.integers(0, 5, 1500)])
    rows = [(i, long(i % 2)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = lambda qs: spark.createDataFrame(qs, "doc_id long, quality int, toxic int")
    assert min(len(t) for _, t in rows) > quality.SAMPLE_BYTES
    # Labels of documents that are not there do not crowd out those that are.
    labels = marks([(i, i % 2, 0) for i in range(60)] + [(i, 1, 0) for i in range(1000, 1400)])
    net = quality.trained(docs, labels, sample=40)
    assert net.fitted
    assert {x["doc_id"] for x in quality.good_only(docs, labels).collect()} == set(range(1, 60, 2))
    for one in ([], [(i, 0, 0) for i in range(60)], [(i, 1, 0) for i in range(60)]):
        assert quality.good_only(docs, marks(one)).count() == 60


def test_chunks_spread_over_a_text():
    text = b"".join(b"%07d " % i for i in range(20_000))
    for size in (0, 1, 512, 513, 16_384, 16_385, len(text)):
        own = text[:size]
        x, held, count = quality.chunked(np.frombuffer(own, np.uint8), np.array([0, size]))
        part = quality.spread(own)
        y, kept, n = quality.chunked(np.frombuffer(part, np.uint8), np.array([0, len(part)]), quality.CHUNK)
        take = np.arange(count[0]) if count[0] <= quality.SAMPLE_CHUNKS else np.arange(quality.SAMPLE_CHUNKS) * (count[0] - 1) // (quality.SAMPLE_CHUNKS - 1)
        assert (y == x[take]).all() and (kept == held[take]).all() and take[-1] == count[0] - 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
    assert all(kept[n].columns == columns for n in names[:-1])
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
    chain = [ids(kept[n]) for n in names]
    assert all(b <= a for a, b in zip(chain, chain[1:])) and chain[-1] == chain[-2] and len(chain[0]) > 850
    assert kept["secret_scans"].where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    assert kept["secret_scans"].where(F.length("text") != F.col("n_chars")).count() == 0
