"""Main text of web pages: a linear-chain conditional random field over the blocks of a page.

A page is cut into leaf blocks (runs of text between block-level tags). A block's features are the tags, classes and
ids of its ancestors and the look of its text; the field scores each block and each pair of neighbours, is trained
by maximum likelihood on labelled pages, and is decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vaultframe.llm.common import read
from vaultframe.llm.labelled_pages import pages

#: Fixed tag lists of the markup: tags that end a block, tags without an end, tags whose content is no text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html iframe ins label legend li main menu nav noscript ol option p pre section select summary table tbody td textarea"
    " tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NESTED = frozenset("li dt dd tr td th option p".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script)\b[^>]*+>.*?(?:</script\b[^>]*+>|\Z)"
    r"|<(?P<raw2>style|title|template)\b[^>]*+(?<!/)>.*?(?:</(?P=raw2)\b[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+>|<[a-z/!?][^>]*+\Z",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
PAGES, EPOCHS = 500, 60


def blocks(page: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """(text, features) of each block in page order; texts are decoded, with single spaces."""
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    held: list[str] = []
    context: tuple[str, ...] = ()
    parent, in_link, linked, at = "", 0, 0, 0

    def flush():
        nonlocal linked
        raw = "".join(held)
        held.clear()
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        share, linked = (linked / max(1, len(raw))), 0
        if text:
            yield text, (*context, "parent:" + parent, *_look(text, share))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if not held and not piece.isspace():
                context, parent = stack[-1][1], stack[-1][0]
            if held or not piece.isspace():
                held.append(piece)
                linked += len(piece) if in_link else 0
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        closing = m["end"] or m["end2"]
        if tag not in BLOCK:
            if tag == "br" and held:
                held.append(" ")
            elif tag == "a":
                in_link = not closing
            continue
        yield from flush()
        in_link = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1][0] == "p" or (tag in NESTED and stack[-1][0] == tag):
            stack.pop() if len(stack) > 1 else None
        rest = (m["rest"] if m["tag"] else m["rest2"]) or ""
        if tag not in VOID and not rest.endswith("/"):  # a self-closing element ends at once
            own = ["tag:" + tag]
            for x in NAMED.finditer(rest):
                own += ["name:" + w for w in WORD.findall((x[1] or x[2] or x[3] or "").lower())]
            stack.append((tag, (*stack[-1][1], *own)))
    if at < len(page) and (tail := page[at:]).strip():
        if not held:
            context, parent = stack[-1][1], stack[-1][0]
        held.append(tail)
    yield from flush()


def _look(text: str, linked: float) -> tuple[str, ...]:
    n = len(text)
    return (
        "length:" + ("1" if n < 20 else "2" if n < 60 else "3" if n < 200 else "4"),
        "linked:" + ("0" if linked < 0.1 else "1" if linked < 0.7 else "2"),
        "end:" + ("1" if text[-1] in ".!?" else "0"),
        "copyright:" + ("1" if "©" in text[:40] else "0"),
    )


class Field:
    """Weights of features for label 1 (article) against 0, and of pairs of neighbouring labels."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs.tolist()

    def decode(self, features: list[tuple[str, ...]]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to label 1."""
        get, (p, q), back = self.weights.get, self.pairs, []
        a, b = 0.0, sum(get(f, 0.0) for f in {*features[0], "bias"}) if features else 0.0
        for own in features[1:]:
            s = sum(get(f, 0.0) for f in {*own, "bias"})
            to0, to1 = (0, a + p[0]) if a + p[0] > b + q[0] else (1, b + q[0]), (0, a + p[1]) if a + p[1] > b + q[1] else (1, b + q[1])
            back.append((to0[0], to1[0]))
            a, b = to0[1], to1[1] + s
        label = [int(b >= a)] if features else []
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]


def fit(examples: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood with a small penalty: forward and backward sums over all pages at once, Adam steps."""
    names = sorted({f for feats, _ in examples for own in feats for f in own} | {"bias"})
    number = {f: i for i, f in enumerate(names)}
    pages_, longest = len(examples), max(len(y) for _, y in examples)
    block, feature = [], []
    labels, real = np.zeros((pages_, longest), int), np.zeros((pages_, longest), bool)
    for i, (feats, y) in enumerate(examples):
        labels[i, : len(y)], real[i, : len(y)] = y, True
        for t, own in enumerate(feats):
            for f in {*own, "bias"}:
                block.append(i * longest + t)
                feature.append(number[f])
    block, feature = np.array(block), np.array(feature)
    w, pair = np.zeros(len(names)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    both = real[:, 1:] & real[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    total = real.sum()
    for step in range(1, epochs + 1):
        s = np.bincount(block, w[feature], pages_ * longest).reshape(pages_, longest)
        e = np.stack([np.zeros_like(s), s], axis=2)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(real[:, t, None], e[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + pair, axis=1), forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            backward[:, t] = np.where(both[:, t, None], np.logaddexp.reduce(pair + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        p1 = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None])
        gw = np.bincount(feature, ((labels - p1) * real).ravel()[block], len(w)) - 0.02 * w
        joint = np.exp(forward[:, :-1, :, None] + pair + (e + backward)[:, 1:, None, :] - z[:, None, None, None])
        gp = seen - (joint * both[:, :, None, None]).sum(axis=(0, 1)) - 0.02 * pair
        for x, g, m, v in ((w, gw / total, state[0], state[1]), (pair, gp / total, state[2], state[3])):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 1e-4}, pair)


def example(page: str) -> tuple[list[tuple[str, ...]], list[int]]:
    """Features and labels of a marked page; marks do not enter the features."""
    feats, y = [], []
    for text, own in blocks(page):
        bare = text.replace("\x01", "").replace("\x02", "").strip()
        feats.append((*(f for f in own if not f.startswith(("length:", "end:", "copyright:"))), *(f for f in _look(bare or ".", 0.0) if not f.startswith("linked:"))))
        y.append(int("\x01" in text))
    return feats, y


@lru_cache(maxsize=2)
def trained(n: int = PAGES, seed: int = 1) -> Field:
    """A field fitted to n labelled pages (bounded: they are made here)."""
    return fit([x for x in map(example, pages(n, seed)) if x[0]])


def main_text(page: str, field: Field) -> str:
    found = list(blocks(page))
    if not found:
        return ""
    return " ".join(text for (text, _), y in zip(found, field.decode([f for _, f in found]), strict=True) if y)


def extract(web: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row: the article's blocks, joined by one space.

    Null and empty pages, and pages without an article, give an empty text. Broken markup is read leniently (an
    unfinished last tag is dropped, unclosed elements end with their parents, self-closing ones at once). What drawings
    and formulas (svg, math) say is text of the block they stand in, but for their titles and styles. Equal rows each get their row; other
    columns are ignored.
    """
    field = field or trained()

    def per_batch(batches):
        for batch in batches:
            texts = [main_text(p.as_py() or "", field) for p in batch.column("html")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = web.schema["page_id"].dataType.simpleString()
    return web.select("page_id", "url", "html").mapInArrow(per_batch, f"page_id {kind}, url string, text string, n_chars bigint")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
