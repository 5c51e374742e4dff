"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover it wholly. Each byte is embedded, filters of eight bytes slide
over a chunk in steps of STEP bytes, each filter's greatest response is kept (max-pooling), and the mean and the maximum over all chunks
enter one logistic unit. The network is trained here, on labelled documents only; a score depends on text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import arrays as A
from vaultframe.llm.common import named, numbered, read, text_of

#: Bytes of a chunk, bytes from one chunk to the next; bytes between two places of a filter, which spans two such steps.
CHUNK, STRIDE, STEP = 512, 448, 4
WIDTH, FILTERS = 8, 32
#: Bounds of the training sample: documents, and chunks of a document, as many as cover SAMPLE_BYTES bytes; of a longer
#: document they are spread over the whole. Scoring has no such bounds.
SAMPLE, SAMPLE_BYTES = 4000, 16_384
SAMPLE_CHUNKS = -(-(SAMPLE_BYTES - CHUNK + STRIDE) // STRIDE)
EPOCHS, MOST_EPOCHS, BATCH, RATE = 14, 100, 64, 4e-3
#: A document is predicted good from this score.
CUT = 0.7
PAD = 256


def spread(text: bytes, most: int = SAMPLE_CHUNKS) -> bytes:
    """The chunks of a text laid end to end; of more than `most`, so many at even distances, the first and the last included."""
    count = max(1, -(-(len(text) - CHUNK + STRIDE) // STRIDE))
    nth = range(count) if count <= most else [k * (count - 1) // (most - 1) for k in range(most)]
    return b"".join(text[k * STRIDE : k * STRIDE + CHUNK] for k in nth)


def chunked(data: np.ndarray, offsets: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, CHUNK) byte numbers, PAD after the end; the bytes in each chunk; chunks of each text (one at least)."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-(size - CHUNK + stride) // stride))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(offsets[:-1], count) + nth * stride
    held = np.clip(np.repeat(offsets[1:], count) - start, 0, CHUNK)
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    x = padded[np.minimum(start, len(data))[:, None] + np.arange(CHUNK)].astype(np.int16)
    x[np.arange(CHUNK) >= held[:, None]] = PAD
    return x, held, count


class Network:
    """Parameters: e (bytes), w (filters over two steps), b, v (weights of mean and maximum), c."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (PAD + 1, WIDTH)), "w": r.normal(0, 0.25, (2 * STEP * WIDTH, FILTERS)),
            "b": np.zeros(FILTERS), "v": r.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.p["e"][PAD] = 0

    def responses(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedded chunks, and the greatest response of each filter with its place."""
        a = self.p["e"][x]
        half = STEP * WIDTH
        both = np.concatenate([self.p["w"][:half], self.p["w"][half:]], axis=1)
        u = (a.reshape(-1, half) @ both).reshape(len(x), CHUNK // STEP, 2 * FILTERS)
        z = u[:, :-1, :FILTERS] + u[:, 1:, FILTERS:]
        short = np.flatnonzero(held < CHUNK)
        z[short] = np.where((np.arange(CHUNK // STEP - 1) * STEP < held[short, None])[:, :, None], z[short], -1e9)
        at = z.argmax(axis=1) if self.training else None
        return a, np.maximum(z.max(axis=1) + self.p["b"], 0), at

    training = fitted = False

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for first, last in A.slices(offsets, 1 << 19):
            part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            x, held, count = chunked(part, at)
            pieces = [self.responses(x[k : k + 256], held[k : k + 256])[1] for k in range(0, len(x), 256)]
            r, begin = np.concatenate(pieces), np.cumsum(count) - count
            mean, top = np.add.reduceat(r, begin, axis=0) / count[:, None], np.maximum.reduceat(r, begin, axis=0)
            z = np.concatenate([mean, top], axis=1).astype(np.float64) @ self.p["v"].astype(np.float64) + float(self.p["c"][0])
            out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, x: np.ndarray, held: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, begin, n = self.p, np.cumsum(count) - count, len(y)
        a, r, at = self.responses(x, held)
        mean, top = np.add.reduceat(r, begin, axis=0) / count[:, None], np.maximum.reduceat(r, begin, axis=0)
        f = np.concatenate([mean, top], axis=1)
        dz = ((1 / (1 + np.exp(-np.clip(f @ p["v"] + p["c"], -40, 40))) - y) / n).astype(np.float32)
        df = dz[:, None] * p["v"]
        dr = np.repeat(df[:, :FILTERS] / count[:, None], count, axis=0)
        dr += np.repeat(df[:, FILTERS:], count, axis=0) * (r == np.repeat(top, count, axis=0))
        dr *= r > 0
        # Only the place of the greatest response carries a gradient.
        place = at[:, :, None] * STEP + np.arange(2 * STEP)
        chunk = np.arange(len(x))[:, None, None]
        window = a[chunk, place].reshape(len(x), FILTERS, -1)
        de_rows = (dr[:, :, None] * p["w"].T).reshape(-1, WIDTH)
        which = x[chunk, place].ravel()
        de = np.stack([np.bincount(which, de_rows[:, k], PAD + 1) for k in range(WIDTH)], axis=1).astype(np.float32)
        de[PAD] = 0
        return {"e": de, "w": np.einsum("cfk,cf->kf", window, dr), "b": dr.sum(axis=0), "v": f.T @ dz, "c": dz.sum(keepdims=True)}

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int | None = None) -> Network:
        """Adam on the logistic loss of texts as spread() gives them, in a fixed random order; a small sample is passed over more often."""
        self.training = True
        epochs = epochs or max(EPOCHS, min(MOST_EPOCHS, EPOCHS * SAMPLE // max(1, len(texts))))
        order = np.random.default_rng(11)
        raw = [np.frombuffer(t, np.uint8) for t in texts]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        total = epochs * -(-len(raw) // BATCH)
        for _ in range(epochs):
            for ids in np.array_split(order.permutation(len(raw)), -(-len(raw) // BATCH)):
                data = np.concatenate([raw[i] for i in ids])
                offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in ids])])
                g = self.gradients(*chunked(data, offsets, CHUNK), labels[ids])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, d in g.items():
                    d = d + 1e-5 * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.99 * second[k] + 0.01 * d * d
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self.training, self.fitted = False, True
        return self


def held_out():
    """Documents whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network fitted on labelled documents of any length, chosen by a hash of doc_id: `sample`, or a few more of a rare label.

    Labels of documents that are there are chosen first and are few, so texts are only scanned for them. Of a document
    the chunks that spread() takes come to the driver.

    Without labelled documents of both kinds the network is left as it began, not `fitted`, with every score near the
    share of label 1.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # A proven bound: at most `most` rows of two numbers. A rare label is not left to chance.
    most = sample + 2 * BATCH
    chosen = first(known, sample)
    for label in (0, 1):
        chosen = chosen.unionByName(first(known.where(F.col("quality") == label), BATCH))
    chosen = chosen.distinct()

    def per_batch(batches):
        for batch in batches:
            data, offsets = A.column_bytes(batch.column("text"))
            chunks = [spread(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("a", "b", "quality")), pa.array(chunks, pa.binary())], ["a", "b", "quality", "chunks"])

    kind = labels.schema["quality"].dataType.simpleString()
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = found.select(F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"), "quality", "text")
    rows = found.mapInArrow(per_batch, f"a bigint, b bigint, quality {kind}, chunks binary").orderBy("a", "b").limit(most).select("quality", "chunks").toPandas()
    y = rows["quality"].to_numpy(np.float32)
    net = Network()
    net.p["c"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(set(y.tolist())) < 2:
        net.p["v"][:] = 0
        return net
    net.fit([bytes(t) for t in rows["chunks"]], y)
    del rows
    A.give_back()
    return net


def scored(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with __score (0 to 1) as a last column; null and empty texts have a score like any other."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def per_batch(batches):
        for batch in batches:
            data, offsets = A.column_bytes(batch.column(text))
            yield pa.record_batch([*batch.columns, pa.array(net.scores(data, offsets))], [*batch.schema.names, "__score"])

    return docs.mapInArrow(A.tidy(per_batch), f"{kinds}, `__score` double")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document with its score; where no network could be fitted, that is the same number for all."""
    docs = read(spark, sf_dir, "documents")
    net = trained(docs, read(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", text_of().alias("text")), net)
    return out.select(
        "doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= CUT, 1).otherwise(0).alias("predicted")
    )


def good_only(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs without those that score below the cut; columns and repeated rows stay.

    Where labelled documents of both kinds are not found, nothing is known of quality and all documents stay.
    """
    net = trained(docs, labels)
    if not net.fitted:
        return docs
    plain, _, text = numbered(docs)
    return named(scored(plain, net, text).where(F.col("__score") >= cut), docs)


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
