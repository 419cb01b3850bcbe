"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. A byte that ends a stretch of eight
bytes seen up to 32 bytes before has another vector than the same byte elsewhere. These vectors and learned
filters give one activation per filter and position, max-pooled over a chunk; the mean and the maximum over a text's chunks go
through one dense layer into a probability. For scoring, byte vectors and filters are folded into one table per
filter tap, so a position costs a few table rows.

Fitting uses a bounded, seeded sample of labelled rows (``sample`` is the bound) on the driver. Scoring is a map
over the rows and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, seeded_order, smallest, whole

#: A chunk is four blocks of positions; the next one starts three blocks on, so chunks overlap by a block.
SPAN, PER_CHUNK, STEP = 128, 4, 3
TAPS, FILTERS, WIDTH = 5, 16, 8
#: Dense inputs: mean, maximum and minimum over chunks, the logarithm of the length, the intercept.
INPUTS = 3 * FILTERS + 2
SAMPLE, EPOCHS, BATCH, RATE, SEED = 3000, 8, 32, 0.01, 11
CUT = 0.3
TILE = 16384
#: A repeated stretch, the farthest it may lie back, and the zero bytes between texts that keep them apart.
STRETCH, BACK = 8, 32
PAD = STRETCH + BACK
SYMBOLS = 512


@dataclass
class ByteNet:
    vectors: np.ndarray  # SYMBOLS x WIDTH
    filters: np.ndarray  # TAPS x WIDTH x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # INPUTS

    @classmethod
    def fresh(cls, share: float) -> ByteNet:
        rng = np.random.default_rng(SEED)
        start = np.log(share / (1 - share))
        dense = np.concatenate((rng.normal(0, 0.1, 3 * FILTERS), [0.0, start]))
        return cls(rng.normal(0, 0.5, (SYMBOLS, WIDTH)), rng.normal(0, 0.3, (TAPS, WIDTH, FILTERS)), np.zeros(FILTERS), dense)

    def tables(self) -> np.ndarray:
        """TAPS x SYMBOLS x FILTERS; the bias is in the first tap's."""
        t = np.einsum("bw,twf->tbf", self.vectors, self.filters)
        t[0] += self.bias
        return np.ascontiguousarray(t, dtype=np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.dense]


def _repeated(data: bytes) -> np.ndarray:
    """Which bytes end a stretch of STRETCH bytes that also ends 2 to BACK bytes earlier."""
    n = len(data) - STRETCH + 1
    stretch = np.empty(n, np.uint64)
    for k in range(min(STRETCH, n)):
        stretch[k::STRETCH] = np.frombuffer(data, "<u8", len(stretch[k::STRETCH]), k)
    seen = np.zeros(len(data), bool)
    for lag in range(2, BACK + 1):
        seen[STRETCH - 1 + lag :] |= stretch[lag:] == stretch[:-lag]
    return seen


class Bytes:
    """Texts laid end to end as bytes, with the blocks and chunks of filter positions of each.

    A text has a position for every byte that TAPS bytes fit at, one at least (zero bytes fill up short texts).
    """

    def __init__(self, texts: Sequence[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.length = np.array([len(r) for r in raw])
        data = bytes(PAD) + b"".join(r + bytes(PAD) for r in raw)
        self.flat = np.frombuffer(data, np.uint8).astype(np.intp) + 256 * _repeated(data)
        begin = PAD + np.concatenate(([0], np.cumsum(self.length + PAD)[:-1])) if raw else np.zeros(0, np.int64)
        positions = np.maximum(1, self.length - TAPS + 1)
        self.n = int(begin[-1] + positions[-1]) if raw else 0
        blocks = -(-positions // SPAN)
        # starts of all blocks and, after each text, of the gap that belongs to none
        first = np.concatenate([np.append(b + SPAN * np.arange(k), b + p) for b, k, p in zip(begin, blocks, positions)]) if raw else np.zeros(0, np.int64)
        self.cuts, lead = first[:-1] if raw else first, np.concatenate(([0], np.cumsum(blocks + 1)[:-1])) if raw else first
        self.chunks = np.maximum(1, -(-(blocks - 1) // STEP))
        self.starts = np.concatenate(([0], np.cumsum(self.chunks)[:-1])) if raw else first
        own = np.arange(self.chunks.sum()) - np.repeat(self.starts, self.chunks)
        offset = own[:, None] * STEP + np.arange(PER_CHUNK)
        offset = np.minimum(offset, np.repeat(blocks, self.chunks)[:, None] - 1)
        self.blocks = np.repeat(lead, self.chunks)[:, None] + offset
        self.spans = np.stack([first[self.blocks[:, 0]], first[self.blocks[:, -1] + 1]], axis=1) if raw else np.zeros((0, 2), np.int64)


def activations(tables: np.ndarray, data: Bytes) -> np.ndarray:
    act = np.empty((data.n, FILTERS), np.float32)
    more = np.empty((min(TILE, data.n), FILTERS), np.float32)
    for s in range(0, data.n, TILE):
        here = act[s : s + TILE]
        np.take(tables[0], data.flat[s : s + len(here)], axis=0, out=here, mode="clip")
        for k in range(1, TAPS):
            here += np.take(tables[k], data.flat[s + k : s + k + len(here)], axis=0, out=more[: len(here)], mode="clip")
    return act


def pooled(act: np.ndarray, data: Bytes) -> np.ndarray:
    """Largest activation of every filter in every chunk."""
    return np.maximum.reduceat(act, data.cuts, axis=0)[data.blocks].max(axis=1)


def _features(best: np.ndarray, data: Bytes) -> np.ndarray:
    h = np.maximum(best, 0)
    mean = np.add.reduceat(h, data.starts, axis=0) / data.chunks[:, None]
    size = np.log1p(data.length)[:, None] / 10
    return np.hstack([mean, np.maximum.reduceat(h, data.starts, axis=0), np.minimum.reduceat(h, data.starts, axis=0), size, np.ones_like(size)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _crop(text: str, rng: np.random.Generator) -> str:
    """A short stretch of a good text, which is good as well: short texts are rare among the labelled ones."""
    n = int(np.exp(rng.uniform(np.log(16), np.log(400))))
    at = int(rng.integers(0, max(1, len(text) - n)))
    return text[at : at + n].strip()


def fit(texts: Sequence[str], labels: Sequence[int], epochs: int = EPOCHS) -> ByteNet:
    """Adam on the log loss. Without labelled texts the network answers the prior of one half."""
    y = np.asarray(labels, np.float64)
    net = ByteNet.fresh((y.sum() + 1) / (len(y) + 2))
    parts = net.parts()
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    rng = np.random.default_rng(SEED + 1)
    for epoch in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        for b in range(0, len(y), BATCH):
            pick = order[b : b + BATCH]
            target, crops = y[pick], [_crop(texts[i], rng) for i in pick if y[i] == 1]
            target = np.concatenate((target, np.ones(len(crops))))
            data = Bytes([texts[i] for i in pick] + crops)
            act = activations(net.tables(), data)
            best = pooled(act, data)
            x = _features(best, data)
            dz = (_sigmoid(x @ net.dense) - target) / len(target)
            g_dense = dz @ x
            doc = np.repeat(np.arange(len(target)), data.chunks)
            dh = (dz / data.chunks)[doc][:, None] * net.dense[:FILTERS]
            h = np.maximum(best, 0)
            for part in (1, 2):
                cols = slice(part * FILTERS, (part + 1) * FILTERS)
                dh += np.where(h == x[doc][:, cols].astype(np.float32), dz[doc][:, None] * net.dense[cols], 0)
            dh *= best > 0
            at = np.stack([s + act[s:e].argmax(axis=0) for s, e in data.spans])
            g_bias, g_filters, g_vectors = dh.sum(axis=0), np.zeros_like(net.filters), np.zeros_like(net.vectors)
            cols = np.broadcast_to(np.arange(FILTERS), dh.shape)
            for k in range(TAPS):
                seen = np.zeros((SYMBOLS, FILTERS))
                np.add.at(seen, (data.flat[at + k], cols), dh)
                g_filters[k] = net.vectors.T @ seen
                g_vectors += seen @ net.filters[k].T
            step += 1
            for p, g, m, v in zip(parts, (g_vectors, g_filters, g_bias, g_dense + 1e-4 * net.dense), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def score_texts(net_tables: np.ndarray, dense: np.ndarray, texts: Sequence[str]) -> np.ndarray:
    """Probability of label 1 for whole texts; memory follows the longest text."""
    out = []
    for s in range(0, len(texts), 64):
        data = Bytes(texts[s : s + 64])
        out.append(_sigmoid(_features(pooled(activations(net_tables, data), data), data) @ dense))
    return np.concatenate(out) if out else np.zeros(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``sample`` labelled rows that are not held out, in a seeded order of ids.

    Null ids and labels are left out; an id with several labels takes the largest, one with several texts the
    smallest text. Only the sample reaches the driver.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    few = smallest(known, sample, seeded_order(SEED, F.col("_id")))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), whole(F.col(text_col)).alias("_t")).join(F.broadcast(few), "_id")
    rows = texts.groupBy("_id", "_y").agg(F.min("_t").alias("_t")).orderBy("_id").collect()
    return [r["_t"] for r in rows], [r["_y"] for r in rows]


def quality_score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """A function from a text column to its score column, fitted on a bounded sample of ``labels.quality``."""
    net = fit(*labelled_sample(docs, labels, "quality", sample, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast((net.tables(), net.dense))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [score_texts(*shared.value, texts.slice(at, 64).to_pylist()) for at in range(0, len(texts), 64)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    def of(text: Column) -> Column:
        return score(text)

    return of


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null and empty texts are scored as one position of zero bytes. A null id counts as not held out here but has no
    label to learn from. Rows that repeat an id have one row each; other columns are not read. Empty documents
    give an empty result, empty labels the score of an untrained network around one half.
    """
    score = quality_score(docs, labels, sample, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(whole(F.col(text_col))).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
