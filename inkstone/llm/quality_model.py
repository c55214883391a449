r"""Quality classifier (operator 6): hashed word n-grams, logistic regression by FTRL-proximal updates.

Features of a text, hashed into 2^20 weights: each word, each pair of neighbouring words, and the same of
the words' shapes (letters, digits and marks in runs: `THE!!` is `A!`), each kind scaled by 1 / sqrt(its
number) so that long and short texts weigh alike, and two buckets that stand for the text's length and
its share of repeated three-word windows. Labels come only from training rows, at most `MOST` of them with
`MOST_BYTES` of text, chosen by hash of doc_id; their features are gathered once and updates are made example by example
(per-coordinate rates, L1 and L2), `EPOCHS` times, on the driver. Scoring is one pass without a shuffle: a
sparse dot product for each text.

Null and empty texts have the bias and the length bucket only. Labels of a doc_id that repeats count
once (the smaller); of texts that repeat a labelled doc_id the one of the smallest hash is learned from. Equal
texts get equal scores. Very long texts are read whole. Without training rows every score is 0.5; an empty table
gives an empty result. A null doc_id is scored, held_out false. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import table
from inkstone.llm._models import chosen, remainder, with_text
from inkstone.llm._words import SPACED, Words, mix, prefix_hash, powers, slices

BITS = 20
#: The documented bounds of the training sample: labelled rows, and bytes of their texts.
MOST = 6_000
MOST_BYTES = 48 << 20
EPOCHS = 3
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def shapes(w: Words) -> np.ndarray:
    """A hash of each word's shape: its byte classes with runs collapsed."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    c = _CLASS[w.data]
    keep = np.ones(len(c), dtype=bool)
    np.not_equal(c[1:], c[:-1], out=keep[1:])
    keep[w.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    s = prefix_hash(c[keep])
    a, b = at[w.start], at[w.end]
    return mix((s[b] - s[a]) * powers(len(s))[1][a] + (b - a).astype(np.uint64))


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, first): hashed features of text d in first[d]:first[d + 1]."""
    w = Words(texts, SPACED, lower=False)
    n = len(w.counts)
    text = w.text_of()
    shape = shapes(w)
    same = text[1:] == text[:-1]
    k = np.uint64(0x9E3779B97F4A7C15)
    kinds = [
        (text, w.hash + np.uint64(1)),
        (text[1:][same], (mix(w.hash[:-1] + k) + w.hash[1:])[same]),
        (text, shape + np.uint64(2)),
        (text[1:][same], (mix(shape[:-1] + k + k) + shape[1:])[same]),
    ]
    rows, index, value = [], [], []
    for who, h in kinds:
        count = np.bincount(who, minlength=n)
        rows.append(who)
        index.append((mix(h) >> np.uint64(64 - bits)).astype(np.int64))
        value.append((1.0 / np.sqrt(np.maximum(count, 1)))[who])
    triple = np.zeros(0, np.int64)
    repeated = np.zeros(n)
    if len(text) > 2:
        triple = np.flatnonzero(text[2:] == text[:-2])
        key = mix(mix(w.hash[triple] + k) + mix(w.hash[triple + 1] + k + k) + w.hash[triple + 2] + text[triple].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        total = np.maximum(np.bincount(text[triple], minlength=n), 1)
        repeated = np.bincount(text[triple], weights=times[back] > 1, minlength=n) / total
    length = np.floor(2 * np.log2(w.counts + 1)).astype(np.int64)
    share = np.ceil(10 * repeated).astype(np.int64)
    for salt, bucket in ((3, length), (4, share)):
        rows.append(np.arange(n))
        index.append((mix(bucket.astype(np.uint64) * k + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64))
        value.append(np.ones(n))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(index)[order], np.concatenate(value)[order].astype(np.float32), np.searchsorted(row[order], np.arange(n + 1))


class Ftrl:
    """FTRL-proximal logistic regression; weights are made from the sums z and n when needed."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        i, where = np.unique(index, return_inverse=True)
        x = np.bincount(where, weights=value)
        i, x = np.append(i, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            index, value, first = features(batch.column(2).slice(lo, hi - lo))
            cut = lambda a, d: a[first[d] : first[d + 1]].tobytes()
            yield pa.record_batch(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    batch.column(3).slice(lo, hi - lo),
                    pa.array([cut(index.astype(np.int32), d) for d in range(hi - lo)], pa.binary()),
                    pa.array([cut(value, d) for d in range(hi - lo)], pa.binary()),
                ],
                names=["doc_id", "y", "h", "i", "v"],
            )


def train(docs: DataFrame, labelled: DataFrame, most: int = MOST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from labelled(doc_id, y): 2^BITS of them and the bias."""
    few = chosen(labelled, most, 6)
    texts = with_text(docs, few, MOST_BYTES, 6).select("doc_id", "y", "text", "_h")
    rows = texts.mapInArrow(_gather, "doc_id long, y int, h long, i binary, v binary")
    model = Ftrl()
    examples: dict[int, tuple] = {}
    hashes: dict[int, int] = {}
    for batch in rows.toArrow().to_batches():
        for d, y, h, i, v in zip(*batch.columns, strict=True):
            d, h = d.as_py(), h.as_py()
            if d not in hashes or h < hashes[d]:
                hashes[d] = h
                examples[d] = (np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32), y.as_py())
    ids = sorted(examples)
    rng = np.random.default_rng(6)
    for _ in range(epochs):
        for at in rng.permutation(len(ids)):
            model.learn(*examples[ids[at]])
    return model.weights(np.arange(len(model.z))).astype(np.float32)


def _score(keep: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(keep)):
                index, value, first = features(batch.column(keep).slice(lo, hi - lo))
                dot = np.concatenate([[0.0], np.cumsum(weights[index] * value.astype(np.float64))])
                s = dot[first[1:]] - dot[first[:-1]] + float(weights[-1])
                yield pa.record_batch(
                    [batch.column(c).slice(lo, hi - lo) for c in range(keep)] + [pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))],
                    names=[*batch.schema.names[:keep], "score"],
                )

    return run


def score(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(_score(len(keep), weights), f"{fields}, score double")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = (
        table(spark, sf_dir, "labels")
        .where(F.col("quality").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).cast("int").alias("y"))
    )
    out = score(docs, train(docs, labelled), ["doc_id"])
    return out.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
