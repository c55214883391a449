r"""Toxicity (operator 8): non-negative positive-unlabelled learning with numpy.

Confirmed toxic examples (labelled rows of the training part) and unlabelled text train a linear
classifier over the presence of hashed words, word pairs and word beginnings. Columns are chosen by how much more often they stand in
positives than in unlabelled text; the weights minimise the class-prior-corrected risk

    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))

with the logistic loss: where the second term falls below zero, the step goes back up its gradient instead.
Negative labels are not examples; the prior is the share of toxic rows among training labels. At most
`MOST_POSITIVE` and `MOST_UNLABELLED` texts of `MOST_BYTES` each (chosen by hash of doc_id, from training rows)
are fitted, on `COLUMNS` features: bounds of the fit alone. Scoring is one pass without a shuffle.

Null and empty texts score by the bias alone. A doc_id labelled twice is toxic if any label says so.
Of texts that repeat a doc_id the one of the smallest hash is learned from; equal texts get equal scores. Very
long texts are read whole. Without positives every score is about 0; an empty table gives an empty result. A null
doc_id is scored, held_out false. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import table
from inkstone.llm._models import chosen, remainder, with_text
from inkstone.llm._words import ALNUM, Words, mix, powers, prefix_hash, slices

BITS = 20
MOST_POSITIVE = 3_000
MOST_UNLABELLED = 9_000
#: Bytes of the texts of each of the two.
MOST_BYTES = 64 << 20
#: Features of the classifier.
COLUMNS = 1_024
#: Bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Columns whose likelihood ratio (nats) could be chance among 2^20 are left out.
LEAST_GAIN = 12.0


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, bucket) of the hashed words, word pairs and word beginnings, repeats included, and the number of texts."""
    w = Words(texts, ALNUM)
    text = w.text_of()
    same = text[1:] == text[:-1]
    pair = (mix(w.hash[:-1] + np.uint64(0x9E3779B97F4A7C15)) + w.hash[1:])[same]
    rows, hashes = [text, text[1:][same]], [w.hash, pair]
    s = prefix_hash(w.data)
    inv = powers(len(s))[1]
    for n in BEGINNINGS:
        at = np.flatnonzero(w.end - w.start >= n)
        a = w.start[at]
        rows.append(text[at])
        hashes.append((s[a + n] - s[a]) * inv[a] + np.uint64(n))
    return np.concatenate(rows), (mix(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int64), len(w.counts)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            rows, bucket, n = presence(batch.column(2).slice(lo, hi - lo))
            both = np.unique(rows << BITS | bucket)
            first = np.searchsorted(both, np.arange(n + 1) << BITS)
            own = (both & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    batch.column(3).slice(lo, hi - lo),
                    pa.array([own[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                ],
                names=["doc_id", "positive", "h", "i"],
            )


def choose_columns(pos: list[np.ndarray], unl: list[np.ndarray], most: int = COLUMNS) -> np.ndarray:
    """Buckets by the log ratio of their smoothed shares in positives and unlabelled texts, weighted by support."""
    size = 1 << BITS
    p = np.bincount(np.concatenate(pos), minlength=size) if pos else np.zeros(size)
    u = np.bincount(np.concatenate(unl), minlength=size) if unl else np.zeros(size)
    a, b = (p + 0.5) / (len(pos) + 1), (u + 0.5) / (len(unl) + 1)
    gain = a * np.log(a / b) + (1 - a) * np.log(np.maximum(1 - a, 1e-9) / np.maximum(1 - b, 1e-9))
    gain[(p < 3) | (a < 1.5 * b) | (gain * len(pos) < LEAST_GAIN)] = 0
    top = np.argsort(-gain, kind="stable")[:most]
    return np.sort(top[gain[top] > 0])


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam on shuffled batches."""
    rng = np.random.default_rng(8)
    w = np.zeros(xp.shape[1] + 1)
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        bp = xp[rng.integers(0, len(xp), min(len(xp), 512))]
        bu = xu[rng.integers(0, len(xu), min(len(xu), 2048))]
        sp, su = bp @ w[:-1] + w[-1], bu @ w[:-1] + w[-1]
        qp, qu = 1 / (1 + np.exp(-np.clip(sp, -35, 35))), 1 / (1 + np.exp(-np.clip(su, -35, 35)))
        # d/ds log(1 + e^-s) = q - 1 for the positive loss, d/ds log(1 + e^s) = q for the negative one
        negative = np.mean(np.logaddexp(0, su)) - prior * np.mean(np.logaddexp(0, sp))
        g_plus = prior * _mean(bp, qp - 1)
        g_minus = _mean(bu, qu) - prior * _mean(bp, qp)
        g = g_plus + g_minus if negative >= 0 else -g_minus
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _mean(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.append(r @ x, r.sum()) / len(r)


def train(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) from positives(doc_id) and unlabelled(doc_id)."""
    found: dict[tuple, np.ndarray] = {}
    hashes: dict[tuple, int] = {}
    for positive, ids, most, salt in ((True, positives, MOST_POSITIVE, 8), (False, unlabelled, MOST_UNLABELLED, 9)):
        few = chosen(ids, most, salt).withColumn("positive", F.lit(positive))
        texts = with_text(docs, few, MOST_BYTES, salt).select("doc_id", "positive", "text", "_h")
        for batch in texts.mapInArrow(_gather, "doc_id long, positive boolean, h long, i binary").toArrow().to_batches():
            for d, p, h, i in zip(*batch.columns, strict=True):
                key, h = (d.as_py(), p.as_py()), h.as_py()
                if key not in hashes or h < hashes[key]:
                    hashes[key] = h
                    found[key] = np.frombuffer(i.as_py(), np.int32)
    keys = sorted(found)
    pos, unl = [found[k] for k in keys if k[1]], [found[k] for k in keys if not k[1]]
    columns = choose_columns(pos, unl)
    if not pos or not unl or not len(columns):
        return columns[:0], np.zeros(0), -35.0

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(columns)), dtype=np.float32)
        for r, i in enumerate(rows):
            at = np.searchsorted(columns, i)
            at[at == len(columns)] = 0
            x[r, at[columns[at] == i]] = 1
        return x

    w, b = fit_nnpu(dense(pos), dense(unl), prior)
    return columns, w, b


def _score(keep: int, columns: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, dtype=np.int32)
        number[columns] = np.arange(len(columns))
        for batch in batches:
            for lo, hi in slices(batch.column(keep)):
                rows, bucket, n = presence(batch.column(keep).slice(lo, hi - lo))
                at = number[bucket]
                known = at >= 0
                both = np.unique(rows[known] * max(len(columns), 1) + at[known])
                s = bias + np.bincount(both // max(len(columns), 1), weights=weights[both % max(len(columns), 1)], minlength=n)
                yield pa.record_batch(
                    [batch.column(c).slice(lo, hi - lo) for c in range(keep)] + [pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))],
                    names=[*batch.schema.names[:keep], "score"],
                )

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str]) -> DataFrame:
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(_score(len(keep), *model), f"{fields}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = (
        table(spark, sf_dir, "labels")
        .where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    prior = known.agg(F.avg(F.col("toxic").cast("int"))).first()[0] or 0.0
    positives = known.where("toxic").select("doc_id")
    unlabelled = docs.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id").distinct()
    model = train(docs, positives, unlabelled, min(max(prior, 1e-3), 0.9))
    out = score(docs, model, ["doc_id"])
    return out.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
