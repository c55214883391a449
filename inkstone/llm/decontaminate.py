r"""Benchmark decontamination (operator 10): an FM-index for each shard of training text.

Windows are 13 consecutive words of a benchmark item (a shorter item is one window). The benchmark is read
in blocks of bounded size, each broadcast once; every training shard (about `SHARD_WORDS` words of whole
documents) is indexed against each block:

* words of the block's vocabulary are its alphabet; any other word, and each document's end, is a
  terminator, equal to nothing. Runs shorter than the shortest window hold no occurrence and are left out.
* the runs' suffixes are sorted (prefix doubling), giving the Burrows-Wheeler transform, whose wavelet
  matrix answers rank queries;
* all windows are searched backwards at once; ranges that stay open are located by stepping back to
  sampled suffix positions (every 16th, and every start of a run);
* occurrences are merged into removal spans.

Nothing is shuffled: texts stay in their partitions. Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after
lower-casing A-Z. Null or empty texts: no words, nothing hit. Benchmark rows without words are ignored,
those with a null item_id hit but are not listed; equal item_ids count once. Repeated documents are
judged one by one. Very long texts are indexed whole, in a shard of their own. An empty table gives an empty
result, an empty benchmark hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import table
from inkstone.llm._words import ALNUM, Words, slices

WINDOW = 13
SHARD_WORDS = 1 << 18
#: A block of the benchmark: at most so many bytes of text (or one item).
BLOCK_BYTES = 16 << 20
SAMPLE = 16


class Windows:
    """The distinct windows of some items over their own alphabet (symbols from 1; 0 terminates)."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW):
        w = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.vocabulary = np.unique(w.hash)
        symbols = np.searchsorted(self.vocabulary, w.hash).astype(np.int32) + 1
        rows: dict[bytes, int] = {}
        lists: list[set] = []
        for d, (item, _) in enumerate(items):
            lo, n = w.first[d], int(w.counts[d])
            for i in range(max(n - window, 0) + 1) if n else ():
                key = symbols[lo + i : lo + min(i + window, n)].tobytes()
                at = rows.setdefault(key, len(lists))
                if at == len(lists):
                    lists.append(set())
                if item is not None:
                    lists[at].add(item)
        self.length = np.array([len(k) // 4 for k in rows], dtype=np.int64)
        self.shortest = int(self.length.min()) if len(rows) else 0
        self.items = [sorted(s) for s in lists]
        # Right-aligned: column 0 is the last word.
        self.symbols = np.zeros((len(rows), int(self.length.max()) if len(rows) else 0), dtype=np.int32)
        for i, k in enumerate(rows):
            self.symbols[i, : self.length[i]] = np.frombuffer(k, dtype=np.int32)[::-1]

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of t in order; zeros end a suffix and are ordered by position."""
    n = len(t)
    stops = np.flatnonzero(t == 0)
    rank = t.astype(np.int64) + len(stops)
    rank[stops] = np.arange(len(stops))
    order = np.argsort(rank, kind="stable")
    rank = _ranks(order, rank[order])
    open_ = np.flatnonzero(_shared(rank[order]))  # places in the order that are not settled
    h = 1
    while len(open_):
        at = order[open_]
        follow = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        by = np.lexsort((follow, rank[at]))
        at, follow, base = at[by], follow[by], rank[at[by]]
        order[open_] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (base[1:] != base[:-1]) | (follow[1:] != follow[:-1])
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_ = open_[_shared(rank[at])]
        h *= 2
    return order


def _ranks(order: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Rank of each suffix: the first place of its key in the order."""
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def _shared(sorted_ranks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sorted_ranks), dtype=bool)
    eq = sorted_ranks[1:] == sorted_ranks[:-1]
    out[1:] |= eq
    out[:-1] |= eq
    return out


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with running counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(int(top).bit_length(), 1)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        lo, hi = np.zeros(len(i), dtype=np.int64), i.astype(np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, z = self.ones[level][lo], self.ones[level][hi]
            lo = np.where(one, self.zeros[level] + a, lo - a)
            hi = np.where(one, self.zeros[level] + z, hi - z)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        i, out = i.astype(np.int64), np.zeros(len(i), dtype=np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            one = ones[i + 1] > ones[i]
            out = out * 2 + one
            i = np.where(one, self.zeros[level] + ones[i], i - ones[i])
        return out


class FMIndex:
    """t: symbols from 1, zeros as terminators; t must end with one."""

    def __init__(self, t: np.ndarray, sample: int = SAMPLE):
        sa = suffix_array(t)
        before = t[sa - 1]  # of suffix 0: the last terminator
        self.n, top = len(t), int(t.max()) if len(t) else 0
        self.matrix = WaveletMatrix(before, top)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=top + 1))])
        kept = (sa % sample == 0) | (before == 0)
        self.sampled = np.concatenate([[0], np.cumsum(kept)])
        self.position = sa[kept]
        self.top = top

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns given from their last symbol backwards."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(length[live] > step) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = patterns[live, step]
            known = c <= self.top
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live], hi[live] = (
                self.start[c] + self.matrix.rank(c, lo[live]),
                self.start[c] + self.matrix.rank(c, hi[live]),
            )
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.sampled[row + 1] > self.sampled[row]
            out[todo[done]] = self.position[self.sampled[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            c = self.matrix.access(row)
            row = self.start[c] + self.matrix.rank(c, row)
            steps += 1
        return out


def occurrences(w: Words, windows: Windows, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in the texts of w."""
    none = np.zeros(0, dtype=np.int64)
    if not len(w.hash) or not windows.shortest:
        return none, none
    symbol = windows.encode(w.hash)
    word = np.arange(len(symbol))
    text = w.text_of()
    # Runs of vocabulary words inside one text, each followed by one terminator.
    inside = symbol > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
    at = np.flatnonzero(begins)
    if not len(at):
        return none, none
    run = np.cumsum(begins) - 1
    size = np.bincount(run[inside], minlength=len(at))
    keep = inside & (size[run] >= windows.shortest)
    word = word[keep]
    if not len(word):
        return none, none
    last = np.ones(len(word), dtype=bool)
    last[:-1] = run[word][1:] != run[word][:-1]
    place = np.arange(len(word)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    t = np.zeros(len(word) + int(last.sum()), dtype=np.int32)
    back = np.zeros(len(t), dtype=np.int64)
    t[place], back[place] = symbol[word], word
    index = FMIndex(t, sample)
    lo, hi = index.search(windows.symbols, windows.length)
    found = np.flatnonzero((hi > lo) & (windows.length > 0))
    many = (hi - lo)[found]
    which = np.repeat(found, many)
    rows = np.repeat(lo[found], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return back[index.locate(rows)], which


_OUT = "n_words long, n_hit long, items array<string>, spans array<struct<lo:long,hi:long>>"
_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _shards(blocks: list, keep: int):
    """Rows of `keep` columns and the text (last) to `keep` columns, counts, items and byte spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(keep), SHARD_WORDS * 7):
                w = Words(batch.column(keep).slice(lo, hi - lo), ALNUM)
                text = w.text_of()
                items: list[set] = [set() for _ in range(hi - lo)]
                edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
                for block in blocks:
                    windows = block.value
                    at, which = occurrences(w, windows)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + windows.length[which], -1)
                    pair = np.unique(text[at] * max(len(windows.items), 1) + which) if len(at) else at
                    for p in pair.tolist():
                        items[p // len(windows.items)].update(windows.items[p % len(windows.items)])
                hit = np.cumsum(edge[:-1]) > 0
                n_hit = np.bincount(text[hit], minlength=hi - lo)
                spans: list[list] = [[] for _ in range(hi - lo)]
                first = hit.copy()
                first[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
                final = hit.copy()
                final[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
                for a, z in zip(np.flatnonzero(first), np.flatnonzero(final), strict=True):
                    d = text[a]
                    spans[d].append({"lo": int(w.start[a] - w.offsets[d]), "hi": int(w.end[z] - w.offsets[d])})
                yield pa.record_batch(
                    [batch.column(c).slice(lo, hi - lo) for c in range(keep)]
                    + [
                        pa.array(w.counts.astype(np.int64)),
                        pa.array(n_hit.astype(np.int64)),
                        pa.array([sorted(map(str, s)) for s in items], pa.list_(pa.string())),
                        pa.array(spans, _SPANS),
                    ],
                    names=[*batch.schema.names[:keep], "n_words", "n_hit", "items", "spans"],
                )

    return run


def _blocks(benchmark: DataFrame, size: int) -> list:
    """Broadcast handles of the benchmark's windows, a bounded block each."""
    sc = benchmark.sparkSession.sparkContext
    out, block, held = [], [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if block and held + len(row["text"]) > size:
            out.append(sc.broadcast(Windows(block)))
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
    if block:
        out.append(sc.broadcast(Windows(block)))
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` columns of docs, n_words, n_hit, items (sorted strings) and spans (byte ranges to remove)."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    blocks = _blocks(benchmark, block_bytes)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(_shards(blocks, len(keep)), f"{fields}, {_OUT}")


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its removal spans."""
    raw, out, at = text.encode(), b"", 0
    for lo, hi in spans:
        out += raw[at:lo]
        at = hi
    return (out + raw[at:]).decode()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )
