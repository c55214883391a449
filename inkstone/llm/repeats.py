r"""Suffix-array dedup (operator 9): remove every byte covered by a 400-byte string that starts twice.

1. Anchors. Every 400-byte window of a text picks the leftmost smallest of its 50-byte gram hashes, so
   equal windows, wherever they stand, pick equal grams at equal offsets. About one position in 176 is
   an anchor; only anchors whose gram starts at two places or more can lie in a repeated window.
2. Suffix sort. At those anchors the text to the right (400 bytes) and to the left (350) is sorted by its
   bytes in each group of equal grams. Neighbours in both orders give each anchor the furthest extension shared
   with any other, hence the only window offsets that can repeat; the neighbours' common extensions, taken from
   the bytes, prove them. A member with offsets that no single neighbour proves is compared with all of its
   group, or, where such pairs are many, all windows of the group are hashed, sorted and compared byte by byte.
3. Groups of more than `HOT` anchors never meet in one task: every member is compared with one leader, which
   settles all windows inside what both share; for the rest it goes on in two narrower groups (see
   `_follow`), which are sorted, or get leaders of their own, in the next round. A group is named by the bytes
   its members share on both sides of the anchor; these grow with every round, so the rounds end.
4. Spans are merged per text.

Equal texts are one text (by 128 bits of SHA-256); of 400 bytes or more they vanish wholly. Runs with a short
period keep anchors only near their ends, their inside is repeated by itself. Null text: empty; texts under 400
bytes keep everything. Rows may repeat a doc_id or have none: results belong to the text. Very long texts are
read whole, in pieces that overlap by a window. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import cut, release, table
from inkstone.llm._graph import Sieve
from inkstone.llm._words import buffers, mix, powers, prefix_hash, slices, trim

LENGTH = 400
GRAM = 50
REACH = LENGTH - GRAM
#: Anchors with equal grams that one task may sort together.
HOT = 4_000
#: Leaders of hot groups that are broadcast, at most.
LEADERS = 64_000
#: Anchors sorted at a time (whole groups): some MB of arrays.
PART = 1_024
#: What comparing a pair of anchors costs, in windows hashed and sorted.
PAIR_COST = 4
_PIECE = 1 << 22


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for each i, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    m = -(-len(x) // w) * w
    y = np.full(m, np.iinfo(x.dtype).max, dtype=x.dtype)
    y[: len(x)] = x
    blocks = y.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions in data of the anchors of texts data[off[i]:off[i + 1]], ascending, and their gram hashes."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = prefix_hash(data)
    _, inv = powers(n + 1)
    g = mix((s[gram:] - s[:-gram]) * inv[: n - gram + 1])
    packed = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
    least = window_minima(packed, length - gram + 1)
    usable = np.zeros(n + 1, dtype=np.int32)
    long_enough = np.diff(off) >= length
    np.add.at(usable, off[:-1][long_enough], 1)
    np.add.at(usable, off[1:][long_enough] - length + 1, -1)
    ok = np.cumsum(usable)[: len(least)] > 0
    at = (least[ok] & np.uint64((1 << 24) - 1)).astype(np.int64)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    mark = np.zeros(n, dtype=bool)
    mark[at] = True
    at = np.flatnonzero(mark)
    return at, g[at]


def thin_runs(at: np.ndarray, h: np.ndarray, length: int, gram: int, raw: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors of one text to keep, and the insides of its periodic runs as (start, end).

    Equal gram hashes at equal steps propose a run; it is one where its bytes return after a step.
    """
    keep = np.ones(len(at), dtype=bool)
    spans: list[tuple[int, int]] = []
    if len(at) < 3:
        return keep, spans
    step = np.diff(at)
    same = (h[1:] == h[:-1]) & (step <= gram)
    run = same[1:] & same[:-1] & (step[1:] == step[:-1])  # anchor i + 1 stands inside a run
    if not run.any():
        return keep, spans
    edge = np.diff(np.concatenate([[0], run.astype(np.int8), [0]]))
    for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        a, b, d = int(at[lo]), int(at[hi + 1]) + gram, int(step[lo])
        if b - a >= length + d and np.array_equal(raw[a : b - d], raw[a + d : b]):
            spans.append((a, b))
            inside = (at > a + 2 * length) & (at < b - 2 * length)
            keep &= ~inside
    return keep, spans


def _pieces(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) <= _PIECE or len(off) > 2:
        return anchors(raw, off, length, gram)
    ats, hs = [], []
    for lo in range(0, len(raw) - length + 1, _PIECE):
        part = raw[lo : lo + _PIECE + length - 1]
        at, h = anchors(part, np.array([0, len(part)]), length, gram)
        ats.append(at + lo)
        hs.append(h)
    at, i = np.unique(np.concatenate(ats), return_index=True)
    return at, np.concatenate(hs)[i]


def _find(length: int, gram: int):
    """(key, text) to (h, key, pos, len): anchors (len 0), and insides of periodic runs (len > 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                raw, off = buffers(batch.column(1).slice(lo, hi - lo))
                at, h = _pieces(raw, off, length, gram)
                edges = np.searchsorted(at, off)
                doc = np.repeat(np.arange(hi - lo), np.diff(edges))
                keep = np.ones(len(at), dtype=bool)
                runs: list[tuple[int, int, int]] = []
                for d in np.flatnonzero(np.diff(edges) > 2):
                    part = slice(edges[d], edges[d + 1])
                    keep[part], spans = thin_runs(at[part] - off[d], h[part], length, gram, raw[off[d] : off[d + 1]])
                    runs += [(d, a, b - a) for a, b in spans]
                extra = np.array(runs, dtype=np.int64).reshape(-1, 3)
                who = np.concatenate([doc[keep], extra[:, 0]]).astype(np.int64)
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([h[keep].view(np.int64), np.zeros(len(extra), np.int64)])),
                        batch.column(0).slice(lo, hi - lo).take(pa.array(who)),
                        pa.array(np.concatenate([(at - off[doc])[keep], extra[:, 1]])),
                        pa.array(np.concatenate([np.zeros(int(keep.sum()), np.int64), extra[:, 2]])),
                    ],
                    names=["h", "key", "pos", "len"],
                )

    return run


def _context(length: int, gram: int):
    """(key, text, at: list of pos, h, a and b) to (h, key, pos, a, b, left, ctx)."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for key, text, at in zip(*batch.columns, strict=True):
                key, raw = key.as_py(), text.as_py()
                for x in at.as_py():
                    p = x["pos"]
                    left = min(p, reach)
                    ctx = raw[p - left : p + length]
                    held += len(ctx)
                    for c, v in zip(out, (x["h"], key, p, x["a"], x["b"], left, ctx), strict=True):
                        c.append(v)
                if held > 4 << 20:
                    yield _batch(out)
                    out, held = [[] for _ in range(7)], 0
            yield _batch(out)

    return run


def _batch(out: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h", "key", "pos", "a", "b", "left", "ctx"])


class Extensions:
    """Common extensions of positions in a byte buffer, by its bytes, eight at a time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.padded = np.zeros(0, dtype=np.uint8)

    def _rows(self, width: int) -> np.ndarray:
        """Row i: the `width` bytes from position i on; zeros follow the data."""
        if len(self.padded) < len(self.data) + width:
            self.padded = np.concatenate([self.data, np.zeros(width, np.uint8)])
        return sliding_window_view(self.padded, width)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = most.astype(np.int64)
        if not len(out):
            return out
        width = 8 * max(1, -(-int(out.max()) // 8))
        rows = self._rows(width)
        for lo in range(0, len(out), PART):
            part = slice(lo, lo + PART)
            differ = rows[a[part]].view("<u8") ^ rows[b[part]].view("<u8")
            lane = (differ != 0).argmax(axis=1)
            bits = differ[np.arange(len(lane)), lane]
            # The lowest set bit, a power of two, stands in the first byte that differs.
            byte = (np.frexp((bits & (~bits + np.uint64(1))).astype(np.float64))[1] - 1) >> 3
            out[part] = np.minimum(out[part], np.where(bits == 0, width, 8 * lane + byte))
        return out


def suffix_sort(ext: Extensions, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes (start, size) inside ascending groups, by their bytes; equal ones stay in order."""
    raw = ext.data.tobytes()
    suffixes = [raw[a:z] for a, z in zip(start.tolist(), (start + size).tolist(), strict=True)]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), dtype=np.int64)
    return order[np.argsort(group[order], kind="stable")]


def repeated_spans(
    data: np.ndarray, off: np.ndarray, left: np.ndarray, group: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, from, to) relative to each anchor: bytes covered by windows that two members of a group share.

    data[off[i]:off[i + 1]]: bytes around anchor i, left: where the anchor stands in them, group: ascending.
    """
    reach = length - gram
    n = len(left)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    at = off[:-1] + left
    right_n = off[1:] - at
    fwd = Extensions(data)
    back = Extensions(np.ascontiguousarray(data[::-1]))
    rev = len(data) - at  # reversed text from here on is what stands left of the anchor
    left_n = np.minimum(left, reach).astype(np.int64)

    def neighbours(ext: Extensions, start: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = suffix_sort(ext, start, have, group)
        x, y = order[:-1], order[1:]
        pair = group[x] == group[y]
        x, y = x[pair], y[pair]
        c = ext.common(start[x], start[y], np.minimum(have[x], have[y]))
        best = np.zeros(n, dtype=np.int64)
        np.maximum.at(best, x, c)
        np.maximum.at(best, y, c)
        return best, x, y

    most_r, x1, y1 = neighbours(fwd, at, right_n)
    most_l, x2, y2 = neighbours(back, rev, left_n)
    j_lo, j_hi = np.maximum(0, length - most_r), np.minimum(most_l, reach)
    live = j_lo <= j_hi
    x, y = np.concatenate([x1, x2]), np.concatenate([y1, y2])
    use = live[x] & live[y]
    x, y = np.divmod(np.unique(np.minimum(x, y)[use] * n + np.maximum(x, y)[use]), n)
    r = fwd.common(at[x], at[y], np.minimum(right_n[x], right_n[y]))
    lf = back.common(rev[x], rev[y], np.minimum(left_n[x], left_n[y]))
    good = r + lf >= length
    x, y, r, lf = x[good], y[good], r[good], lf[good]
    member, lo, hi = np.concatenate([x, y]), np.concatenate([-lf, -lf]), np.concatenate([r, r])
    # Offsets that no single neighbour proves: each such member against all of its group, or, where these pairs
    # are many, all windows of the group. Both find the same bytes.
    whole = np.zeros(n, dtype=bool)
    full = (length - hi <= j_lo[member]) & (-lo >= j_hi[member])
    whole[member[full]] = True
    open_ = np.flatnonzero(live & ~whole)
    _, g, size = np.unique(group, return_inverse=True, return_counts=True)
    span = np.maximum(j_hi - j_lo + 1, 0)
    n_pairs = np.bincount(g[open_], minlength=len(size)) * size
    by_pairs = PAIR_COST * n_pairs <= np.bincount(g, weights=span, minlength=len(size))
    x = open_[by_pairs[g[open_]]]
    if len(x):
        first = np.cumsum(size) - size
        count = size[g[x]]
        y = np.repeat(first[g[x]] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        x = np.repeat(x, count)
        other = live[y] & (x != y)
        x, y = x[other], y[other]
        r = fwd.common(at[x], at[y], np.minimum(right_n[x], right_n[y]))
        lf = back.common(rev[x], rev[y], np.minimum(left_n[x], left_n[y]))
        good = r + lf >= length
        member, lo, hi = np.concatenate([member, x[good]]), np.concatenate([lo, -lf[good]]), np.concatenate([hi, r[good]])
    doubtful = np.zeros(len(size), dtype=bool)
    doubtful[g[open_]] = True
    who = np.flatnonzero(live & (doubtful & ~by_pairs)[g])
    if len(who):
        m = np.repeat(who, span[who])
        j = j_lo[m] + np.arange(len(m)) - np.repeat(np.cumsum(span[who]) - span[who], span[who])
        start = at[m] - j
        fits = (j <= left_n[m]) & (length - j <= right_n[m])
        m, j, start = m[fits], j[fits], start[fits]
        s, inv = prefix_hash(data), powers(len(data) + 1)[1]
        h = (s[start + length] - s[start]) * inv[start]
        order = np.lexsort((h, j, g[m]))
        m, j, start, h = m[order], j[order], start[order], h[order]
        new = np.ones(len(m), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (j[1:] != j[:-1]) | (g[m][1:] != g[m][:-1])
        eq = np.flatnonzero(~new)
        sure = fwd.common(start[eq - 1], start[eq], np.full(len(eq), length)) == length
        i = np.concatenate([eq[sure] - 1, eq[sure]])
        if not sure.all():  # equal hashes of different windows: compare these by bytes
            run = np.cumsum(new)
            mixed = np.flatnonzero(np.isin(run, run[eq[~sure]]))
            raw = data.tobytes()
            windows = [(k, raw[a : a + length]) for k, a in zip(run[mixed].tolist(), start[mixed].tolist(), strict=True)]
            often = Counter(windows)
            i = np.concatenate([i, mixed[[often[w] > 1 for w in windows]]])
        i = np.unique(i)
        member, lo, hi = np.concatenate([member, m[i]]), np.concatenate([lo, -j[i]]), np.concatenate([hi, length - j[i]])
    return member, lo, hi


def _merge(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals with equal keys."""
    order = np.lexsort((hi, lo, keys))
    keys, lo, hi = keys[order], lo[order], hi[order]
    if not len(keys):
        return keys, lo, hi
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + keys * span)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (lo[1:] + keys[1:] * span > reach[:-1])
    at = np.flatnonzero(new)
    return keys[at], lo[at], (reach[np.append(at[1:] - 1, len(keys) - 1)] - keys[at] * span)


def _sort_bucket(length: int, gram: int):
    def run(t: pa.Table) -> pa.Table:
        h, pos, left = (t.column(c).to_numpy() for c in ("h", "pos", "left"))
        ctx = t.column("ctx").cast(pa.large_binary()).combine_chunks()
        order = np.argsort(h, kind="stable")
        # Groups of one have no partner here.
        hs = h[order]
        pair = np.zeros(len(hs) + 1, dtype=bool)
        pair[1:-1] = hs[1:] == hs[:-1]
        order = order[pair[1:] | pair[:-1]]
        out = [[], [], []]
        at = 0
        while at < len(order):  # whole groups, about PART anchors at a time
            end = min(at + PART, len(order))
            while end < len(order) and h[order[end]] == h[order[end - 1]]:
                end += 1
            part = order[at:end]
            member, lo, hi = repeated_spans(*buffers(ctx.take(pa.array(part))), left[part].astype(np.int64), h[part], length, gram)
            out[0].append(part[member])
            out[1].append(pos[part[member]] + lo)
            out[2].append(pos[part[member]] + hi)
            at = end
        who, lo, hi = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        code = t.column("key").combine_chunks().dictionary_encode()
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        k, lo, hi = _merge(code.indices.to_numpy().astype(np.int64)[who], lo, hi)
        trim()
        return pa.table({"key": code.dictionary.take(pa.array(k)), "lo": lo, "hi": hi})

    return run


def _twice(rows: DataFrame, by: str) -> DataFrame:
    """Values of `by` that stand at two places (key, pos) or more; partial aggregation only."""
    place = F.struct("key", "pos")
    return rows.groupBy(by).agg(F.min(place).alias("_a"), F.max(place).alias("_z")).where("_a <> _z").select(by)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi - 1:
        mid = (lo + hi) >> 1
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _follow(length: int):
    """Members of hot groups and their leaders to one row each: the span shared with the leader, and the two narrower groups to go on in.

    A group's members share its core: a bytes left and b bytes right of the anchor; windows that are still open
    cover it. One that a member does not share with its leader reaches one byte beyond what both share, to the
    right or to the left. Any other member that has that window differs from the leader at that byte too, so
    both meet in the group of the core that is extended to it and keeps its other side. A core longer than a
    window lies in none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _FOLLOWED]
            leaders: set[tuple] = set()
            names = ("key", "pos", "a", "b", "left", "ctx", "lkey", "lpos", "lleft", "lctx")
            for key, pos, a, b, left, ctx, lkey, lpos, lleft, lctx in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (key, pos) == (lkey, lpos):
                    continue
                r = _shared(ctx[left:], lctx[lleft:])
                lf = _shared(ctx[:left][::-1], lctx[:lleft][::-1])
                row = [key, pos, 0, 0]
                if r + lf >= length:
                    row[2:] = [pos - lf, r + lf]
                    leaders.add((lkey, lpos - lf, r + lf))
                for x, y in ((a, r + 1), (lf + 1, b)):
                    if x <= left and left + y <= len(ctx) and x + y <= length:
                        core = x.to_bytes(4, "little") + ctx[left - x : left + y]
                        row += [int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True), x, y]
                    else:
                        row += [None, 0, 0]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            for key, lo, n in leaders:
                for c, v in zip(out, (key, 0, lo, n, None, 0, 0, None, 0, 0), strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, _FOLLOWED.values(), strict=True)], names=list(_FOLLOWED))

    return run


_FOLLOWED = {"key": pa.binary(), "pos": pa.int64(), "lo": pa.int64(), "len": pa.int64()} | {
    f"{c}{i}": t for i in (1, 2) for c, t in (("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()))
}
_FOLLOWED_SQL = "key binary, pos long, lo long, len long, h1 long, a1 int, b1 int, h2 long, a2 int, b2 int"
_PLACES = "h long, key binary, pos long, len long"


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, spans) to (key, spans, kept digest)."""
    for batch in batches:
        spans_out, sha = [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw, merged = text.as_py(), []
            for s in sorted((x["lo"], x["hi"]) for x in spans.as_py()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, digest = 0, hashlib.sha256()
            for lo, hi in merged:
                digest.update(raw[at:lo])
                at = hi
            digest.update(raw[at:])
            spans_out.append([{"lo": lo, "hi": hi} for lo, hi in merged])
            sha.append(digest.hexdigest())
        yield pa.record_batch(
            [batch.column(0), pa.array(spans_out, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(sha)],
            names=["key", "spans", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, spans array<struct<lo,hi>> (null: the whole text), kept_sha256."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("key"), raw.alias("text"))
    long_ = keyed.where(F.octet_length("text") >= length)

    def texts(keys: DataFrame) -> DataFrame:
        """One row (key, text) for each key."""
        sieve = Sieve(keys.select(F.xxhash64("key").alias("x")), "x")
        some = long_.withColumn("x", F.xxhash64("key")).select("key", "text", *sieve.hashes("x"))
        some = some.mapInArrow(sieve.before(), "key binary, text binary")
        # Copies go before the shuffle, so that a hot text sends one row from each task.
        return some.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key")

    def contexts(marks: DataFrame) -> DataFrame:
        lists = cut(marks.groupBy("key").agg(F.collect_list(F.struct("pos", "h", "a", "b")).alias("at")))  # bounded by a text's length
        return texts(lists).select("key", "text", "at").mapInArrow(
            _context(length, gram), "h long, key binary, pos long, a int, b int, left int, ctx binary"
        )

    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(min(max(size // (2 << 20), width), 1 << 22))
    found = cut(long_.select("key", "text").mapInArrow(_find(length, gram), _PLACES).distinct())
    release(spark)
    spans = found.where("len > 0")
    marks = found.where("len = 0").select("h", "key", "pos", F.lit(0).alias("a"), F.lit(gram).alias("b"))
    while True:
        groups = cut(_twice(marks, "h").join(marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h"))
        sorted_ = (
            contexts(marks.join(groups.where(F.col("n") <= hot).select("h"), "h"))
            .withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
            .groupBy("bucket")
            .applyInArrow(_sort_bucket(length, gram), "key binary, lo long, hi long")
        )
        spans = cut(spans.select("key", "pos", "len").unionByName(sorted_.select("key", F.col("lo").alias("pos"), (F.col("hi") - F.col("lo")).alias("len"))))
        release(spark)
        hot_h = cut(groups.where(F.col("n") > hot).select("h"))
        n_hot = hot_h.count()
        if not n_hot:
            break
        members = contexts(marks.join(hot_h, "h"))
        # The leader: the first member with the context that most members have.
        usual = members.groupBy("h", F.xxhash64("left", "ctx").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos", "a", "b")).alias("l"))
        lead = cut(usual.groupBy("h").agg(F.max_by("l", F.struct("n", "l")).alias("l")).select("h", "l.*"))
        lead_ctx = cut(
            contexts(lead).select("h", F.col("key").alias("lkey"), F.col("pos").alias("lpos"), F.col("left").alias("lleft"), F.col("ctx").alias("lctx"))
        )
        # A leader takes less than a kilobyte; beyond 64 MB of them Spark joins by h and splits hot values.
        joined = members.join(F.broadcast(lead_ctx) if n_hot <= LEADERS else lead_ctx, "h")
        followed = cut(joined.mapInArrow(_follow(length), _FOLLOWED_SQL))
        release(spark)
        spans = spans.unionByName(followed.where("len > 0").select("key", F.col("lo").alias("pos"), "len").distinct())
        narrower = [followed.select(F.col(f"h{i}").alias("h"), "key", "pos", F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i in (1, 2)]
        marks = narrower[0].unionByName(narrower[1]).where("h IS NOT NULL").distinct()
    spans = cut(spans.groupBy("key").agg(F.collect_list(F.struct(F.col("pos").alias("lo"), (F.col("pos") + F.col("len")).alias("hi"))).alias("found")))
    done = texts(spans).select("key", "text", "found").mapInArrow(
        _cut_text, "key binary, spans array<struct<lo:long,hi:long>>, kept_sha256 string"
    )
    narrow = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    copies = narrow.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    # Texts too short for a repeat are joined by their doc_id's hash in place of the key, which empty ones share.
    at = F.when(F.col("n_bytes") >= length, F.col("key")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).cast("binary")
    out = narrow.withColumn("key", at).join(copies, "key", "left").join(done, "key", "left")
    gone = F.coalesce("copied", F.lit(False))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    nothing = F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, everything).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    out = out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
    return out.withColumn("has_repeat", F.col("n_removed") > 0)
