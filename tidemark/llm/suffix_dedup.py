"""Suffix-array deduplication: remove every byte covered by a string of ``length`` bytes (LENGTH) that recurs.

Finding the recurring strings is threshold-bounded interval expansion on a Burrows-Wheeler
transform: starting from the interval of all suffixes, every interval is extended backwards by
each character that precedes it, breadth first. Each new right boundary that an extension finds
gets the current depth as its common-prefix value, so values come in increasing order, and the
search stops at ``length``: boundaries without a value have a common prefix of at least that.

One transform of a whole corpus would not be distributed, so the corpus is cut up without loss:

1. Every window of that length is assigned to the smallest hash of the GRAM-byte strings in it (fewer bytes in shorter windows), its
   anchor. Equal windows have equal anchors at equal places, so only windows that share an
   anchor can be equal. The windows of one anchor lie side by side and form a *context*.
2. Contexts that are equal byte for byte (compared by hash, counted with map-side combine) are
   one context with a count. With a count above one, all its windows recur, wherever it lies; a
   context of one place carries that place along, so what the next steps find needs no look-up.
3. Anchors that have several different contexts are brought together, and the transform runs
   over those contexts only, bucket by bucket: no bucket needs more than its own anchors, and
   parts that no other context of the anchor can match are dropped first.
4. Anchors with more than HOT different contexts, which could outgrow a task, are not brought
   together: the hashes of their single windows are counted instead, which has no hot groups.

Edge cases: a null text is empty; a text shorter than ``length`` loses nothing. Rows that repeat
(same id, same text) count as different places, so from ``length`` bytes on they lose everything.
Overlapping recurrences within one document count. Matches never cross documents. An empty table
gives an empty result. Extra columns are ignored by ``removed`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import SLICE_BYTES, binary_views, mix64, prefix_hash, slices, span_hash
from tidemark.llm._common import bind_batches, lean, written

LENGTH = 400
#: Bytes of an anchor for windows of LENGTH; in proportion for others.
GRAM = 128
CELL = 32
HOT = 1000
#: Bytes of contexts in one transform (more if a single anchor has more; HOT bounds that).
BUCKET_BYTES = 1 << 20

_LOW = np.uint64((1 << 24) - 1)


# --- the transform -------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``depth`` symbols (0 <= symbol < 512), by prefix doubling."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = first + 1  # 0 is "after the end"
    h = 7
    slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while h < depth and len(slots):
        at = order[slots]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + h, n)].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.concatenate([[True], np.diff(key) != 0])
        start = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = start + 1
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def bounded_lcp(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common-prefix values of neighbours in ``order`` (entry i: suffixes i-1 and i), -1 where at least ``depth``.

    Entries 0 and n are 0. Breadth-first backward extension; only boundaries that get their
    value at this depth are extended further, so every boundary is extended once.
    """
    n = len(symbols)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    before = symbols[order - 1]  # the transform; the last symbol precedes the first (it occurs once)
    by = np.argsort(before.astype(np.uint16), kind="stable")
    forward = np.empty(n, np.int64)
    forward[by] = np.arange(n)
    same = before[by[1:]] == before[by[:-1]]
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by[:-1][same]] = by[1:][same]
    previous[by[1:][same]] = by[:-1][same]
    left, right = np.array([0]), np.array([n - 1])
    for level in range(depth):
        size = right - left + 1
        at = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        lo = forward[at[previous[at] < np.repeat(left, size)]]
        hi = forward[at[following[at] > np.repeat(right, size)]]
        lo.sort()
        hi.sort()
        new = lcp[hi + 1] < 0
        left, right = lo[new], hi[new]
        if not len(right):
            break
        lcp[right + 1] = level
    return lcp


def recurring(parts: list[np.ndarray], depth: int = LENGTH) -> list[np.ndarray]:
    """For each byte array, which of its ``depth``-byte windows occur at another place in any of them."""
    if not parts:
        return []
    lengths = np.array([len(p) for p in parts])
    start = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbols = np.full(int(start[-1]) + 1, 1, np.int64)  # 1 between parts, 0 at the end
    for a, p in zip(start[:-1], parts, strict=True):
        symbols[a : a + len(p)] = p.astype(np.int64) + 2
    symbols[-1] = 0
    order = suffix_order(symbols, depth)
    deep = bounded_lcp(symbols, order, depth) < 0
    twice = np.zeros(len(symbols), bool)
    twice[order] = deep[:-1] | deep[1:]
    return [twice[a : a + max(n - depth + 1, 0)] for a, n in zip(start[:-1], lengths, strict=True)]


# --- anchors -------------------------------------------------------------------------------


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie one behind the other in ``data`` and end at ``ends``.

    Arrays: first window, number of windows, place of the anchor behind the first window, hash of
    the anchor, hash of the context.
    """
    gram = GRAM * length // LENGTH
    n, w = len(data), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < length:
        return none
    q = prefix_hash(data)
    i = np.arange(n - gram + 1)
    grams = span_hash(q, i, i + gram)
    key = (grams & ~_LOW) | i.astype(np.uint64)
    m = len(key)
    padded = np.full(-(-m // w) * w, ~np.uint64(0))
    padded[:m] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - w + 1
    at = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & _LOW).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(count), side="right")
    good = np.arange(count) + length <= ends[owner]
    change = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(owner) != 0)])
    first = np.flatnonzero(good & (change | ~np.concatenate([[False], good[:-1]])))
    last = np.flatnonzero(good & np.append(change[1:] | ~good[1:], True))
    if not len(first):
        return none
    place = at[first] - first
    size = last - first + 1
    whole = span_hash(q, first, last + length)
    context = mix64(whole + mix64(place.astype(np.uint64) * np.uint64(1 << 20) + size.astype(np.uint64)))
    return first, size, place, grams[at[first]].view(np.int64), context.view(np.int64)


_ANCHOR = "k1 long, k2 long, lo long, n int, place int, a long, c long"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "lo", "n", "place", "a", "c"]
    for batch in batches:
        data, offsets = binary_views(batch.column("text"))
        k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2"))
        for a, b in slices(offsets):
            lo, hi = int(offsets[a]), int(offsets[b])
            for s in range(lo, max(hi - length + 1, lo + 1), SLICE_BYTES) if b == a + 1 else [lo]:
                e = min(s + SLICE_BYTES + length - 1, hi) if b == a + 1 else hi
                ends = np.array([e - s]) if b == a + 1 else offsets[a + 1 : b + 1] - lo
                first, size, place, gram, context = anchors(data[s:e], ends, length)
                if not len(first):
                    continue
                row = a + np.searchsorted(ends, first, side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), pa.array(first + s - offsets[row]), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(gram), pa.array(context)], names
                )


# --- contested contexts --------------------------------------------------------------------

_CONTEXT = "a long, c long, n int, place int, k1 long, k2 long, lo long, text binary, windows array<long>"


def _context_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each listed context, or the hashes of its windows where its anchor is hot; its place (k1, k2, lo) if it has only one."""
    long, short = pa.int64(), pa.int32()
    schema = pa.schema([("a", long), ("c", long), ("n", short), ("place", short), ("k1", long), ("k2", long), ("lo", long), ("text", pa.binary()), ("windows", pa.list_(long))])
    for batch in batches:
        rows = []
        for k1, k2, text, wanted in zip(*(batch.column(k).to_pylist() for k in ("k1", "k2", "text", "wanted")), strict=True):
            raw = (text or "").encode("utf-8", "replace")
            for x in wanted:
                part = raw[x["lo"] : x["lo"] + x["n"] + length - 1]
                hashes = None
                if x["hot"]:
                    q = prefix_hash(np.frombuffer(part, np.uint8))
                    i = np.arange(x["n"])
                    hashes, part = span_hash(q, i, i + length).view(np.int64), None
                rows.append((x["a"], x["c"], x["n"], x["place"], *((k1, k2, x["lo"]) if x["once"] else (None, None, None)), part, hashes))
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*rows[i : i + 2000], strict=True), schema, strict=True)], schema=schema)


def _cells(rows: list[tuple], length: int) -> list[tuple[int, int]]:
    """For each context the run of windows that could match another context of its anchor; (0, 0) if none.

    All windows whose anchor lies CELL*g .. CELL*g+CELL-1 bytes behind their start have the same
    length-CELL+1 bytes in common; if no other context has these bytes there, none of the
    windows recurs.
    """
    data = np.frombuffer(b"".join(r[-1] for r in rows), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r[-1]) for r in rows])])[:-1]
    a, n, place = (np.array([r[i] for r in rows], np.int64) for i in (0, 2, 3))
    low, high = (place - n + 1) // CELL, place // CELL
    count = high - low + 1
    ctx = np.repeat(np.arange(len(rows)), count)
    g = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    s = begin[ctx] + place[ctx] - CELL * g
    key = mix64(span_hash(prefix_hash(data), s, s + length - CELL + 1) + mix64(a[ctx].view(np.uint64) + g.astype(np.uint64)))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = times[which] > 1
    w0 = np.maximum(place[ctx] - CELL * g - CELL + 1, 0)[shared]
    w1 = np.minimum(place[ctx] - CELL * g, n[ctx] - 1)[shared]
    lo, hi = np.full(len(rows), 1 << 40), np.full(len(rows), -1)
    np.minimum.at(lo, ctx[shared], w0)
    np.maximum.at(hi, ctx[shared], w1)
    return [(int(x), int(y) + 1) if y >= 0 else (0, 0) for x, y in zip(lo, hi, strict=True)]


def _runs(flags: np.ndarray, shift: int) -> list[int]:
    """First and last of each run of true values, one behind the other."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel().__add__(shift).tolist()


def _transform_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of recurring windows of the contexts of one place; all contexts arrive sorted by anchor."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        spans = _cells(rows, length)
        live = [(r, lo, hi) for r, (lo, hi) in zip(rows, spans, strict=True) if hi > lo]
        flags = recurring([np.frombuffer(r[-1], np.uint8)[lo : hi + length - 1] for r, lo, hi in live], length)
        out = [(*r[4:7], _runs(f, lo)) for (r, lo, _), f in zip(live, flags, strict=True) if r[4] is not None and f.any()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in ("a", "c", "n", "place", "k1", "k2", "lo", "text")), strict=True):
            if held and r[:2] == held[-1][:2]:
                continue  # the context of an equal row
            if size >= BUCKET_BYTES and r[0] != held[-1][0]:
                yield from solve(held)
                held, size = [], 0
            held.append(r)
            size += len(r[-1])
    if held:
        yield from solve(held)


# --- the result ----------------------------------------------------------------------------


def _coverage(size: int, spans: list, length: int) -> np.ndarray:
    """Which bytes of a text are covered by the recurring windows listed as (lo, runs)."""
    edge = np.zeros(size + 1, np.int32)
    for x in spans:
        runs = np.array(x["runs"], np.int64).reshape(-1, 2) + x["lo"]
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, np.minimum(runs[:, 1] + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows with k1, k2 keys, spans by key): where windows recur, per distinct (doc_id, text)."""
    bind_batches(docs.sparkSession, 1000)
    rows = docs.withColumn("k1", F.xxhash64(F.lit(1), "doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(2), "text", "doc_id"))
    texts = rows.select("k1", "k2", "text")
    found = written(texts.mapInArrow(lean(functools.partial(_anchor_rows, length=length)), _ANCHOR))
    contexts = found.groupBy("a", "c").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "lo", "n", "place")).alias("at"))
    contexts = written(contexts.select("a", "c", "times", "at.*"))
    several = contexts.groupBy("a").agg(F.count("*").alias("m")).where("m > 1")
    contested = contexts.join(several, "a").select("k1", "k2", F.struct("a", "c", "lo", "n", "place", (F.col("m") > HOT).alias("hot"), (F.col("times") == 1).alias("once")).alias("x"))
    lists = contested.groupBy("k1", "k2").agg(F.collect_list("x").alias("wanted"))  # of one text: bounded by its length
    parts = written(texts.join(lists, ["k1", "k2"]).mapInArrow(lean(functools.partial(_context_rows, length=length)), _CONTEXT))
    solved = parts.where("text is not null").drop("windows").repartition("a").sortWithinPartitions("a", "c").mapInArrow(lean(functools.partial(_transform_rows, length=length)), "k1 long, k2 long, lo long, runs array<int>")
    single = parts.where("text is null").select("a", "c", "k1", "k2", "lo", "place", F.posexplode("windows").alias("w", "h")).withColumn("o", F.col("place") - F.col("w"))
    twice = single.groupBy("a", "o", "h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("a", "o", "h")
    hot = single.where("k1 is not null").join(twice, ["a", "o", "h"], "left_semi").groupBy("k1", "k2", "lo").agg(F.flatten(F.collect_list(F.array("w", "w"))).alias("runs"))
    whole = found.join(contexts.where("times > 1").select("a", "c"), ["a", "c"], "left_semi").select("k1", "k2", "lo", F.expr("array(0, n - 1)").alias("runs"))
    marks = whole.unionByName(solved).unionByName(hot)
    spans = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "runs")).alias("spans"))  # a set: equal rows have the same spans
    return rows, spans


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows, spans = repeats(docs.select("doc_id", "text"), length)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                gone, n_spans = 0, 0
                kept = raw
                if found:
                    cover = _coverage(len(raw), found, length)
                    gone = int(cover.sum())
                    n_spans = int((np.diff(np.concatenate([[0], cover.astype(np.int8)])) == 1).sum())
                    kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                out.append((len(raw), gone, n_spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the recurring bytes cut out of ``text`` (what is left of a cut character goes too) and n_chars anew."""
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}_{'text' if c == 'text' else 'doc_id' if c == 'doc_id' else 'x'}" for i, c in enumerate(columns)])  # extra columns may have any name
    text, key = (inner.columns[columns.index(c)] for c in ("text", "doc_id"))
    rows, spans = repeats(inner.withColumn("text", F.col(text)).withColumn("doc_id", F.col(key)), length)
    given = inner.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, found in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if found:
                    raw = value.encode("utf-8", "replace")
                    value = np.frombuffer(raw, np.uint8)[~_coverage(len(raw), found, length)].tobytes().decode("utf-8", "ignore")
                out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(c) for c in given], given)

    kept = rows.join(spans, ["k1", "k2"], "left").select(*given, "spans")
    done = kept.mapInArrow(lean(run), inner.schema).toDF(*columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else done
