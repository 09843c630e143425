"""MinHash near-deduplication with order MinHash, verified by banded alignment.

A text is the sequence of its five-word k-mers. Each of SKETCHES sketches takes the PICKS k-mers
with the smallest hashes, every k-mer labelled with how often it occurred before (so repeats
count), and keeps them in text order: two texts share a sketch only if they share k-mers *and*
their order, which follows edit similarity. Texts that share a sketch are candidates. Sketches of
few k-mers agree too seldom, so texts of up to SHORT k-mers get SHORT_SKETCHES more of two picks.

A candidate pair is accepted if the banded alignment of the two k-mer sequences keeps 80 % of
them: aligned / (n + m - aligned) >= 0.8, where ``aligned`` is the longest common subsequence
within the band outside of which no such alignment exists. It never exceeds the Jaccard
similarity of the k-mers and equals it where their order agrees. (k-mers are compared by 32 bits
of a hash.)

Equal texts are one class before anything else. Every pair of texts in a bucket (texts of one
sketch) is then joined, found to be in one component already, aligned, or excluded by a bound, without
visiting all pairs of a large group:

1. *Hub.* Each text of a bucket is aligned with the bucket's hub, the text whose buckets hold the
   most texts. An original has the sketches of most of its copies, so it is the hub of its group.
2. *Rare k-mers.* Similar texts share one of the first 20 % + 1 of their k-mers in any common
   order; this orders them by the number of texts that have them, the rarest first. Texts of the
   buckets that are still of several components meet on those k-mers of their prefix which are in
   at most RARE of these texts, so a k-mer makes at most RARE * RARE / 2 pairs.
3. *The rest.* Two texts that share no rare k-mer of their prefixes are similar only if what either
   has of frequent k-mers allows it: min(n - rare_n, m - rare_m) >= 4/9 (n + m). That bounds the
   size of a partner from above, for a loose copy usually below the size of the group's texts.
   Texts of one bucket meet by bins of the size, and only pairs within the bound are aligned.

Groups are the connected components.

Edge cases: null and empty texts are one class of equal texts. A text of one to four words is one
k-mer (it can only match an equal sequence of words). Repeated rows share their class. An
empty table gives an empty result. Extra columns, of any name, are kept by ``without_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import binary_views, joined, mix64, powers, prefix_hash, slices, span_hash, words_of
from tidemark.llm._common import bind_batches, discard, free_name, lean, small_plans, written
from tidemark.llm._graph import components

WORDS = 5
SKETCHES = 16
PICKS = 4
SIMILARITY = 0.8
#: Texts of up to SHORT k-mers have SHORT_SKETCHES more sketches, of SHORT_PICKS.
SHORT, SHORT_SKETCHES, SHORT_PICKS = 50, 8, 2
#: A k-mer is rare if at most so many of the contested texts have it.
RARE = 128
#: Sizes of texts that differ by less than this factor are in one bin.
BIN = 1.02

_STEP = powers(0x9E3779B97F4A7C15, WORDS)
_SEED = mix64(np.arange(1, SKETCHES + SHORT_SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def kmers(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of rows a..b-1, in text order, and the bounds of each row's."""
    text, starts = joined(data, offsets, a, b)
    s, e = words_of(text)
    h = span_hash(prefix_hash(text), s, e)
    bounds = np.searchsorted(s, starts)
    n_words = np.diff(bounds)
    count = np.where(n_words >= WORDS, n_words - WORDS + 1, (n_words > 0).astype(int))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(b - a), count)
    first = bounds[row] + np.arange(int(out_bounds[-1])) - out_bounds[row]
    h = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(first), np.uint64)
    for k in range(WORDS):
        total += np.where(k < n_words[row], h[first + k], np.uint64(k + 1)) * _STEP[k]
    return mix64(total + np.minimum(n_words[row], WORDS).astype(np.uint64)), out_bounds


def repeats(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each k-mer the number of equal ones before it in its row."""
    key = mix64(hashes + mix64(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])[: len(key)]
    place = np.arange(len(key))
    out = np.empty(len(key), np.uint64)
    out[order] = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.uint64)
    return out


def labelled(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes of k-mers together with their number of repeats, so that no row has one twice."""
    return mix64(hashes + repeats(hashes, row) * np.uint64(0xA0761D6478BD642F))


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes (int64) of the sketches of each row, the extra ones of short texts last; zeros where there is none."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    out = np.zeros((n, SKETCHES + SHORT_SKETCHES), np.int64)
    x = labelled(hashes, np.repeat(np.arange(n), size))
    for full, ks, picks in ((np.flatnonzero(size > 0), range(SKETCHES), PICKS), (np.flatnonzero((size > 0) & (size <= SHORT)), range(SKETCHES, SKETCHES + SHORT_SKETCHES), SHORT_PICKS)):
        if not len(full):
            continue
        mine = np.repeat(bounds[full] - np.concatenate([[0], np.cumsum(size[full])[:-1]]), size[full]) + np.arange(int(size[full].sum()))
        heads = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        low = np.uint64((1 << max(len(mine).bit_length(), 1)) - 1)
        at, x_, h_ = np.arange(len(mine), dtype=np.uint64), x[mine], hashes[mine]
        for k in ks:
            v = ((x_ * _SEED[k]) & ~low) | at
            picked = np.empty((picks, len(full)), np.int64)
            for j in range(picks):
                best = np.minimum.reduceat(v, heads)
                none = best == ~np.uint64(0)
                picked[j] = np.where(none, picked[j - 1] if j else 0, (best & low).astype(np.int64))
                v[picked[j]] = ~np.uint64(0)
            picked.sort(axis=0)
            mixed = np.full(len(full), k + 1, np.uint64)
            for j in range(picks):
                mixed = mix64(mixed + h_[picked[j]])
            out[full, k] = mixed.view(np.int64)
    return out


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """aligned / (n + m - aligned) of two k-mer sequences, 0 if it is below ``similarity``.

    Bit-parallel longest common subsequence; matches outside the band, where an alignment would
    have to drop more k-mers than ``similarity`` allows, are not considered.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m):
        return 0.0
    need = similarity / (1 + similarity) * (n + m)
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    k -= head
    differ = np.flatnonzero(a[n - k :][::-1] != b[m - k :][::-1]) if k else []
    tail = int(differ[0]) if len(differ) else k
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    common = head + tail
    if x and y:
        width = int(max(n, m) - need) + 1  # k-mers that either text may drop
        where: dict[int, int] = {}
        for i, h in enumerate(x):
            where[h] = where.get(h, 0) | (1 << i)
        band = (1 << (2 * width + 1)) - 1
        ones = (1 << len(x)) - 1
        v = ones
        for j, h in enumerate(y):
            hit = where.get(h)
            if hit:
                hit &= band << (j - width) if j >= width else band >> (width - j)
                if hit:
                    u = v & hit
                    v = ((v + u) | (v - u)) & ones
        common += len(x) - v.bit_count()
    s = common / (n + m - common)
    return s if s >= similarity else 0.0


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = binary_views(batch.column("text"))
        found, size = np.zeros((len(offsets) - 1, SKETCHES + SHORT_SKETCHES), np.int64), np.zeros(len(offsets) - 1, np.int32)
        for a, b in slices(offsets):
            hashes, bounds = kmers(data, offsets, a, b)
            found[a:b] = sketches(hashes, bounds)
            size[a:b] = np.diff(bounds)
        many = np.where(size > SHORT, SKETCHES, np.where(size > 0, SKETCHES + SHORT_SKETCHES, 0))
        has = np.arange(SKETCHES + SHORT_SKETCHES) < many[:, None]
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(found[has]))
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(size), bands], ["uid", "doc_id", "size", "bands"])


def _sequence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = binary_views(batch.column("text"))
        out: list[bytes] = []
        for a, b in slices(offsets):
            h, bounds = kmers(data, offsets, a, b)
            raw = (h >> np.uint64(32)).astype(np.uint32).tobytes()
            out += [raw[4 * i : 4 * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("num"), pa.array(out, pa.binary())], ["num", "seq"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ok = pa.array([aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) > 0 for x, y in zip(a, b, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], ["u", "v"])


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each labelled k-mer of each text."""
    for batch in batches:
        seqs = [np.frombuffer(x, np.uint32) for x in batch.column("seq").to_pylist()]
        long = np.array([len(x) for x in seqs], np.int64)
        ends = np.cumsum(long)
        lo = 0
        while lo < len(seqs):  # at most a million k-mers at a time, or one text
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), side="right")), lo + 1)
            row = np.repeat(np.arange(lo, hi), long[lo:hi])
            token = labelled(np.concatenate(seqs[lo:hi]).astype(np.uint64), row)
            yield pa.RecordBatch.from_arrays([batch.column("num").take(pa.array(row)), pa.array(long[row].astype(np.int32)), pa.array(token.view(np.int64))], ["num", "size", "token"])
            lo = hi


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, uid (hash of the text), class_id (smallest id of the group), group_rows for every row of ``docs``."""
    spark = docs.sparkSession
    bind_batches(spark, 1000)
    rows = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = written(rows.mapInArrow(lean(_sketch_rows), f"uid binary, doc_id {kind}, size int, bands array<long>"))
    texts = sketched.groupBy("uid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times"), F.min("size").alias("size"), F.min("bands").alias("bands"))
    texts = written(texts.withColumn("num", F.monotonically_increasing_id()))  # numbered once: the table is read from here on
    place = _components(rows, texts)
    labels = texts.select("uid", "num", "first_id", "times").join(place, "num", "left").withColumn("root", F.coalesce("root", "num"))
    classes = labels.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("times").alias("group_rows"))
    of_text = labels.join(classes, "root").select("uid", "class_id", "group_rows")
    return sketched.select("uid", "doc_id").join(of_text, "uid")


def _components(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(num, root) of the texts that share a sketch with another, root being the smallest num of the component."""
    spark = rows.sparkSession
    buckets = texts.select("num", "size", F.explode("bands").alias("h"))
    several = buckets.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    found = written(buckets.join(several, "h"))
    wanted = found.select("num").distinct().join(texts.select("num", "uid", "first_id"), "num")
    chosen = rows.join(wanted, (rows["uid"] == wanted["uid"]) & rows["doc_id"].eqNullSafe(wanted["first_id"])).select("num", "text")
    # One row of each text; the same id may repeat with the same text.
    sequences = written(chosen.mapInArrow(lean(_sequence_rows), "num long, seq binary").groupBy("num").agg(F.min("seq").alias("seq")))

    def settle(place: DataFrame, asked: DataFrame) -> DataFrame:
        """``place`` after aligning the pairs ``asked`` (u, v)."""
        one = sequences.select(F.col("num").alias("u"), F.col("seq").alias("a"))
        two = sequences.select(F.col("num").alias("v"), F.col("seq").alias("b"))
        links = asked.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(lean(_verified), "u long, v long")
        ends = links.join(place.select(F.col("num").alias("u"), F.col("root").alias("ru")), "u").join(place.select(F.col("num").alias("v"), F.col("root").alias("rv")), "v")
        joins = written(ends.where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        if joins.isEmpty():
            return place
        roots = components(joins).select(F.col("node").alias("root"), F.col("root").alias("now"))
        new = written(place.join(roots, "root", "left").select("num", "size", F.coalesce("now", "root").alias("root")))
        discard(place, joins)
        return new

    def contested(place: DataFrame) -> DataFrame:
        """h, num, size, root of the texts of buckets that are not one component."""
        placed = found.select("h", "num").join(place, "num")
        mixed = placed.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
        return placed.join(mixed, "h", "left_semi")

    many = found.count()
    with small_plans(spark, many):
        place = written(found.select("num", "size").distinct().withColumn("root", F.col("num")))
        weight = found.groupBy("num").agg(F.sum("m").alias("weight"))
        ranked = found.select("h", "num", "size").join(weight, "num")
        hubs = ranked.groupBy("h").agg(F.max(F.struct("weight", "num", "size")).alias("hub")).select("h", F.col("hub.num").alias("v"), F.col("hub.size").alias("v_size"))
        star = found.select("h", F.col("num").alias("u"), "size").join(hubs, "h").where((F.col("u") != F.col("v")) & _sizes_fit(F.col("size"), F.col("v_size")))
        place = settle(place, star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        open_ = written(contested(place).select("num", "root").distinct())
    known = written(_rarity(sequences.join(open_, "num")).join(open_, "num"))  # by k-mers: over all partitions
    with small_plans(spark, many):
        place = settle(place, _rare_pairs(known))
        place = settle(place, _frequent_pairs(contested(place).join(known.select("num", "rare"), "num")))
    return place.select("num", "root")


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _overlap_needed(n: Column, m: Column) -> Column:
    """k-mers that two texts of n and m must have in common, less what rounding may take."""
    return F.lit(SIMILARITY / (1 + SIMILARITY)) * (n + m) - F.lit(1e-6)


def _rarity(sequences: DataFrame) -> DataFrame:
    """num, size, rare (number of rare k-mers), first (k-mers that no other text has), prefix (its other rare k-mers, in order)."""
    tokens = sequences.select("num", "seq").mapInArrow(lean(_token_rows), "num long, size int, token long")
    spread = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(spread, "token")
    each = shared.groupBy("num", "size").agg(
        F.count("*").alias("common"),
        F.count_if(F.col("n") > RARE).alias("frequent"),
        F.collect_list(F.when(F.col("n") <= RARE, F.struct("n", "token"))).alias("few"),  # of one text: bounded by its length
    )
    first = (F.col("size") - F.col("common")).cast("int")
    left = F.floor(F.col("size") * F.lit(1 - SIMILARITY) + F.lit(1e-9)).cast("int") + 1 - first
    return each.select("num", "size", (F.col("size") - F.col("frequent")).cast("int").alias("rare"), first.alias("first"), F.slice(F.sort_array("few"), F.lit(1), F.greatest(left, F.lit(0))).getField("token").alias("prefix"))


def _rare_pairs(known: DataFrame) -> DataFrame:
    """u, v: texts of different components that share a rare k-mer of their prefixes and may be similar."""
    tokens = known.select("num", "size", "root", "first", F.posexplode("prefix").alias("at", "token"))
    a, b = (tokens.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("num", "size", "root", "first", "at")]) for x in "ab")
    # Shared k-mers: some of those before this one, it, and some of those after it; none of the texts' own.
    after = lambda x: F.col(f"size_{x}") - F.col(f"first_{x}") - F.col(f"at_{x}") - 1
    most = F.least("at_a", "at_b") + 1 + F.least(after("a"), after("b"))
    may = (F.col("num_a") > F.col("num_b")) & (F.col("root_a") != F.col("root_b")) & (most >= _overlap_needed(F.col("size_a"), F.col("size_b")))
    return a.join(b, (a["token"] == b["token"]) & may).select(F.col("num_a").alias("u"), F.col("num_b").alias("v")).distinct()


def _bin(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(float(np.log(BIN)))).cast("int")


def _frequent_pairs(members: DataFrame) -> DataFrame:
    """u, v: texts of one bucket and different components that may be similar without a rare k-mer in common."""
    n, rare = F.col("size"), F.col("rare")
    # A partner of m has 4/9 (n + m) k-mers in common, which are frequent ones of both.
    most = F.least(n / F.lit(SIMILARITY), (n - rare) * F.lit((1 + SIMILARITY) / SIMILARITY) - n) + F.lit(1e-6)
    live = members.where(rare <= F.floor(n * F.lit(1 - SIMILARITY) + F.lit(1e-9))).withColumn("most", most).where(F.col("most") >= n * SIMILARITY)
    sums = live.groupBy("h", "root").agg(F.count("*").alias("k"))
    main = sums.groupBy("h").agg(F.max(F.struct("k", "root")).alias("x"), F.count("*").alias("roots")).where("roots > 1").select("h", F.col("x.root").alias("main"))
    live = written(live.join(main, "h"))
    # The largest component of a bucket needs no pairs within; texts of the others look for partners.
    least = F.ceil(n * F.lit(SIMILARITY) - F.lit(1e-6))
    seek = live.where((F.col("root") != F.col("main")) & (F.floor("most") >= least)).withColumn("bin", F.explode(F.sequence(_bin(least), _bin(F.floor("most")))))
    names = ["num", "size", "root", "most"]
    a = seek.select("h", "bin", *[F.col(c).alias(f"{c}_a") for c in names])
    b = live.select("h", _bin(n).alias("bin"), "main", *[F.col(c).alias(f"{c}_b") for c in names])
    once = (F.col("root_b") == F.col("main")) | (F.col("num_a") > F.col("num_b"))
    may = (F.col("root_a") != F.col("root_b")) & once & (F.col("size_b") <= F.col("most_a")) & (F.col("size_a") <= F.col("most_b"))
    met = a.join(b, (a["h"] == b["h"]) & (a["bin"] == b["bin"]) & may)
    return met.select(F.greatest("num_a", "num_b").alias("u"), F.least("num_a", "num_b").alias("v")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, group_rows, kept (the document whose id names the class) for every row."""
    return groups(docs.select("doc_id", "text")).select("doc_id", "class_id", "group_rows", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (of rows that repeat it, one)."""
    names = docs.columns
    key, size = free_name(docs, "key"), free_name(docs, "rows")
    labelled_ = groups(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Rows of one group and id may differ in text; the smallest hash of it is kept.
    chosen = labelled_.groupBy("class_id").agg(F.min(F.struct("uid")).alias("x"), F.count("*").alias("n")).select(F.struct("x.uid", "class_id").alias(key), F.col("n").alias(size))
    mine = docs.withColumn(key, F.struct(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("uid"), F.col("doc_id").alias("class_id")))
    kept = mine.join(chosen, mine[key].eqNullSafe(chosen[key])).select(*[mine[c] for c in names], mine[key], size)
    once = kept.where(F.col(size) == 1).select(*names)
    return once.unionByName(kept.where(F.col(size) > 1).dropDuplicates([key]).select(*names))
