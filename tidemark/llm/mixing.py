"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every source gets a target: the budget shared by weight, no source above twice its size,
   what is cut off reshared by weight among the others (water filling).
2. The documents of a source fall into blocks by a hash, so a block is a random sample of its
   source and a hot source is many blocks. Only block totals (a bounded number of them, however
   large the corpus) reach the driver.
3. A source is taken in whole passes over its blocks plus a last, partial pass: a random choice
   of blocks, whose words are the rest of the target. The block in which the rest ends (or a few,
   if they are small) is refined by more hash bits until it is small, and from that last leaf
   whole documents are taken: in random order up to the first that no longer fits, then the
   largest that still fit.
4. The block quotas of all sources are partitioned among the output shards by a binary tree:
   each node draws how many blocks of each source go left from a multivariate hypergeometric
   distribution, so quotas are met exactly and every shard is a fair sample. Each shard then
   gets the next disjoint run of the source's permuted blocks and shuffles its rows locally.

All draws derive from a seed and from hashes of the rows, so reruns agree, and a retried task
gives the same rows.

Edge cases: a null text has size 0; rows of size 0 are taken 0 times. A null source is a source
of its own, last in order. Repeated rows share a block and are taken as often as they fit, each
with its own row. A source without words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
#: Upper bound of the blocks of all sources together, and the words a block has at least.
MAX_BLOCKS = 16384
BLOCK_WORDS = 1_000
#: The blocks in which a rest ends: small ones are joined up to, large ones refined down to about so many words.
LEAF_WORDS = 40_000
SHARDS = 16
SEED = 2024


@dataclass
class Source:
    name: str | None
    size: int
    target: float = 0.0
    blocks: int = 1


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> list[float]:
    """Target of each source, given in order: shares by weight (repeating), capped at ``most`` times the size."""
    total = budget * sum(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = [i for i in sorted(open_) if unit * w[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * w[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (column) in each shard (row); columns sum to ``quotas``.

    Every node halves its shards and draws the left half's blocks from a multivariate
    hypergeometric distribution over the quotas that reached it.
    """
    if shards == 1:
        return quotas[None, :].copy()
    left = shards // 2
    total = int(quotas.sum())
    share = total * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, share, method="marginals") if total else np.zeros_like(quotas)
    return np.vstack([splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, shards - left, rng)])


def _hash(seed: int) -> Column:
    """63 hash bits of a row, the same for equal rows only."""
    return F.xxhash64(F.lit(seed), "doc_id", F.coalesce(F.xxhash64("_text"), F.lit(0))).bitwiseAND(F.lit((1 << 62) - 1))


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def plan(totals: list[Source]) -> list[Source]:
    """Targets and numbers of blocks; ``totals`` in code-point order of the names, null last."""
    words = sum(s.size for s in totals)
    per = max(BLOCK_WORDS, -(-words // MAX_BLOCKS))
    for s, t in zip(totals, targets([s.size for s in totals]), strict=True):
        s.target, s.blocks = t, max(1, s.size // per)
    return totals


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard, shard_order (both null if not taken), copies for every row.

    Extra columns of ``docs`` are not read. ``taken`` is the words the mix takes of the row:
    its size times the number of its copies.
    """
    return _mixed(docs, shards, seed).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("_copies")).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("_shard")).alias("shard"),
        F.col("_order").alias("shard_order"),
        F.col("_copies").cast("int").alias("copies"),
    )


def _mixed(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """The rows of ``mix`` with the hash of each row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("source").alias("_source"), F.col("text").alias("_text"))
    rows = cut(rows.select("doc_id", "_source", size_of("_text").alias("size"), _hash(seed).alias("_h")))
    sums = rows.groupBy("_source").agg(F.sum("size").alias("n")).collect()  # one row a source
    ordered = sorted(sums, key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sources = plan([Source(r["_source"], int(r["n"])) for r in ordered])
    schema = "_source string, _k long, source_size long, target double, _blocks long"
    facts = spark.createDataFrame([(s.name, i, s.size, s.target, s.blocks) for i, s in enumerate(sources)], schema)
    rows = rows.join(F.broadcast(facts.withColumnRenamed("_source", "_src")), F.col("_source").eqNullSafe(F.col("_src"))).drop("_src", "_source")
    rows = rows.withColumn("_block", F.col("_h") % F.col("_blocks"))
    blocks = {(r["_k"], r["_block"]): int(r["n"]) for r in rows.groupBy("_k", "_block").agg(F.sum("size").alias("n")).collect()}

    # Whole passes, and the blocks of the partial pass in a random order until the rest is used up.
    passes, rest, edge, taken = [], [], {}, {}
    for k, s in enumerate(sources):
        held = 0
        whole = min(int(MOST), int(s.target // s.size)) if s.size else 0
        left = s.target - whole * s.size
        if whole >= MOST or left < 0.5:
            left = 0.0
        passes.append(whole)
        for b in np.random.default_rng([seed, k]).permutation(s.blocks).tolist() if left else ():
            words = blocks.get((k, b), 0)
            if k not in edge and words <= left:
                taken[(k, b)] = True
                left -= words
            elif k not in edge or held + words <= LEAF_WORDS:
                held = words + (held if k in edge else 0)
                edge.setdefault(k, []).append(b)
            else:
                break
        rest.append(left)
    extra = spark.createDataFrame([(k, b) for k, b in taken] or [(-1, -1)], "_k2 long, _b2 long")
    fixed = spark.createDataFrame([(k, p) for k, p in enumerate(passes)] or [(-1, 0)], "_k3 long, _pass long")
    rows = (
        rows.join(F.broadcast(extra), (F.col("_k") == F.col("_k2")) & (F.col("_block") == F.col("_b2")), "left")
        .join(F.broadcast(fixed), F.col("_k") == F.col("_k3"), "left")
        .withColumn("_part", F.col("_k2").isNotNull().cast("int"))
        .drop("_k2", "_b2", "_k3")
    )
    rows = _with_edges(rows, sources, edge, rest, seed)
    rows = rows.withColumn("_copies", F.coalesce("_pass", F.lit(0)) + F.greatest("_part", F.coalesce("_leaf", F.lit(0))))
    return _with_shards(rows, sources, passes, taken, edge, shards, seed)


def take(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them, each row as often as it has copies, with shard and shard_order.

    Copies are looked up by the row's hash. Of equal rows one comes back as often as all of them are taken.
    """
    names = [c for c in docs.columns if c not in ("shard", "shard_order")]
    mixed = _mixed(docs, shards, seed).withColumnRenamed("_h", "key")
    total = mixed.groupBy("key").agg(F.sum("_copies").alias("_sum"), F.count("*").alias("_n"), F.min("_shard").alias("shard"), F.min("_order").alias("shard_order")).where("_sum > 0")
    keyed = docs.withColumn("_text", F.col("text")).withColumn("key", _hash(seed)).drop("_text").select(*names, "key")
    single = keyed.join(total, "key")
    rows = single.where("_n = 1").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int")))).select(*names, "shard", "shard_order")
    repeated = single.where("_n > 1").dropDuplicates(["key"]).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int")))).select(*names, "shard", "shard_order")
    return rows.unionByName(repeated)


def _with_edges(rows: DataFrame, sources: list[Source], edge: dict[int, list[int]], rest: list[float], seed: int) -> DataFrame:
    """Adds ``_leaf``: 1 for rows of a boundary block that the rest of their source's target still takes.

    A boundary block is cut by further hash bits into 64 parts, whole parts are taken in order,
    and the part in which the rest ends is cut again, until it has LEAF_WORDS at most. Of that
    leaf, equal rows are one item with a count; items are taken in hash order up to the first that
    does not fit, and from the others the largest that still fit, which leaves a small rest.
    """
    spark = rows.sparkSession
    if not edge:
        return rows.withColumn("_leaf", F.lit(0))
    now = {k: rest[k] for k in edge}  # words left of each source
    path: dict[int, list[int]] = {k: [] for k in edge}
    full: list[tuple[int, str]] = []

    def digits(n: int) -> Column:
        parts = [((F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "_h"), 6 * i)).bitwiseAND(63)).cast("string") for i in range(n)]
        return F.concat_ws(".", *parts) if parts else F.lit("")

    at_edge = spark.createDataFrame([(k, b) for k, mine in edge.items() for b in mine], "_k4 long, _b4 long")
    inside = rows.join(F.broadcast(at_edge), (F.col("_k") == F.col("_k4")) & (F.col("_block") == F.col("_b4"))).select("_k", "_h", "size", "doc_id")
    done: dict[int, str] = {}
    for depth in range(1, 10):
        todo = [k for k in now if k not in done]
        if not todo:
            break
        prefix = spark.createDataFrame([(k, ".".join(map(str, path[k]))) for k in todo], "_k4 long, _p4 string")
        part = inside.join(F.broadcast(prefix), (F.col("_k") == F.col("_k4")) & (digits(depth - 1) == F.col("_p4")))
        sums = part.groupBy("_k", F.element_at(F.split(digits(depth), r"\."), -1).cast("int").alias("d")).agg(F.sum("size").alias("n")).collect()
        by: dict[int, dict[int, int]] = {}
        for r in sums:
            by.setdefault(r["_k"], {})[r["d"]] = int(r["n"])
        for k in todo:
            parts = by.get(k, {})
            if sum(parts.values()) <= LEAF_WORDS or depth == 9:
                done[k] = ".".join(map(str, path[k]))
                continue
            left = now[k]
            for d in sorted(parts):
                if parts[d] <= left:
                    full.append((k, ".".join(map(str, [*path[k], d]))))
                    left -= parts[d]
                else:
                    path[k].append(d)
                    break
            now[k] = left
    leaf = spark.createDataFrame([(k, p, now[k]) for k, p in done.items()], "_k4 long, _p4 string, _left double")
    depth_of = {k: len(p.split(".")) if p else 0 for k, p in done.items()}
    depths = sorted(set(depth_of.values()))
    at_leaf = F.lit(None).cast("string")
    for n in depths:
        at_leaf = F.when(F.col("_k").isin([k for k, d in depth_of.items() if d == n]), digits(n)).otherwise(at_leaf)
    items = (
        inside.withColumn("_p", at_leaf)
        .join(F.broadcast(leaf), (F.col("_k") == F.col("_k4")) & (F.col("_p") == F.col("_p4")))
        .where("size > 0")
        .groupBy("_k", "_left", "_h", "size")
        .agg(F.count("*").alias("n"))
    )
    start = "named_struct('left', {}, 'open', true, 'seen', cast(array() as array<bigint>), 'out', cast(array() as array<struct<h: bigint, m: bigint>>))"
    step = (
        "named_struct('left', s.left - x.size * ({0}), 'open', {1}, 'seen', case when {1} then concat(s.seen, array(x._h)) else s.seen end, "
        "'out', concat(s.out, array(named_struct('h', x._h, 'm', {0}))))"
    )
    walked = (
        items.groupBy("_k", "_left")
        .agg(F.sort_array(F.collect_list(F.struct("_h", "size", "n"))).alias("a"))  # LEAF_WORDS items at most
        .select("_k", "a", F.expr(f"aggregate(a, {start.format('cast(floor(_left + 0.5) as bigint)')}, (s, x) -> {step.format('case when s.open and x.size * x.n <= s.left then x.n else 0L end', 's.open and x.size * x.n <= s.left')})").alias("s"))
        .select("_k", "s", F.expr("transform(sort_array(transform(filter(a, x -> not array_contains(s.seen, x._h)), x -> struct(x.size as size, x._h as _h, x.n as n)), false), x -> x)").alias("b"))
        .select("_k", F.expr(f"concat(s.out, aggregate(b, {start.format('s.left')}, (t, x) -> {step.replace('s.', 't.').format('least(x.n, floor(t.left / x.size))', 'true')}, t -> t.out))").alias("o"))
        .select("_k", F.explode("o").alias("o"))
        .select(F.col("_k").alias("_k5"), F.col("o.h").alias("_h5"), F.col("o.m").alias("_m5"))
        .where("_m5 > 0")
    )
    whole = spark.createDataFrame(full or [(-1, "")], "_k6 long, _p6 string")
    length = F.size(F.split("_p6", r"\."))
    most = max([1, *[len(p.split(".")) for _, p in full]])
    hit = F.lit(False)
    for n in range(1, most + 1):
        hit = hit | ((length == n) & (F.col("_p6") == digits(n)))
    whole_rows = inside.join(F.broadcast(whole), (F.col("_k") == F.col("_k6")) & hit).select(F.col("_k").alias("_k7"), F.col("_h").alias("_h7")).distinct()
    chosen = walked.unionByName(whole_rows.select(F.col("_k7").alias("_k5"), F.col("_h7").alias("_h5"), F.lit(1 << 40).alias("_m5")))
    chosen = chosen.groupBy("_k5", "_h5").agg(F.max("_m5").alias("_m5"))
    joined = rows.join(chosen, (F.col("_k") == F.col("_k5")) & (F.col("_h") == F.col("_h5")), "left")
    # Where only some of several equal rows fit, the first ones get the copy; equal rows are interchangeable.
    few = joined.where(F.col("_m5").isNotNull())
    order = Window.partitionBy("_k", "_h").orderBy("doc_id")
    few = few.withColumn("_leaf", (F.row_number().over(order) <= F.col("_m5")).cast("int"))
    many = joined.where(F.col("_m5").isNull()).withColumn("_leaf", F.lit(0))
    return many.unionByName(few).drop("_k5", "_h5", "_m5")


def _with_shards(rows: DataFrame, sources: list[Source], passes: list[int], taken: dict, edge: dict[int, list[int]], shards: int, seed: int) -> DataFrame:
    """Adds the output shard of each row's block in its last pass, and a random order within the shard."""
    spark = rows.sparkSession
    quotas = np.array([(s.blocks if passes[k] else sum(1 for key in taken if key[0] == k) + len(edge.get(k, ()))) for k, s in enumerate(sources)], dtype=np.int64)
    if not len(quotas):
        return rows.withColumn("_shard", F.lit(None).cast("int")).withColumn("_order", F.lit(None).cast("long"))
    tree = splitting_tree(quotas, shards, np.random.default_rng([seed, 99]))
    owner = []
    for k, s in enumerate(sources):
        mine = list(range(s.blocks)) if passes[k] else [b for kk, b in taken if kk == k] + edge.get(k, [])
        mine = [mine[i] for i in np.random.default_rng([seed, k, 7]).permutation(len(mine))]
        owner += [(k, b, int(j)) for b, j in zip(mine, np.repeat(np.arange(shards), tree[:, k]), strict=True)]
    where = spark.createDataFrame(owner or [(-1, -1, 0)], "_k8 long, _b8 long, _shard int")
    out = rows.join(F.broadcast(where), (F.col("_k") == F.col("_k8")) & (F.col("_block") == F.col("_b8")), "left").drop("_k8", "_b8")
    out = out.withColumn("_shard", F.when(F.col("_copies") > 0, F.col("_shard")))
    return out.withColumn("_order", F.when(F.col("_copies") > 0, F.xxhash64(F.lit(seed + 2), "_h")))
