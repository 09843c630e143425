"""Embedding near-dedup with hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one class. Classes are dealt to shards of about SHARD_ROWS; each shard builds
its graph in one task. Every class then queries every shard, BLOCK_ROWS queries to a task, all
beams of a step together. Each (block, shard) task audits its beams before it uses them: on queries
planted at just COSINE from known nodes, so that no audit is without true links, and on a sample
of its own queries, answered by an exact scan. The beam is widened until both audits find RECALL
of the links; where BEAM_MOST does not do it, the block is answered by an exact scan. A query whose beam
is half full of links may have more than fit, so it is answered by an exact scan of that shard.
Every link is verified by its cosine in double precision. Tasks return sums of links for each
vector and a spanning forest of their links, both linear in the vectors they saw, never all
pairs of a dense group. ``audited_recall`` is the share of true links that the audits found
at the beams used. Within a shard both vectors of a pair search, and each counts the links that its
own search found.

Edge cases: a vector that is null, zero or has null or non-finite components (or another
length than most) links with nothing and is its own component. Equal vectors are linked with each
other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import bind_batches, cut
from tidemark.llm._graph import components

COSINE = 0.95
SHARD_ROWS = 32768
BLOCK_ROWS = 8192
#: Queries whose beams move together.
STEP = 1024
LINKS = 12
BEAM = 48
BEAM_MOST = 384
BUILD_BEAM = 48
RECALL = 0.98
#: Planted queries, and own queries with an exact scan, of each audit.
PLANTED, AUDIT = 128, 64
WIDE = 4  # beam members expanded in one step


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, axis=1), axis=1, kind="stable"), axis=1)
    return np.argsort(-sims, axis=1, kind="stable")


class Graph:
    """A small-world graph over unit vectors; level l holds every node whose own level is at least l."""

    def __init__(self, x: np.ndarray, seed: int = 17) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(int), 8)
        order = np.lexsort((rng.random(n), -self.level))  # the highest levels first
        self.entry = int(order[0]) if n else -1
        self.top = int(self.level[self.entry]) if n else 0
        self.near = [np.full((n, 2 * LINKS if lv == 0 else LINKS), -1, np.int32) for lv in range(self.top + 1)]
        done = 1
        while done < n:
            batch = order[done : done + min(max(1, done // 3), 512)]
            self._insert(batch)
            done += len(batch)

    def _search(self, q: np.ndarray, start: np.ndarray, beam: int, lv: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` nodes (ids, similarities; -1 where fewer) from the nodes ``start`` (one row for each query)."""
        b, n = len(q), len(self.x)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        k = min(start.shape[1], beam)
        ids[:, :k] = start[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("bd,bkd->bk", q, self.x[ids[:, :k]]), -np.inf)
        seen = np.zeros((b, n + 1), bool)
        np.put_along_axis(seen, np.where(ids >= 0, ids, n), True, axis=1)
        opened = np.zeros((b, beam), bool)
        live = np.arange(b)
        while len(live):
            s = np.where(opened[live] | (ids[live] < 0), -np.inf, sims[live])
            pick = _best(s, min(WIDE, beam))
            value = np.take_along_axis(s, pick, axis=1)
            go = value[:, 0] > -np.inf
            live, pick, value = live[go], pick[go], value[go]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            cur = np.where(value > -np.inf, np.take_along_axis(ids[live], pick, axis=1), 0)
            nxt = self.near[lv][cur]
            nxt[value == -np.inf] = -1
            nxt = nxt.reshape(len(live), -1).astype(np.int64)
            nxt.sort(axis=1)
            nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = -1
            nxt[seen[live[:, None], nxt]] = -1  # column n belongs to "none" as index -1
            seen[live[:, None], nxt] = True
            seen[:, n] = False
            new = np.where(nxt >= 0, np.einsum("bd,bkd->bk", q[live], self.x[nxt]), -np.inf)
            all_s = np.concatenate([sims[live], new], axis=1)
            keep = _best(all_s, beam)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], nxt], axis=1), keep, axis=1)
            sims[live] = np.take_along_axis(all_s, keep, axis=1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros_like(nxt, bool)], axis=1), keep, axis=1)
            ids[live[:, None], np.arange(beam)] = np.where(sims[live] > -np.inf, ids[live], -1)
        return ids, sims

    def _diverse(self, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of the candidates (sorted, -1 for none): first those nearer to q than to any taken, then the nearest left."""
        x = self.x[ids]
        to_q = np.where(ids >= 0, np.einsum("bd,bkd->bk", q, x), -np.inf)
        among = np.einsum("bid,bjd->bij", x, x)
        b, c = ids.shape
        worst = np.full((b, c), -np.inf, np.float32)  # largest similarity to one taken so far
        taken = np.zeros((b, c), bool)
        count = np.zeros(b, int)
        for i in range(c):
            ok = (to_q[:, i] > worst[:, i]) & (count < most) & (ids[:, i] >= 0)
            taken[:, i] = ok
            count += ok
            worst = np.where(ok[:, None], np.maximum(worst, among[:, i]), worst)
        rank = np.where(taken, 2.0, 0.0) + np.where(ids >= 0, np.arange(c, 0, -1) / (c + 1), -9.0)
        keep = np.argsort(-rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(rank, keep, axis=1) > -1, np.take_along_axis(ids, keep, axis=1), -1)

    def _insert(self, batch: np.ndarray) -> None:
        q = self.x[batch]
        start = np.full((len(batch), 1), self.entry, np.int64)
        within = q @ q.T
        np.fill_diagonal(within, -np.inf)
        for lv in range(self.top, -1, -1):
            mine = self.level[batch] >= lv
            start, _ = self._search(q, start, BUILD_BEAM if mine.any() else 4, lv)
            if not mine.any():
                continue
            peers = np.where(mine[None, :], within, -np.inf)
            k = min(8, len(batch))
            col = _best(peers, k)
            fellow = np.where(np.take_along_axis(peers, col, axis=1) > -np.inf, batch[col], -1)
            cand = np.concatenate([start, fellow], axis=1)[mine]
            me = batch[mine]
            cand[cand == me[:, None]] = -1
            s = np.where(cand >= 0, np.einsum("bd,bkd->bk", self.x[me], self.x[cand]), -np.inf)
            col = _best(s, min(32, cand.shape[1]))
            cand = np.where(np.take_along_axis(s, col, axis=1) > -np.inf, np.take_along_axis(cand, col, axis=1), -1)
            chosen = self._diverse(self.x[me], cand, LINKS)
            self.near[lv][me, : chosen.shape[1]] = chosen
            self._link_back(lv, np.repeat(me, chosen.shape[1]), chosen.ravel())

    def _link_back(self, lv: int, new: np.ndarray, old: np.ndarray) -> None:
        near = self.near[lv]
        good = old >= 0
        new, old = new[good], old[good]
        order = np.argsort(old, kind="stable")
        new, old = new[order], old[order]
        nodes, at, count = np.unique(old, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 2048):
            v, c = nodes[a : a + 2048], count[a : a + 2048]
            wide = int(c.max())
            extra = np.full((len(v), wide), -1, np.int64)
            row = np.repeat(np.arange(len(v)), c)
            nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            extra[row, nth] = new[at[a] : at[a] + int(c.sum())]
            cand = np.concatenate([near[v].astype(np.int64), extra], axis=1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            cand[cand == v[:, None]] = -1
            s = np.where(cand >= 0, np.einsum("bd,bkd->bk", self.x[v], self.x[cand]), -np.inf)
            col = _best(s, min(64, cand.shape[1]))
            cand = np.where(np.take_along_axis(s, col, axis=1) > -np.inf, np.take_along_axis(cand, col, axis=1), -1)
            kept = self._diverse(self.x[v], cand, near.shape[1])
            near[v] = -1
            near[v[:, None], np.arange(kept.shape[1])] = kept

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, np.float32)
        start = np.full((len(q), 1), self.entry, np.int64)
        for lv in range(self.top, 0, -1):
            start, _ = self._search(q, start, 4, lv)
        return self._search(q, start, beam, 0)

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.x), self.x.shape[1], self.top, self.entry], np.int64).tobytes(), *[a.tobytes() for a in self.near]])

    @staticmethod
    def load(blob: bytes, x: np.ndarray) -> Graph:
        g = Graph.__new__(Graph)
        n, _, g.top, g.entry = (int(v) for v in np.frombuffer(blob, np.int64, 4))
        g.x, g.near, at = np.ascontiguousarray(x, np.float32), [], 32
        for lv in range(g.top + 1):
            w = 2 * LINKS if lv == 0 else LINKS
            g.near.append(np.frombuffer(blob, np.int32, n * w, at).reshape(n, w))
            at += 4 * n * w
        return g


def planted(x: np.ndarray, many: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, for each, a query at a hair above ``cosine`` from it, in a random direction."""
    rng = np.random.default_rng(len(x))
    nodes = rng.choice(len(x), min(many, len(x)), replace=False)
    base = x[nodes]
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    size = np.sqrt((away * away).sum(axis=1, keepdims=True))
    away = np.divide(away, size, out=np.zeros_like(away), where=size > 1e-9)
    near = min(cosine + 1e-3, 1.0)
    return nodes, near * base + np.sqrt(1 - near * near) * away


def links(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float = COSINE, beam: int = BEAM, own: int | None = None, audits: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (queries, nodes) of cosine at least ``cosine`` (unit vectors in double), in bounded parts, a query in one part only.

    Queries that are nodes themselves, from node ``own`` on, are not linked with themselves.
    ``audits`` gets two numbers added: true links that the audits know of, and those found.
    """
    if not len(q) or not len(x):
        return
    slack = np.float32(cosine - 1e-4)

    def scan(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = q[some] @ x.T >= cosine
        if own is not None:
            out[np.arange(len(some)), own + some] = False
        r, c = np.nonzero(out)
        return some[r], c

    audit = np.sort(np.random.default_rng(0).permutation(len(q))[:AUDIT])
    u, v = scan(audit)
    yield u, v
    rest = np.setdiff1d(np.arange(len(q)), audit)
    if not len(rest):
        return
    nodes, probes = planted(x, PLANTED, cosine)
    while True:
        beam = min(beam, len(x))
        ids, _ = graph.query(probes, beam)
        hits = int((ids == nodes[:, None]).any(axis=1).sum())
        ok = hits >= RECALL * len(nodes)
        found = 0
        if ok and len(u):
            asked = np.unique(u)
            ids, sims = graph.query(q[asked], beam)
            full = ((sims >= slack) & (ids >= 0)).sum(axis=1) * 2 >= beam
            mine = np.searchsorted(asked, u)
            found = int((full[mine] | (ids[mine] == v[:, None]).any(axis=1)).sum())
            ok = found >= RECALL * len(u)
        if ok or beam >= min(BEAM_MOST, len(x)):
            break
        beam *= 2
    if audits is not None:
        audits += [len(nodes) + len(u), hits + found if ok else len(nodes) + len(u)]
    for a in range(0, len(rest), STEP):
        some = rest[a : a + STEP]
        dense = some
        if ok:
            ids, sims = graph.query(q[some], beam)
            hit = (sims >= slack) & (ids >= 0)
            full = hit.sum(axis=1) * 2 >= beam
            dense = some[full]
            r, c = np.nonzero(hit & ~full[:, None])
            u, v = some[r], ids[r, c]
            good = np.einsum("id,id->i", q[u], x[v]) >= cosine
            if own is not None:
                good &= own + u != v
            yield u[good], v[good]
        for b in range(0, len(dense), 256):
            yield scan(dense[b : b + 256])


class Forest:
    """Spanning forest of links between queries and nodes, kept while they arrive."""

    def __init__(self, queries: int, nodes: int) -> None:
        self.label, self.queries = np.arange(queries + nodes), queries
        self.edges: list[tuple[int, int]] = []

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        """Links (u, v) with equal u side by side."""
        if not len(u):
            return
        starts = np.flatnonzero(np.concatenate([[True], np.diff(u) != 0]))
        for a, b in zip(starts, [*starts[1:], len(u)], strict=True):
            query, some = int(u[a]), v[a:b]
            of = self.label[self.queries + some]
            for label, at in zip(*np.unique(of, return_index=True), strict=True):
                mine = self.label[query]
                if label != mine:
                    self.label[self.label == label] = mine
                    self.edges.append((query, int(some[at])))


def units_of(column: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision as bytes; None for a vector that links with nothing."""
    out: list[bytes | None] = [None] * len(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for n in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == n)
        x = values[offsets[rows][:, None] + np.arange(n)]
        most = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (most > 0)
        rows, x = rows[good], x[good] / most[good][:, None]
        x = x / np.sqrt(np.einsum("id,id->i", x, x))[:, None] + 0.0
        for i, unit in zip(rows.tolist(), x, strict=True):
            out[i] = unit.tobytes()
    return out


def neighbours(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    bind_batches(spark, 2000)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = units_of(batch.column("embedding"))
            uids = [hashlib.md5(u).digest() if u else None for u in units]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(uids, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "uid", "unit"])

    rows = cut(vectors.select("vec_id", "embedding").mapInArrow(prepare, f"vec_id {kind}, uid binary, unit binary"))
    classes = cut(rows.where("uid is not null").groupBy("uid").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("times"), F.min("unit").alias("unit")))
    n = classes.count()
    shards = max(1, -(-n // SHARD_ROWS))  # dealt by hash, so of about equal size
    placed = classes.select("uid", "times", "unit", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for s, u, t, x in zip(*(batch.column(c).to_pylist() for c in ("shard", "uid", "times", "unit")), strict=True):
                held.setdefault(s, []).append((len(x), u, t, x))
        for s in sorted(held):
            mine = sorted(held.pop(s))
            sizes = sorted({m[0] for m in mine})
            for size in sizes:  # vectors of different lengths never link
                some = [m for m in mine if m[0] == size]
                x = np.frombuffer(b"".join(m[3] for m in some)).reshape(len(some), -1)
                arrays = [[s], [size], [b"".join(m[1] for m in some)], [np.array([m[2] for m in some], np.int64).tobytes()], [x.tobytes()], [Graph(x).dump()]]
                types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], ["shard", "size", "uids", "times", "units", "graph"])

    built = cut(placed.repartition(shards, "shard").mapInArrow(build, "shard int, size int, uids binary, times binary, units binary, graph binary"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of queries and each shard from its own on (links are symmetric)."""
        for batch in batches:
            for s, size, uids, times, units in zip(*(batch.column(c).to_pylist() for c in ("shard", "size", "uids", "times", "units")), strict=True):
                m = len(uids) // 16
                for a in range(0, m, BLOCK_ROWS):
                    b = min(a + BLOCK_ROWS, m)
                    for other in range(s, shards):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([other], pa.int32()), pa.array([size], pa.int32()), pa.array([s], pa.int32()), pa.array([a], pa.int32()), pa.array([uids[16 * a : 16 * b]]), pa.array([times[8 * a : 8 * b]]), pa.array([units[size * a : size * b]])],
                            ["shard", "size", "home", "first", "q_uids", "q_times", "q_units"],
                        )

    asked = built.select("shard", "size", "uids", "times", "units").mapInArrow(blocks, "shard int, size int, home int, first int, q_uids binary, q_times binary, q_units binary")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                d = get["size"] // 8
                x, q = np.frombuffer(get["units"]).reshape(-1, d), np.frombuffer(get["q_units"]).reshape(-1, d)
                own = get["home"] == get["shard"]
                t_x, t_q = np.frombuffer(get["times"], np.int64), np.frombuffer(get["q_times"], np.int64)
                of_q, of_x, forest, audits = np.zeros(len(q)), np.zeros(len(x)), Forest(len(q), len(x)), []
                for u, v in links(Graph.load(get["graph"], x), x, q, own=get["first"] if own else None, audits=audits):
                    of_q += np.bincount(u, weights=t_x[v], minlength=len(q))
                    if not own:
                        of_x += np.bincount(v, weights=t_q[u], minlength=len(x))
                    forest.add(u, v)
                uid, other, add = [b"", b""][: len(audits)], [None, None][: len(audits)], list(audits)  # no vector has an empty uid
                kinds = ["true", "found"][: len(audits)]
                for names, total in ((get["q_uids"], of_q), (get["uids"], of_x)):
                    for k in np.flatnonzero(total).tolist():
                        uid.append(names[16 * k : 16 * k + 16])
                        other.append(None)
                        add.append(int(total[k]))
                for a, b in forest.edges:
                    uid.append(get["q_uids"][16 * a : 16 * a + 16])
                    other.append(get["uids"][16 * b : 16 * b + 16])
                    add.append(0)
                kinds += ["link"] * (len(uid) - len(kinds))
                if uid:
                    yield pa.RecordBatch.from_arrays([pa.array(uid, pa.binary()), pa.array(other, pa.binary()), pa.array(add, pa.int64()), pa.array(kinds)], ["u", "v", "n", "kind"])

    tasks = asked.repartition("shard", "home", "first").join(built, ["shard", "size"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row holds a shard
    try:
        found = cut(tasks.mapInArrow(answer, "u binary, v binary, n long, kind string"))
    finally:
        bind_batches(spark, 2000)
    audit = {r["kind"]: r["n"] for r in found.where("kind <> 'link'").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    found = found.where("kind = 'link'")
    recall = audit["found"] / audit["true"] if audit.get("true") else 1.0  # no audit: everything was scanned
    sums = found.where("v is null").groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("links"))
    roots = components(found.where("v is not null").select("u", "v"))
    known = classes.select("uid", "first_id", "times").join(sums, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    known = known.select("uid", "first_id", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "uid").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("first_id").alias("component")), "root").select("uid", (F.col("links") + F.col("times") - 1).alias("_n"), "component")
    out = rows.select("vec_id", "uid").join(named, "uid", "left")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audited_recall", F.lit(recall))
