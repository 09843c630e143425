"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of PASSAGE bytes. Every passage is encoded (shares of byte classes,
hashed byte pairs, repetition of words), projected, and given a weight by gated attention,
softmax(w . (tanh(V x) * sigmoid(U x))); the score is the logistic of the weighted mean. Only
labels of whole documents are used: which passages matter is learned. Training is numpy on a
bounded sample on the driver; scoring runs in Arrow batches over whole texts.

Edge cases: a null or empty text is one passage of zeros and gets that score. Repeated rows get
equal scores. An empty table gives an empty result. Without labels of both classes every score
is the share of label 1 in the sample (0.5 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import SLICE_BYTES, binary_views, joined, prefix_hash, slices, span_hash, words_of
from tidemark.llm._common import bind_batches, held_out, labelled_sample, lean

PASSAGE = 512
HASHED = 64
HIDDEN = 16
THRESHOLD = 0.3

_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % HASHED


def _classes() -> tuple[np.ndarray, int]:
    """Byte classes: lower, upper, digit, blank, line end, bytes of other scripts, control, and each ASCII mark by itself."""
    kind = np.full(256, 6)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r")):
        kind[list(chars)] = k
    kind[128:] = 5
    n = 7
    for c in range(33, 127):
        if not chr(c).isalnum():
            kind[c] = n
            n += 1
    return kind, n


_CLASS, N_CLASS = _classes()
N_FEATURES = N_CLASS + HASHED + 4


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the rows, and the row of each passage; an empty row has one passage of zeros."""
    n = len(offsets) - 1
    text, starts = joined(data, offsets, 0, n)
    lengths = np.diff(offsets)
    count = np.maximum(-(-lengths // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    row_of = np.repeat(np.arange(n), count)
    at = np.arange(len(text)) - np.repeat(starts[:-1], np.diff(starts))
    row = np.repeat(np.arange(n), np.diff(starts))
    # A short last passage is joined to the one before it.
    nth = np.minimum(at // PASSAGE, np.maximum(lengths // PASSAGE - 1, 0)[row])
    passage = first[row] + nth
    used = int(first[-1])
    x = np.zeros((used, N_FEATURES), np.float32)
    x[:, :N_CLASS] = np.bincount(passage * N_CLASS + _CLASS[text], minlength=used * N_CLASS).reshape(used, N_CLASS)
    x[np.arange(used), 4] -= np.bincount(passage[starts[1:] - 1], minlength=used)  # the line ends put in by joined()
    if len(text) > 1:
        pair = _PAIR[text[:-1].astype(np.int64) * 256 + text[1:]]
        x[:, N_CLASS : N_CLASS + HASHED] = np.bincount(passage[:-1] * HASHED + pair, minlength=used * HASHED).reshape(used, HASHED)
    size = np.maximum(x[:, :N_CLASS].sum(axis=1), 1)
    x[:, :N_CLASS] /= size[:, None]
    x[:, N_CLASS : N_CLASS + HASHED] /= size[:, None]
    s, e = words_of(text)
    if len(s):
        q = prefix_hash(text)
        h = span_hash(q, s, e)
        p = passage[s]
        n_words = np.bincount(p, minlength=used)
        order = np.lexsort((h, p))
        ps, hs = p[order], h[order]
        fresh = np.concatenate([[True], (np.diff(ps) != 0) | (np.diff(hs) != 0)])
        distinct = np.bincount(ps[fresh], minlength=used)
        chars = np.bincount(p, weights=(e - s).astype(float), minlength=used)
        after = np.concatenate([[False], (h[1:] == h[:-1]) & (p[1:] == p[:-1])])
        x[:, -4] = distinct / np.maximum(n_words, 1)
        x[:, -3] = np.log1p(chars / np.maximum(n_words, 1))
        x[:, -2] = np.bincount(p, weights=after, minlength=used) / np.maximum(n_words, 1)
        x[:, -1] = np.log1p(n_words) / 5
    keep = np.ones(used, bool)
    keep[first[1:] - 1] = (lengths % PASSAGE == 0) | (count == 1)
    keep[first[:-1]] = True
    x[:, :N_CLASS] = np.sqrt(np.maximum(x[:, :N_CLASS], 0))
    x[:, N_CLASS : N_CLASS + HASHED] = np.sqrt(x[:, N_CLASS : N_CLASS + HASHED])
    return x[keep], row_of[keep]


class GatedAttention:
    """Score of a bag: logistic(sum_k a_k (C . relu(P x_k)) + c), a = softmax over the bag of gated attention."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float64)
        self.p = {"V": normal(N_FEATURES, HIDDEN), "U": normal(N_FEATURES, HIDDEN), "w": normal(HIDDEN), "P": normal(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "C": normal(HIDDEN), "c": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def _forward(self, x: np.ndarray, row: np.ndarray, n: int) -> dict:
        t, s = np.tanh(x @ self.p["V"]), 1 / (1 + np.exp(-(x @ self.p["U"])))
        g = (t * s) @ self.p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, row, g)
        a = np.exp(g - top[row])
        a /= np.bincount(row, weights=a, minlength=n)[row]
        h = np.maximum(x @ self.p["P"] + self.p["b"], 0)
        v = h @ self.p["C"]
        z = np.bincount(row, weights=a * v, minlength=n) + self.p["c"][0]
        return {"t": t, "s": s, "a": a, "h": h, "v": v, "z": z, "y": 1 / (1 + np.exp(-np.clip(z, -40, 40)))}

    def scores(self, x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        return self._forward((x - self.mean) / self.scale, row, n)["y"]

    def train(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> GatedAttention:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        m, v2, step = {k: 0.0 * a for k, a in self.p.items()}, {k: 0.0 * a for k, a in self.p.items()}, 0
        start = np.searchsorted(row, np.arange(len(y) + 1))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                bags = order[i : i + batch]
                take = np.concatenate([np.arange(start[b], start[b + 1]) for b in bags])
                r = np.repeat(np.arange(len(bags)), start[bags + 1] - start[bags])
                xb = x[take]
                f = self._forward(xb, r, len(bags))
                dz = (f["y"] - y[bags]) / len(bags)
                d = dz[r]
                mean = np.bincount(r, weights=f["a"] * f["v"], minlength=len(bags))
                dg = d * f["a"] * (f["v"] - mean[r])
                dv = d * f["a"]
                dh = dv[:, None] * self.p["C"] * (f["h"] > 0)
                dts = dg[:, None] * self.p["w"]
                grad = {
                    "w": (f["t"] * f["s"]).T @ dg,
                    "V": xb.T @ (dts * f["s"] * (1 - f["t"] ** 2)),
                    "U": xb.T @ (dts * f["t"] * f["s"] * (1 - f["s"])),
                    "C": f["h"].T @ dv,
                    "P": xb.T @ dh,
                    "b": dh.sum(axis=0),
                    "c": np.array([dz.sum()]),
                }
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit_texts(texts: list[str], labels: list[int]) -> GatedAttention:
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    if not raw:
        return GatedAttention().train(np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros(0))
    parts, rows = [], []
    for a, b in slices(offsets, SLICE_BYTES // 4):  # the driver has less memory than a worker
        x, row = encode(np.frombuffer(b"".join(raw[a:b]), dtype=np.uint8), offsets[a : b + 1] - offsets[a])
        parts.append(x)
        rows.append(row + a)
    del raw
    return GatedAttention().train(np.concatenate(parts), np.concatenate(rows), np.array(labels, dtype=float))


def fit(docs: DataFrame, labels: DataFrame) -> GatedAttention:
    got = sorted(labelled_sample(docs, labels, "quality").collect(), key=lambda r: (r["_rank"], r["_id"], r["text"]))
    return fit_texts([r["text"] for r in got], [r["label"] for r in got])


def score_columns(model: GatedAttention, text: pa.Array) -> np.ndarray:
    data, offsets = binary_views(text)
    out = np.zeros(len(offsets) - 1)
    for a, b in slices(offsets):
        out[a:b] = _long(model, data, int(offsets[a]), int(offsets[b])) if b == a + 1 else model.scores(*encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)
    return out


def _long(model: GatedAttention, data: np.ndarray, lo: int, hi: int, most: int = PASSAGE * 4096) -> np.ndarray:
    """Score of one text; a very long one is encoded a part at a time, with a passage of its neighbours on either side."""
    parts = []
    for i in range(lo, max(hi, lo + 1), most):
        if i > lo and hi - i < PASSAGE:
            break  # joined to the passage before it
        a, b = max(i - PASSAGE, lo), min(i + most + PASSAGE, hi)
        b = hi if hi - b < PASSAGE else b
        x, _ = encode(data[a:b], np.array([0, b - a]))
        parts.append(x[int(i > a) : int(i > a) + most // PASSAGE])
    x = np.concatenate(parts)
    return model.scores(x, np.zeros(len(x), int), 1)


def with_score(docs: DataFrame, model: GatedAttention, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (double, replaces one of that name), computed from ``text``."""
    bind_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(score_columns(model, batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], score], [*columns, name])

    rows = docs.select(*columns)
    return rows.mapInArrow(lean(run), rows.withColumn(name, F.lit(0.0)).schema)


def predict(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    bind_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_columns(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")
