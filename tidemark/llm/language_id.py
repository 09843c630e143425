"""Language identification with a convolutional network over bytes.

Texts are cut into windows of WINDOW bytes. Every byte has a small embedding; filters of
several widths slide over it, the largest response of each filter in a window feeds a softmax
over the learned languages, and a text gets the mean of its windows' probabilities. The network
is trained in numpy on the driver from a bounded sample and scored in Arrow batches, SLICE_BYTES
of text at a time, so memory does not depend on the length of a text.

Edge cases: a null text, an empty one and one without any letter get ``und`` and score 0; they
still have a row. Repeated rows get equal results; ties go to the language first in code-point
order. An empty table gives an empty result. With no labelled row, everything is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._bytes import SLICE_BYTES, binary_views, slices
from tidemark.llm._common import bind_batches, fold, held_out

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Bounds of the training sample: rows of each language, characters and windows of each row.
SAMPLE_ROWS = 600
SAMPLE_CHARS = 20_000
SAMPLE_WINDOWS = 4
#: Windows scored in one step; chosen so that the responses stay in cache.
SLICE_WINDOWS = 64

_LETTER = re.compile(r"[^\W\d_]")


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (zero-padded, bytes + 1) of all rows, and the row of each; the last window of a row ends with it."""
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(nth * WINDOW, np.maximum(lengths[row] - WINDOW, 0)) + offsets[row]
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[row + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int16) + 1, 0).astype(np.int16), row


class ByteCnn:
    """Embedding, multi-width filters with ReLU and max pooling over a window, softmax."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = (rng.normal(0, 1, (w * EMBED, FILTERS)) / np.sqrt(w * EMBED)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = (rng.normal(0, 1, (len(WIDTHS) * FILTERS, len(languages))) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray, trace: dict | None = None) -> np.ndarray:
        e = self.p["e"][x]
        parts = []
        for w in WIDTHS:
            seen = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)
            flat = np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(len(x), WINDOW - w + 1, w * EMBED)
            h = (flat.reshape(-1, w * EMBED) @ self.p[f"f{w}"]).reshape(len(x), WINDOW - w + 1, FILTERS)
            if trace is not None:
                best = h.argmax(axis=1)
                trace[w] = (flat, best)
            parts.append(np.maximum(h.max(axis=1) + self.p[f"b{w}"], 0))
        return np.concatenate(parts, axis=1)

    def folded(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Responses as table rows: embedding and filter of a byte pair multiplied out beforehand.

        A filter of width 4 is the sum of a row of the first and a row of the second pair, one
        of width 3 of a pair and a byte, so scoring needs gathers and additions only.
        """
        one = {w: [self.p["e"] @ self.p[f"f{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)] for w in WIDTHS}
        pair = lambda x, y: (x[:, None, :] + y[None, :, :]).reshape(257 * 257, FILTERS)
        two = [pair(*one[2]), pair(one[3][0], one[3][1]), pair(one[4][0], one[4][1]), pair(one[4][2], one[4][3])]
        return [np.ascontiguousarray(t) for t in two], np.ascontiguousarray(one[3][2])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_tables"):
            self._tables = self.folded()
        pairs, last = self._tables
        bias = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])
        out = np.empty((len(x), len(self.languages)))
        for a in range(0, len(x), SLICE_WINDOWS):
            s = np.ascontiguousarray(x[a : a + SLICE_WINDOWS].T).astype(np.int32)  # bytes first, so that maxima run along memory
            at = s[:-1] * 257 + s[1:]
            three, four = np.take(pairs[1], at[:-1], axis=0), np.take(pairs[2], at[:-2], axis=0)
            three += np.take(last, s[2:], axis=0)
            four += np.take(pairs[3], at[2:], axis=0)
            top = [r.max(axis=0) for r in (np.take(pairs[0], at, axis=0), three, four)]
            z = (np.maximum(np.concatenate(top, axis=1) + bias, 0) @ self.p["o"] + self.p["c"]).astype(np.float64)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + SLICE_WINDOWS] = z / z.sum(axis=1, keepdims=True)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCnn:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                ids = order[a : a + batch]
                xb, yb, trace = x[ids], y[ids], {}
                h = self.pooled(xb, trace)
                z = h @ self.p["o"] + self.p["c"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(ids)), yb] -= 1
                z /= len(ids)
                g = {"o": h.T @ z, "c": z.sum(axis=0), "e": np.zeros_like(self.p["e"])}
                dh = (z @ self.p["o"].T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    flat, best = trace[w]
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    chosen = flat[np.arange(len(ids))[:, None], best]
                    g[f"f{w}"] = np.einsum("nfd,nf->df", chosen, d)
                    g[f"b{w}"] = d.sum(axis=0)
                    back = (d[:, :, None] * self.p[f"f{w}"].T[None]).reshape(len(ids), FILTERS, w, EMBED)
                    sym = xb[np.arange(len(ids))[:, None, None], best[:, :, None] + np.arange(w)]
                    np.add.at(g["e"], sym, back)
                step += 1
                for key, grad in g.items():
                    m[key] += 0.1 * (grad - m[key])
                    v2[key] += 0.001 * (grad * grad - v2[key])
                    self.p[key] -= (rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v2[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> ByteCnn | None:
    """A network for every language of rows outside fold 2 of 4 that has a text of at most ``chars`` characters.

    The sample has at most ``rows`` ids of each language, the first in the order of a hash of the
    id (of rows that share id and language one), and SAMPLE_WINDOWS windows of each text.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (fold("doc_id", 4) != 2))
    known = known.where(F.length("text") <= chars).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.xxhash64("doc_id").alias("_rank"), "text")
    # One scan for the ids: every task keeps only the first ranks of each language before they are shuffled.
    order = Window.partitionBy("_lang").orderBy("_rank", "_id")
    chosen = known.select("_id", "_lang", "_rank").withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= rows).select("_id", "_lang").distinct()
    got = known.join(F.broadcast(chosen), ["_id", "_lang"]).groupBy("_rank", "_id", "_lang").agg(F.min("text").alias("text")).collect()  # ``rows`` of each language at most
    languages = sorted({r["_lang"] for r in got})
    found = [(r["text"], languages.index(r["_lang"])) for r in sorted(got, key=lambda r: (r["_rank"], r["_id"], r["text"]))]
    if not found:
        return None
    rng = np.random.default_rng(3)
    xs, ys = [], []
    for text, code in found:
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        x, _ = windows_of(raw, np.array([0, len(raw)]))
        if len(x) > SAMPLE_WINDOWS:
            x = x[rng.choice(len(x), SAMPLE_WINDOWS, replace=False)]
        xs.append(x)
        ys.append(np.full(len(x), code))
    return ByteCnn(languages).train(np.concatenate(xs), np.concatenate(ys))


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    bind_batches(docs.sparkSession)
    names = model.languages if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_views(batch.column("text"))
            n = len(offsets) - 1
            total, count = np.zeros((n, max(len(names), 1))), np.zeros(n)
            texts = batch.column("text")
            letters = np.array([bool(t) and _LETTER.search(t) is not None for t in (v.as_py() for v in texts)], dtype=bool) if n else np.zeros(0, bool)
            for a, b in slices(offsets) if model else ():
                for lo in range(int(offsets[a]), int(offsets[b]), SLICE_BYTES) if b == a + 1 else [int(offsets[a])]:
                    part = np.array([lo, min(lo + SLICE_BYTES, int(offsets[b]))]) if b == a + 1 else offsets[a : b + 1]
                    x, row = windows_of(data, part)
                    p = model.probabilities(x)
                    for k in range(len(names)):
                        total[a:b, k] += np.bincount(row, weights=p[:, k], minlength=b - a)
                    count[a:b] += np.bincount(row, minlength=b - a)
            mean = total / np.maximum(count, 1)[:, None]
            best = mean.argmax(axis=1) if n else np.zeros(0, int)
            sure = letters & (count > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([names[k] if ok else "und" for k, ok in zip(best, sure, strict=True)], pa.string()),
                    pa.array(np.where(sure, np.minimum(mean[np.arange(n), best], 1.0), 0.0)),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
