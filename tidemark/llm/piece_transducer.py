"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A vocabulary file is compiled into a transducer with three parts: the normaliser (a blank becomes
the piece marker, one marker is put before a text), the pieces as a trie over characters, and
byte fallback for characters that no piece has. Composed with an input it is a lattice whose arcs
are pieces; the encoding is the shortest path in the tropical semiring (min, +).

* Unigram vocabularies: an arc weighs minus the score of its piece.
* Merge (BPE) vocabularies: scores are merge priorities and do not add up. Here the state also
  holds the last piece; an arc weighs 0 if the merges never join across the two pieces and
  infinity if they would. Exactly one path is finite, the one that the merges produce, so the
  result equals that of the reference library (tested).

Pieces contain the marker only at their start, or are runs of it, so a text splits into words
before composition; the words of a batch that are not in a bounded cache are composed together,
one numpy step per character. Decoding is the inverse transducer: bytes of the pieces, with the
marker turned into a blank and the first blank removed.

Edge cases: a null or empty text has no ids and decodes to an empty text. A text with a literal
marker (U+2581) decodes to a blank there, as in the reference library; ``round_trip`` is false
for it. Control pieces are never produced from text. Rows are independent; extra columns are
kept by ``with_ids`` (a column of the same name is replaced). An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import bind_batches, lean

MARK = "▁"
#: Vocabulary used by the queries (a public one; never copied into this repository).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_WORDS = 250_000
SLICE_CHARS = 1 << 21
_INF = np.float64(np.inf)


class HashTable:
    """Open addressing over int64 keys >= 0, probed a whole array at a time."""

    def __init__(self, size: int = 1 << 12) -> None:
        self.keys, self.values, self.n = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(len(self.keys)).bit_length() + 1)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        while 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys >= 0
            old = self.keys[full], self.values[full]
            self.keys, self.values, self.n = np.full(4 * len(self.keys), -1, np.int64), np.zeros(4 * len(self.keys), np.int32), 0
            self.add(*old)
        mask, at = len(self.keys) - 1, self._at(keys)
        todo = np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]  # of several for one slot, one wins
            won = self.keys[slot] == keys[todo]
            self.values[slot[won]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & mask
        self.n += len(keys)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(len(keys), missing, np.int32)
        mask, at, todo = len(self.keys) - 1, self._at(keys), np.arange(len(keys))
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], (at[on] + 1) & mask
        return out


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    merges: bool  # merge priorities rather than additive scores
    dummy_prefix: bool


def read_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only identity normalisation with marked blanks is supported")
    return Vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.trainer_spec.model_type == 2, norm.add_dummy_prefix)


class PieceTransducer:
    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.v = vocabulary
        self.id_of = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] in (1, 4)}
        self.byte_id = np.full(256, v.kinds.index(2) if 2 in v.kinds else 0, np.int32)
        for i, p in enumerate(v.pieces):
            if v.kinds[i] == 6:
                self.byte_id[int(p[3:5], 16)] = i
        self.runs = {len(p): i for p, i in self.id_of.items() if set(p) == {MARK}} if v.merges else {}
        # Where no piece has a letter before a mark, no path crosses that place: texts are cut there too.
        inside = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        free = "".join(c for c in ",.;:!?" if not any(pair[1] == c and pair[0].isalpha() for pair in inside))
        tail = f"|(?<=[^\\W\\d_])[{free}][^ \\n]*" if free else ""
        word = f" ?(?:[^\\W\\d_]+(?=[{free}])|[^ \\n]+)" if free else " ?[^ \\n]+"
        self.split_text = re.compile(rf"{word}{tail}|\n| +(?= [^ \n])| +").findall
        words = {p: i for p, i in self.id_of.items() if not (v.merges and len(p) > 1 and set(p) == {MARK})}
        if any(MARK in p[1:] for p in words):
            raise ValueError("a piece holds the marker inside")
        # The trie: symbols of characters, transitions and final pieces.
        self.symbol = np.zeros(0x110000, np.int32)
        letters = sorted({c for p in words for c in p})
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        final: dict[int, int] = {}
        for p, i in words.items():
            node = 0
            for c in p:
                node = nodes.setdefault((node, int(self.symbol[ord(c)])), len(nodes) + 1)
            final[node] = i
        self.step = HashTable()
        self.step.add(np.array([a * self.width + b for a, b in nodes], np.int64), np.array(list(nodes.values()), np.int32))
        self.final = np.full(len(nodes) + 1, -1, np.int32)
        self.final[list(final)] = list(final.values())
        self.longest = max(map(len, words), default=1)
        self.weight = np.zeros(len(v.pieces)) if v.merges else -np.array(v.scores)
        self.fallback_weight = 0.0 if v.merges else float(-min(v.scores) + 10)
        # Merge order and the last merge of each piece.
        order = sorted((i for p, i in words.items() if len(p) > 1), key=lambda i: (-v.scores[i], i))
        self.rank = {i: r for r, i in enumerate(order)} | {i: -1 for p, i in words.items() if len(p) == 1}
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs = HashTable(1 << 16)
        self.cache: dict[str, bytes] = {}
        blobs = [self._bytes_of(i) for i in range(len(v.pieces))]
        self.piece_len = np.array([len(b) for b in blobs], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(blobs), np.uint8)

    def _bytes_of(self, i: int) -> bytes:
        if self.v.kinds[i] == 6:
            return bytes([int(self.v.pieces[i][3:5], 16)])
        return b"" if self.v.kinds[i] == 3 else self.v.pieces[i].replace(MARK, " ").encode()

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging, best priority first and leftmost among equals (used for single pieces and as a check)."""
        while len(symbols) > 1:
            best = min(((self.rank[self.id_of[a + b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.id_of and self.id_of[a + b] in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def _children(self, i: int) -> tuple[int, int]:
        if i not in self.split:
            text, best = self.v.pieces[i], None
            symbols = list(text)
            while len(symbols) > 2:  # merge up to the last step
                options = [(self.rank[self.id_of[a + b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.id_of and self.id_of[a + b] in self.rank]
                if not options:
                    break
                k = min(options)[1]
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            best = (self.id_of[symbols[0]], self.id_of[symbols[1]]) if len(symbols) == 2 else (-1, -1)
            self.split[i] = best
        return self.split[i]

    def admissible(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces gives just these two.

        Undoes the merges of both, latest first, along the two sides that touch; at each stage
        the touching parts must not be joined before the next merge that takes one of them in.
        """
        x, y, next_x, next_y = left, right, 1 << 60, 1 << 60
        rank, pieces = self.rank, self.v.pieces
        while True:
            both = self.id_of.get(pieces[x] + pieces[y])
            if both is not None and both in rank and rank[both] < next_x and rank[both] <= next_y:
                return False
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                return True
            if ry >= rx:
                next_y, y = ry, self._children(y)[0]
            else:
                next_x, x = rx, self._children(x)[1]
            if x < 0 or y < 0:
                return False  # a piece that merging can never produce

    def _admissible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.v.pieces) + right
        got = self.pairs.get(key, 2)
        new = np.unique(key[got == 2])
        if len(new):
            n = len(self.v.pieces)
            self.pairs.add(new, np.array([self.admissible(int(k) // n, int(k) % n) for k in new], np.int32))
            got = self.pairs.get(key, 2)
        return got == 1

    def shortest_paths(self, words: list[str]) -> list[bytes]:
        """Ids (int32, as bytes) of words that have the marker only at their start."""
        code = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass") if words else b"", np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words])
        start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        symbol = np.append(self.symbol[code], 0)
        inner = np.ones(len(code) + 1, bool)
        inner[np.concatenate([start[1:] - 1, [len(code)]])] = False
        # Compose: all arcs of the lattice.
        pos = np.flatnonzero(inner)
        begin = np.repeat(start, lengths)
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        state, at, origin = np.zeros(len(pos), np.int64), pos.copy(), pos.copy()
        for k in range(1, self.longest + 1):
            state = self.step.get(state * self.width + symbol[at], -1).astype(np.int64)
            alive = (state >= 0) & (symbol[at] > 0) & inner[at]
            state, at, origin = state[alive], at[alive] + 1, origin[alive]
            if not len(state):
                break
            end = self.final[state] >= 0
            arcs.append((origin[end], np.full(int(end.sum()), k), self.final[state[end]]))
        word_of = np.full(len(code) + 1, 0)
        word_of[pos] = begin
        unknown = pos[symbol[pos] == 0]
        arcs.append((unknown, np.ones(len(unknown), np.int64), np.full(len(unknown), -2)))
        frm, size, piece = (np.concatenate([a[i] for a in arcs]) for i in range(3))
        until = frm + size
        when = until - word_of[frm]
        order = np.argsort(when.astype(np.uint16) if len(when) and when.max() < 1 << 16 else when, kind="stable")
        frm, until, piece, when = frm[order], until[order], piece[order], when[order]
        # Shortest path, by the distance of arc ends from the start of their word. A node is the place after a character.
        cost, last, back = np.full(len(code) + 2, _INF), np.full(len(code) + 2, -2, np.int64), np.zeros(len(code) + 2, np.int64)
        cost[start] = 0
        bounds = np.searchsorted(when, np.arange(1, (int(when[-1]) if len(when) else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            f, u, p = frm[a:b], until[a:b], piece[a:b]
            c = cost[f] + np.where(p >= 0, self.weight[p], self.fallback_weight)
            if self.v.merges:
                check = np.flatnonzero((p >= 0) & (last[f] >= 0) & (c < _INF))
                c[check[~self._admissible(last[f[check]], p[check])]] = _INF
                first = np.flatnonzero(c < _INF)  # one for each place at most
                cost[u[first]], last[u[first]], back[u[first]] = c[first], p[first], f[first]
                continue
            best = np.lexsort((f, c, u))
            first = best[np.concatenate([[True], np.diff(u[best]) != 0])]
            first = first[c[first] < _INF]
            cost[u[first]], last[u[first]], back[u[first]] = c[first], p[first], f[first]
        # Read the paths backwards.
        here, live = start + lengths, np.arange(len(words))
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        while len(live := live[here[live] > start[live]]):
            h = here[live]
            steps.append((live, last[h], back[h]))
            here[live] = back[h]
            n += 1
        if not steps:
            return [b"" for _ in words]
        w = np.concatenate([s[0] for s in steps])
        p = np.concatenate([s[1] for s in steps])
        o = np.concatenate([s[2] for s in steps])
        depth = np.repeat(-np.arange(n), [len(s[0]) for s in steps])
        order = np.lexsort((depth, w))
        w, p, o = w[order], p[order], o[order]
        count = np.ones(len(p), np.int64)
        odd = np.flatnonzero(p < 0)  # byte fallback: as many ids as the character has bytes
        raw = [chr(c).encode("utf-8", "replace") for c in code[o[odd]].tolist()]
        count[odd] = [len(r) for r in raw]
        ids = np.repeat(p, count).astype(np.int32)
        ids[ids < 0] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(count)])
        blob, cut = ids.tobytes(), 4 * ends[np.searchsorted(w, np.arange(len(words) + 1))]
        return [blob[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _run(self, n: int) -> bytes:
        """Ids of n markers that nothing follows up on: greedy, as equal priorities merge leftmost first."""
        if not self.runs:
            return b""
        most, out = max(self.runs), []
        while n:
            k = max(x for x in self.runs if x <= min(n, most))
            out.append(self.runs[k])
            n -= k
        return np.array(out, np.int32).tobytes()

    def _learn(self, tokens: set[str]) -> None:
        if len(self.cache) + len(tokens) > CACHE_WORDS:
            self.cache.clear()
        plain = [t for t in tokens if t.strip(" ") or not self.runs]
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            self.cache.update(zip(part, self.shortest_paths([t.replace(" ", MARK) for t in part]), strict=True))
        for t in tokens:
            if t not in self.cache:
                self.cache[t] = self._run(len(t))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32."""
        split = [self.split_text((" " if self.v.dummy_prefix else "") + t.replace(MARK, " ")) if t else [] for t in texts]
        need = set().union(*split) if split else set()
        new = need - self.cache.keys()
        if new:
            self._learn(new)
            if not need <= self.cache.keys():
                self._learn(need)
        out = [b"".join(map(self.cache.__getitem__, s)) for s in split]
        if self.runs and any(not t.strip(" ") for t in need):
            lone = np.int32(self.runs[1]).tobytes()
            for k, s in enumerate(split):
                for i in range(len(s) - 1):  # a run whose last marker stayed alone takes in the next one's
                    if not s[i].strip(" ") and s[i + 1][0] == " " and self.cache[s[i + 1]][:4] == lone:
                        out[k] = self._with_runs(s)
                        break
        return out

    def _with_runs(self, tokens: list[str]) -> bytes:
        lone, out, held = np.int32(self.runs[1]).tobytes(), [], 0
        for t in tokens:
            ids = self.cache[t]
            if not t.strip(" "):
                held += len(t)
            elif held and t[0] == " " and ids[:4] == lone:
                out += [self._run(held + 1), ids[4:]]
                held = 0
            else:
                out += [self._run(held), ids]
                held = 0
        return b"".join([*out, self._run(held)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of the texts ids[bounds[k]:bounds[k+1]]."""
        size = self.piece_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.piece_at[ids] - ends[:-1], size) + np.arange(int(ends[-1]))
        data, off = self.piece_bytes[at], ends[bounds]
        if self.v.dummy_prefix:
            keep = np.ones(len(data), bool)
            keep[off[:-1][(np.diff(off) > 0)]] = False
            off = off - np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
            data = data[keep]
        return data, off


_COMPILED: dict[str, PieceTransducer] = {}


def transducer(path: str = MODEL) -> PieceTransducer:
    """The compiled transducer of a vocabulary file, once per Python worker."""
    if path not in _COMPILED:
        _COMPILED[path] = PieceTransducer(read_vocabulary(path))
    return _COMPILED[path]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        b, n = a + 1, len(texts[a])
        while b < len(texts) and n + len(texts[b]) <= SLICE_CHARS:
            n += len(texts[b])
            b += 1
        yield a, b
        a = b


def with_ids(docs: DataFrame, path: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, n_fallback (byte pieces), ids_sha256 (of the ids as little-endian
    int32), round_trip (the ids decode to the text) and, if ``keep_ids``, ids (array of int)."""
    bind_batches(docs.sparkSession)
    made = {"n_tokens": T.LongType(), "n_fallback": T.LongType(), "ids_sha256": T.StringType(), "round_trip": T.BooleanType()}
    if keep_ids:
        made["ids"] = T.ArrayType(T.IntegerType())
    columns = [c for c in docs.columns if c not in made]
    rows = docs.select(*columns) if "text" in columns else docs
    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, t) for k, t in made.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        is_byte = np.array([k == 6 for k in model.v.kinds])
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _parts(texts):
                part = texts[a:b]
                coded = model.encode(part)
                bounds = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int64)
                ids = np.frombuffer(b"".join(coded), np.int32)
                data, off = model.decode(ids, bounds)
                raw = data.tobytes()
                trip = [raw[i:j] == t.encode("utf-8", "replace") for i, j, t in zip(off[:-1].tolist(), off[1:].tolist(), part, strict=True)]
                fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
                out = [pa.array(np.diff(bounds)), pa.array(np.diff(fallback[bounds])), pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array(trip, pa.bool_())]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in columns], *out], [*columns, *made])

    return rows.mapInArrow(lean(run), schema)


def encode_all(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_fallback, ids_sha256, round_trip of every row."""
    return with_ids(docs.select("doc_id", "text"), path, keep_ids=False).select("doc_id", "n_tokens", "n_fallback", "ids_sha256", "round_trip", F.lit(path.rsplit("/", 1)[-1]).alias("vocabulary"))
