"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of context windows.

The lexicon is learned: terms (whole words, and word beginnings for inflected forms) are taken
greedily by how many labelled toxic texts they explain that no clean text contains. The terms
form a trie; the set of (trie node, edits spent) pairs that a word can reach is the product of
the trie with the Levenshtein automaton of every term at once, and determinising those sets
gives one table over characters. All words of a batch step through that table together.

Each hit then gets the features of a window of CONTEXT words around it: other hits near it,
quotation marks or reporting words about it. A logistic model learned from the labelled rows
weighs hits inside and outside quotation, exact and misspelled, into the score of the text. Words one
edit or swap away from shorter terms and from word beginnings are a feature of their own with a
lower weight; those that clean labelled texts have do not count.

Edge cases: a null, empty or word-less text has no hits and gets the lowest score, never an
error. Repeated rows get equal scores. An empty table gives an empty result. Without labels of
both classes every score is the share of label 1 in the sample (0 if there is none).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._common import bind_batches, held_out, labelled_sample

CONTEXT = 12
THRESHOLD = 0.5
#: A misspelling may spend one edit on words of at least so many letters; shorter ones must be exact.
FUZZY_LETTERS = 6
#: The same of loose hits, for whole words and word beginnings.
LOOSE_LETTERS = 5
STEM_LETTERS = (4, 5, 6, 7, 8)
SLICE_CHARS = 1 << 19
#: Quotation marks (fixed values).
QUOTES = "\"'«»„“”‘’‹›"

Term = tuple[str, bool]  # letters, and whether longer words that begin so are meant too


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased text, and starts and ends of its runs of letters and digits."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(code) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[np.minimum(code, len(_LETTER) - 1)]
    edge = np.diff(inside)
    return code, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Letters and digits of the basic plane; characters beyond count as letters.
_LETTER = np.array([chr(c).isalnum() for c in range(0xFFFF)] + [True])


class Lexicon:
    """Table of the determinised product of the trie and the Levenshtein automata of its terms.

    State 0 is dead and state 1 the start. ``value[s]`` is 0 where a word that ends in ``s`` is
    no term, 1 where it is one (or begins with a stem), 2 where it is one edit away.
    """

    def __init__(self, terms: list[Term], loose: bool = False) -> None:
        if loose:
            terms = sorted({t for t in terms if len(t[0]) >= LOOSE_LETTERS})
        self.terms = terms
        letters = sorted({c for t, _ in terms for c in t})
        self.alphabet = np.zeros(0x10000, dtype=np.int32)  # 0: any letter that no term has
        for k, c in enumerate(letters):
            self.alphabet[min(ord(c), 0xFFFF)] = k + 1
        child: list[dict[int, int]] = [{}]
        ends: list[tuple[bool, bool]] = [(False, False)]  # whole word, stem
        edits = [0]  # most edits that a term below this node allows
        for term, stem in terms:
            node, allowed = 0, 1 if loose or (len(term) >= FUZZY_LETTERS and not stem) else 0
            edits[0] = max(edits[0], allowed)
            for c in term:
                code = int(self.alphabet[min(ord(c), 0xFFFF)])
                if code not in child[node]:
                    child[node][code] = len(child)
                    child.append({})
                    ends.append((False, False))
                    edits.append(0)
                node = child[node][code]
                edits[node] = max(edits[node], allowed)
            whole, begins = ends[node]
            ends[node] = (whole or not stem, begins or stem)
        self.fuzzy_end = {n for n in range(len(child)) if ends[n][0] and edits[n]}

        def close(items: set[tuple[int, int]]) -> frozenset:
            """Skip letters of the term (deletions); drop what another item reaches with fewer edits."""
            todo, seen = list(items), set(items)
            while todo:
                node, e = todo.pop()
                for nxt in child[node].values() if node >= 0 else ():
                    if e < edits[nxt] and (nxt, e + 1) not in seen:
                        seen.add((nxt, e + 1))
                        todo.append((nxt, e + 1))
            least: dict[int, int] = {}
            for node, e in seen:
                least[node] = min(e, least.get(node, 9))
            return frozenset(least.items())

        start = close({(0, 0)})
        index, rows, value = {frozenset(): 0, start: 1}, [np.zeros(len(letters) + 1, np.int32)], [0, 0]
        queue = [start]
        while queue:
            state = queue.pop(0)
            row = np.zeros(len(letters) + 1, np.int32)
            for code in range(len(letters) + 1):
                out: set[tuple[int, int]] = set()
                for node, e in state:
                    if node < 0:
                        out.add((node, e))  # inside the tail of a stem
                        continue
                    if code in child[node]:
                        nxt = child[node][code]
                        out.add((nxt, e))
                        if ends[nxt][1] and e == 0:
                            out.add((-1, 0))
                        elif ends[nxt][1] and loose:
                            out.add((-2, 1))
                    if e < edits[node]:
                        out.add((node, e + 1))  # a letter too many
                        out |= {(nxt, e + 1) for nxt in child[node].values() if e < edits[nxt]}  # another letter
                new = close(out)
                if loose and any(node >= 0 and e and ends[node][1] for node, e in new):
                    new = frozenset({*new, (-2, 1)})  # the beginning is met with an edit: any tail
                if new not in index:
                    index[new] = len(index)
                    queue.append(new)
                    kinds = {1 if e == 0 else 2 for node, e in new if node < 0 or (loose and ends[node][1]) or (ends[node][0] and (e == 0 or node in self.fuzzy_end))}
                    value.append(min(kinds) if kinds else 0)
                row[code] = index[new]
            rows.append(row)
        self.table, self.value = np.array(rows), np.array(value, dtype=np.int8)
        self.stuck = np.flatnonzero((self.table == np.arange(len(self.table))[:, None]).all(axis=1))

    def match(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """0, 1 or 2 for every word code[start:end]."""
        if not self.terms or not len(start):
            return np.zeros(len(start), np.int8)
        symbol = self.alphabet[np.minimum(code, 0xFFFF)]
        state = np.ones(len(start), np.int32)
        settled = np.zeros(len(self.table), bool)
        settled[self.stuck] = True
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            state[live] = self.table[state[live], symbol[at]]
            at = at + 1
            go = (at < end[live]) & ~settled[state[live]]
            live, at = live[go], at[go]
        return self.value[state]


def learn_terms(texts: list[str], labels: list[int], share: float = 0.02, most: int = 64) -> list[Term]:
    """Greedy cover of the toxic texts by words and word beginnings that clean texts lack.

    A candidate must be in ``share`` of the toxic texts (4 at least) and may be in at most 1 % as
    many clean ones, by share of texts; each clean text that has it counts against ten toxic
    ones. Among those whose cover is within 3 % of the best a whole word is preferred to a beginning,
    then the longest: short beginnings meet innocent words by chance.
    """
    holders: dict[Term, set[int]] = defaultdict(set)
    clean: dict[Term, int] = defaultdict(int)
    toxic = [t for t, y in zip(texts, labels, strict=True) if y]
    tame = [t for t, y in zip(texts, labels, strict=True) if not y]

    def terms_of(text: str) -> set[Term]:
        code, s, e = words(text)
        low = text.lower()
        if len(low) != len(code):
            return set()
        found = {low[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)}
        return {(w, False) for w in found if len(w) > 2} | {(w[:k], True) for w in found for k in STEM_LETTERS if len(w) > k}

    for i, t in enumerate(toxic):
        for term in terms_of(t):
            holders[term].add(i)
    least = max(4, share * len(toxic))
    wanted = {k for k, v in holders.items() if len(v) >= least}
    for t in tame:
        for term in terms_of(t) & wanted:
            clean[term] += 1
    good = {k: holders[k] for k in wanted if clean[k] * max(len(toxic), 1) <= 0.01 * len(holders[k]) * max(len(tame), 1)}
    chosen: list[Term] = []
    left = set(range(len(toxic)))
    while left and len(chosen) < most and good:
        worth = {k: len(v & left) - 10 * clean[k] for k, v in good.items()}
        top = max(worth.values())
        if top < least:
            break
        best = max((k for k, v in worth.items() if v >= 0.97 * top), key=lambda k: (not k[1], len(k[0]), worth[k], k[0]))
        chosen.append(best)
        left -= good.pop(best)
    # Terms as frequent as those chosen belong to the lexicon too, even where every text that has them is covered.
    floor = max(least, 0.25 * min((len(holders[c]) for c in chosen), default=0))
    for k in sorted(good, key=lambda k: (-len(holders[k]), k[1], -len(k[0]), k[0])):
        known = any(c.startswith(k[0]) if k[1] else False for c, _ in chosen) or any(stem and k[0].startswith(c) for c, stem in chosen)
        if len(chosen) < most and len(holders[k]) - 10 * clean[k] >= floor and not known:
            chosen.append(k)
    return sorted(chosen)


def swapped(terms: list[Term]) -> list[Term]:
    """Terms with two neighbouring letters swapped."""
    made = {(t[:i] + t[i + 1] + t[i] + t[i + 2 :], stem) for t, stem in terms if len(t) >= LOOSE_LETTERS for i in range(len(t) - 1)}
    return sorted(made - set(terms))


class Loose:
    """Words that are near to terms for which the lexicon has no edits, or are one swap away; not those in ``tame``."""

    def __init__(self, terms: list[Term]) -> None:
        self.near, self.swaps = Lexicon(terms, loose=True), Lexicon([(t, s) for t, s in swapped(terms)])
        self.tame: set[str] = set()

    def found(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Indices of the words that match and are no hits of the lexicon (``kind``)."""
        some = np.flatnonzero((kind == 0) & (end - start >= LOOSE_LETTERS - 1))
        s, e = start[some], end[some]
        some = some[(self.near.match(code, s, e) > 0) | (self.swaps.match(code, s, e) == 1)]
        return some[[self.word(code, start[i], end[i]) not in self.tame for i in some]] if len(some) else some

    @staticmethod
    def word(code: np.ndarray, a: int, b: int) -> str:
        return code[a:b].tobytes().decode("utf-32-le", "surrogatepass")

    def learn(self, lexicon: Lexicon, texts: list[str]) -> None:
        """Adds the variants that clean ``texts`` have."""
        for t in texts:
            code, s, e = words(t)
            self.tame |= {self.word(code, s[i], e[i]) for i in self.found(code, s, e, lexicon.match(code, s, e))}


N_FEATURES = 7


def features(lexicon: Lexicon, texts: list[str], loose: Loose | None = None) -> np.ndarray:
    """Per text: hits outside quotation (exact, misspelled), inside, crowded hits, share of words, any, loose hits outside (all damped)."""
    text = "\n".join(texts)
    lengths = np.array([len(t.lower()) for t in texts])
    code, s, e = words(text)
    n = len(texts)
    bounds = np.cumsum(lengths + 1)
    kind = lexicon.match(code, s, e)
    hit = np.flatnonzero(kind)
    x = np.zeros((n, N_FEATURES))
    row_all = np.searchsorted(bounds, s, side="right")
    total = np.bincount(row_all, minlength=n)[:n] if len(s) else np.zeros(n)
    loosely = loose.found(code, s, e, kind) if loose else np.zeros(0, int)
    if not len(hit) and not len(loosely):
        return x
    mark = np.flatnonzero(np.isin(code, np.array([ord(c) for c in QUOTES], dtype=np.uint32)))
    outer = np.ones(len(mark), bool)  # an apostrophe inside a word is none
    inner = (mark > 0) & (mark < len(code) - 1)
    outer[inner] = ~(_LETTER[np.minimum(code[mark[inner] - 1], 0xFFFF)] & _LETTER[np.minimum(code[mark[inner] + 1], 0xFFFF)])
    mark = mark[outer]

    def in_quotes(hit: np.ndarray) -> np.ndarray:
        row = row_all[hit]
        row_start = np.concatenate([[0], bounds[:-1]])[row]
        left = np.searchsorted(mark, s[hit]) - np.searchsorted(mark, np.maximum(row_start, s[np.maximum(hit - CONTEXT, 0)]))
        after = np.append(e, len(code))[np.minimum(hit + CONTEXT, len(e))]
        right = np.searchsorted(mark, np.minimum(after, bounds[row])) - np.searchsorted(mark, e[hit])
        return (left % 2 == 1) & (right > 0)

    if len(loosely):
        x[:, 6] = np.log1p(np.bincount(row_all[loosely[~in_quotes(loosely)]], minlength=n)[:n])
    if len(hit):
        row, quoted = row_all[hit], in_quotes(hit)
        # Hits of other texts of the batch do not count.
        first, last = np.searchsorted(row, row), np.searchsorted(row, row, side="right")
        near = np.minimum(np.searchsorted(hit, hit + CONTEXT, side="right"), last) - np.maximum(np.searchsorted(hit, hit - CONTEXT), first) - 1
        for k, mask in enumerate((~quoted & (kind[hit] == 1), ~quoted & (kind[hit] == 2), quoted, ~quoted & (near > 0))):
            x[:, k] = np.log1p(np.bincount(row[mask], minlength=n)[:n])
        x[:, 4] = np.sqrt(np.bincount(row[~quoted], minlength=n)[:n] / np.maximum(total, 1))
        x[:, 5] = x[:, 0] > 0
    return x


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None, bias: float, constant: float | None = None, loose: Loose | None = None) -> None:
        self.lexicon, self.weights, self.bias, self.constant, self.loose = lexicon, weights, bias, constant, loose

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, a = np.zeros(len(texts)), 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE_CHARS):
                size += len(texts[b])
                b += 1
            out[a:b] = 1 / (1 + np.exp(-np.clip(features(self.lexicon, texts[a:b], self.loose) @ self.weights + self.bias, -40, 40)))
            a = b
        return out


def fit_texts(texts: list[str], labels: list[int]) -> ToxicityModel:
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(Lexicon([]), None, 0.0, float(y.mean()) if len(y) else 0.0)
    lexicon = Lexicon(learn_terms(texts, labels))
    loose = Loose(lexicon.terms)
    loose.learn(lexicon, [t for t, label in zip(texts, labels, strict=True) if not label])
    x = np.concatenate([features(lexicon, texts[i : i + 50], loose) for i in range(0, len(texts), 50)])
    # Prior weights: a hit counts for, quotation counts against; learning moves away from them where the labels say so.
    prior, w, b = np.array([2.0, 1.0, 0.2, 0.5, 2.0, 2.0, 0.5]), np.array([2.0, 1.0, 0.2, 0.5, 2.0, 2.0, 0.5]), -2.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        w = w - 0.5 * (x.T @ (p - y) / len(y) + 1e-3 * (w - prior))
        b = b - 0.5 * (p - y).mean()
    return ToxicityModel(lexicon, w, float(b), loose=loose)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    got = sorted(labelled_sample(docs, labels, "toxic").collect(), key=lambda r: (r["_rank"], r["_id"], r["text"]))
    return fit_texts([r["text"] for r in got], [r["label"] for r in got])


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    bind_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
