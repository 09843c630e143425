"""Quality rules: a decision list learned by sequential covering, applied as Spark conditional expressions.

Every document is described by a handful of counts (words, characters, symbols, repeated lines
and three-word windows), all computed with built-in functions inside one row, without a shuffle.
From a bounded sample of labelled rows the driver grows conjunctions of thresholds that pick out
rejected documents, prunes them on rows that were set aside, and emits them as an ordered
``CASE WHEN``. The main path has no Python on the executors.

Edge cases: a null or blank text has no words, zero counts, fails the base rule and is not kept.
Ties and repeated rows are judged alike, as each row is judged on its own. An empty table gives
an empty result, and without labelled rows of both classes the list is empty (the base rule
alone decides). Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import labelled_sample

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOL = r"[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus COUNTS (long).

    Three-word windows are compared by hash: each window becomes one long, its hash in the high
    bits and its position in the low ones; after one sort of the longs equal windows are
    neighbours. Filter on COUNTS only after writing or checkpointing the result: a pushed-down
    predicate would repeat the whole computation for each use of a column. A text of n words leaves 64 - log2(n) bits to the hash, so the chance of one
    false match in a text of 1,000 words is below 1e-10.
    """
    kept = [F.col(c) for c in docs.columns if not c.startswith("_qr_")]
    step = docs.select(
        *kept,
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"), F.lit(1)).alias("_qr_words"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("_qr_lines"),
    )
    kept = [F.col(c) for c in docs.columns]
    step = step.select(
        *kept,
        "_qr_words",
        "n_symbols",
        (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_qr_words").cast("long").alias("n_words"),
        F.length(F.array_join("_qr_words", "")).cast("long").alias("word_chars"),
        F.ceil(F.log2(F.size("_qr_words") + F.lit(2))).cast("int").alias("_qr_bits"),
    )
    step = step.select(
        *kept,
        *[c for c in COUNTS if c != "n_repeat_words"],
        "_qr_bits",
        F.expr(
            "case when n_words < 4 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> "
            "shiftleft(shiftrightunsigned(xxhash64(_qr_words[i], _qr_words[i + 1], _qr_words[i + 2]), _qr_bits), _qr_bits) | i)) end"
        ).alias("_qr_s"),
    )
    step = step.select(
        *kept,
        *[c for c in COUNTS if c != "n_repeat_words"],
        F.expr(
            "transform(filter(sequence(0, size(_qr_s)), j -> j < size(_qr_s) and ("
            "(j > 0 and shiftrightunsigned(_qr_s[greatest(j - 1, 0)] ^ _qr_s[j], _qr_bits) = 0) or "
            "(j + 1 < size(_qr_s) and shiftrightunsigned(_qr_s[j] ^ _qr_s[least(j + 1, size(_qr_s) - 1)], _qr_bits) = 0))), "
            "j -> cast(_qr_s[j] & (shiftleft(1L, _qr_bits) - 1) as int))"
        ).alias("_qr_at"),
    )
    return step.select(
        *kept,
        *[c for c in COUNTS if c != "n_repeat_words"],
        F.expr("cast(size(array_distinct(concat(_qr_at, transform(_qr_at, x -> x + 1), transform(_qr_at, x -> x + 2)))) as bigint)").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


#: What the learner may put thresholds on: name and SQL over COUNTS.
FEATURES = {
    "words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "symbols": "cast(n_symbols as double)",
    "repeated_lines": "cast(n_dup_lines as double)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _tally(rule: Rule, rows: list[dict], labels: list[int]) -> tuple[int, int]:
    hit = [y for row, y in zip(rows, labels, strict=True) if _covers(rule, row)]
    return len(hit) - sum(hit), sum(hit)


def _cuts(rows: list[dict], feature: str, most: int = 48) -> list[float]:
    values = sorted({row[feature] for row in rows})
    middles = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    if len(middles) <= most:
        return middles
    return [middles[i * (len(middles) - 1) // (most - 1)] for i in range(most)]


def _grow(rows: list[dict], labels: list[int]) -> Rule:
    """Add the threshold with the best information gain until only rejected rows are covered."""
    rule: Rule = ()
    inside = list(zip(rows, labels, strict=True))
    while len(rule) < 4:
        bad, good = sum(1 - y for _, y in inside), sum(y for _, y in inside)
        if not good or not bad:
            break
        before, best, gain = math.log2(bad / (bad + good)), None, 1e-9
        for feature in FEATURES:
            ordered = sorted((row[feature], y) for row, y in inside)
            below_bad = below_good = at = 0
            for cut in _cuts([row for row, _ in inside], feature):
                while at < len(ordered) and ordered[at][0] <= cut:
                    below_bad += 1 - ordered[at][1]
                    below_good += ordered[at][1]
                    at += 1
                for above, b, g in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    if b and (now := b * (math.log2(b / (b + g)) - before)) > gain:
                        best, gain = Condition(feature, above, cut), now
        if best is None:
            break
        rule += (best,)
        inside = [(row, y) for row, y in inside if best.holds(row)]
    return rule


def _prune(rule: Rule, rows: list[dict], labels: list[int]) -> Rule:
    """Drop final conditions while (rejected - kept) / covered on the set-aside rows does not fall."""

    def worth(r: Rule) -> float:
        bad, good = _tally(r, rows, labels)
        return (bad - good) / (bad + good) if bad + good else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(rows: list[dict], labels: list[int], precision: float = 0.9, least: int = 3, most: int = 12) -> list[Rule]:
    """Ordered rules for label 0 by sequential covering; rows need the keys of FEATURES."""
    rules: list[Rule] = []
    left = list(zip(rows, labels, strict=True))
    aside = left[::3]
    grow_on = [x for i, x in enumerate(left) if i % 3]
    while len(rules) < most and sum(1 - y for _, y in grow_on) >= least:
        rule = _grow([r for r, _ in grow_on], [y for _, y in grow_on])
        if not rule:
            break
        rule = _prune(rule, [r for r, _ in aside], [y for _, y in aside])
        bad, good = _tally(rule, [r for r, _ in grow_on + aside], [y for _, y in grow_on + aside])
        if bad < least or bad < precision * (bad + good):
            break
        rules.append(rule)
        grow_on = [(r, y) for r, y in grow_on if not _covers(rule, r)]
        aside = [(r, y) for r, y in aside if not _covers(rule, r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule fires, as one ordered CASE WHEN."""
    if not rules:
        return F.lit(True)
    whens = " ".join(f"when {' and '.join(c.sql() for c in rule)} then false" for rule in rules)
    return F.expr(f"case {whens} else true end")


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from a bounded sample of labelled rows (see ``labelled_sample``) that pass the base rule."""
    sample = with_counts(labelled_sample(docs, labels, "quality"))
    wanted = ["label", "_rank", "_id", base_failed().alias("base"), *[F.expr(sql).alias(name) for name, sql in FEATURES.items()]]
    got = [r for r in sample.select(*wanted).collect() if not r["base"]]
    got.sort(key=lambda r: (r["_rank"], r["_id"]))
    return learn_rules([{k: float(r[k]) for k in FEATURES} for r in got], [r["label"] for r in got])


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for every row."""
    counted = with_counts(docs.select("doc_id", "text"))
    return counted.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
