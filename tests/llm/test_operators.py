"""Each operator against a brute-force version, and on nulls, empty texts, repeats, empty tables and extra columns."""

import hashlib
import json
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hnsw, language_id, mixing, order_minhash, piece_transducer, quality_mil, quality_rules, suffix_dedup, tool_calls, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "ing", "ti", "sh", "ea"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(40)]
    passage = prose(rng, 120)
    texts = [*base, None, "", " \n\t ", "one", base[0], base[0], base[1].replace("an", "en", 2), base[2] + " " + passage, passage + " " + base[3], "\n".join([base[4]] * 3), "é" * 900, "a " * 500]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# 1 ------------------------------------------------------------------------------------------


def test_targets_fill_up_to_the_cap():
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([20, 2995 / 3, 5990 / 3])
    assert mixing.targets([100, 100, 100, 100]) == pytest.approx([200, 200 / 3, 400 / 3, 200]) and mixing.targets([]) == []
    assert mixing.targets([0, 10]) == pytest.approx([0, 15])


def test_splitting_tree_meets_quotas():
    tree = mixing.splitting_tree(np.array([7, 0, 31]), 5, np.random.default_rng(1))
    assert tree.sum(axis=0).tolist() == [7, 0, 31] and (tree >= 0).all() and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and mixing.mix(none).count() == 0
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
        target[r["source_size"], r["target"]] = r["target"]
    for k, t in target.items():
        assert abs(taken[k] - t) <= max(0.03 * t, 60)
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(mixing.mix(docs.repartition(2)).collect()) == key(got)
    copies = mixing.take(docs)
    assert copies.count() == sum(r["copies"] for r in got)


# 2 ------------------------------------------------------------------------------------------


def test_recurring_windows():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = rng.integers(97, 100, 60, dtype=np.uint8)
        parts = [np.concatenate([rng.integers(97, 100, rng.integers(0, 30), dtype=np.uint8), base[: rng.integers(0, 60)]]) for _ in range(6)]
        d = int(rng.integers(1, 25))
        seen = Counter(p[i : i + d].tobytes() for p in parts for i in range(len(p) - d + 1))
        for p, g in zip(parts, suffix_dedup.recurring(parts, d), strict=True):
            assert list(g) == [seen[p[i : i + d].tobytes()] > 1 for i in range(max(0, len(p) - d + 1))]


def brute_removed(rows, n=suffix_dedup.LENGTH):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(raw[i : i + n] for _, raw in raws for i in range(len(raw) - n + 1))
    out = []
    for d, raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 1])
def test_removed(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # with 1, all contested anchors take the exact way for hot ones
    got = sorted(tuple(r) for r in suffix_dedup.removed(docs).collect())
    assert got == brute_removed(texts_of(docs))
    assert suffix_dedup.removed(none).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_removed_of_other_lengths_and_clashing_columns(docs):
    assert sorted(tuple(r) for r in suffix_dedup.removed(docs, 300).collect()) == brute_removed(texts_of(docs), 300)
    odd = docs.withColumns({"k1": F.lit(1), "spans": F.lit("s"), "a": F.lit(2.0), "c0_x": F.lit(3)})
    kept = suffix_dedup.without_repeats(odd, 300)
    sizes = Counter((r["doc_id"], len((r["text"] or "").encode())) for r in kept.collect())
    assert kept.columns == odd.columns and kept.where("k1 = 1 and spans = 's' and a = 2 and c0_x = 3").count() == docs.count()
    assert all(r[1] - r[2] >= min(n for d, n in sizes if d == r[0]) for r in brute_removed(texts_of(docs), 300))


# 3 ------------------------------------------------------------------------------------------


def brute_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, docs, none):
    more = spark.createDataFrame([(900, "a b c a b c x\n#a|b\n\nz\nz\n", "", "", 0, ""), (901, "x x x x", "", "", 0, ""), (902, "漢 字 é", "", "", 0, "")], DOCS)
    both = docs.unionByName(more)
    got = sorted((r["doc_id"], *[r[c] for c in quality_rules.COUNTS]) for r in quality_rules.with_counts(both).collect())
    assert got == sorted((d, *brute_counts(t)) for d, t in texts_of(both))
    judged = {r["doc_id"]: r for r in quality_rules.apply_rules(both, []).collect()}
    assert judged[901]["base_failed"] and not judged[901]["kept"] and quality_rules.apply_rules(none, []).count() == 0


def test_rules_find_a_threshold(spark):
    rng = random.Random(2)
    rows = [dict.fromkeys(quality_rules.FEATURES, 0.0) | {"words": rng.uniform(60, 500), "symbols_per_word": s} for s in [0.9, 0.8, 0.7] * 20 + [0.0, 0.1] * 60]
    rules = quality_rules.learn_rules(rows, [0] * 60 + [1] * 120)
    assert all(any(all(c.holds(r) for c in rule) for rule in rules) == (i < 60) for i, r in enumerate(rows))
    assert quality_rules.learn_rules([], []) == [] and quality_rules.learn_rules(rows, [1] * 180) == []


# 4 ------------------------------------------------------------------------------------------


def test_aligned_is_the_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.05] + [rng.randint(0, 30) for _ in range(rng.randint(0, 3))]
        d = [0] * (len(b) + 1)
        for x in a:
            p = 0
            for j, y in enumerate(b):
                t = d[j + 1]
                d[j + 1] = p + 1 if x == y else max(d[j + 1], d[j])
                p = t
        s = d[-1] / (len(a) + len(b) - d[-1]) if b else 0
        assert order_minhash.aligned(np.array(a), np.array(b)) == pytest.approx(s if s >= 0.8 else 0)


def test_near_copies(docs, none):
    rows = texts_of(docs)
    grams = {}
    for d, t in rows:
        w = words(t)
        grams[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([("", t or "")])
    root = {d: d for d in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and (grams[a] & grams[b]).total() >= 0.8 * (grams[a] | grams[b]).total():
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = order_minhash.classes(docs).collect()
    assert len(got) == len(rows) and all(r["class_id"] == root[r["doc_id"]] for r in got)
    assert order_minhash.classes(none).count() == 0
    kept = order_minhash.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(root.values()))


def edited(rng, w, n):
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"x{rng.random()}"
    return w


def test_near_copies_of_loose_groups(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(3):  # an original and copies that are near to it only
        base = prose(rng, 300).split()
        texts += [base, *[edited(rng, base, 6) for _ in range(40)]]
    w = prose(rng, 300).split()
    for _ in range(30):  # a chain: each is near to its neighbours
        w = edited(rng, w, 5)
        texts.append(w)
    passage = prose(rng, 100).split()
    texts += [passage + prose(rng, 60).split() for _ in range(60)]
    grams = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if (grams[a] & grams[b]).total() >= 0.8 * (grams[a] | grams[b]).total()]
    root = list(range(len(texts)))
    for a, b in near:
        x, y = root[a], root[b]
        root = [min(x, y) if v in (x, y) else v for v in root]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_near_copies_of_short_texts(spark):
    pairs = [[f"w{i}x{k}" for k in range(9)] for i in range(400)]
    rows = [(2 * i + k, " ".join(w[: 9 - k])) for i, w in enumerate(pairs) for k in range(2)]
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 for r in got) and len(got) == 800


# 5, 7, 8 ------------------------------------------------------------------------------------


def test_quality(docs, none):
    rng = random.Random(1)
    good = [prose(rng, 120) for _ in range(60)]
    bad = [prose(rng, 40) + " " + " ".join(f"{w}###" for w in prose(rng, 60).split()) for _ in range(60)]
    model = quality_mil.fit_texts(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    score = quality_mil.score_columns(model, pa.array(good[40:] + bad[40:]))
    assert (score[:20] >= 0.3).all() and (score[20:] < 0.3).all()
    got = quality_mil.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got) and quality_mil.predict(none, model).count() == 0
    assert quality_mil.with_score(docs, model).columns == [*docs.columns, "score"]
    assert quality_mil.fit_texts([], []).constant == 0.5


def test_language(spark, docs, none):
    rng = random.Random(1)
    made = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    rows = [(i, made(["the", "ing", "sh"] if i % 2 else ["ción", "que", "ñ"], 80), "en" if i % 2 else "es", "s", 0, "") for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "en", "s", 0, ""), (901, "123 !", "en", "s", 0, ""), (902, "", None, "s", 0, "")], DOCS)
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows) and got[900]["lang_pred"] == got[901]["lang_pred"] == got[902]["lang_pred"] == "und"
    assert language_id.predict(none, model).count() == 0 and language_id.fit(none) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lexicon_automaton():
    rng = random.Random(3)
    terms = [("pathetic", False), ("scum", False), ("lowei", True), ("idiots", False)]
    lexicon = toxicity.Lexicon(terms)
    some = ["scum", "scam", "pathetic", "patetic", "pathettic", "pathatic", "athetic", "lowei", "loweixyz", "lowe", "idiotss", "idots", "x"]
    some += ["".join(rng.choice("patheicscumlowdz") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    for _ in range(300):
        w = list(rng.choice(["pathetic", "idiots", "scum", "lowei"]))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abcz")
        some.append("".join(w))
    code, s, e = toxicity.words(" ".join(some))
    for w, kind in zip(some, lexicon.match(code, s, e), strict=True):
        exact = w in ("pathetic", "scum", "idiots") or w.startswith("lowei")
        near = any(edits(w, t) == 1 for t in ("pathetic", "idiots"))
        assert kind == (1 if exact else 2 if near else 0), w


def test_toxicity(docs, none):
    rng = random.Random(4)
    clean = [prose(rng, 80) for _ in range(100)]
    toxic = [f"{prose(rng, 30)} {rng.choice(['pathetic', 'worthless'])} {rng.choice(['moron', 'scum'])} {prose(rng, 30)}" for _ in range(60)]
    model = toxicity.fit_texts(clean[:70] + toxic[:40], [0] * 70 + [1] * 40)
    score = model.scores(clean[70:] + toxic[40:])
    assert (score[:30] < 0.5).all() and (score[30:] >= 0.5).all()
    quoted = model.scores(['they said "pathetic moron" about it', "you pathetic moron"])
    assert quoted[0] < quoted[1]
    assert toxicity.predict(docs, model).count() == docs.count() and toxicity.predict(none, model).count() == 0


def test_toxicity_of_a_text_does_not_depend_on_its_neighbours():
    rng = random.Random(4)
    clean = [prose(rng, 80) for _ in range(60)]
    toxic = [f"{prose(rng, 30)} {rng.choice(['pathetic', 'worthless'])} {rng.choice(['moron', 'scum'])} {prose(rng, 30)}" for _ in range(40)]
    model = toxicity.fit_texts(clean + toxic, [0] * 60 + [1] * 40)
    some = ["you are scum", "moron and scum", 'they said "you scum"', "", "pathetic", 'he is a "moron"', "no", "scum"]
    alone = [model.scores([t])[0] for t in some]
    for _ in range(5):
        order = rng.sample(range(len(some)), len(some))
        assert model.scores([some[i] for i in order]).tolist() == pytest.approx([alone[i] for i in order], abs=1e-12)


def test_misspelt_short_words_and_stems():
    rng = random.Random(6)
    clean = [f"{prose(rng, 60)} {'idiom' if i % 3 else 'union'} {prose(rng, 5)}" for i in range(100)]
    toxic = [f"{prose(rng, 30)} {rng.choice(['idiot', 'moron'])} loweib{rng.choice('xyz')}{i} {prose(rng, 30)}" for i in range(60)]
    model = toxicity.fit_texts(clean + toxic, [0] * 100 + [1] * 60)
    assert {t for t, _ in model.lexicon.terms} >= {"idiot", "moron"} and any(stem for _, stem in model.lexicon.terms)
    rest = prose(random.Random(9), 40)
    plain, exact, tame, *loose = model.scores([f"{rest} {w} {rest}" for w in ("tisher", "idiot", "idiom", "idoit", "morron", "idot", "lowejbq7")])
    assert tame == plain and all(plain < v < exact for v in loose)


# 6 ------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    a = {"id": "a", "name": "search", "arguments": {"query": "x", "limit": 2}}
    b = {"id": "b", "name": "fetch", "arguments": json.dumps({"url": "$a"})}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(b, a)), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "r"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": 1})),
        (1, 4, "assistant", call({"id": "a", "name": "search", "arguments": {}}, {"id": "c", "name": "search", "arguments": {"query": 3}}, {"id": "d", "name": "nope", "arguments": {}})),
        (1, 5, "assistant", call({"id": "e", "name": "search", "arguments": {"query": "$f"}}, {"id": "f", "name": "search", "arguments": {"query": "$e"}}, {"id": "g", "name": "search", "arguments": {"query": "$none"}})),
        (2, 0, "tool", json.dumps({"tool_call_id": "a", "content": 0})), (2, 1, "assistant", call(a)), (None, 0, None, None), (3, 0, "assistant", "{broken"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    got = {(r["conv_id"], r["turn"], r["call_no"]): r for r in tool_calls.linked(df).collect()}
    assert len(got) == 15
    assert got[1, 1, 1]["depth"] == 0 and got[1, 1, 0]["depth"] == 1 and got[1, 1, 1]["linked_turn"] == 2 and got[1, 2, 0]["linked_turn"] == 1
    problem = {k: r["problem"] for k, r in got.items()}
    assert problem[1, 1, 0] == "no_result" and problem[1, 1, 1] is None and problem[1, 3, 0] == "orphan_result" and problem[1, 4, 0] == "duplicate_id"
    assert problem[1, 4, 1] == "bad_arguments" and problem[1, 4, 2] == "unknown_tool" and problem[1, 5, 0] == problem[1, 5, 1] == "cycle" and problem[1, 5, 2] == "missing_dependency"
    assert problem[2, 0, 0] == "result_before_call" and got[3, 0, 0]["kind"] == "text" and got[None, 0, 0]["json"] == '{"content":null,"role":null}'
    assert json.loads(got[1, 1, 1]["json"])["arguments"] == {"limit": 2, "query": "x"}
    assert tool_calls.linked(df.where("false")).count() == 0


def test_repeated_and_broken_tool_messages(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    two = call({"id": "a", "name": "search", "arguments": {"query": "x"}}, {"id": "b", "name": "search", "arguments": {"query": "$a"}})
    deep = "[" * 5000 + "]" * 5000
    odd = [call({"id": "n", "name": "search", "arguments": "NaN"}), call({"id": "s", "name": "search", "arguments": '{"query": "\\ud800"}'}), call({"id": "d", "name": "search", "arguments": deep})]
    odd += ['{"tool_calls": [{"id": "\\ud800"}]}', '{"tool_calls": [{"id": NaN}]}', '{"tool_calls": ' + deep + "}"]
    rows = [(1, 0, "assistant", two), (1, 0, "assistant", two), (1, 1, "tool", '{"tool_call_id": "a"}'), *[(2, i, "assistant", t) for i, t in enumerate(odd)], (3, 0, "tool", '{"tool_call_id": "\\udfff"}')]
    got = tool_calls.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    of = lambda c: [r for r in got if r["conv_id"] == c]
    assert len(of(1)) == 5 and sorted(r["problem"] or "" for r in of(1)) == ["", "", "duplicate_id", "duplicate_id", "no_result"]
    assert [r["kind"] for r in sorted(of(2), key=lambda r: r["turn"])][:5] == ["call", "call", "call", "text", "text"] and len(of(2)) == 6 and of(3)[0]["kind"] == "text"


def brute_links(rows):
    """(conv_id, turn, call_no): (linked_turn, depth, problem), for calls of the search tool with good arguments."""
    calls, results = {}, {}
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: r[:2]):
        body = json.loads(text)
        if role == "assistant":
            for no, x in enumerate(body["tool_calls"]):
                calls.setdefault((c, x["id"]), (t, no, x["depends_on"]))
        else:
            results.setdefault((c, body["tool_call_id"]), t)

    def depth(c, cid, above=()):
        if cid in above:
            return None
        deep = [depth(c, d, (*above, cid)) for d in calls[c, cid][2] if (c, d) in calls]
        return None if None in deep else max(deep, default=-1) + 1

    for c, t, role, text in rows:
        body = json.loads(text)
        if role == "tool":
            own = calls.get((c, body["tool_call_id"]))
            out[c, t, 0] = (own and own[0], None, "orphan_result" if own is None else "result_before_call" if t < own[0] else None)
            continue
        for no, x in enumerate(body["tool_calls"]):
            if calls[c, x["id"]][:2] != (t, no):
                out[c, t, no] = (None, None, "duplicate_id")
                continue
            r, n = results.get((c, x["id"])), depth(c, x["id"])
            lost = any((c, d) not in calls for d in x["depends_on"])
            out[c, t, no] = (r, n, "missing_dependency" if lost else "cycle" if n is None else "no_result" if r is None else None)
    return out


def test_tool_calls_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in range(30):
        ids = [f"i{k}" for k in range(7)]
        for t in range(12):
            if rng.random() < 0.5:
                made = [{"id": rng.choice(ids), "name": "search", "arguments": {"query": "q"}, "depends_on": rng.sample(ids, rng.choice([0, 0, 1, 2]))} for _ in range(rng.randint(1, 3))]
                rows.append((c, t, "assistant", json.dumps({"tool_calls": made})))
            else:
                rows.append((c, t, "tool", json.dumps({"tool_call_id": rng.choice(ids), "content": t})))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r["conv_id"], r["turn"], r["call_no"]): (r["linked_turn"], r["depth"], r["problem"]) for r in tool_calls.linked(df).collect()}
    assert got == brute_links(rows)


def test_plain_turns_as_tools(spark, none):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 3, "assistant", "c"), (1, 4, "system", "d"), (2, 1, "assistant", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.linked(tool_calls.as_tools(df)).collect()}
    assert {k: (r["kind"], r["linked_turn"], r["depth"], r["problem"]) for k, r in got.items()} == {
        (1, 0): ("call", 1, 0, None), (1, 1): ("result", 0, None, None), (1, 2): ("call", 3, 1, "bad_arguments"), (1, 3): ("result", 2, None, None), (1, 4): ("text", None, None, None), (2, 1): ("result", None, None, "orphan_result"),
    }
    assert json.loads(got[1, 0]["json"])["arguments"] == {"query": "a"}


# 9 ------------------------------------------------------------------------------------------


@pytest.mark.skipif(not Path(piece_transducer.MODEL).exists(), reason="needs the vocabulary file")
def test_pieces(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    rng = random.Random(1)
    texts = ["", " ", "   a", "Hello  world\n\tx é € 漢字 𝄞 ▁a", "  漢", "a   漢  b", "a \n b", " " * 50 + "z", "x" * 200, "\r\n a\r\n", "<s> <0x0A>"]
    texts += ["".join(rng.choice(" \n\taeinrthe.,!漢é0-") for _ in range(rng.randint(1, 60))) for _ in range(800)] + [prose(rng, 300)]
    model = piece_transducer.transducer()
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(t), t
    got = piece_transducer.with_ids(docs.withColumn("ids", F.lit(1)))
    for r in got.collect():
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"]) and library.decode(r["ids"]) == (r["text"] or "")
    assert piece_transducer.encode_all(none).count() == 0


# 10 -----------------------------------------------------------------------------------------


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 150)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(8, 16))
    x = [*(centre[i % 8] + rng.normal(size=16) * 0.05 for i in range(160)), *rng.normal(size=(240, 16))]
    rows = [(i, [float(np.float32(v)) for v in vec], 0) for i, vec in enumerate(x)]
    rows += [(400, rows[0][1], 1), (401, rows[0][1], 1), (402, None, 0), (403, [0.0] * 16, 0), (404, [float("nan")] * 16, 0), (405, [None] * 16, 0), (406, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    m = np.array([r[1] for r in rows[:402]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    root = list(range(402))
    for a, b in np.argwhere(link):
        x_, y_ = root[a], root[b]
        root = [min(x_, y_) if v in (x_, y_) else v for v in root]
    got = {r["vec_id"]: r for r in hnsw.neighbours(df).collect()}
    assert sum(abs(got[i]["n_links"] - int(link[i].sum())) for i in range(402)) <= 0.02 * link.sum()
    assert all(got[i]["n_links"] <= int(link[i].sum()) for i in range(402))
    assert all(got[i]["component_id"] == root[i] for i in range(402))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(402, 407))
    assert hnsw.neighbours(df.where("false")).count() == 0


@pytest.mark.parametrize("own", [None, 0])
def test_audit_without_links_is_no_evidence(own):
    class Blind:
        """Finds nothing, or nothing but the query itself."""

        def query(self, q, beam):
            ids = np.full((len(q), beam), -1)
            if own is not None:
                ids[:, 0] = np.arange(len(q))
            return ids, np.where(ids >= 0, 1, -np.inf).astype(np.float32)

    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16))
    x[501] = x[17] * 2 + 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:700]
    if own is None:
        q = rng.normal(size=(700, 16))
        q[501] = x[17]
        q /= np.linalg.norm(q, axis=1, keepdims=True)
    audits = []
    found = {(a, b) for u, v in hnsw.links(Blind(), x, q, own=own, audits=audits) for a, b in zip(u.tolist(), v.tolist(), strict=True)}
    assert (501, 17) in found and audits[0] >= hnsw.PLANTED


def test_forest_spans_links():
    forest = hnsw.Forest(3, 4)
    for u, v in (([], []), ([0, 0, 1], [0, 1, 1]), ([2], [3])):
        forest.add(np.array(u, int), np.array(v, int))
    assert sorted(forest.edges) == [(0, 0), (0, 1), (1, 1), (2, 3)]


def test_graph_finds_planted_links():
    x = np.random.default_rng(5).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes, q = hnsw.planted(x, 200, 0.95)
    assert np.allclose((q * x[nodes]).sum(axis=1), 0.951) and np.allclose(np.linalg.norm(q, axis=1), 1)
    audits = []
    found = {(a, b) for u, v in hnsw.links(hnsw.Graph(x), x, q, audits=audits) for a, b in zip(u.tolist(), v.tolist(), strict=True)}
    assert sum((i, n) in found for i, n in enumerate(nodes.tolist())) >= 0.95 * len(nodes) and 0.98 <= audits[1] / audits[0] <= 1
