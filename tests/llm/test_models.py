"""Toxicity, quality and language-model scores: held-out accuracy and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import context_tree, learning, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(df, spark, label):
    rows = df.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("held_out", "predicted", label).collect()
    out = {}
    for held in (False, True):
        part = [r for r in rows if r["held_out"] == held]
        out[held] = {y: sum(r["predicted"] == y for r in part if r[label] == y) / max(1, sum(r[label] == y for r in part)) for y in (0, 1)}
    return out


def test_quality_on_held_out_rows(spark):
    df = queries.queries()["op6_quality"](spark, SF)
    found = accuracy(df, spark, "quality")
    assert found[True][1] > 0.95 and found[True][0] > 0.85
    assert df.count() == 1000 and df.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_toxicity_on_held_out_rows(spark):
    df = queries.queries()["op2_toxicity"](spark, SF)
    found = accuracy(df, spark, "toxic")
    assert found[True][0] > 0.95 and found[True][1] > 0.4 and found[False][1] > 0.6
    assert df.count() == 1000 and df.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def learned(spark):
    """Labelled texts with two rude stems; one polite word begins like one of them."""
    rng = np.random.default_rng(0)
    common = [f"w{c}{d}o" for c in "abcdefgh" for d in "xyz"]
    rows = []
    for i in range(400):
        words = rng.choice(common, 40).tolist()
        if i % 4 == 0:
            words[3], words[20] = ("moronic", "idiotlike")[i % 8 == 0], "scumbag"
        elif i % 4 == 1:
            words[5] = "scumble"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_cases(spark):
    docs, labels = learned(spark)
    lexicon = toxicity.learn(docs, labels, exceptions=("idiotlike savant",))
    a = lexicon.automaton()
    score = lambda t: toxicity.measures(a, t)[2]
    assert all(score(t) == 1 for t in ("a scumbag", "SCUMBAG!", "sсumbаg", "5cumb4g", "scum​bag", "ｓcumbag", "idi0tlike"))
    assert all(score(t) == 0 for t in ("scumble", "wxo", "", None, "an idiotlike savant"))
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "scumbag " * 5000, 3)], "doc_id long, text string, score_ int")
    got = {(r["doc_id"], r["score"] >= toxicity.THRESHOLD) for r in toxicity.scored(odd, lexicon).collect()}
    assert got == {(None, False), (1, False), (2, True)}
    assert toxicity.scored(odd.limit(0), lexicon).count() == 0
    unlabelled = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, unlabelled).select("score").collect()} == {0.5}


def test_matcher_equals_a_naive_one():
    """Hits and exceptions against a search of every entry at every word."""
    rng = np.random.default_rng(11)
    stems = ["grob", "grobn", "fuzz", "fuzzle", "dork", "ripp"]
    weights = {s: float(rng.uniform(2, 5)) for s in stems}
    spared = ["grobnik", "dork side", "fuzzle wuzzle fuzz", "ripp"]
    a = toxicity.Lexicon(weights, spared, []).automaton()
    pool = ["grob", "grobner", "grobnik", "fuzzy", "fuzzles", "fuzzle", "wuzzle", "fuzz", "dork", "side", "sider", "ripp", "ripper", "plain", "a", "agrob"]
    for _ in range(300):
        text = toxicity.fold(" ".join(rng.choice(pool, rng.integers(0, 30))))
        want, at = {}, [i for i, c in enumerate(text) if c == " " and i + 1 < len(text)]
        for i in at:
            found = [w for k, w in weights.items() if text.startswith(" " + k, i)]
            covered = any(b <= i < b + len(p) + 1 for p in spared for b in at if text.startswith(f" {p} ", b))
            if found and not covered:
                want[i] = max(found)
        assert toxicity.hits(a, text) == want


def test_many_hits_and_exceptions_take_no_quadratic_time():
    import time

    a = toxicity.Lexicon({"scumb": 3.0}, ["scumble"], []).automaton()
    text = toxicity.fold("scumbag scumble " * 200_000)
    start = time.process_time()
    assert len(toxicity.hits(a, text)) == 200_000
    assert time.process_time() - start < 20


def test_near_copies_in_the_sample():
    rng = np.random.default_rng(2)
    w = [f"w{rng.integers(10**6)}" for _ in range(200)]
    alike = lambda t: sum(x == y for x, y in zip(toxicity._signature(" ".join(w)), toxicity._signature(" ".join(t)), strict=True))
    assert alike(w) == toxicity.MINIMA and alike([*w, "more"]) >= toxicity.ALIKE
    assert alike([*w[:80], *(f"v{k}" for k in range(120))]) < toxicity.ALIKE
    assert toxicity._signature("") == toxicity._signature("  ")


def test_all_lines_are_learned_from(spark, monkeypatch):
    """A long document's lines all reach the fit, with their true neighbours, whatever a chain may hold."""
    lines = "\n".join(f"line {k} {'x' * (k % 7)}" for k in range(500))
    docs = spark.createDataFrame([(1, lines, 1), (2, "short | | one", 0), (3, "two\nlines", 1)], "doc_id long, text string, quality int")
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, counts, y, rounds=3: seen.append((x, counts)) or fit(x, counts, y, 3))
    for window in (512, 64):
        seen.clear()
        monkeypatch.setattr(quality, "WINDOW", window)
        monkeypatch.setattr(quality.windows, "__defaults__", (window,))
        quality.learn(docs, docs.select("doc_id", "quality"))
        assert seen and all(len(x) == 503 == c.sum() and c.max() <= window for x, c in seen)
        x, n = seen[0][0], quality.OWN
        assert (x[1:, n : 2 * n] != x[:-1, :n]).any(axis=1).sum() == 2  # only where another document begins
    assert quality.windows(np.array([1, 64, 65, 200]), 64).tolist() == [1, 64, 64, 1, 64, 64, 64, 8]


def test_quality_query_by_brute_force(spark):
    """The query's scores against the definition: every labelling of a text's lines, weighted and summed."""
    docs = spark.createDataFrame([(i, "A calm line of words here.\nAnd one more, quite plain." if i % 2 else "A | b | c!! | d%%\nX!! Y!! Z!! | |", i % 2) for i in range(60)], "doc_id long, text string, y int")
    field = quality.learn(docs, docs.select("doc_id", F.col("y").alias("quality")))
    texts = ["A calm line.\n| | |\n\nplain words", "", "one", "x\ny"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scored(rows, field).collect()}
    for i, t in enumerate(texts):
        own, counts, sizes = quality.own_features([t])
        x = quality.with_neighbours((own - field.mean) / field.spread, counts)
        emission, total, good = x @ field.theta, 0.0, np.zeros(len(x))
        for y in itertools.product((0, 1), repeat=len(x)):
            w = math.exp(sum(e * v for e, v in zip(emission, y)) + sum(field.change[a, b] for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
        share = float(np.dot(good / total, sizes + 1) / (sizes + 1).sum())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(share * field.curve[0] + field.curve[1]))), rel=1e-6)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(5)
    counts = np.array([3, 1, 4])
    emission, change = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected, logz = quality.marginals(emission, counts, change)
    at, total, pairs = 0, 0.0, np.zeros((2, 2))
    for n in counts:
        weight, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(e * v for e, v in zip(emission[at : at + n], y)) + sum(change[a, b] for a, b in zip(y, y[1:])))
            weight += w
            one += w * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += w
        assert np.allclose(good[at : at + n], one / weight)
        pairs += two / weight
        total += math.log(weight)
        at += n
    assert np.allclose(expected, pairs) and logz == pytest.approx(total)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, "A calm line of words here.\nAnd one more, quite plain." if i % 2 else "A | b | c!! | d%%\nX!! Y!! Z!! | |", i % 2) for i in range(60)], "doc_id long, text string, y int")
    field = quality.learn(docs, docs.select("doc_id", F.col("y").alias("quality")))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "\n" * 50), (3, "A calm line of words here.\n" * 5000)], "doc_id long, text string")
    rows = quality.scored(odd, field).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(odd.limit(0), field).count() == 0
    none = quality.learn(docs, docs.limit(0).select("doc_id", F.col("y").alias("quality")))
    assert {round(r["score"], 6) for r in quality.scored(odd, none).collect()} == {0.5}


# --- context-tree weighting -----------------------------------------------------------------


def weighted(history, depth, context, tail):
    """Probability (weighted) and its next-one share, by the definition, for the bits seen in a context."""
    mine = [(c, b) for c, b in history if c.startswith(context)]
    zeros, ones = sum(b == 0 for _, b in mine), sum(b == 1 for _, b in mine)
    kt = 1.0
    for i in range(zeros):
        kt *= (i + 0.5) / (i + 1)
    for j in range(ones):
        kt *= (j + 0.5) / (zeros + j + 1)
    if len(context) == depth:
        return kt
    below = 1.0
    for c in {c[: len(context) + 1] for c, _ in mine}:
        below *= weighted(history, depth, c, tail)
    return 0.5 * kt + 0.5 * below


def tree_of(spark, grams, counts):
    """string_probabilities with groups of two strings, so that contexts of two bytes lie in several."""
    rows = spark.createDataFrame([(int(g), None, int(n)) for g, n in zip(grams, counts)], "gram long, word binary, n long")
    return {r["gram"]: r["logp"] for r in context_tree.string_probabilities(rows, 2).collect()}


def test_context_tree_against_the_definition(spark):
    """P(bit) is the ratio of the tree's probabilities with and without one more such bit."""
    train = [[b"abab", b"aab"], [b"ba"], [b"abba", b"b"]]
    grams, sizes = context_tree.strings_of(train)
    keys, counts = context_tree.tally(grams)
    probe, _ = context_tree.strings_of([[b"abz"]])
    every = np.unique(np.concatenate([keys, probe]))
    n = np.array([dict(zip(keys.tolist(), counts.tolist())).get(k, 0) for k in every.tolist()])
    got = tree_of(spark, every, n)

    def context(k):
        return bytes((k >> (8 * (context_tree.DEPTH + 1 - d))) & 255 for d in range(1, context_tree.DEPTH + 1))

    seen = [(context(k), k & 255) for k in grams.tolist()]
    for k in [*keys[:6].tolist(), *probe.tolist()]:
        p = 1.0
        for bit in range(8):
            node = (1 << bit) | ((k & 255) >> (8 - bit))
            history = [(c, b >> (7 - bit) & 1) for c, b in seen if (1 << bit) | (b >> (8 - bit)) == node]
            more = history + [(context(k), (k & 255) >> (7 - bit) & 1)]
            p *= weighted(more, context_tree.DEPTH, b"", None) / weighted(history, context_tree.DEPTH, b"", None)
        assert got[k] == pytest.approx(math.log10(p), abs=1e-9)


def test_estimates_of_large_counts():
    zeros = np.array([[0.0, 3.0, 5000.0], [1e6, 4095.0, 1e9]])
    ones = np.array([[0.0, 9000.0, 5000.0], [0.0, 4096.0, 7.0]])
    want = [[math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for a, b in zip(x, y)] for x, y in zip(zeros, ones)]
    assert context_tree.log_estimate(zeros, ones) == pytest.approx(np.array(want), rel=1e-9, abs=1e-5)


def test_lookup():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    table = context_tree.Lookup(keys, np.arange(len(keys), dtype=np.float32))
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert np.isnan(table.get(rng.integers(1 << 49, 1 << 50, 1000))).all()
    assert np.isnan(context_tree.Lookup(keys[:0], np.zeros(0, dtype=np.float32)).get(keys)).all()


def test_language_model_scores(spark):
    rows = [(i, "The cat sat on the mat" if i % 3 else "a dog ran") for i in range(40)] + [(None, None), (50, ""), (51, "Zebra!"), (51, "Zebra!")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gram string")
    full = sorted(map(tuple, context_tree.score(docs).collect()), key=str)
    cut = sorted(map(tuple, context_tree.score(docs, strings=20, most_words=2).collect()), key=str)
    assert len(full) == len(rows)
    for a, b in zip(full, cut, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    held = lambda k: __import__("zlib").crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts, train = {}, 0
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    for k, t in rows:
        if not held(k):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
                train += 1
    want = sorted(
        ((k, held(k), len(tokens(t)), sum(w in counts for w in tokens(t)), train, sum(math.log10((counts.get(w, 0) + 1) / (train + len(counts) + 1)) for w in tokens(t))) for k, t in rows), key=str
    )
    for a, b in zip(full, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert all(r[6] < 0 for r in full)
    assert context_tree.score(docs.limit(0)).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    grams, _ = context_tree.strings_of([[b"hello", b"help", b"held"]] * 3)
    keys, counts = context_tree.tally(grams)
    context = keys[0] >> 8 << 8
    every = np.unique(np.concatenate([keys, context + np.arange(256)]))
    n = np.array([dict(zip(keys.tolist(), counts.tolist())).get(k, 0) for k in every.tolist()])
    got = tree_of(spark, every, n)
    p = 10 ** np.array([got[k] for k in every.tolist()])
    assert p[every >> 8 << 8 == context].sum() == pytest.approx(1.0)


def test_logistic_of_one_class():
    w = learning.fit_logistic(np.zeros((4, 1)), np.ones(4))
    assert 0.5 < learning.logistic(np.zeros((1, 1)), w)[0] < 1


def labelled_by_chance(spark, label, ones, zeros):
    """Documents whose texts say nothing about their label, and the labels."""
    import random

    rng = random.Random(3)
    n = ones + zeros
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6):06d}" for _ in range(12)) if label == "toxic" else "the same line of words") for i in range(n)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % n < ones)) for i in range(n)], f"doc_id long, {label} int")


def training_share(spark, labels, label):
    return labels.filter(~learning.held_out(F.col("doc_id"))).agg(F.avg(label)).first()[0]


def test_caps_keep_the_odds_of_toxic_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_SAMPLE", 30)
    monkeypatch.setattr(toxicity, "CLEAN_SAMPLE", 30)
    docs, labels = labelled_by_chance(spark, "toxic", 60, 540)
    scores = [r["score"] for r in toxicity.scored(docs, toxicity.learn(docs, labels)).collect()]
    assert scores == pytest.approx([training_share(spark, labels, "toxic")] * 600, abs=0.01)


def test_caps_keep_the_odds_of_good_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", {0: 30, 1: 30})
    docs, labels = labelled_by_chance(spark, "quality", 300, 60)
    scores = [r["score"] for r in quality.scored(docs, quality.learn(docs, labels)).collect()]
    assert scores == pytest.approx([training_share(spark, labels, "quality")] * 360, abs=0.01)


# --- bounds of learning ---------------------------------------------------------------------


def test_an_id_counts_once_in_a_sample(spark):
    from tracewright.llm.learning import labelled_sample

    docs = spark.createDataFrame([(0, f"text {k}") for k in range(500)] + [(i, "b") for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(0, 0), (77, 1)], "doc_id long, y int")
    sample, totals = labelled_sample(docs, labels, "y", {0: 100, 1: 100}, "once")
    rows = sample.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == sum(totals.values()) <= 9
    again, _ = labelled_sample(docs.repartition(5), labels, "y", {0: 100, 1: 100}, "once")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))


def test_lines_that_are_learned_from_are_bounded(spark):
    from tracewright.llm import quality

    rows = [(i, i % 2, "x\n" * (k - 1) + "x") for i, k in enumerate([1, 2, 3, 500, 4, 5, 1, 1, 2000])]
    kept = quality.within_lines(spark.createDataFrame(rows, "doc_id long, y int, text string"), lines=100).collect()
    assert {r["doc_id"] for r in kept} <= {0, 1, 2, 6, 7} and kept
    few = quality.within_lines(spark.createDataFrame([(i, 1, "x\nx") for i in range(60)], "doc_id long, y int, text string"), lines=100).collect()
    assert len(few) == 25


def test_scores_replace_a_column_of_their_name(spark):
    from tracewright.llm import quality, toxicity

    docs = spark.createDataFrame([(1, "a b", "old"), (2, None, "old")], "doc_id long, text string, score string")
    for df in (toxicity.scored(docs, toxicity.Lexicon({}, [], [0.0, 0.0, 0.0, 0.0])), quality.scored(docs, quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int")))):
        assert df.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in df.collect())
