import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.operators import corpus, diversity, gates, matching, resample, sampling, stats


# --- matching -------------------------------------------------------------------------------


def pairs_by_hand(treated, controls, caliper):
    used, out = set(), []
    for t, x in enumerate(treated):
        free = [(abs(x - c), i) for i, c in enumerate(controls) if i not in used]
        if not free:
            break
        gap, i = min(free)
        if gap <= caliper * max(x, 1):
            out.append((t, i))
            used.add(i)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=25), st.lists(st.integers(1, 30), max_size=25), st.sampled_from([0.0, 0.05, 0.3, 2.0]))
def test_fast_matcher_equals_the_rule(treated, controls, caliper):
    treated = sorted(treated)
    got = matching.match_lengths(np.array(treated, dtype=float), np.array(controls, dtype=float), caliper)
    gaps = lambda ps: [(t, abs(treated[t] - controls[c])) for t, c in ps]
    want = pairs_by_hand(treated, controls, caliper)
    assert gaps(got) == gaps(want) and got == want


def test_a_pure_length_effect_goes_away(spark):
    r = np.random.default_rng(1)
    rows = [(i, bool(i % 2), float(w), float(w) / 100 + r.normal(0, 0.1)) for i, w in enumerate(r.integers(50, 400, 600) + np.arange(600) % 2 * 60)]
    df = spark.createDataFrame(rows, "id long, f boolean, w double, v double")
    plain = stats.welch(df, [], "f", "v").first()
    matched = matching.matched_estimate(matching.matched_pairs(df, "id", "f", "w", "v"), "scope").first()
    assert plain["ci_excludes_zero"] and abs(matched["difference"]) < abs(plain["difference"]) / 4
    assert matched["max_pair_gap"] <= 0.05 + 1e-9


def test_matching_refuses(spark):
    df = spark.createDataFrame([(1, True, 10.0, 1.0), (2, False, 500.0, 1.0)], "id long, f boolean, w double, v double")
    assert matching.matched_pairs(df, "id", "f", "w", "v").count() == 0
    few = spark.createDataFrame([(1, True, 10.0, 1.0), (2, False, 10.0, 0.0)], "id long, f boolean, w double, v double")
    r = matching.matched_estimate(matching.matched_pairs(few, "id", "f", "w", "v"), "scope").first()
    assert r["n_pairs"] == 1 and r["difference"] is None and r["note"]


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(matching.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0]


# --- diversity ------------------------------------------------------------------------------


def entropy_by_thresholds(d):
    n = len(d)
    heights = sorted({d[i][j] for i in range(n) for j in range(i)})
    total, last = 0.0, 0.0
    for h in heights:
        labels = list(range(n))
        for i in range(n):
            for j in range(n):
                if d[i][j] <= last and labels[i] != labels[j]:
                    a, b = labels[i], labels[j]
                    labels = [a if x == b else x for x in labels]
        if last == 0.0 and not any(d[i][j] == 0 for i in range(n) for j in range(i)):
            labels = list(range(n))
        sizes = np.array([labels.count(x) for x in set(labels)]) / n
        total += -(sizes * np.log2(sizes)).sum() * (h - last)
        last = h
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=3, max_size=9), st.integers(0, 10**6))
def test_entropy_equals_brute_force(picks, seed):
    base = np.random.default_rng(seed).normal(size=(7, 4))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    points = base[picks]
    d = np.maximum(1 - points @ points.T, 0)
    d[d < 1e-12] = 0
    hse, norm, mean = diversity.diversity(points)
    assert hse == pytest.approx(entropy_by_thresholds(d), abs=1e-9)
    pairs = [d[i][j] for i in range(len(d)) for j in range(i)]
    assert mean == pytest.approx(np.mean(pairs), abs=1e-9) and norm == pytest.approx(hse / np.log2(len(points)))


def test_hand_case():
    assert diversity.entropy_integral([(0, 0, 1), (0, 2, 3), (10, 0, 2)], 4) == pytest.approx(10.0)


def test_single_voices(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.6, 0.8])], "t string, v array<double>")
    rows = {r["t"]: r for r in diversity.hse_by_trace(df, "t", "v").collect()}
    assert rows["a"]["single_voice"] and rows["a"]["hse"] == 0.0 and rows["b"]["hse"] > 0
    assert [r["t"] for r in diversity.hse_by_trace(df, "t", "v", single="drop").collect()] == ["b"]


# --- statistics -----------------------------------------------------------------------------


def test_estimates_need_rows(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, 2.0), ("b", True, 1.0), ("b", True, 3.0), ("b", False, 1.0), ("b", False, 0.0)], "g string, f boolean, v double")
    r = {x["g"]: x for x in stats.welch(df, ["g"], "f", "v").collect()}
    assert r["a"]["difference"] is None and r["b"]["difference"] == 1.5
    assert stats.within_group_paired(df, "g", "f", "v", least=3).first()["difference"] is None
    assert stats.within_group_paired(df, "g", "f", "v", least=2).first()["difference"] == 0.25


def test_each_group_counts_once(spark):
    rows = [("a", True, 2.0)] * 50 + [("a", False, 0.0)] + [("b", True, 0.0), ("b", False, 0.0)]
    df = spark.createDataFrame(rows, "g string, f boolean, v double")
    assert stats.within_group_paired(df, "g", "f", "v", least=2).first()["difference"] == 1.0


def test_strata_with_repeated_edges(spark):
    df = spark.createDataFrame([(float(w),) for w in [1] * 10 + [5, 9]], "w double")
    got = {r["bin"]: r["count"] for r in stats.quantile_strata(df, "w", 4).groupBy("bin").count().collect()}
    assert got == {3: 12}


def test_medians_differ(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "x int")
    assert df.select(stats.upper_median(F.col("x")), F.percentile("x", 0.5)).first()[:] == (3, 2.5)


def test_bootstrap_covers_and_repeats(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("v"))
    a, b = (resample.bootstrap_ci(df, "v", "id", 100, 1).first() for _ in range(2))
    assert a == b and a["ci95_low"] < a["mean"] < a["ci95_high"]
    assert resample.bootstrap_ci(df.filter("id < 0"), "v", "id", 10).first()["mean"] is None
    assert resample.mediation_bootstrap(df.withColumn("f", F.lit(True)), "f", "v", "id", 10).first()["difference"] is None


# --- sampling and corpora -------------------------------------------------------------------


def test_positions_and_splits(spark):
    df = spark.range(0, 1000, 3).toDF("k")
    got = sorted((r["k"], r["pos"]) for r in sampling.positions(df, "k").collect())
    assert got == [(3 * i, i) for i in range(334)]
    split = sampling.train_val_split(df, "k", 6, seed=1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"val": 55, "train": 279}
    with pytest.raises(ValueError):
        sampling.train_val_split(df, "k", train=300, val=100)
    with pytest.raises(ValueError):
        sampling.chunk_plan(df, None, "k", 0)
    assert sampling.offset_slice(df, "k", 10, 3).count() == 3


def test_sample_keeps_order(spark):
    got = [r["id"] for r in sampling.sample_in_order(spark.range(100), "id", 20, 5).collect()]
    assert got == sorted(got) and len(got) == 20
    assert {r["id"] for r in sampling.seeded_sample(spark.range(100), "id", 20, 5).collect()} == set(got)


def test_resume_with_null_keys(spark):
    plan = spark.createDataFrame([("a", None, 0.1), ("a", 1.0, 0.1), ("b", None, 0.3)], "p string, alpha double, s double")
    done = spark.createDataFrame([("a", None, 0.1 + 1e-9)], "p string, alpha double, s double")
    assert sorted(map(str, corpus.not_done(plan, done, ["p", "alpha", "s"]).collect())) == sorted(map(str, plan.collect()[1:]))


def test_calibration_overlay(spark):
    f = spark.createDataFrame([(0, 1.0, 0.1), (1, 2.0, 0.2), (5, 3.0, 0.3)], "index int, max_act double, frac_nonzero double")
    c = spark.createDataFrame([([9.0, 8.0], [0.9, 0.8])], "max_act array<double>, frac_nonzero array<double>")
    assert sorted(tuple(r) for r in corpus.calibrated(f, c).select("index", "max_act", "frac_nonzero").collect()) == [(0, 9.0, 0.9), (1, 8.0, 0.8), (5, 3.0, 0.3)]


def test_kept_traces_counts(spark):
    df = spark.createDataFrame([(True, ""), (False, " "), (None, "x"), (True, "y")], "truncated boolean, response string")
    kept, counts = corpus.kept_traces(df)
    assert kept.count() == 1 and counts.first()[:] == (2, 1, 1)


def test_gates(spark):
    a, b, none = spark.range(3).toDF("k"), spark.range(1, 4).toDF("k"), spark.range(0).toDF("k")
    gates.same_keys(a, a, "k")
    for l, r in ((a, b), (none, none)):
        with pytest.raises(gates.GateError):
            gates.same_keys(l, r, "k")
    with pytest.raises(gates.GateError):
        gates.least_rate(a, "k", F.col("k") > 0)
    with pytest.raises(gates.GateError):
        gates.pool_total(a, 4)
    assert gates.pool_total(a, 4, allow_short=True) == 3
    with pytest.raises(gates.GateError):
        gates.not_copied(spark.createDataFrame([(0.5,), (0.9,)], "v double"), "v", [0.501])
    assert gates.training_config(16, 4, 8) == 8
    for bad in ((2, 4, 8), (16, 4, 1), (3, 3, 2)):
        with pytest.raises(ValueError):
            gates.training_config(*bad)
    with pytest.raises(ValueError):
        gates.training_config(16, 4, 8, lr=1.0)
    with pytest.raises(gates.GateError):
        corpus.pair_arms_checked(a, b.filter("k > 2"), "k")


# --- files and streams ----------------------------------------------------------------------


def test_jsonl_sources(spark, tmp_path):
    from tracewright.sources import readers, sinks

    p = tmp_path / "a.jsonl"
    p.write_text('{"pid": "1", "n": 1}\n\n{"pid": "2", "n": 2}\n{"pid": "3", "n"')
    assert sorted(r["pid"] for r in readers.jsonl_tolerant(spark, str(p), "pid string, n int").collect()) == ["1", "2"]
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps({"summary": {}, "per_trace": [{"pid": "1", "v": 0.5}, {"pid": "2", "v": 1.5}]}))
    assert readers.json_document(spark, str(doc), "pid string, v double", "per_trace").count() == 2
    out = str(tmp_path / "out")
    sinks.append_new(spark.range(3).toDF("k"), out, ["k"], "k long")
    sinks.append_new(spark.range(5).toDF("k"), out, ["k"], "k long")
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    a = spark.range(3).toDF("pid")
    sinks.paired(a.withColumn("dialogue", F.lit("d")), a.withColumn("monologue", F.lit("m")), str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 3


def test_shards_and_fallback(spark, tmp_path):
    import gzip

    from tracewright.sources import readers

    for i in range(2):
        with gzip.open(tmp_path / f"batch-{i}.jsonl.gz", "wt") as f:
            f.write(json.dumps({"index": i}) + "\n")
    (tmp_path / "notes.txt").write_text("{}")
    assert readers.shards(spark, str(tmp_path), "index int", keep=str(tmp_path / "kept")).count() == 2
    got = readers.with_fallback(lambda: spark.read.parquet(str(tmp_path / "absent")), lambda: spark.range(4))
    assert got.count() == 4


def test_log_traces(spark, tmp_path):
    from tracewright.sources import readers

    (tmp_path / "a.log").write_text("\x1b[36m(main_task pid=3)\x1b[0m <think>a\nb</think><answer>1</answer> noise <think>c</think><answer>2</answer>")
    assert [r["trace"][:8] for r in readers.log_traces(spark, str(tmp_path / "a.log")).orderBy("pos").collect()] == ["<think>a", "<think>c"]


def test_problem_adapters(spark):
    from tracewright.sources import readers

    mcq = readers.choice_problems(spark.createDataFrame([("p1", "q?", "good", "b1", "b2", "b3")], "pid string, q string, r string, a string, b string, c string"), "q", "r", ["a", "b", "c"]).first()
    assert f"({mcq['answer']}) good" in mcq["prompt"]
    m = readers.math_problems(spark.createDataFrame([("p", "x", "so \\boxed{2}", "t", "5"), ("q", "x", "none", "t", "5")], "pid string, problem string, solution string, type string, level string"))
    assert [r["answer"] for r in m.collect()] == ["2"]
    c = readers.countdown_problems(spark.createDataFrame([("p", [1, 2], 3)], "pid string, nums array<int>, target int")).first()
    assert c["answer"] == "3|1,2" and "[1, 2]" in c["prompt"]
    pool = readers.pool([readers.pool_rows(spark.createDataFrame([("1", "t", "a")], "pid string, t string, a string"), s, F.col("t"), F.col("a")) for s in ("x", "y")])
    assert sorted(r["pid"] for r in pool.collect()) == ["x/1", "y/1"]


def test_metric_stream_restarts(spark, tmp_path):
    from tracewright.streaming import metrics

    logs, out, state = (str(tmp_path / x) for x in ("logs", "out", "state"))

    def run():
        metrics.write_metrics(metrics.metric_stream(spark, logs), out, state).awaitTermination()
        return sorted(r["step"] for r in spark.read.schema("step long").json(out).collect())

    assert run() == []
    (tmp_path / "logs" / "1.log").write_text("step:1 - a:1\nnoise\nstep:1 - a:2\n")
    assert run() == [1]
    (tmp_path / "logs" / "2.log").write_text("step:1 - a:3\nstep:2 - a:4\n")
    assert run() == [1, 2]


def test_half_written_cache_is_written_anew(spark, tmp_path):
    from tracewright.sources import readers

    import gzip

    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a.jsonl.gz", "wt") as f:
        f.write('{"index": 1}\n{"index": 2}\n')
    keep = tmp_path / "kept"
    (keep / "_temporary").mkdir(parents=True)
    for _ in range(2):
        assert readers.shards(spark, str(tmp_path / "in"), "index int", keep=str(keep)).count() == 2
    assert (keep / "_SUCCESS").exists() and [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp")] == []


def test_records_keep_their_order_in_their_file(spark, tmp_path):
    from tracewright.sources import readers

    for name in ("b", "a"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"x": "{name}{k}"}}\n' for k in range(500)))
    rows = readers.in_file_order(spark, str(tmp_path), "x string").orderBy("file", "line").collect()
    assert [r["x"] for r in rows] == [f"{n}{k}" for n in "ab" for k in range(500)]
    assert [r["line"] for r in rows] == [*range(500)] * 2


def test_argmax_of_equal_scores_is_the_least(spark):
    rows = [("a", 7, 2.0), ("a", 3, 2.0), ("a", 9, 2.0), ("a", None, 5.0), ("a", 1, None), ("b", None, 1.0), ("c", 4, float("nan")), ("c", 5, 1.0)]
    df = spark.createDataFrame(rows, "k string, what int, score double")
    for some in (df.repartition(1), df.repartition(5), df.orderBy("what").coalesce(1), df.orderBy(F.desc("what")).coalesce(1)):
        got = {r["k"]: (r["what"], r["score"]) for r in corpus.argmax(some, ["k"], "what", "score").collect()}
        assert got["a"] == (3, 5.0) and got["b"] == (None, 1.0) and got["c"][0] == 4


def test_layers_of_equal_values_tie_in_any_order(spark):
    import random

    from tracewright.operators import reports

    r = random.Random(2)
    values = [r.randrange(11) / 100 * r.randrange(1, 51) for _ in range(300)]
    rows = [(layer, v) for layer in range(12) for v in r.sample(values, len(values))]
    df = spark.createDataFrame([*rows, (90, 1e25), (90, 1e25), (91, 1e-12), (92, float("nan")), (93, None)], "layer int, v double").repartition(7)
    got = {x["layer"]: (x["mean_change"], x["place"]) for x in corpus.layer_rank(df, "layer", "v").collect()}
    assert len({got[k][0] for k in range(12)}) == 1 and got[0][0] == pytest.approx(sum(values) / 300)
    assert [got[k][1] for k in (92, 90, *range(12), 91, 93)] == list(range(1, 17))
    assert got[90][0] == 1e25 and got[91][0] == 1e-12 and got[93][0] is None
    top = reports.largest_shifts(df.filter("layer < 90"), "layer", "v", 5)
    assert [x["layer"] for x in top.orderBy("place").collect()] == [0, 1, 2, 3, 4]
