"""Operators that cut their work into tasks equal the rule applied to everything at once."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.operators import diversity, gates, matching, order_stats, reports, resample, sampling, stats
from tracewright.sources import readers, sinks


# --- numbering ------------------------------------------------------------------------------


def test_places_inside_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(("hot", "hot", "a", "b", None)), r.choice((None, *range(20))), i) for i in range(500)]
    got = sampling.numbered(spark.createDataFrame(rows, "g string, k int, i int"), ["g"], ["k", "i"], "place").collect()
    want = {}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want |= {x[2]: k for k, x in enumerate(own)}
    assert {x["i"]: x["place"] for x in got} == want
    assert sampling.positions(spark.range(0), "id").count() == 0


# --- matching -------------------------------------------------------------------------------


def by_rule(rows, caliper):
    """(treated, control) keys: treated rows by length and key take the nearest free control, the shorter one on a tie."""
    controls, out = sorted((l, k) for k, f, l in rows if f is False and l is not None), []
    for x, k in sorted((l, k) for k, f, l in rows if f and l is not None):
        if not controls:
            break
        gap, l, c = min((abs(x - l), l, c) for l, c in controls)
        if gap <= caliper * max(x, 1):
            out.append((k, c))
            controls.remove((l, c))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4), st.integers(0, 4)), max_size=20), st.sampled_from([0.0, 0.05, 0.3, 2.0]))
def test_counts_are_matched_like_rows(cells, caliper):
    cells = sorted({x: (t, c) for x, t, c in cells}.items())
    lengths, t, c = np.array([x for x, _ in cells], dtype=float), np.array([v[0] for _, v in cells], dtype=int), np.array([v[1] for _, v in cells], dtype=int)
    flows = matching.match_counts(lengths, t, c, caliper)
    rows, names = [], {}
    for i, x in enumerate(lengths):
        for f, n in ((True, t[i]), (False, c[i])):
            for k in range(n):
                names[f, i, k] = len(rows)
                rows.append((len(rows), f, float(x)))
    got = sorted((names[True, i, a + p], names[False, j, b + p]) for i, j, n, a, b in flows for p in range(n))
    assert got == by_rule(rows, caliper)


@pytest.mark.parametrize("caliper", [0.0, 0.05, 0.3, 1.5])
def test_matched_pairs_equal_the_rule(spark, caliper):
    r = random.Random(int(caliper * 100))
    rows = [(i, r.choice((True, True, False, None)), r.choice((None, 7.0, 7.0, float(r.randint(0, 40)), round(r.uniform(100, 3000), 1), r.uniform(1e6, 1e7)))) for i in range(700)]
    df = spark.createDataFrame([(*x, r.choice(("x", "y", None))) for x in rows], "id long, f boolean, w double, g string")
    pairs = matching.matched_pairs(df.withColumn("v", F.col("w")), "id", "f", "w", "v", caliper)
    assert sorted((p["treated_id"], p["control_id"]) for p in pairs.collect()) == by_rule(rows, caliper)
    groups = {x["id"]: x["g"] for x in df.collect()}
    apart = matching.matched_pairs(df.withColumn("v", F.col("w")), "id", "f", "w", "v", caliper, by="g").collect()
    for g in ("x", "y", None):
        assert sorted((p["treated_id"], p["control_id"]) for p in apart if p["g"] == g) == by_rule([x for x in rows if groups[x[0]] == g], caliper)


def test_lengths_are_cut_at_wide_gaps(spark):
    lengths = [float(x) for x in (*range(1, 40), 60, 61, 100, 104, 120, 500)]
    counts = spark.createDataFrame([(g, x, 1) for g in ("a", "b") for x in lengths], "g string, l double, t int")
    pieces = {}
    for r in matching.length_pieces(counts, 0.05).collect():
        pieces.setdefault(r["piece"], set()).add((r["g"], r["l"]))
    want, held = [], []
    for g in ("a", "b"):
        for x in lengths:
            if held and (held[-1][0] != g or x - held[-1][1] > 0.05 * max(x, 1)):
                want.append(set(held))
                held = []
            held.append((g, x))
    assert sorted(map(sorted, pieces.values())) == sorted(map(sorted, [*want, set(held)])) and len(pieces) > 40


def test_many_pairs_of_one_length_are_spread(spark, monkeypatch):
    monkeypatch.setattr(matching, "SPREAD", 7)
    df = spark.range(400).select(F.col("id"), (F.col("id") % 2 == 0).alias("f"), F.lit(5.0).alias("w"), F.lit(1.0).alias("v"))
    pairs = matching.matched_pairs(df, "id", "f", "w", "v").collect()
    assert sorted((p["treated_id"], p["control_id"]) for p in pairs) == [(2 * k, 2 * k + 1) for k in range(200)]


# --- entropy of long traces -----------------------------------------------------------------


def vectors(spark, traces):
    return spark.createDataFrame([(t, [float(x) for x in v]) for t, vs in traces.items() for v in vs], "t string, v array<double>")


def test_tiled_trees_give_the_same_entropy(spark):
    r = np.random.default_rng(4)
    traces = {f"t{n}": r.normal(size=(n, 6)) + 3 * r.integers(0, 2, (n, 1)) for n in (2, 3, 11, 12, 40, 65, 130)}
    traces["same"] = np.ones((50, 6))
    traces["zero"] = np.zeros((33, 6))
    df = vectors(spark, traces)
    whole = {x["t"]: x for x in diversity.hse_by_trace(df, "t", "v").collect()}
    for tile in (8, 10, 64):
        parted = {x["t"]: x for x in diversity.hse_by_trace(df, "t", "v", long=11, tile=tile).collect()}
        assert parted.keys() == whole.keys()
        for t, x in whole.items():
            assert parted[t]["n_segments"] == x["n_segments"] and parted[t]["single_voice"] == x["single_voice"]
            assert [parted[t][c] for c in ("hse", "hse_norm", "mean_dist")] == pytest.approx([x[c] for c in ("hse", "hse_norm", "mean_dist")], abs=1e-9)


def test_edges_between_two_tiles_span_them():
    r = np.random.default_rng(5)
    points = r.normal(size=(30, 4))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    gap = 1 - points @ points.T
    for cut in (1, 12, 29):
        edges = diversity._tile_edges(points[:cut], points[cut:])
        got = sorted(edges[:, 0])
        pairs, label, want = sorted((max(gap[i, j], 0), i, j) for i in range(cut) for j in range(cut, 30)), list(range(30)), []
        for h, i, j in pairs:
            if label[i] != label[j]:
                want.append(h)
                label = [label[i] if x == label[j] else x for x in label]
        assert got == pytest.approx(want)


def test_a_trace_of_fifty_thousand_segments(spark):
    # two opposed directions: a tree with one edge of height 2 and else 0, of which half the segments each are known
    n = 50_000
    df = spark.range(n).select(F.lit("x").alias("t"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(-1.0), F.lit(0.0))).alias("v"))
    got = diversity.hse_by_trace(df, "t", "v", tile=8192).first()
    assert (got["n_segments"], got["single_voice"]) == (n, False)
    assert got["hse"] == pytest.approx(2.0) and got["mean_dist"] == pytest.approx(2 * (n / 2) ** 2 / (n * (n - 1) / 2))


# --- order statistics -----------------------------------------------------------------------


def test_quantiles_of_any_groups(spark):
    r = random.Random(9)
    rows = [(r.choice(("hot",) * 5 + ("a", None)), r.choice((None, r.gauss(0, 1), 5.0, float(r.randint(-3, 3)), r.expovariate(1) * 1e9))) for _ in range(900)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.05, 0.5, 0.875, 1.0]
    got = {x["g"]: x for x in order_stats.quantiles(df, ["g"], "v", shares).join(order_stats.upper_medians(df, ["g"], "v").withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).collect()}
    for g in {x[0] for x in rows}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        if values:
            assert got[g]["quantiles"] == pytest.approx(list(np.quantile(values, shares))) and got[g]["upper_median"] == values[len(values) // 2]
        else:
            assert got[g]["quantiles"] == [None] * 5 and got[g]["upper_median"] is None
    whole = order_stats.quantiles(df, [], "v", shares).first()["quantiles"]
    assert whole == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], shares)))
    assert order_stats.quantiles(df.limit(0), [], "v", [0.5]).first()["quantiles"] == [None]
    assert order_stats.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_length_and_population_summaries(spark):
    df = spark.createDataFrame([("a", "one two"), ("a", "three"), ("a", None), ("b", "x y z w")], "g string, t string")
    assert {x["g"]: tuple(x)[1:] for x in stats.length_stats(df, ["g"], "t").collect()} == {"a": (3, 6, *stats_of(df, "a"), 7, 1), "b": (1, 7, 4, 7, 4)}  # a null text has no length and no words
    one = stats.population_summary(spark.range(5), [], "id").first()
    assert tuple(one) == pytest.approx((2.0, 2**0.5, 0.2, 2.0, 3.8))


def stats_of(df, g):
    from tracewright.functions.text import word_count

    return [df.filter(F.col("g") == g).agg(F.percentile(word_count(F.col("t")), 0.5).cast("int")).first()[0]]


# --- bootstrap ------------------------------------------------------------------------------


@pytest.mark.parametrize("held", [7, 50, 1000])
def test_units_in_several_arrays_give_the_same_means(spark, held):
    import hashlib

    r = random.Random(3)
    values = [(i * 13 % 101, r.choice((None, r.random(), r.random()))) for i in range(60)]
    df = spark.createDataFrame(values, "id long, v double")
    got = {x["b"]: x["mean"] for x in resample._replicates(df, "v", "id", 20, "s", held).collect()}
    ordered = [v for _, v in sorted(values)]
    for b in range(20):
        drawn = [ordered[int(hashlib.md5(f"s|{b}|{i}".encode()).hexdigest()[:8], 16) % 60] for i in range(60)]
        some = [v for v in drawn if v is not None]
        assert got[b] == pytest.approx(sum(some) / len(some))


def test_classes_in_several_arrays(spark):
    rows = spark.range(80).select("id", (F.col("id") % 3 == 0).alias("f"), (F.col("id") * F.col("id") % 17).cast("double").alias("v"))
    one, parted = (resample.mediation_bootstrap(rows, "f", "v", "id", 40, seed=2, held=h).first() for h in (1000, 11))
    assert tuple(one) == pytest.approx(tuple(parted))


def test_draws_are_md5_and_no_rows(spark):
    import hashlib

    import numpy as np

    b, i = (np.array(x) for x in zip(*[(r, s) for r in (0, 9, 10, 3999) for s in (0, 9, 10, 99_999, 1_234_567, 10**10)], strict=True))
    for seed in (11, "7l", "é", "s" * 30, "s" * 60):
        assert resample.slot_numbers(seed, b, i).tolist() == [int(hashlib.md5(f"{seed}|{x}|{y}".encode()).hexdigest()[:8], 16) for x, y in zip(b, i, strict=True)]
    units = spark.range(900).select("id", F.lit(0).alias("g"), F.lit(1.0).alias("v"))
    drawn = resample._drawn(spark, units, "id", 3000, 1, 900, 2_000)  # 2.7 M draws
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan
    rows = drawn.groupBy("b").agg(F.sum("c").alias("c"), F.count("*").alias("parts")).collect()
    assert len(rows) == 3000 and all(r["c"] == 900 for r in rows) and sum(r["parts"] for r in rows) < 3010


# --- chunks, file order, early stop ---------------------------------------------------------


def test_thousands_of_chunks_resume(spark, tmp_path):
    path, out = str(tmp_path / "plan"), str(tmp_path / "out")
    spark.range(8_000).withColumn("chunk", F.expr("id div 2")).write.parquet(path)
    plan = spark.read.parquet(path)
    bad = F.pmod(F.hash("chunk"), F.lit(40)) == 37  # the chunks of a late task

    def breaks(rows):
        return rows.select("id", F.when(bad, F.raise_error(F.lit("lost"))).otherwise(F.col("id") * 2).cast("long").alias("twice"), "chunk")

    with pytest.raises(Exception, match="lost"):
        sinks.write_chunks(plan, out, breaks, tasks=40)
    there = spark.read.schema("id long, twice long, chunk long").parquet(out)
    before = {r["id"] for r in there.collect()}
    left = sinks.open_chunks(plan, out)
    assert 0 < len(before) < 8_000 and left.count() == 8_000 - len(before)
    sinks.write_chunks(plan, out, lambda rows: rows.select("id", (F.col("id") * 2).alias("twice"), "chunk"), tasks=40)
    rows = spark.read.schema("id long, twice long, chunk long").parquet(out)
    assert rows.count() == 8_000 and rows.filter("twice <> 2 * id OR chunk <> id div 2").isEmpty() and rows.select("id").distinct().count() == 8_000
    assert sinks.open_chunks(plan, out).isEmpty()


def test_lines_of_a_file_that_many_tasks_read(spark, tmp_path):
    (tmp_path / "large.jsonl").write_text("".join(f'{{"x": {k}, "pad": "{"p" * (k % 50)}"}}\n' + "\n" * (k % 3 == 0) for k in range(4000)))
    (tmp_path / "small.jsonl").write_text('{"x": 1}\n{"x": 2}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.in_file_order(spark, str(tmp_path), "x int")
        assert rows.rdd.getNumPartitions() > 3
        got = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["x"]) for r in rows.collect())
        assert spark.read.schema("x int").json(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [*[("large.jsonl", k, k) for k in range(4000)], ("small.jsonl", 0, 1), ("small.jsonl", 1, 2)]


def test_a_scan_stops_when_all_classes_are_full(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.choice((True, False, None)), i % 30) for i in range(900)]
    spark.createDataFrame(rows, "id int, ok boolean, shard int").write.partitionBy("shard").parquet(str(tmp_path / "s"))
    shards = {f"shard={k}": str(tmp_path / "s" / f"shard={k}") for k in range(30)}
    asked = []

    def read(paths):
        asked.append(len(paths))
        return spark.read.schema("id int, ok boolean").parquet(*paths)

    some, done = readers.balanced_scan(read, shards, "ok", [True, False], "id", 20, seed=1)
    assert done["read"] < 30 and done == {"shards": 30, "read": sum(asked[:-1]), "rows": done["rows"]} and asked[:2] == [1, 2]
    kept = some.collect()
    assert sorted(x["ok"] for x in kept) == [False] * 20 + [True] * 20
    again, _ = readers.balanced_scan(lambda p: spark.read.schema("id int, ok boolean").parquet(*p).repartition(7), shards, "ok", [True, False], "id", 20, seed=1)
    assert sorted(x["id"] for x in kept) == sorted(x["id"] for x in again.collect())
    _, capped = readers.balanced_scan(read, shards, "ok", [True, False], "id", 20, seed=1, most_rows=1)
    assert capped["read"] == 1
    every, whole = readers.balanced_scan(read, shards, "ok", [True, False], "id", 10_000, seed=1)
    assert whole["read"] == 30 and every.count() == sum(x[1] is not None for x in rows)


# --- reports, gates, curves -----------------------------------------------------------------


def test_wide_numbers_keep_their_digits(spark):
    one = spark.createDataFrame([(123456789.123, "a long name")], "v double, k string")
    assert one.select("*").transform(lambda d: reports.report_lines(d, [("k", 4, None), ("v", 8, "%.3f")])).first()["line"] == "a long name123456789.123"


def test_gates_as_rows(spark):
    flags = spark.createDataFrame([(True,), (None,), (True,)], "ok boolean")
    got = {r["gate"]: (r["passed"], r["value"]) for r in gates.solved_row(flags, F.col("ok"), 0.4).unionByName(gates.solved_row(flags.limit(0), F.col("ok"), name="none")).collect()}
    assert got == {"solved": (True, pytest.approx(1 / 3)), "none": (False, None)}
    runs = spark.createDataFrame([("a", True), ("b", False)], "run string, has_checkpoint boolean")
    assert tuple(gates.curves_row(spark.createDataFrame([("a",), ("b",), ("b",)], "run string"), runs, "run").first()) == ("curves_have_runs", False, 1.0)
    assert [tuple(gates.total_row(spark.range(3), n, short).first())[1] for n, short in ((3, False), (4, False), (4, True), (2, True))] == [True, False, True, False]
    report = gates.enough_row(spark.range(0)).unionByName(gates.enough_row(spark.range(2), 2, "two"))
    with pytest.raises(gates.GateError, match="enough: 0.0"):
        gates.failing(report)
    gates.failing(report.filter("gate = 'two'"))


def test_configurations_as_rows_follow_the_rules(spark):
    r = random.Random(6)
    rows = [(r.choice((0, 1, 8, 6)), r.choice((1, 4, 0)), r.choice((0, 1, 2, 3, 8, -2)), r.choice((1e-5, 1.0, 1e-9))) for _ in range(200)]
    df = spark.createDataFrame(rows, "b int, a int, g int, lr double")
    for x in df.select("*", gates.config_findings(F.col("b"), F.col("a"), F.col("g"), F.col("lr")).alias("f")).collect():
        try:
            assert gates.training_config(x["b"], x["a"], x["g"], x["lr"]) == x["f"]["prompts"] and x["f"]["wrong"] is None
        except ValueError:
            assert x["f"]["wrong"]


def test_windows_of_curves(spark):
    rows = [("p", 1, 2.0), ("p", 5, 4.0), ("q", 5, 1.0), ("q", 9, 7.0), ("other", 5, 100.0), ("p", 20, 1.0)]
    df = spark.createDataFrame(rows, "c string, s int, v double")
    got = {r["part"]: (r["first"], r["second"], r["gap"]) for r in stats.curve_windows(df, F.col("s"), {"early": (1, 5), "late": (5, 9), "none": (30, 40)}, "c", "v", "p", "q").collect()}
    assert got == {"early": (3.0, 1.0, 2.0), "late": (4.0, 4.0, 0.0)}


def test_six_adapters(spark):
    gpqa = readers.gpqa_pool(spark.createDataFrame([(1, "main", " q? ", " yes ", "no", "never", "maybe")], "pid int, subtask string, question string, right string, wrong1 string, wrong2 string, wrong3 string")).first()
    assert gpqa["pid"] == "gpqa/main/1" and gpqa["options"][ord(gpqa["answer"]) - 65] == "yes" and sorted(gpqa["options"]) == ["maybe", "never", "no", "yes"] and f"({gpqa['answer']}) yes" in gpqa["task"]
    musr = readers.musr_pool(spark.createDataFrame([(1, "m", "story", "who?", ["a", "b"], 1)], "pid int, subtask string, narrative string, question string, choices array<string>, answer_index int")).first()
    assert (musr["answer"], musr["task"]) == ("B", "story\n\nwho?\n(A) a\n(B) b")
    ifeval = readers.ifeval_pool(spark.createDataFrame([(1, "do")], "pid int, prompt string")).first()
    assert (ifeval["gradable"], ifeval["answer"], ifeval["options"]) == (False, "", [])
    assert readers.math_hard_pool(spark.createDataFrame([(1, "algebra", "p", "none")], "pid int, subtask string, problem string, solution string")).count() == 0


# --- shares of squared values ---------------------------------------------------------------


def test_variance_cutoff_cuts_groups_into_ranges(spark):
    r = random.Random(9)
    rows = [(r.choice(("hot", "hot", "hot", "a", None)), r.choice((None, 0.0, 3.0, -2.0, r.uniform(-5, 9)))) for _ in range(900)]
    rows += [("none", None), ("zero", 0.0), ("zero", 0.0), ("one", 4.0), ("nan", float("nan")), ("nan", 1.0)]
    for share in (0.5, 0.9, 0.99):
        got = stats.variance_cutoff(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", share).collect()
        want = {}
        for g in {x for x, _ in rows}:
            squares = [v * v for v in sorted((v for x, v in rows if x == g and v is not None), key=lambda v: (v == v, -v))]
            total = sum(squares)
            want[g] = 1 + sum(s < share * total for s in np.cumsum(squares)) if total > 0 else 1
        assert {x["g"]: x["k"] for x in got} == want and len(got) == len(want)
    whole = stats.variance_cutoff(spark.createDataFrame(rows[:900], "g string, v double"), [], "v", 0.9).collect()
    squares = [v * v for v in sorted((v for _, v in rows[:900] if v is not None), reverse=True)]
    assert [x["k"] for x in whole] == [1 + int((np.cumsum(squares) < 0.9 * sum(squares)).sum())]
    assert stats.variance_cutoff(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0
