import datetime

import pytest
from pyspark.sql import functions as F

from tracewright.operators import gates, reports
from tracewright.sources import sinks


def test_chunks_go_on_where_a_run_broke_off(spark, tmp_path):
    plan, out = spark.range(10).withColumn("chunk", F.expr("id div 4")), str(tmp_path / "out")

    def breaks(rows):
        if rows.first()["chunk"] == 1:
            raise RuntimeError("lost")
        return rows

    with pytest.raises(RuntimeError):
        sinks.commit_chunks(plan, out, breaks)
    (tmp_path / "out" / "chunk=2").mkdir()  # begun, not whole
    assert sinks.commit_chunks(plan, out, lambda rows: rows) == [1, 2]
    assert sinks.commit_chunks(plan, out, lambda rows: rows) == []
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(10))


def test_states_of_runs(spark):
    at = datetime.datetime(2024, 1, 1, 12)
    old = at - datetime.timedelta(minutes=90)
    rows = [
        ("end", old, "Final validation metrics: {}"), ("val", old, "step:250 - a:1 - val/test_score/x:0.5"), ("step", old, "step:249 - global_seqlen/mean:3"),
        ("early", old, "step:248 - global_seqlen/mean:3"), ("short", old, "step:249 - a:1 - val/test_score/x:0.5"), ("live", at, "step:3 - global_seqlen/mean:3"),
        ("live", old, None), ("none", None, None),
    ]
    lines = spark.createDataFrame(rows, "run string, ts timestamp, line string")
    got = {r["run"]: r["state"] for r in reports.run_states(lines, "run", "ts", "line", F.lit(at)).collect()}
    assert got == {"end": "done", "val": "done", "step": "done", "early": "stalled", "short": "stalled", "live": "running", "none": "stalled"}


def test_slices_share_no_key(spark):
    assert gates.disjoint(spark.range(3), spark.range(3, 5), ["id"]) == 5
    with pytest.raises(gates.GateError, match="1 keys"):
        gates.disjoint(spark.range(4), spark.range(3, 5), ["id"])


def test_report_cases(spark):
    one = spark.createDataFrame([("a", 1.0, None), (None, None, "x")], "k string, v double, w string")
    lines = [r["line"] for r in reports.report_lines(one, [("k", 3, None), ("v", 6, "%.2f"), ("w", 2, None)]).collect()]
    assert lines == ["a    1.00- ", "-       -x "]
    bounds = spark.createDataFrame([([0, 2, 5],), ([7],), ([],)], "b array<int>")
    assert [[tuple(x) for x in r["i"]] for r in bounds.select(reports.intervals(F.col("b")).alias("i")).collect()] == [[(0, 2), (2, 5)], [], []]
    bins = spark.createDataFrame([("early", 0.0, 2.0), ("late", 1.0, 3.0)], "bin string, a double, b double")
    assert sorted(tuple(r) for r in reports.change_of_bins(bins, ["a", "b"]).collect()) == [("a", 0.0, 1.0, 1.0, None), ("b", 2.0, 3.0, 1.0, 0.5)]
    scored = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.9), (4, None)], "k int, s double")
    assert [(r["k"], r["role"]) for r in reports.anchor_and_top(scored, "k", "s", 2, 2).collect()] == [(2, "anchor"), (1, "candidate"), (3, "candidate")]
    cells = spark.createDataFrame([("x", True, None), ("x", None, True)], "arm string, p boolean, f boolean")
    assert {r["gate"]: (r["passed"], r["value"]) for r in gates.rates(cells, "arm", {"parse": F.col("p"), "format": F.col("f")}).collect()} == {"parse:x": (False, 0.5), "format:x": (False, 0.5)}
    shifts = spark.createDataFrame([(1, -3.0), (2, 2.0), (3, 3.0), (4, 0.1)], "layer int, v double")
    assert [(r["layer"], r["place"]) for r in reports.largest_shifts(shifts, "layer", "v", 3).orderBy("place").collect()] == [(1, 1), (3, 2), (2, 3)]
