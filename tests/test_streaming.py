import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tracewright.sources import readers
from tracewright.streaming import metrics, tail, tracker

POINTS = "step bigint, metrics map<string,double>"


def followed(spark, tmp_path, split=None):
    """Lines that one run of a stream reads, and those of all runs."""
    out, state, logs = (str(tmp_path / x) for x in ("out", "state", "logs"))

    def run():
        before = len(rows()) if (tmp_path / "out").exists() else 0
        stream = metrics.tailed(spark, logs, split).writeStream.format("json").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
        stream.start().awaitTermination()
        return len(rows()) - before

    def rows():
        return sorted((r["file"].rsplit("/", 1)[1], r["at"], r["value"]) for r in spark.read.schema("file string, at long, value string").json(out).collect())

    return run, rows


@pytest.mark.parametrize("split", [None, 7])
def test_a_growing_log_is_read_once(spark, tmp_path, split):
    run, rows = followed(spark, tmp_path, split)
    logs = tmp_path / "logs"
    logs.mkdir()
    assert run() == 0
    (logs / "a.txt").write_bytes(b"one\n\nthree is long enough for ranges\nto")
    (logs / "_skipped").write_bytes(b"no log\n")
    (logs / "b.txt").write_bytes(b"no end yet")
    assert run() == 3
    assert run() == 0
    with (logs / "a.txt").open("ab") as f:
        f.write(b"rn\r\n\xff\n")
    with (logs / "b.txt").open("ab") as f:
        f.write(b"\nnext\nheld")
    assert run() == 4
    assert rows() == [
        ("a.txt", 0, "one"), ("a.txt", 4, ""), ("a.txt", 5, "three is long enough for ranges"), ("a.txt", 37, "torn"), ("a.txt", 43, "�"),
        ("b.txt", 0, "no end yet"), ("b.txt", 11, "next"),
    ]
    (logs / "b.txt").write_bytes(b"anew\n")  # shorter than before
    (logs / "a.txt").rename(tmp_path / "gone")
    assert run() == 1
    (tmp_path / "gone").rename(logs / "a.txt")
    assert run() == 0


def test_ranges_have_each_line_once(tmp_path):
    r = random.Random(1)
    for k in range(30):
        data = b"".join(bytes(r.choice(b"xyz") for _ in range(r.choice((0, 0, 1, 5, 40)))) + b"\n" for _ in range(r.randint(1, 60)))
        path = tmp_path / f"{k}.log"
        path.write_bytes(data + b"torn")
        reader = tail.TailReader(str(path), split=r.choice((1, 3, 10, 1000)))
        end = reader.latestOffset()
        assert list(end.values()) == [len(data)]
        begin = r.choice([0, *[i + 1 for i, c in enumerate(data) if c == 10]])
        got = [(a, v) for p in reader.partitions({str(path): begin}, end) for b in reader.read(p) for a, v in zip(b["at"].to_pylist(), b["value"].to_pylist())]
        at, want = begin, []
        for line in data[begin:].split(b"\n")[:-1]:
            want.append((at, line.decode()))
            at += len(line) + 1
        assert got == want


def test_long_lines_are_searched_in_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 16)
    path = tmp_path / "a.log"
    path.write_bytes(b"x" * 100 + b"\n" + b"y" * 50 + b"\n" + b"z" * 70)
    reader = tail.TailReader(str(path), split=20)
    end = reader.latestOffset()
    assert list(end.values()) == [152]
    assert [(v[0], len(v)) for p in reader.partitions({}, end) for b in reader.read(p) for v in b["value"].to_pylist()] == [("x", 100), ("y", 50)]
    assert tail.TailReader(str(tmp_path / "none")).latestOffset() == {}


def test_the_first_record_of_a_step_stays(spark, tmp_path):
    logs, out, state = (str(tmp_path / x) for x in ("logs", "out", "state"))
    (tmp_path / "logs").mkdir()
    r = random.Random(7)
    lines = [(step, 1000 * step + k) for step in range(40) for k in range(3)]
    r.shuffle(lines)
    first = {}
    for name in "ab":  # by file, then place in it
        some = lines[:60] if name == "a" else lines[60:]
        (tmp_path / "logs" / f"{name}.log").write_text("".join(f"step:{s} - x:{v}\n" for s, v in some))
        for s, v in some:
            first.setdefault(s, v)

    def run():
        metrics.write_metrics(metrics.metric_stream(spark, logs), out, state).awaitTermination()
        return sorted((x["step"], x["metrics"]["x"]) for x in readers.jsonl(spark, out, POINTS).collect())

    assert run() == sorted((s, float(v)) for s, v in first.items())
    with (tmp_path / "logs" / "a.log").open("a") as f:
        f.write("step:3 - x:9\nstep:77 - x:1 - y:2\nstep:77 - x:5\n")
    assert run() == sorted([*[(s, float(v)) for s, v in first.items()], (77, 1.0)])
    whole = next(x["metrics"] for x in readers.jsonl(spark, out, POINTS).collect() if x["step"] == 77)
    assert whole == {"x": 1.0, "y": 2.0}


def test_first_records_need_no_python_and_no_memory(spark, tmp_path):
    before = spark.conf.get(metrics.STATE_STORE)
    stream = metrics.metric_stream(spark, str(tmp_path / "logs"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Aggregate" in plan
    (tmp_path / "logs" / "a.log").write_text("".join(f"step:{k % 700} - x:{k}\n" for k in range(1400)))
    query = metrics.write_metrics(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    state = next(p.stateOperators[0] for p in query.recentProgress if p.stateOperators and p.stateOperators[0].numRowsUpdated)
    assert state.numRowsTotal == 700 and any(name.startswith("rocksdb") for name in state.customMetrics)
    assert sorted((r["step"], r["metrics"]["x"]) for r in readers.jsonl(spark, str(tmp_path / "out"), POINTS).collect()) == [(k, float(k)) for k in range(700)]
    assert spark.conf.get(metrics.STATE_STORE) == before


def test_merged_records_keep_the_first_of_each_metric(spark):
    rows = spark.createDataFrame([(1, 2, {"a": 2.0, "b": 5.0}), (1, 1, {"a": 1.0}), (2, 3, {"a": 3.0})], "step int, at int, metrics map<string,double>")
    assert {r["step"]: r["metrics"] for r in metrics.merged_by_step(rows, ["at"]).collect()} == {1: {"a": 1.0, "b": 5.0}, 2: {"a": 3.0}}


# --- trackers beside the sink ---------------------------------------------------------------


class Kept:
    def __init__(self):
        self.got, self.closed = [], False

    def log(self, point, step):
        if step == 13:
            raise ValueError(step)
        self.got.append((step, point))

    def finish(self):
        self.closed = True


def test_a_tracker_gets_points_in_order_and_closes():
    kept = Kept()
    t = tracker.Tracker(lambda: kept)
    assert t.offer([(k, {"a": 1.0}) for k in range(20)]) == 20
    assert t.finish() and kept.closed and [s for s, _ in kept.got] == [k for k in range(20) if k != 13]
    assert t.counts() == {"sent": 19, "failed": 1, "dropped": 0, "waiting": 0}


def test_a_full_queue_drops_and_counts():
    import threading

    gate = threading.Event()

    class Slow(Kept):
        def log(self, point, step):
            gate.wait(20)
            super().log(point, step)

    slow = Slow()
    t = tracker.Tracker(lambda: slow, capacity=3)
    began = time.monotonic()
    taken = sum(t.offer([(100 + k, {})]) for k in range(50))
    assert time.monotonic() - began < 2 and 3 <= taken <= 4 and t.dropped == 50 - taken
    gate.set()
    assert t.finish() and t.sent == taken and t.sent + t.failed + t.dropped == 50


@pytest.mark.parametrize("fails", [True, False])
def test_a_tracker_that_does_not_open_costs_the_sink_nothing(spark, tmp_path, fails):
    def opens():
        if fails:
            raise OSError("none")
        time.sleep(600)

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("".join(f"step:{k} - a:{k}\n" for k in range(100)))
    began = time.monotonic()
    t = tracker.Tracker(opens, start_seconds=0.2)
    assert time.monotonic() - began < 0.2
    time.sleep(0.5)
    tracker.write_tracked(metrics.metric_stream(spark, str(logs)), str(tmp_path / "out"), str(tmp_path / "state"), t).awaitTermination()
    assert spark.read.schema(POINTS).json(str(tmp_path / "out")).count() == 100
    assert t.counts() == {"sent": 0, "failed": 0, "dropped": 100, "waiting": 0}


def test_points_beyond_the_room_are_not_fetched(spark, tmp_path):
    import threading

    gate = threading.Event()

    class Slow(Kept):
        def log(self, point, step):
            gate.wait(60)
            super().log(point, step)

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("".join(f"step:{100 + k} - a:{k}\n" for k in range(40)))
    slow = Slow()
    t = tracker.Tracker(lambda: slow, capacity=5)
    tracker.write_tracked(metrics.metric_stream(spark, str(logs)), str(tmp_path / "out"), str(tmp_path / "state"), t).awaitTermination()
    gate.set()
    assert t.finish() and t.sent == 5 and t.dropped == 35
    assert [s for s, _ in slow.got] == [100, 101, 102, 103, 104]
    assert len({json.loads(line)["step"] for p in (tmp_path / "out").rglob("*.json") for line in p.read_text().splitlines()}) == 40


class Brief:
    def log(self, point, step):
        time.sleep(0.001)
        if step % 10 == 3:
            raise ValueError(step)


def test_trackers_by_task_get_all_points_through_little_room(spark, tmp_path):
    logs, out, state, counts = (str(tmp_path / x) for x in ("logs", "out", "state", "counts"))

    def run(stream):
        tracker.write_tracked_by_task(stream, out, state, counts, Brief, capacity=3, patience=60.0, finish_seconds=60.0).awaitTermination()
        return tuple(spark.read.schema(tracker.COUNTS).parquet(counts).agg(*[F.sum(c) for c in ("sent", "failed", "dropped", "waiting")]).first())

    (tmp_path / "logs").mkdir()
    for name in "ab":
        (tmp_path / "logs" / f"{name}.log").write_text("".join(f"step:{k} - x:{name == 'b':d}\n" for k in range(200)))
    assert run(metrics.metric_stream(spark, logs, first_only=False)) == (360, 40, 0, 0)
    (tmp_path / "logs" / "c.log").write_text("step:3 - x:1\nstep:4 - x:1\n")
    assert run(metrics.metric_stream(spark, logs, first_only=False)) == (361, 41, 0, 0)


def test_patience_ends():
    class Slow(Kept):
        def log(self, point, step):
            time.sleep(60)

    t = tracker.Tracker(Slow, capacity=2)
    began = time.monotonic()
    assert t.offer([(k, {}) for k in range(50)], patience=0.5) <= 3 and time.monotonic() - began < 5
    hanging = tracker.Tracker(lambda: time.sleep(600), start_seconds=0.3, capacity=2)
    hanging.offer([(k, {}) for k in range(50)], patience=60)
    assert time.monotonic() - began < 10 and hanging.counts() == {"sent": 0, "failed": 0, "dropped": 50, "waiting": 0}
