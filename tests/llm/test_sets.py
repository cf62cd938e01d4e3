"""Sharding, mixing, near copies, leaks and the pipeline: brute force on small tables."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import rows_of, table
from tracewright.llm import decontamination, mixing, queries, sharding, simhash
from tracewright.llm.common import words_of

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCUMENTS)


# --- sharding -------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = spark.createDataFrame([(*((k // side**i) % side for i in range(n)),) for k in range(side**n)], ", ".join(f"a{i} int" for i in range(n)))
        rows = cells.withColumn("h", sharding.hilbert_index([F.col(f"a{i}") for i in range(n)], bits)).collect()
        path = [np.array(r[:n]) for r in sorted(rows, key=lambda r: r["h"])]
        assert sorted(r["h"] for r in rows) == list(range(side**n))
        assert all(np.abs(a - b).sum() == 1 for a, b in zip(path, path[1:]))


def test_shards(spark):
    rows = queries.queries()["op3_hilbert"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(24))
    sizes = [len(x) for x in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_shard_cases(spark):
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "x" * 40000, "de", None)]
    got = sharding.shard_documents(documents(spark, rows), shards=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert sharding.shard_documents(documents(spark, rows).limit(0)).count() == 0
    assert sharding.shard_documents(documents(spark, rows[:1])).first()["text_crc32"] == 0


def test_shard_cells_hold_like_shares(spark):
    random.seed(4)
    sources = [None] * 5 + ["hot"] * 60 + [f"s{random.randrange(300):03}" for _ in range(200)]
    rows = [(i, "x" * (i * i % 997), None, s) for i, s in enumerate(sources)]
    bounds = sharding.cell_bounds(sharding._measured(documents(spark, rows)), ("size", "source", "lang"))
    assert bounds["lang"] == []
    for name, values in (("source", [s for s in sources if s]), ("size", [f"{len(t) + 8:020}" for _, t, _, _ in rows])):
        expected = {}
        for v in sorted(set(values)):
            below = sum(x < v for x in values)
            expected[(2 * below + values.count(v)) * 16 // (2 * len(values))] = v
        assert bounds[name] == sorted(expected.items())


def test_written_shards_carry_whole_rows_and_their_ranges(spark, tmp_path):
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "x" * 40000, "de", None), (3, "y", "en", "t")]
    docs = documents(spark, rows).withColumn("shard", F.lit("mine")).withColumn("Curve", F.lit(7)).withColumn("_rows", F.lit(1))
    ranges = sharding.write_shards(docs, str(tmp_path / "out"), shards=2).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    for r in ranges:
        held = [x for x in back.collect() if x["shard_"] == r["shard"]]
        assert r["rows"] == len(held)
        ids = [x["doc_id"] for x in held if x["doc_id"] is not None]
        assert (r["min_doc_id"], r["max_doc_id"]) == (min(ids), max(ids))
        sizes = [len(x["text"] or "") + 8 for x in held]
        assert (r["min_size"], r["max_size"]) == (min(sizes), max(sizes))
    empty = sharding.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0


def test_filters_skip_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def read(dimensions):
        """Mean number of the 24 shards that a filter on one value, or one sixteenth of the range, must read."""
        rows = sharding.shard_documents(docs, dimensions=dimensions).collect()
        out = {}
        for name in ("source", "lang"):
            of = {}
            for r in rows:
                of.setdefault(r[name], set()).add(r["shard"])
            out[name] = np.mean([len(s) for s in of.values()])
        for name in ("size", "doc_id"):
            values = sorted(r[name] for r in rows)
            ends = {}
            for r in rows:
                low, high = ends.get(r["shard"], (r[name], r[name]))
                ends[r["shard"]] = min(low, r[name]), max(high, r[name])
            cuts = [values[k * (len(values) - 1) // 16] for k in range(17)]
            out[name] = np.mean([sum(low <= b and high >= a for low, high in ends.values()) for a, b in zip(cuts, cuts[1:])])
        return out

    four = read(sharding.DIMENSIONS)
    assert max(four.values()) <= 14, four
    two = read(("size", "source"))
    assert max(two["size"], two["source"]) <= 9, two


# --- mixing ---------------------------------------------------------------------------------


def test_mix_equals_its_sql(spark):
    df = queries.queries()["op7_mixing"](spark, SF)
    assert table(df.columns, df.collect()) == table(*rows_of(queries.oracle_sql()["op7_mixing"], SF))


def water_fill(sizes):
    total, weights = sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    held = set()
    while True:
        free = sum(w for i, w in enumerate(weights) if i not in held)
        level = (total - sum(3 * sizes[i] for i in held)) / free if free else 0
        over = {i for i in range(len(sizes)) if i not in held and weights[i] * level > 3 * sizes[i]}
        if not over:
            return [3 * s if i in held else weights[i] * level for i, s in enumerate(sizes)]
        held |= over


def test_water_filling(spark):
    rng = random.Random(4)
    for _ in range(3):
        sizes = [rng.choice([0, 1, 5, 100, 1000, 20000]) for _ in range(7)]
        df = spark.createDataFrame([(f"0s{i}", s) for i, s in enumerate(sizes)], "source_key string, source_size long")
        got = [r["target"] for r in mixing.source_targets(df).orderBy("source_key").collect()]
        assert got == pytest.approx(water_fill(sizes))


def test_equal_rows_are_repeated_each_on_its_own(spark):
    rows = [(7, "a b c", "en", "a")] * 50 + [(i, "a b c d", "en", "b") for i in range(100)] + [(None, "x y", "en", None)] * 20
    docs = documents(spark, rows).withColumn("_number", F.lit(1)).withColumn("_times", F.lit("clash"))
    size = words_of(F.col("text"))
    taken = {r["source_key"]: r["n"] for r in mixing.mix(docs, size).groupBy("source_key").agg(F.sum("copies").alias("n")).collect()}
    out = mixing.repeated(docs, size)
    assert out.columns == docs.columns
    got = {"1" if r["source"] is None else "0" + r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert got == taken
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.repeated(docs.repartition(3), size).collect()))


def test_mix_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", ("a", "b", None)[i % 3]) for i in range(300)] + [(None, None, None, "a"), (7, "", "en", "b"), (7, "", "en", "b")]
    docs = documents(spark, rows).withColumn("size", F.lit("clash"))
    mixed = mixing.mix(docs, words_of(F.col("text")))
    by = mixed.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(by) == 3 and all(abs(r["taken"] - r["target"]) <= 60 for r in by)
    assert mixed.filter("copies > 3").count() == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs, words_of(F.col("text"))).collect()))
    out = mixing.repeated(docs, words_of(F.col("text")))
    assert out.columns == docs.columns and out.count() >= mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0), words_of(F.col("text"))).count() == 0
    silent = mixing.mix(documents(spark, [(1, "", "en", "a")]), words_of(F.col("text"))).first()
    assert (silent["target"], silent["copies"]) == (0.0, 1)


# --- near copies ----------------------------------------------------------------------------


def print_by_hand(t):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in ([w[i : i + 4] for i in range(len(w) - 3)] if len(w) > 3 else [w] if w else [])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, radius):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    prints = [print_by_hand(t) for _, t in rows]
    want = {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, components_by_hand(prints, 4), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.queries()["op1_simhash"](spark, SF).collect()} == want


@pytest.mark.parametrize("tiles", [1, 5, 40])
def test_tiles_lose_no_link(spark, tiles):
    rng = random.Random(tiles)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    prints = list(dict.fromkeys(p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for p in base for _ in range(6)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(range(len(prints)), signed, strict=True)), "node long, print0 long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, tiles=tiles)).collect()}
    assert [roots.get(i, i) for i in range(len(prints))] == components_by_hand(prints, 4)


def test_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (200, 201)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 140), 100) | {200: 200, 201: 200}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_cases(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    docs = documents(spark, [(9, None, "en", "s"), (4, "", "en", "s"), (5, "A b", "en", "s"), (3, "a  B", "en", "s"), (8, long, "en", "s"), (7, long, "en", "s"), (None, long, "en", "s"), (5, "A b", "en", "s")])
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(docs.withColumn("print0", F.lit(1))).collect())
    assert got == [("3", 3), ("4", 4), ("5", 3), ("5", 3), ("7", 7), ("8", 7), ("9", 4), ("None", 7)]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "7"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    rows = []
    for g in range(30):
        w = [f"t{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((10 * g, " ".join(w)))
        copy = list(w)
        for k in rng.sample(range(300), 4):
            copy[k] = "edit"
        rows.append((10 * g + 1, " ".join(copy)))
        half = w[:150] + [f"u{rng.randrange(10**6)}" for _ in range(150)]
        rows.append((10 * g + 2, " ".join(half)))
    kept = {r["doc_id"] for r in simhash.one_of_each(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert kept == {i for i, _ in rows if i % 10 != 1}


def similar_by_hand(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in range(len(sets)) if root(i) == i}


def test_copies_are_decided_at_the_threshold(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    texts = []
    for own in (18, 19, 20, 21, 22, 30, 40):  # sets of 160 + own shingles, 160 in common: 0.8 at 20
        for _ in range(6):
            shared = fresh(164)
            texts += [" ".join(shared + fresh(own)), " ".join(shared + fresh(own))]
    for n in (5, 6, 7, 8, 9, 10, 14, 20):  # one word more
        for _ in range(6):
            w = fresh(n)
            texts += [" ".join(w), " ".join(w + fresh(1))]
    banner = fresh(12)  # common shingles: in every text of a group
    texts += [" ".join(banner + fresh(k % 4)) for k in range(40)] + [" ".join(fresh(3000) + banner) for _ in range(10)]
    want = similar_by_hand(texts)
    got = {r["doc_id"] for r in simhash.one_of_each(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == want and 0 < len(want) < len(texts)


def test_planted_pairs_are_found(spark):
    """Recall at the stated threshold and above, for long and short texts, of pairs that share so many of their shingles."""
    rng = random.Random(21)
    fresh = lambda n: [f"p{rng.randrange(10**7)}" for _ in range(n)]
    texts, pairs = [], {}
    for share in (0.80, 0.85, 0.90):
        for n in (16, 60, 300):
            for _ in range(25):
                own = round(n * (1 - share) / (2 * share))  # shingles of each side alone
                own = own - (n / (n + 2 * own) < share)
                shared = fresh(n + 4)
                pairs.setdefault(share, []).append((len(texts), len(texts) + 1))
                texts += [" ".join(shared + fresh(own)), " ".join(shared + fresh(own))]
    kept = {r["doc_id"] for r in simhash.one_of_each(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for share, some in pairs.items():
        assert all(a in kept for a, _ in some)
        assert sum(b not in kept for _, b in some) / len(some) >= 0.99


def test_a_large_group_makes_no_square(spark, monkeypatch):
    """Near copies of one text: each is verified a few times, not with every other."""
    rng = random.Random(23)
    base = [f"g{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(400), 3):
            w[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    made, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, sets: made.append(pairs.count()) or similar(pairs, sets))
    assert [r["doc_id"] for r in simhash.one_of_each(documents(spark, rows)).collect()] == [0]
    assert sum(made) <= 3 * len(rows)


def test_only_nodes_and_trees_leave_the_tiles(spark):
    """Of 300 texts that are all similar: rows with candidates as nodes and tile pairs, links as nodes, however many pairs there are."""
    rng = random.Random(29)
    base = [f"g{k}" for k in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(w)))
    texts = spark.createDataFrame(rows, "row long, text string")
    nodes = simhash.sketches(texts).withColumnRenamed("row", "node")
    met = simhash.with_candidates(nodes)
    tiles = met.select("a", "b").distinct().count()
    assert 300 <= met.count() <= 300 * 2 * tiles and met.select("node").distinct().count() == 300
    sets = simhash.sets_of(texts, texts.select("row")).withColumnRenamed("row", "node")
    links = simhash.verified_links(met.join(sets, "node"))
    assert 299 <= links.count() <= met.count() and simhash.components(links).select("root").distinct().count() == 1
    assert {r["class"] for r in simhash.copies(texts).collect()} == {0}


def test_texts_that_are_close_and_not_similar_stay_apart(spark):
    """A chain of texts, each near enough to the next, and a group whose fingerprints are close and whose sets are just below 0.8."""
    rng = random.Random(31)
    fresh = lambda n: [f"q{rng.randrange(10**7)}" for _ in range(n)]
    texts, w = [], fresh(300)
    for k in range(12):
        texts.append(" ".join(w))
        w = w[8:] + fresh(8)
    head = fresh(90)
    texts += [" ".join(head + fresh(14)) for _ in range(30)]
    want = similar_by_hand(texts)
    got = {r["doc_id"] for r in simhash.one_of_each(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == want and 0 in got and len(got & set(range(12))) == 1 and len(got) > 25


def test_no_row_is_repeated_beyond_the_cap(spark):
    rows = [(i, "" if i % 2 else "a", "en", "small") for i in range(10)] + [(100 + i, "w " * 500, "en", "z") for i in range(20)]
    mixed = mixing.mix(documents(spark, rows), words_of(F.col("text")))
    small = mixed.filter("source_key = '0small'").collect()
    assert {r["copies"] for r in small} == {3} and all(r["target"] == 3 * r["source_size"] for r in small)


def test_what_another_query_staged_stays(spark, tmp_path):
    import corpus_pipeline
    from tracewright.llm.common import run_folders, stage

    with run_folders() as outer:
        other = stage(spark.range(5), "other")
        with run_folders() as own:
            stage(spark.range(3), "inner")
        assert len(own) == 1
    assert outer[1:] == own
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(60).write.parquet(str(tmp_path / f"{name}.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert other.count() == 5


# --- leaks ----------------------------------------------------------------------------------


def test_items_too_short_to_be_found_are_named(spark):
    items = spark.createDataFrame([(1, "the cat sat"), (2, "one two three four five"), (3, None), (None, "x")], "item_id long, text string")
    assert sorted((r["item_id"], r["words"]) for r in decontamination.unsearchable(items).collect()) == [(1, 3), (3, 0)]


def test_leaks_equal_brute_force(spark):
    got = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op4_decontamination"](spark, SF).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        seq = decontamination.words(r["text"])
        for item, t in items:
            parts = decontamination.question_answer(t)
            if all(decontamination.contained(p, seq) >= 0.8 for p in parts):
                want.add((r["doc_id"], item))
    assert want and got == want


def test_wand_equals_exhaustive_scores():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)] + ["the"] * 20 + ["of"] * 10
    index = decontamination.Index([(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 25)))) for i in range(50)], threshold=0.4, block=4)
    for _ in range(40):
        terms = {index.terms[w] for w in (rng.choice(vocabulary) for _ in range(30)) if w in index.terms}
        score = np.zeros(50)
        for k in terms:
            for item, s in index.postings[k]:
                score[item] += s
        got = {i: s for b in range(index.n_blocks) for i, s in index.retrieve(terms, b)}
        assert got == pytest.approx({i: s for i, s in enumerate(score) if s >= 0.4})


def test_shallow_pass_keeps_every_block():
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(80)] + ["the"] * 30
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(40)]
    index = decontamination.Index(items, block=4)
    texts = [" ".join([*(rng.choice(vocabulary) for _ in range(50)), t, *(rng.choice(vocabulary) for _ in range(50))]) for _, t in items]
    for (i, _), found in zip(items, index.leaks(texts), strict=True):
        assert i in {x["item_id"] for x in found}


def test_leak_cases(spark):
    rng = random.Random(8)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(20)) + ". " + " ".join(f"a{k}" for k in range(7)) + "."
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (None, item), (4, "")], "item_id long, text string")
    filler = " ".join(f"z{k}" for k in range(3000))
    docs = documents(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (3, item.upper(), "en", "s"), (3, item.upper(), "en", "s"), (4, filler + " " + item + " " + filler, "en", "s"), (None, item, "en", "s"), (5, item.split(". ")[0], "en", "s"), (6, filler, "en", "s")])
    docs = docs.withColumn("leaks", F.lit("clash"))
    found = decontamination.annotate(docs, bench, "found").select("doc_id", F.explode("found.item_id").alias("i")).collect()
    assert sorted((str(r["doc_id"]), r["i"]) for r in found) == sorted([(k, i) for k in ("3", "3", "4", "None") for i in (1, 2)])
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6]
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    items = [(i, " ".join(f"x{i}y{k}" for k in range(12))) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(i, f"before {t} behind", "en", "s") for i, t in items])
    found = decontamination.annotate(docs, bench, "found").select("doc_id", F.explode("found.item_id").alias("i")).collect()
    assert sorted((r["doc_id"], r["i"]) for r in found) == [(i, i) for i in range(12)]


def test_passes_score_as_one_index(spark, monkeypatch):
    """Items that share words, in one index and in many: the same leaks with the same scores."""
    rng = random.Random(5)
    pool = [f"v{k}" for k in range(200)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(6, 30)))) for i in range(60)] + [(60, "yes"), (61, "yes no yes no")]
    docs = documents(spark, [(i, " ".join([*(rng.choice(pool) for _ in range(80)), items[i][1], *(rng.choice(pool) for _ in range(80)), "yes no yes no yes"]), "en", "s") for i in range(60)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for limit in (1 << 20, 500):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", limit)
        rows = decontamination.annotate(docs, bench, "found").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*").collect()
        found.append({(r["doc_id"], r["item_id"]): (round(r["score"], 9), *tuple(r)[3:]) for r in rows})
    assert found[0] == found[1] and {(i, i) for i in range(60)} <= set(found[0]) and not {60, 61} & {i for _, i in found[0]}


def test_small_batches_find_the_same(monkeypatch):
    rng = random.Random(10)
    pool = [f"v{k}" for k in range(100)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(12))) for i in range(50)]
    texts = [" ".join([*(rng.choice(pool) for _ in range(90)), t]) for _, t in items] + ["", None]
    index = decontamination.Index(items, block=2)
    want = index.leaks(texts)
    for rows, cells in ((1, 1), (30, 60), (200, 10_000)):
        monkeypatch.setattr(decontamination, "ROWS", rows)
        monkeypatch.setattr(decontamination, "CELLS", cells)
        assert index.leaks(texts) == want


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    from tracewright.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, SF), "test")
        seen[name] = docs
        if name != names[-1]:
            assert docs.columns == before.columns
    keys = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in seen.items()}
    assert keys["quality"] >= keys["near_duplicates"] >= keys["decontamination"] >= keys["mixing"] == keys["token_records"]
    assert seen["token_records"].count() == seen["mixing"].count() > 0
    total = seen["token_records"].agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert total[0] == total[1]


def test_release(spark, tmp_path, monkeypatch):
    from tracewright.llm import common

    monkeypatch.setattr(common, "_MADE", [])
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    common.stage(spark.range(5), "x")
    assert len(list(tmp_path.iterdir())) == 1 and common.release(spark) == 1 and not list(tmp_path.iterdir())


def pipeline_by_hand(spark, rows, labels, items):
    """(doc_id, ids' checksum) of every record, a stage at a time on plain lists; rows: (doc_id, text, source)."""
    import hashlib

    from tokenizers import Tokenizer

    from tracewright.llm import quality, token_records

    docs = documents(spark, [(i, t, "en", s) for i, t, s in rows])
    field = quality.learn(docs, labels)
    rows = [r for r in rows if field.score([r[1]])[0] >= quality.THRESHOLD]
    # of each group of near copies the least id, a null one last
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    rows = [rows[order[k]] for k in sorted(similar_by_hand([rows[k][1] or "" for k in order]))]
    leaked = lambda t: any(len(decontamination.words(x)) >= 5 and all(decontamination.contained(p, decontamination.words(t)) >= 0.8 for p in decontamination.question_answer(x)) for x in items)
    rows = [r for r in rows if not leaked(r[1])]
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    targets = water_fill([sum(size(t) for _, t, s in rows if s == name) for name in sources])
    plain, out = Tokenizer.from_file(token_records.default_tokenizer()), []
    for name, target in zip(sources, targets, strict=True):
        own = [r for r in rows if r[2] == name]
        own.sort(key=lambda r: (hashlib.md5(f"mix-17|{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r[1])))
        whole = sum(size(t) for _, t, _ in own)
        times, before = int(target // whole) if whole else 0, 0
        for i, t, _ in own:
            copies = times + (times < 3 and before + size(t) / 2 <= target - times * whole)
            before += size(t)
            ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            out += [(str(i), zlib.crc32(ids.tobytes()))] * copies
    return sorted(out)


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    """Hand-made rows beside real ones: nulls, repeats, exact and near copies, a leak, a very long text, columns of clashing names."""
    import corpus_pipeline

    real = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70).collect()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    longest = max(real, key=lambda r: len(r["text"]))["text"]
    base = next(r["text"] for r in real if 400 < len(r["text"]) < 2000)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in real]
    rows += [(None, None, None), (900, None, "src1"), (901, "", "src1"), (901, "", "src1"), (902, base, "src2"), (None, base, "src2"), (903, base + " tail", None)]
    rows += [(904, base[:200] + " " + items[0] + " " + base[200:], "src3"), (905, " ".join(w[::-1] for w in longest.split()[:3000]), "src4"), (906, longest * 40, "src5")]
    docs = documents(spark, [(i, t, "en", s) for i, t, s in rows])
    names = {"leaks": "x", "quality": 2, "row": 5, "_spot": 1, "copies": "y"}
    docs.withColumns({k: F.lit(v) for k, v in names.items()}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == pipeline_by_hand(spark, rows, labels, items)
    assert sorted(r["start"] for r in got)[0] == 0 and len(got) > 20
    assert not {"904", "None"} <= {str(r["doc_id"]) for r in got}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
