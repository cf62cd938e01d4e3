"""Jaccard join, alignment and filter audit: brute force on small tables."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_sets import documents
from tests.oracle import rows_of, table
from tracewright.llm import alignment, filter_audit, jaccard, queries

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


# --- Jaccard join ---------------------------------------------------------------------------


def shingles(text):
    words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def joined(rows):
    """doc_id: (size, component, links), by all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    names = {x: min((rows[k][0] for k in range(len(rows)) if label[k] == x and rows[k][0] is not None), default=None) for x in set(label)}
    return sorted(((rows[k][0], len(sets[k]), names[label[k]], links[k]) for k in range(len(rows))), key=str)


def near_texts(seed=5):
    """Texts of many sizes with chains of edits around the threshold, so that links, misses and indirect links occur."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    texts = []
    for size in (1, 2, 3, 4, 5, 6, 9, 14, 30, 47, 48, 90, 133, 200, 400, 900):
        words = [word() for _ in range(size)]
        for _ in range(6):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, size // r.choice((40, 60, 200)))):
                words[r.randrange(size)] = word()
            if r.random() < 0.3:
                words = words[: max(1, int(size * r.choice((0.84, 0.86, 0.9))))]
                words += [word() for _ in range(size - len(words)) if r.random() < 0.1]
            size = len(words)
    texts += [texts[40]] * 3 + ["  " + texts[50].upper().replace(" ", "\t\n")] + [None, "", " \n", "é", "É", "A b C d", "a B c D e"]
    return texts


@pytest.mark.parametrize("tiles", [1, 5, 40])
def test_jaccard_equals_brute_force(spark, tiles):
    rows = [(7 * i % 211 - 3, t) for i, t in enumerate(near_texts())]
    rows += [(None, rows[60][1]), (None, "none has an id"), (rows[3][0], rows[3][1]), (None, None)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows]).withColumn("n", F.lit("x")).withColumn("node", F.lit(1)).withColumn("bits", F.lit(None).cast("string"))
    got = jaccard.jaccard_classes(docs, tiles=tiles)
    want = joined(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len({c for _, n, c, k in want if k}) >= 10 and any(k == 0 and n > 9 for _, n, _, k in want)


def test_jaccard_of_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert sorted((tuple(x) for x in jaccard.jaccard_classes(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()), key=str) == joined(rows)


def test_no_tables_or_words(spark):
    docs = documents(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (None, " ", "en", "s")])
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0
    assert sorted((tuple(r) for r in jaccard.jaccard_classes(docs).collect()), key=str) == [(1, 0, 1, 0), (2, 0, 2, 0), (None, 0, None, 0)]


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(8)
    sets = []
    for n in (1, 2, 3, 7, 64, 127, 128, 129, 200, 256, 300, 1000, 1100, 5000, 70_000):
        base = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for part in (1.0, 0.93, 0.86, 0.5):
            kept = base[: max(1, int(n * part))]
            sets.append(np.unique(np.concatenate([kept, r.integers(0, 1 << 63, int(n * 0.05), dtype=np.uint64)])))
    n = np.array([len(x) for x in sets])
    maps = [jaccard.bitmap(x).tobytes() for x in sets]
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 85 * (n[i] + n[j] - both):
                want.add((j, i))
    for side in (None, np.arange(len(sets)) % 2):
        got = [tuple(sorted(x)) for p, q in jaccard.candidates(n, maps, side, rows=5, columns=7) for x in zip(p.tolist(), q.tolist(), strict=True)]
        assert len(got) == len(set(got))
        assert {x for x in want if side is None or side[x[0]] != side[x[1]]} <= set(got)
        assert side is not None or len(got) < len(want) + 60


def test_tiles_that_may_hold_links_meet():
    cells = [(n, 3 + n % 5, n * (3 + n % 5), n, n) for n in range(1, 200)]
    plan, spans = jaccard.plan_tiles(cells, tiles=50)
    at = {}
    for cell, first, cut in plan:
        for t in range(first, first + cut):
            at.setdefault(t, []).append(cell)
    assert sorted(at) == list(range(len(spans)))
    for i in at:
        for j in range(i, len(spans)):
            if any(85 * q <= 100 * p for p in at[i] for q in at[j]):
                assert spans[i][2] >= j and spans[j][1] <= i


# --- alignment ------------------------------------------------------------------------------


def token_bytes():
    import re

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.default_tokenizer())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    table = alignment.byte_level()
    plain = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    first = lambda t: [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
    second = lambda t: [(i, plain(b.id_to_piece(i))) for i in b.encode(t)]
    return first, second


def aligned(texts):
    """By definition, token by token."""
    first, second = token_bytes()
    out, every = [], {}
    for t in texts:
        a, b = (first(t), second(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            out.append(None)
            continue
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, x in tokens:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for _, e, i in side if low < e <= cut) for side in spans))
            low = cut
        for x in links:
            every[x] = every.get(x, 0) + 1
        out.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in every.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None else
        (r[0], r[1], len(r[2]), len(r[3]), sum(every[x] == best[x[1]] for x in r[3]), sum(every[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())
        for r in out
    ]


def odd_texts():
    r = random.Random(11)
    made = ["".join(r.choice(["a", "e", " ", "  ", "\n", "the", " of", "É", "ß", "漢字", "1", "12", ".", "'s", "\t", "\r", "\xa0", "🙂", "_", "<", "Token"]) for _ in range(r.randint(1, 60))) for _ in range(120)]
    fixed = [None, "", " ", "\n", "  two  blanks ", "▁ in a text", "a▁b", "nul\x00nul", "<s> </s> <unk> <|endoftext|> <0x41>", "ﬁne Å", "é", "antidisestablishmentarianism", " lead", "trail ", "a\n\nb", "same", "same"]
    return made + fixed


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_alignment_equals_definition(spark, monkeypatch, block):
    texts = odd_texts()
    docs = documents(spark, [(i if i % 9 else None, t, "en", "s") for i, t in enumerate(texts)]).withColumn("block", F.lit("x")).withColumn("keys", F.lit(1))
    monkeypatch.setattr(alignment, "BLOCK", block)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = alignment.aligned_documents(docs.repartition(3), alignment.default_tokenizer(), alignment.default_pieces())
    got = sorted((str(r["doc_id"]), *[r[c] for c in columns]) for r in found.collect())
    assert got == sorted((str(i if i % 9 else None), *x) for i, x in enumerate(aligned(texts)))


def test_long_texts_are_aligned_in_pieces(monkeypatch):
    r = random.Random(2)
    text = " " + " ".join("".join(r.choice("abcdefgh é.") for _ in range(r.randint(1, 9))) for _ in range(4000))
    both = alignment.Aligner(alignment.default_tokenizer(), alignment.default_pieces())
    whole = both.block([text.encode()])
    monkeypatch.setattr(alignment, "PIECE", 3000)
    pieces = alignment.sure_cuts(text.encode(), 3000)
    assert len(pieces) > 5 and b"".join(pieces) == text.encode()
    parted = both.block([text.encode()])
    assert {k: list(v) for k, v in whole.items()} == {k: list(v) for k, v in parted.items()}
    assert both.block([(text + "▁").encode()])["n_a"].tolist() == [0]


def test_both_encoders_equal_the_tokenizers():
    first, second = token_bytes()
    both = alignment.Aligner(alignment.default_tokenizer(), alignment.default_pieces())
    texts = [" " + t for t in odd_texts() if t]
    for side, want in ((0, [[i for i, _ in first(t[1:])] for t in texts]), (1, [[i for i, _ in second(t[1:])] for t in texts])):
        import pyarrow as pa

        ids, sizes = both.sides[side].encode(pa.array(texts))
        ends = np.cumsum(sizes)
        # U+2581 is a space to the second, so texts with it differ in bytes, not in ids
        assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == want


def test_alignment_of_nothing(spark):
    empty = documents(spark, [(1, None, "en", "s"), (2, "", "en", "s")])
    run = lambda d: alignment.aligned_documents(d, alignment.default_tokenizer(), alignment.default_pieces())
    assert run(empty.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in run(empty).filter("n_a + n_b + n_groups + n_links + n_best + count_sum = 0 AND groups_sha256 = ''").collect()) == [1, 2]


# --- filter audit ---------------------------------------------------------------------------


def audited(rows, labels):
    """By definition, every order applied to every part."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    marks = set("#$%&*|")
    facts = []
    for i, text, part in rows:
        t = text or ""
        w = split(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(marks & set(t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        facts.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own, removed = [f for f in facts if f[0] == part], {}
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                removed[x] = removed.get(x, 0) + len(gone)
                fails = sum(f[1][x] for f in own)
                only = sum(f[1][x] and sum(f[1].values()) == 1 for f in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), fails - len(gone), only, sum(f[2] for f in gone), sum(f[3] for f in gone), x]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = removed[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order(spark):
    r = random.Random(4)
    rows = []
    for i in range(160):
        n = r.choice((0, 3, 49, 50, 51, 80))
        text = " ".join(r.choice(("a", "b", "Cc", "DD", "e#", *[f"w{k}" for k in range(60)])) for _ in range(n))
        rows.append((r.choice((None, i, i, i)), r.choice((text, text, None, "same text", "x " * 60)), r.choice(("s1", "s2", "", None))))
    rows += [rows[5], (None, "same text", "only"), (10**6, "A", "only")]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i in range(0, 170, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, 1, "y") for i, t, s in rows], "doc_id long, text string, source string, words int, part string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    facts = filter_audit.with_labels(filter_audit.measured(docs), known)
    names = ["kept", "removed", "redundant", "unique_fails", "good", "toxic", "shapley"]
    got = filter_audit.audit(facts, filter_audit.quality_filters(), ["good", "toxic"]).collect()
    want = audited(rows, labels)
    assert {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in names) for x in got} == want
    assert len(got) == len(want) == 4 * 600


def test_audit_of_other_filters(spark):
    rows = spark.range(10).select(F.lit("p").alias("part"), F.when(F.col("id") > 2, F.col("id")).alias("v"))
    got = filter_audit.audit(rows, {"x": F.col("v") > 5, "y": F.col("v") % 2 == 0}, []).collect()
    assert {(r["filter_order"], r["step"]): (r["filter"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in got} == {
        ("xy", 1): ("x", 6, 4, 0, 2, 6), ("xy", 2): ("y", 5, 1, 2, 1, 4), ("yx", 1): ("y", 7, 3, 0, 1, 4), ("yx", 2): ("x", 5, 2, 2, 2, 6),
    }
    assert filter_audit.audit(rows.limit(0), {"x": F.col("v") > 5}, []).count() == 0


def test_audit_query_equals_its_sql(spark):
    df = queries.queries()["op13_filter_audit"](spark, SF)
    assert table(df.columns, df.collect()) == table(*rows_of(queries.oracle_sql()["op13_filter_audit"], SF))


@pytest.mark.parametrize("name, rows", [("op11_jaccard", joined)])
def test_jaccard_query_equals_brute_force(spark, name, rows):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.queries()[name](spark, SF).collect()), key=str) == rows(docs)


def test_alignment_query_equals_definition(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").collect()]
    every = queries.queries()["op12_alignment"](spark, SF)
    columns = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in every.collect()}
    for (i, _), x in zip(docs, aligned([t for _, t in docs]), strict=True):
        assert got[i] == (*x[:4], x[6])
