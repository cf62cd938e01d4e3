"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digits or signs
that stand for letters, and drops invisible characters. The lexicon is learned from a bounded sample of
labelled documents: word beginnings that are far more frequent in toxic ones, weighted by the logarithm
of the ratio. Words of clean documents that begin like an entry are exceptions, and so are phrases
that a caller names; a hit inside an exception doesn't count. The weights found, over the number of
words, give the score by a logistic curve fitted on the sample, whose classes are weighted to their frequency
among all training labels.

Bounds, all parameters of learning alone: TOXIC_SAMPLE and CLEAN_SAMPLE documents, of near copies one (MINIMA,
ALIKE); entries of SHORTEST to LONGEST letters, ENTRIES of them; PER_DOCUMENT occurrences of a beginning in one
document. Scoring reads whole texts and counts every hit.

Cases. Null and empty texts score as texts without a hit; without usable labels the score is one
constant; null ids are scored and in the bucket of the empty text; repeated rows score alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .batches import slices, with_columns
from .learning import fit_logistic, held_out, labelled_sample, logistic, row_weights

#: Labelled documents that are learned from, at most.
TOXIC_SAMPLE, CLEAN_SAMPLE = 3000, 6000
SHORTEST, LONGEST = 4, 14
#: Log odds that an entry needs, and the lexicon's largest size. The log-likelihood ratio that it needs grows with the
#: logarithm of the candidates, as chance finds do.
WEIGHT, ENTRIES = 2.0, 2000
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ᴢ": "z",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)).lower()
        if plain != chr(point) and plain.isascii():
            table[point] = "".join(SIGNS.get(c, c) for c in plain)
    table |= {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {ord(k): v for k, v in SIGNS.items()}
    table |= dict.fromkeys(map(ord, INVISIBLE))
    table |= dict.fromkeys(range(0x300, 0x370))
    table |= {p: " " for p in range(128) if not chr(p).isalnum() and chr(p) not in SIGNS}
    return table


_FOLD = _folding()
#: The digit one also stands for an l.
_FOLD_L = _FOLD | {ord("1"): "l"}


def fold(text: str | None, one: str = "i") -> str:
    """Folded text between blanks; every word of it stands between blanks."""
    return " " + (text or "").lower().translate(_FOLD if one == "i" else _FOLD_L) + " "


def beginnings(folded: str) -> Counter:
    """The word beginnings that can become entries, and how often each stands in the text."""
    found: Counter = Counter()
    for w, c in Counter(folded.split()).items():
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            found[w[:n]] += c
    return found


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: list[float]):
        self.weights, self.exceptions, self.curve = weights, sorted(exceptions), curve

    def automaton(self):
        found = ahocorasick.Automaton()
        entries = {" " + fold(k).strip(): (len(fold(k).strip()) + 1, w, False) for k, w in self.weights.items()}
        entries |= {fold(k): (len(fold(k)), 0.0, True) for k in self.exceptions}
        for k, v in entries.items():
            found.add_word(k, v)
        if entries:
            found.make_automaton()
        return found if entries else None


def hits(automaton, folded: str) -> dict[int, float]:
    """The heaviest entry at each word that no exception covers, by the word's place."""
    if automaton is None:
        return {}
    best: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (n, weight, exception) in automaton.iter(folded):
        if exception:
            covered.append((end - n + 1, end))
        else:
            at = end - n + 1
            best[at] = max(best.get(at, 0.0), weight)
    if not covered:
        return best
    covered.sort()
    starts = [a for a, _ in covered]
    reach = list(accumulate((b for _, b in covered), max))  # how far the spans up to each go
    return {at: w for at, w in best.items() if not (k := bisect_right(starts, at)) or reach[k - 1] <= at}


def measures(automaton, text: str | None) -> tuple[float, float, float]:
    """Weight found by length and in all (both on a log scale), and whether anything was found."""
    folded = fold(text)
    best = hits(automaton, folded)
    if text and "1" in text:
        best = hits(automaton, fold(text, "l")) | best
    if not best:
        return 0.0, 0.0, 0.0
    total = sum(best.values())
    return float(np.log1p(1000 * total / max(1, len((text or "").split())))), float(np.log1p(total)), 1.0


#: In learning, one document counts so often at most for a beginning: a text that repeats a word speaks for itself alone.
PER_DOCUMENT = 10
#: Of labelled documents whose shingles' least values agree in so many of so many, one is learned from.
MINIMA, ALIKE = 16, 12


def _counted(sample: DataFrame, only=None) -> tuple[dict[str, tuple[int, int]], int]:
    """For each beginning, how many of the sample's documents have it and how often; and the words in all.
    Bounded, as the sample is."""

    def count(batches):
        docs: Counter = Counter()
        times: Counter = Counter()
        n = 0
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    folded = fold(text)
                    n += folded.count(" ") - 1
                    for k, c in beginnings(folded).items():
                        if only is None or k in only.value:
                            docs[k] += 1
                            times[k] += min(c, PER_DOCUMENT)
        docs[""], times[""] = 0, n
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([times[k] for k in docs], pa.int64())], names=["k", "n", "m"])

    rows = sample.select("text").mapInArrow(count, "k string, n long, m long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter("n >= 3 OR k = ''")
    out = {r["k"]: (r["n"], r["m"]) for r in rows.collect()}
    return out, out.pop("", (0, 0))[1]


def _signature(text: str) -> list[int]:
    """Least values of the hashes of the text's five-word shingles under MINIMA mixings."""
    w = text.lower().split()
    grams = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    hashes = np.array([xxhash.xxh64_intdigest(g) for g in grams], dtype=np.uint64)
    odd = np.arange(MINIMA, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(0x9E3779B97F4A7C15)
    out = []
    for k in odd:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * k
        out.append(int((mixed ^ (mixed >> np.uint64(32))).min() >> np.uint64(1)))
    return out


def _without_copies(sample: DataFrame) -> list[int]:
    """Ids of the sample's documents, one of each group of near copies (at most the sample's rows)."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_signature(t) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "s"])

    having: dict[tuple[int, int], list[int]] = {}
    kept = []
    for r in sorted(sample.select("doc_id", "text").mapInArrow(sign, "doc_id long, s array<long>").collect()):
        keys = list(enumerate(r["s"]))
        agree = Counter(k for key in keys for k in having.get(key, ()))
        if agree and max(agree.values()) >= ALIKE:
            continue
        kept.append(r["doc_id"])
        for key in keys:
            having.setdefault(key, []).append(r["doc_id"])
    return kept


def learn(documents: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    spark = documents.sparkSession
    sample, totals = labelled_sample(documents, labels, "toxic", {1: TOXIC_SAMPLE, 0: CLEAN_SAMPLE}, "toxic-sample")
    kept = spark.createDataFrame([(k,) for k in _without_copies(sample)], "doc_id long")
    sample = sample.join(F.broadcast(kept), "doc_id")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, list(exceptions), [0.0, 0.0, 0.0, -3.0 if n_clean else 0.0])
    toxic, toxic_words = _counted(sample.filter("y = 1"))
    clean, clean_words = _counted(sample.filter("y = 0"), spark.sparkContext.broadcast(frozenset(toxic)))
    weights = choose(toxic, clean, (n_toxic, toxic_words), (n_clean, clean_words))
    spared = list(exceptions) + _exceptions(sample, set(weights))
    lexicon = Lexicon(weights, spared, [])
    rows = _measured(sample.select("text", "y"), lexicon).select("m_density", "m_total", "m_any", "y").collect()
    x = np.array([list(r)[:3] for r in rows])
    y = np.array([float(r[3]) for r in rows])
    lexicon.curve = fit_logistic(x, y, weights=row_weights(y, totals)).tolist()
    return lexicon


def choose(toxic: dict, clean: dict, toxic_size: tuple[int, int], clean_size: tuple[int, int]) -> dict[str, float]:
    """Entries and weights. toxic, clean: documents and times of each beginning; sizes: documents and words. Of beginnings with the same documents the longest stays; one that a
    shorter entry begins, and weighs no more, adds nothing."""
    strong = {}
    least = 2 * np.log(max(2, len(toxic)))
    n_toxic, n_clean = toxic_size[0], clean_size[0]
    for k, (a, times) in toxic.items():
        b, clean_times = clean.get(k, (0, 0))
        weight = np.log((times + 0.5) / (toxic_size[1] + 1)) - np.log((clean_times + 0.5) / (clean_size[1] + 1))
        share = (a + b) / (n_toxic + n_clean)
        evidence = 2 * (a * np.log(a / (share * n_toxic)) + (b * np.log(b / (share * n_clean)) if b else 0))
        if weight >= WEIGHT and evidence >= least:
            strong[k] = (float(weight), a)
    longest = _longest(strong)
    out: dict[str, float] = {}
    for k in sorted(longest, key=lambda k: (len(k), k)):
        if not any(out.get(k[:n], -1.0) >= longest[k][0] - 0.7 for n in range(SHORTEST, len(k))):
            out[k] = longest[k][0]
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])


def _longest(strong: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    best: dict[str, int] = {}
    for q, (_, n) in strong.items():
        best[q[:-1]] = max(best.get(q[:-1], 0), n)
    return {k: v for k, v in strong.items() if best.get(k, 0) < 0.98 * v[1]}


def _exceptions(sample: DataFrame, entries: set[str]) -> list[str]:
    """Words of clean documents that begin like an entry and that toxic documents have no more often."""
    found = sample.sparkSession.sparkContext.broadcast(frozenset(entries))

    def words(batches):
        for batch in batches:
            rows = []
            for part in slices(batch, 0):
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows += [(w, y) for w in set(fold(text).split()) if any(w[:n] in found.value for n in range(SHORTEST, min(len(w), LONGEST) + 1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["w", "y"])

    counts = sample.select("text", "y").mapInArrow(words, "w string, y int").groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    return sorted(r["w"] for r in counts.filter("clean >= 2 AND clean >= toxic").collect())


def _measured(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    def make():
        automaton = lexicon.automaton()

        def work(texts):
            return list(zip(*[measures(automaton, t) for t in texts], strict=True))

        return work

    return with_columns(documents, "text", make, ["m_density", "m_total", "m_any"], [DoubleType()] * 3)


def scored(documents: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """documents with the column `name` (in place of one of that name): how likely each is toxic."""
    curve = np.array(lexicon.curve)

    def make():
        automaton = lexicon.automaton()
        return lambda texts: [logistic(np.array([measures(automaton, t) for t in texts]).reshape(-1, 3), curve)]

    return with_columns(documents.drop(name), "text", make, [name], [DoubleType()])


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
