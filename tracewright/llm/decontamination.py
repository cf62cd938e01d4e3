"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max WAND.

Each training passage (a window twice as long as the longest item, every item's length apart, so
that any copy of an item lies in one passage whole) is a query. An item's score is its BM25 score
for the passage's words over its score for its own words; all items at or above the threshold are
retrieved. Items lie in blocks; a shallow pass adds the block maxima of the passage's rarer words,
for all passages of a batch at once, and only blocks that can reach the threshold are entered, with
WAND's pivots. A retrieved item is a leak if the passage holds at least `similarity` of the five-word
shingles of its question (all but the last sentence) and as much of its answer (the last sentence).

The index is broadcast for at most BLOCK_BYTES of item text at a time; a larger benchmark is taken
in several passes of the documents, each written before the next. What scores and passages depend on (the number
of items, their average and greatest length, the words' document frequencies) is counted once over all items, so
the passes find what one index would.

Cases. Null and empty texts and items match nothing, and so do items of fewer than five words, which are no
evidence (unsearchable() names them); items with a null id are ignored; equal items
are found each by its id; repeated rows of documents are found each; empty tables give no rows;
other columns are ignored (or passed through where rows are annotated).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .batches import free_name, with_columns
from .common import stage

THRESHOLD = 0.6
SIMILARITY = 0.8
SHINGLE = 5
#: Items in a block of the index.
BLOCK = 8
#: Item text in one index, in characters (a worker holds some 30 bytes for each).
BLOCK_BYTES = 4 << 20
#: Rows of the index and cells of sums that a batch of passages looks at together.
ROWS, CELLS = 1 << 19, 1 << 21
K1, B = 1.2, 0.75
#: Share of an item's score that its commonest words may give without being looked up.
COMMON = 0.2

_WORDS = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before the last sentence and of it; of a single sentence, its first two thirds and the rest."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    every = words(text)
    cut = -(-2 * len(every) // 3)
    return every[:cut], every[cut:]


def shingles(seq: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(seq[i : i + size]) for i in range(max(1, len(seq) - size + 1))} if seq else set()


def contained(part: list[str], passage: list[str], size: int = SHINGLE) -> float:
    """Share of the part's shingles that the passage has; a part shorter than a shingle is one."""
    mine = shingles(part, size)
    if not mine:
        return 1.0
    n = min(size, len(part))
    return len(mine & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(mine)


@dataclass
class Statistics:
    """What the scores take from all items: their number, average and greatest length in words, and words' document frequencies."""

    items: int
    average: float
    longest: int
    frequency: dict[str, int]

    @classmethod
    def of(cls, texts: list[list[str]]) -> Statistics:
        frequency: dict[str, int] = {}
        for seq in texts:
            for w in set(seq):
                frequency[w] = frequency.get(w, 0) + 1
        return cls(len(texts), sum(map(len, texts)) / max(1, len(texts)), max(map(len, texts), default=1), frequency)


class Index:
    """Postings with impacts (a word's part of an item's score, 1 in all) and their block maxima.

    known: the statistics of all items, if these are only some of them.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, similarity: float = SIMILARITY, block: int = BLOCK, known: Statistics | None = None):
        self.threshold, self.similarity, self.block = threshold, similarity, block
        texts = [(i, t, words(t)) for i, t in sorted(items) if i is not None]
        texts = [x for x in texts if len(x[2]) >= SHINGLE]
        self.ids = [i for i, _, _ in texts]
        self.parts = [question_answer(t) for _, t, _ in texts]
        known = known or Statistics.of([w for _, _, w in texts])
        self.longest, average, every, df = known.longest, known.average, known.items, known.frequency
        counts = [Counter(seq) for _, _, seq in texts]
        self.terms = {w: k for k, w in enumerate(sorted({w for tf in counts for w in tf}))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, ((_, _, seq), tf) in enumerate(zip(texts, counts, strict=True)):
            scores = {
                w: math.log(1 + (every - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(seq) / average))
                for w, n in tf.items()
            }
            total = sum(scores.values())
            for w, s in scores.items():
                self.postings[self.terms[w]].append((item, s / total))
        self._split_common(len(texts))
        self._block_maxima()

    def _split_common(self, n: int) -> None:
        """The commonest words, as long as no item gets more than COMMON from them, are left to the deep pass."""
        held = np.zeros(max(1, n))
        self.rare = np.ones(len(self.terms), dtype=bool)
        for k in sorted(range(len(self.terms)), key=lambda k: (-len(self.postings[k]), k)):
            more = held.copy()
            for item, s in self.postings[k]:
                more[item] += s
            if more.max() > COMMON:
                break
            held, self.rare[k] = more, False
        self.slack = float(held.max())

    def _block_maxima(self) -> None:
        starts, blocks, maxima = [0], [], []
        self.maxima: list[dict[int, float]] = []
        for k, rows in enumerate(self.postings):
            best: dict[int, float] = {}
            for item, s in rows:
                best[item // self.block] = max(best.get(item // self.block, 0.0), s)
            self.maxima.append(best)
            if self.rare[k]:
                blocks += best
                maxima += best.values()
            starts.append(len(blocks))
        self.starts = np.array(starts)
        self.blocks, self.bounds = np.array(blocks, dtype=np.int64), np.array(maxima)
        self.n_blocks = -(-len(self.ids) // self.block)

    def _passages(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and stop (in the joined words) of every passage."""
        step = self.longest
        n = np.maximum(1, -(-lengths // step) - 1) * (lengths > 0)
        doc = np.repeat(np.arange(len(lengths)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        base = np.cumsum(lengths) - lengths
        return doc, base[doc] + nth * step, base[doc] + np.minimum(nth * step + 2 * step, lengths[doc])

    def _candidates(self, known: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
        """(passage, block) whose maxima can reach the threshold."""
        at = np.flatnonzero((known >= 0) & self.rare[np.maximum(known, 0)]) if len(self.terms) else np.zeros(0, dtype=np.int64)
        # passages are a step apart and two steps long: a word is in one or two of them
        fan = self.starts[known[at] + 1] - self.starts[known[at]]
        first, last = np.searchsorted(at, starts), np.searchsorted(at, stops)
        through = np.concatenate([[0], np.cumsum(fan)])
        load = np.concatenate([[0], np.cumsum(through[last] - through[first])])
        most = max(1, CELLS // max(1, self.n_blocks))
        out, a = [], 0
        while a < len(starts):
            b = max(a + 1, min(int(np.searchsorted(load, load[a] + ROWS, side="right")) - 1, a + most))
            n = last[a:b] - first[a:b]
            passage = np.repeat(np.arange(b - a), n)
            place = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            reach = np.zeros((b - a) * self.n_blocks)
            rows = np.cumsum(fan[place])
            c = 0
            while c < len(place):  # more than once for a passage beyond ROWS alone
                d = max(c + 1, int(np.searchsorted(rows, (rows[c - 1] if c else 0) + ROWS, side="right")))
                m, word = fan[place[c:d]], known[at[place[c:d]]]
                row = np.repeat(self.starts[word] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                cell = np.repeat(passage[c:d], m) * self.n_blocks + self.blocks[row]
                reach += np.bincount(cell, weights=self.bounds[row], minlength=len(reach))
                c = d
            hit = np.flatnonzero(reach >= self.threshold - self.slack - 1e-9)
            out += [(a + int(x) // self.n_blocks, int(x) % self.n_blocks) for x in hit]
            a = b
        return out

    def retrieve(self, terms: set[int], block: int) -> list[tuple[int, float]]:
        """WAND in one block: the items that score at least the threshold, exactly scored."""
        low, high = block * self.block, (block + 1) * self.block
        cursors = []
        for k in sorted(terms):
            bound = self.maxima[k].get(block)
            if bound is not None:
                rows = self.postings[k]
                cursors.append([rows[bisect_left(rows, (low,)) : bisect_left(rows, (high,))], 0, bound])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            reach, pivot = 0.0, None
            for c in cursors:
                reach += c[2]
                if reach >= self.threshold - 1e-9:
                    pivot = c[0][c[1]][0]
                    break
            if pivot is None:
                break
            score = 0.0
            for c in cursors:
                rows, at, _ = c
                while at < len(rows) and rows[at][0] < pivot:
                    at += 1
                if at < len(rows) and rows[at][0] == pivot:
                    score += rows[at][1]
                    at += 1
                c[1] = at
            cursors = [c for c in cursors if c[1] < len(c[0])]
            if score >= self.threshold - 1e-9:
                found.append((pivot, score))
        return found

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text its verified items, each once with its best passage."""
        if not self.ids:
            return [[] for _ in texts]
        split = [words(t) for t in texts]
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        get = self.terms.get
        known = np.array([get(w, -1) for seq in split for w in seq], dtype=np.int64)
        doc, starts, stops = self._passages(lengths)
        base = np.cumsum(lengths) - lengths
        best: list[dict[int, dict]] = [{} for _ in texts]
        last, terms = -1, set()
        for p, block in self._candidates(known, starts, stops):
            if p != last:
                last, terms = p, set(known[starts[p] : stops[p]].tolist()) - {-1}
            d = int(doc[p])
            for item, score in self.retrieve(terms, block):
                if best[d].get(item, {"score": 0.0})["score"] >= score:
                    continue
                passage = split[d][int(starts[p] - base[d]) : int(stops[p] - base[d])]
                question, answer = (contained(x, passage) for x in self.parts[item])
                if question >= self.similarity and answer >= self.similarity:
                    best[d][item] = {"item_id": self.ids[item], "score": score, "question_overlap": question, "answer_overlap": answer, "word": int(starts[p] - base[d])}
        return [[b[k] for k in sorted(b)] for b in best]


LEAK = StructType(
    [StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("question_overlap", DoubleType()), StructField("answer_overlap", DoubleType()), StructField("word", LongType())]
)


def annotate(documents: DataFrame, benchmark: DataFrame, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """documents with the array column `name` of the leaks of each row."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // BLOCK_BYTES))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(passes)).cast("int"))
    profiles = stage(with_columns(items, "text", lambda: _profiled, ["n", "bag"], [LongType(), ArrayType(StringType())]).filter(F.col("n") >= SHINGLE).select("part", "n", "bag"), "leak-words")
    size = profiles.agg(F.count("*").alias("items"), F.coalesce(F.sum("n") / F.count("*"), F.lit(0.0)).alias("average"), F.coalesce(F.max("n"), F.lit(1)).alias("longest")).first()
    frequency = profiles.select(F.explode("bag").alias("word")).groupBy("word").count()
    found = documents
    for k in range(passes):
        some = items.filter(F.col("part") == k).select("item_id", "text").collect()  # about BLOCK_BYTES of text, and its words
        own = frequency.join(profiles.filter(F.col("part") == k).select(F.explode("bag").alias("word")).distinct(), "word").collect()
        known = Statistics(size["items"], size["average"], size["longest"], {r["word"]: r["count"] for r in own})
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in some], threshold, known=known))
        column = name if k == 0 else free_name(found, name)
        found = with_columns(found, "text", lambda i=index: (lambda texts: [i.value.leaks(texts)]), [column], [ArrayType(LEAK)])
        if column != name:
            found = found.withColumn(name, F.concat(name, column)).drop(column)
        if passes > 1:  # one index at a time
            found = stage(found, "leak-pass")
            index.destroy()
    return found


def unsearchable(benchmark: DataFrame) -> DataFrame:
    """item_id, text and words of the items that annotate() can't find: those with an id and a text of fewer than SHINGLE words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
    counted = with_columns(items, "text", lambda: (lambda texts: [[len(words(t)) for t in texts]]), ["words"], [LongType()])
    return counted.filter(F.col("words") < SHINGLE)


def _profiled(texts: list[str | None]) -> list[list]:
    """How many words each text has, and which."""
    split = [words(t) for t in texts]
    return [[len(w) for w in split], [sorted(set(w)) for w in split]]


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a leak, with their own columns."""
    name = free_name(documents, "leaks")
    return annotate(documents, benchmark, name).filter(F.size(name) == 0).drop(name)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "leaks")
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
