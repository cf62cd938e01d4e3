"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours. Document labels
are all that is known, so training starts from them: all lines of a good document are good, those of
a bad one bad; after a first fit, lines of bad documents that the field takes for good are relabelled
(the worst line of a document stays bad) and the field is fitted again. A document's quality is the
mean of its lines' forward-backward marginals, weighted by length, through a logistic curve fitted on
the same sample, whose classes are weighted to their frequency among all training labels.

Cases. Null and empty texts have one empty line; without usable labels the score is one constant;
null ids are scored and in the bucket of the empty text; repeated rows score alike; an empty table
gives no rows; other columns pass through or are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from .batches import with_columns
from .learning import fit_logistic, held_out, labelled_sample, logistic, row_weights

#: Labelled documents that are learned from, at most; all their lines are. Documents of more than LINES // 50 lines are not, and
#: of the others no more than LINES lines in all, in the order of the ids' hashes.
SAMPLE = {0: 1000, 1: 1500}
LINES = 400_000
#: Lines of a chain in training. A longer document is cut into several chains: all lines keep their labels and their
#: true neighbours' features, and the transition at a cut alone is not counted.
WINDOW = 512
THRESHOLD = 0.7
ROUNDS, RATE, PENALTY = 120, 0.1, 1e-3

_CLASSES = np.full(256, 5, dtype=np.uint8)
for _name, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b".,", range(128, 256))):
    _CLASSES[list(_chars)] = _name if _name < 5 else 6
OWN = 16


def own_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, OWN) features, the lines of each text, and the lines' lengths in bytes."""
    raw = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    counts = np.array([len(x) for x in raw])
    lines = [x for doc in raw for x in doc]
    sizes = np.array([len(x) for x in lines])
    joined = _CLASSES[np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)]
    starts = np.cumsum(sizes + 1) - sizes - 1
    share = np.stack([np.add.reduceat((joined == k).astype(np.int32), starts) for k in range(7)], axis=1).astype(np.float64)
    share[:, 5] -= 1  # the line's end
    words = np.empty((len(lines), 7))
    for i, line in enumerate(lines):
        w = line.split()
        n = len(w)
        if not n:
            words[i] = 0
            continue
        pairs = max(1, n - 1)
        words[i] = (n, len(set(w)) / n, sum(map(eq, w, w[1:])) / pairs, sum(map(eq, w, w[2:])) / pairs, len(set(zip(w, w[1:]))) / pairs, w.count(b"|") / n, sum(map(len, w)) / n)
    seen_once = np.concatenate([_repeats(doc) for doc in raw])
    text = np.maximum(1, sizes)
    out = np.empty((len(lines), OWN))
    out[:, :7] = share / text[:, None]
    out[:, 7] = np.log1p(sizes) / 5
    out[:, 8] = np.log1p(words[:, 0]) / 5
    out[:, 9:13] = words[:, 1:5]
    out[:, 13] = words[:, 5]
    out[:, 14] = words[:, 6] / 10
    out[:, 15] = seen_once
    return out, counts, sizes


def _repeats(lines: list[bytes]) -> np.ndarray:
    """1 for a line that the document has more than once."""
    if len(lines) == len(set(lines)):
        return np.zeros(len(lines))
    times: dict[bytes, int] = {}
    for x in lines:
        times[x] = times.get(x, 0) + 1
    return np.array([float(times[x] > 1 and len(x) > 0) for x in lines])


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and behind it (zero at the ends), and a constant."""
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    stops = np.cumsum(counts)
    before[stops - counts] = 0
    behind[stops - 1] = 0
    return np.hstack([own, before, behind, np.ones((len(own), 1))])


def marginals(emission: np.ndarray, counts: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, the expected transitions (2 x 2) in all, and the log partition in all.

    emission: a line's score for good over bad. Documents run in step, the longest first.
    """
    order = np.argsort(-counts, kind="stable")
    n = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")  # documents with a line t
    trans = np.exp(change)
    good = np.exp(np.clip(emission, -30, 30))
    alpha = np.empty((len(emission), 2))
    scale = np.ones(len(emission))
    for t in range(longest):
        at = first[: live[t]] + t
        a = np.ones((live[t], 2)) if t == 0 else alpha[at - 1] @ trans
        a[:, 1] *= good[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    beta = np.ones((len(emission), 2))
    total = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        ahead = beta[at + 1].copy()
        ahead[:, 1] *= good[at + 1]
        ahead /= scale[at + 1][:, None]
        total += (alpha[at].T @ ahead) * trans
        beta[at] = ahead @ trans.T
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), total, float(np.log(scale).sum())


class Field:
    """Weights of the line features, the 2 x 2 transitions, the features' scales and the final curve."""

    def __init__(self, theta: np.ndarray, change: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.theta, self.change, self.mean, self.spread = theta, change, mean, spread
        self.curve = np.array([0.0, 0.0])

    def lines(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = with_neighbours((own - self.mean) / self.spread, counts)
        return marginals(x @ self.theta, counts, self.change)[0]

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """The length-weighted share of good in each text."""
        own, counts, sizes = own_features(texts)
        return weighted(self.lines(own, counts), counts, sizes)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return logistic(self.quality(texts)[:, None], self.curve) if texts else np.zeros(0)


def weighted(good: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts, weight = np.cumsum(counts) - counts, sizes + 1.0
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood of the lines' labels y, by Adam on the exact gradient."""
    follows = np.ones(len(y), dtype=bool)
    follows[np.cumsum(counts) - counts] = False
    later = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1].astype(int), y[later].astype(int)), 1)
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        good, expected, _ = marginals(x @ w[:-4], counts, w[-4:].reshape(2, 2))
        slope = np.r_[x.T @ (y - good), (seen - expected).ravel()] / len(y) - PENALTY * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-4], w[-4:].reshape(2, 2)


def windows(counts: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Lines of the chains that documents of so many lines are cut into."""
    return np.concatenate([np.r_[np.full((n - 1) // most, most), (n - 1) % most + 1] for n in counts]).astype(np.int64)


def within_lines(sample: DataFrame, lines: int = LINES) -> DataFrame:
    """The sample's documents (a bounded number) whose lines are within the bound, each class on its own half of it."""
    counted = sample.withColumn("_n", F.regexp_count("text", F.lit("\n")) + 1).filter(F.col("_n") <= lines // 50)
    order = Window.partitionBy("y").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_n", F.sum("_n").over(order)).filter(F.col("_n") <= lines // 2).drop("_n")


def learn(documents: DataFrame, labels: DataFrame) -> Field:
    """A field from a bounded sample: line features (of a bounded number of lines) come to the driver, never texts."""
    sample, totals = labelled_sample(documents, labels, "quality", SAMPLE, "quality-sample")
    sample = within_lines(sample)

    def make():
        def work(texts):
            own, counts, sizes = own_features(texts)
            ends = np.cumsum(counts)
            return [[np.c_[own[a:b], sizes[a:b]].astype("<f4").tobytes() for a, b in zip(ends - counts, ends, strict=True)]]

        return work

    rows = with_columns(sample.select("y", "text"), "text", make, ["f"], [BinaryType()]).select("y", "f").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["f"])))  # the sample's order is not fixed, sums should be
    labels_of = np.array([float(r["y"]) for r in rows])
    if not len(rows) or labels_of.min() == labels_of.max():
        field = Field(np.zeros(3 * OWN + 1), np.zeros((2, 2)), np.zeros(OWN), np.ones(OWN))
        field.curve = fit_logistic(np.zeros((len(rows), 1)), labels_of)
        return field
    cells = [np.frombuffer(bytes(r["f"]), dtype="<f4").astype(np.float64).reshape(-1, OWN + 1) for r in rows]
    counts = np.array([len(c) for c in cells])
    every = np.concatenate(cells)
    own, sizes = every[:, :OWN], every[:, OWN]
    mean, spread = own.mean(axis=0), own.std(axis=0) + 1e-3
    x = with_neighbours((own - mean) / spread, counts)
    y = np.repeat(labels_of, counts)
    chains = windows(counts)
    theta, change = fit(x, chains, y)
    good = marginals(x @ theta, chains, change)[0]
    starts = np.cumsum(counts) - counts
    worst = good == np.repeat(np.minimum.reduceat(good, starts), counts)
    y = np.where((y == 0) & (good > 0.8) & ~worst, 1.0, y)
    field = Field(*fit(x, chains, y), mean, spread)
    share = weighted(field.lines(own, counts), counts, sizes)
    field.curve = fit_logistic(share[:, None], labels_of, weights=row_weights(labels_of, totals))
    return field


def scored(documents: DataFrame, field: Field, name: str = "score") -> DataFrame:
    """documents with the column `name` (in place of one of that name): how likely each is of good quality."""
    return with_columns(documents.drop(name), "text", lambda: (lambda texts: [field.score(texts)]), [name], [DoubleType()])


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, field).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
