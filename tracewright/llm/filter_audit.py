"""What every order of a set of filters removes: the order's effect on each filter's count, by part of the corpus.

Documents are measured once; the measures are staged and the filters are conditions on them. A prefix of an order
leaves the same survivors whichever way it is arranged, so the trie of all orders has as many states as the filters
have subsets. The trie is walked depth first: a state's survivors are a persisted DataFrame, filtered from that of
the state above and let go when the states below are done (so as many are held as there are filters, and a lost
executor costs a filter over the staged measures). A state reached again by another order is not walked again. At
every state one job counts, by part, what each of the filters still to come removes: these are the trie's edges.
All orders are then put together from the edges.

Cases. Null text is empty; a null part is the empty string; a null condition lets a row pass; repeated rows count
each; rows with a null id are identical to none by the copy filter (neither fail it nor make others fail), and have
no labels; of contradicting labels any 1 counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh_dir, stage

#: Tasks over which the rows of one text are dealt.
SALTS = 16


def measured(documents: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, words, distinct words, capitals, code points, whether one of #$%&*| is there, and whether a smaller doc_id has the same text."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"),
        words.alias("w"), F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"), F.length(text).alias("chars"), text.rlike("[#$%&*|]").alias("marks"),
    )
    narrow = rows.select("doc_id", "part", "digest", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct"), "capitals", "chars", "marks")
    narrow = stage(narrow, "audit-measures")
    several = narrow.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    # a frequent text is dealt out over SALTS tasks
    dealt = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = narrow.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    return salted.join(dealt, ["digest", "salt"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("digest", "salt", "least")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `good` (quality 1) and `toxic` (toxic 1) of their labels; without, neither."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    return rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def edges(rows: DataFrame, fails: dict[str, Column], lost: list[str]) -> DataFrame:
    """part, edge, n, removed and the sums of the flags in `lost` over the removed, of every part and edge that rows reach.

    An edge is state * len(fails) + filter; a state is the bit set of the filters that were applied.
    """
    names, spark, path = list(fails), rows.sparkSession, fresh_dir(rows.sparkSession, "audit-edges")
    bad = [F.coalesce(c, F.lit(False)) for c in fails.values()]
    whole = stage(rows.select("part", *lost, *[c.alias(f"_f{i}") for i, c in enumerate(bad)]), "audit-rows")
    every, seen = (1 << len(names)) - 1, set()

    def walk(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [i for i in range(len(names)) if not state >> i & 1]
        sums = [F.struct(F.lit(state * len(names) + i).alias("edge"), F.count_if(f"_f{i}").alias("removed"), *[F.count_if(F.col(f"_f{i}") & F.col(c)).alias(c) for c in lost]).alias(f"e{i}") for i in left]
        counted = survivors.groupBy("part").agg(F.count("*").alias("n"), *sums)
        counted.select("part", "n", F.inline(F.array(*[f"e{i}" for i in left]))).write.mode("append").parquet(path)
        for i in left:
            below = state | 1 << i
            if below not in seen and below != every:
                walk(below, survivors.filter(~F.col(f"_f{i}")))
        survivors.unpersist()

    walk(0, whole)
    return spark.read.schema(", ".join(["part string", "n long", "edge int", "removed long", *[f"{c} long" for c in lost]])).parquet(path)


def audit(rows: DataFrame, fails: dict[str, Column], lost: list[str]) -> DataFrame:
    """One row a part, order of all filters and step (zeros included).

    rows: part, what the conditions in `fails` (true: the filter removes the row) need, and boolean columns `lost`.
    Columns: part, filter_order (the names joined), step (from 1), filter, kept (after the step), removed (in it), redundant
    (failing its filter, removed earlier), unique_fails (failing its filter alone), the `lost` among the removed, and
    shapley: its filter's removed summed over all orders.
    """
    names, width = list(fails), len(fails)
    every, spark = (1 << width) - 1, rows.sparkSession
    found = edges(rows, fails, lost)
    of = [(s, i) for s in range(every) for i in range(width) if not s >> i & 1]
    # of an edge, in how many orders it is walked; 2^(filters) * filters rows
    weights = spark.createDataFrame([(s * width + i, i, int(s == 0), int(s | 1 << i == every), factorial(s.bit_count()) * factorial(width - 1 - s.bit_count())) for s, i in of], "edge int, f int, first int, last int, orders long")
    steps = []
    for order in permutations(range(width)):
        state = 0
        for k, i in enumerate(order):
            steps.append(("".join(names[j] for j in order), k + 1, names[i], state * width + i))
            state |= 1 << i
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter string, edge int")
    parts = found.filter(F.col("edge") < width).select("part").distinct()
    ids = F.array(*[F.lit(s * width + i) for s, i in of])
    full = parts.select("part", F.explode(ids).alias("edge")).join(found, ["part", "edge"], "left").na.fill(0).join(F.broadcast(weights), "edge")
    alone = lambda flag: F.sum(F.col("removed") * F.col(flag))
    filters = full.groupBy("part", "f").agg(alone("first").alias("fails"), alone("last").alias("unique_fails"), alone("orders").alias("shapley"))
    each = full.join(filters, ["part", "f"]).select(
        "part", "edge", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley"
    )
    return each.join(F.broadcast(plan), "edge").select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def quality_filters() -> dict[str, Column]:
    """The five filters that the query audits."""
    return {
        "A": F.col("words") < 50,
        "B": 100 * F.col("distinct") < 65 * F.col("words"),
        "C": 100 * F.col("capitals") > 5 * F.col("chars"),
        "D": F.col("marks"),
        "E": F.col("copy"),
    }


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    rows = with_labels(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named = rows.withColumnsRenamed({"good": "good_lost", "toxic": "toxic_lost"})
    return audit(named, quality_filters(), ["good_lost", "toxic_lost"])


OP13_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS bad
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM x p, x q, x r, x s, x u WHERE p.b + q.b + r.b + s.b + u.b = 31 AND p.b | q.b | r.b | s.b | u.b = 31),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS filter, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS earlier FROM o, k),
m AS (SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (bad & (own | earlier) = 0), 0) AS kept, coalesce(sum(n) FILTER (bad & own <> 0 AND bad & earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (bad & own <> 0 AND bad & earlier <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bad = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (bad & own <> 0 AND bad & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (bad & own <> 0 AND bad & earlier = 0), 0) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM m"""
