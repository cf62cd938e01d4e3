"""Deterministic sampling and splitting (O6-O16, W5, W7, J7). Order comes from md5(seed | key), so a draw is the
same on any cluster and in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def draw(seed, *keys) -> Column:
    """The sort key of a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).cast("binary"))


def seeded_sample(df: DataFrame, key: str, n: int, seed=0) -> DataFrame:
    """N rows in shuffled order (a top-n, not a full sort)."""
    return df.withColumn("_draw", draw(seed, key)).orderBy("_draw", key).limit(n).drop("_draw")


def sample_in_order(df: DataFrame, key: str, n: int, seed=0) -> DataFrame:
    """A seeded sample in the rows' own order."""
    return seeded_sample(df, key, n, seed).orderBy(key)


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def quota_sample(df: DataFrame, group: str, key: str, quotas: DataFrame, seed=0) -> DataFrame:
    """Of every group as many rows as the quota table (group, quota) says. The largest quota is a literal, so that
    each task hands on that many rows of a group at most."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    met = ranked(df.join(quotas, group).withColumn("_draw", draw(seed, key)), [group], ["_draw", key])
    return met.filter(F.col("rn") <= F.lit(int(most))).filter(F.col("rn") <= F.col("quota")).drop("_draw", "rn")


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed=0) -> DataFrame:
    """N rows of every class."""
    return ranked(df.withColumn("_draw", draw(seed, key)), [label], ["_draw", key]).filter(F.col("rn") <= n).drop("_draw", "rn")


_INDEX = (1 << 33) - 1


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df in as many ranges of the order as a shuffle has partitions, staged, with `_range` and `_at`, the place inside."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return scratch.stage(dealt, "ranges").withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_INDEX)))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with each row's 0-based place in its group (null is a group, too), in the order. Groups, and equal rows, may span any
    number of ranges; what is shuffled once they are sorted are the groups' sizes in each range."""
    placed = ranges(df, [*by, *order])
    keys = [f"_g{i}" for i in range(len(by))]
    pieces = placed.groupBy("_range", *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of a group, as many rows as ranges
    offsets = pieces.select(F.col("_range").alias("_r"), *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    same = F.col("_range") == F.col("_r")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return placed.join(offsets if by else F.broadcast(offsets), same).withColumn(name, F.col("_at") + F.col("_off")).select(*df.columns, name)


def positions(df: DataFrame, key: str, name: str = "pos", ties: tuple[str, ...] = ()) -> DataFrame:
    """0-based places in key order (null first); equal keys in the order of `ties`."""
    return numbered(df, [], [key, *ties], name)


def stride_shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Every shards-th row in key order."""
    return positions(df, key).withColumn("shard", F.pmod("pos", F.lit(shards)).cast("int"))


def offset_slice(df: DataFrame, key: str, offset: int, n: int) -> DataFrame:
    """Rows offset .. offset + n in key order."""
    return positions(df, key).filter((F.col("pos") >= offset) & (F.col("pos") < offset + n))


def chunk_plan(work: DataFrame, done: DataFrame | None, key: str, size: int) -> DataFrame:
    """What isn't done yet, in order, in chunks of `size`."""
    if size < 1:
        raise ValueError("a chunk has at least one row")
    left = work if done is None else work.join(done.select(key), key, "left_anti")
    return positions(left, key).withColumn("chunk", F.expr(f"pos div {size}"))


def train_val_split(df: DataFrame, key: str, fraction: int | None = 6, train: int | None = None, val: int | None = None, seed=0) -> DataFrame:
    """A `split` column. By fraction: the first max(1, n div fraction) shuffled rows are val. By size: the first
    `train` rows are train, the next `val` are val, the rest is unused; too few rows are an error."""
    shuffled = positions(df.withColumn("_draw", F.concat_ws("|", draw(seed, key), F.col(key).cast("string"))), "_draw")
    if train is not None:
        have = df.count()
        if have < train + (val or 0):
            raise ValueError(f"{have} rows are fewer than the {train} + {val or 0} that are asked for")
        split = F.when(F.col("pos") < train, "train").when(F.col("pos") < train + (val or 0), "val")
        return shuffled.withColumn("split", split).filter("split IS NOT NULL").drop("_draw", "pos")
    n = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
    cut = F.greatest(F.lit(1), F.expr(f"_n div {fraction}"))
    return shuffled.crossJoin(n).withColumn("split", F.when(F.col("pos") < cut, "val").otherwise("train")).drop("_draw", "pos", "_n")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key (dropDuplicates would keep any)."""
    return ranked(df, keys, order).filter("rn = 1").drop("rn")


def shuffled_options(options: Column, *key: Column) -> Column:
    """Options in an order that depends on the key alone."""
    tagged = F.transform(options, lambda o, i: F.struct(F.md5(F.concat_ws("|", *[k.cast("string") for k in key], i.cast("string")).cast("binary")).alias("d"), o.alias("o")))
    return F.transform(F.array_sort(tagged), lambda t: t["o"])
