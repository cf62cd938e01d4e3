"""Sharding along a Hilbert curve over several metadata dimensions (DataFrame functions only).

Documents that are close in size, place in the id range, source and language get close curve
indexes, so runs of the sorted rows are narrow in every dimension at once and a reader that
filters on any of them can skip files by their ranges.

Sizes, sources and languages are quantised by frequency: a value's cell is the share of the rows
below the middle of its own, so cells hold like numbers of rows however skewed the values are, cells
keep the order of the values, and one hot value takes one cell. S shards over d dimensions leave some
S^(1/d) cuts a dimension; whoever filters on two dimensions alone names these two.

Cases. A null text has no bytes (size 8) and checksum 0; null ids, sources and languages are in cell
0 of their dimension; equal rows keep an arbitrary but fixed order; an empty table gives an empty
result; shard_documents ignores other columns, write_shards carries them, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import free_name
from .common import numbered, running_sum, shuffle_width, stage, text_bytes

BITS = 4
DIMENSIONS = ("size", "place", "source", "lang")


def _measured(documents: DataFrame, *keep: Column) -> DataFrame:
    return documents.select(
        "doc_id",
        (text_bytes(F.col("text")) + 8).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        "source",
        "lang",
        *keep,
    )


def _ordinal(dimension: str) -> Column:
    """The dimension's value as text that sorts as the value does."""
    return F.lpad(F.col(dimension).cast("string"), 20, "0") if dimension == "size" else F.col(dimension).cast("string")


def cell_bounds(measured: DataFrame, dimensions: tuple[str, ...], bits: int = BITS) -> dict[str, list[tuple[int, str]]]:
    """For each dimension its cells, ascending, each with its greatest value (as _ordinal gives it).

    Values are counted before the exchange and their running sums go over ranges of values, so neither a
    hot value nor many values come into one task; 2^bits rows a dimension are collected.
    """
    named = F.array(*[F.struct(F.lit(d).alias("dimension"), _ordinal(d).alias("value")) for d in dimensions])
    counts = (
        measured.select(F.explode(named).alias("of")).select("of.*").filter("value IS NOT NULL")
        .groupBy("dimension", "value").agg(F.count("*").alias("n"))
    )
    summed = running_sum(counts, "dimension", ["value"], "n", "shard-values")
    totals = summed.groupBy("dimension").agg(F.sum("n").alias("_all"))
    cell = F.expr(f"((2 * before + n) * {1 << bits}) div (2 * _all)").cast("int")
    rows = (
        summed.join(F.broadcast(totals), "dimension")  # a row for each dimension
        .groupBy("dimension", cell.alias("cell"))
        .agg(F.max("value").alias("most"))
        .collect()
    )
    out: dict[str, list[tuple[int, str]]] = {d: [] for d in dimensions}
    for r in sorted(rows, key=lambda r: r["cell"]):
        out[r["dimension"]].append((r["cell"], r["most"]))
    return out


def _cell(dimension: str, bounds: list[tuple[int, str]]) -> Column:
    out, value = F.when(_ordinal(dimension).isNull(), 0), _ordinal(dimension)
    for cell, most in bounds:
        out = out.when(value <= F.lit(most), cell)
    return out.otherwise(0)


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell with these integer coordinates, 0 <= axis < 2^bits.

    The state of the transform (one integer per axis) runs through a fixed list of steps with
    `aggregate`, so the expression stays linear in bits x axes.
    """
    n = len(axes)
    low = lambda s: [s[f"x{i}"] for i in range(n)]
    pack = lambda xs: F.struct(*[x.alias(f"x{i}") for i, x in enumerate(xs)])
    steps = F.array(
        *[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]
    )

    def undo(state: Column, step: Column) -> Column:
        xs, q, at = low(state), step["q"], step["i"]
        mine = F.element_at(F.array(*xs), at + 1)
        mask = q - F.lit(1)
        swap = F.when(mine.bitwiseAND(q) != 0, F.lit(0)).otherwise(xs[0].bitwiseXOR(mine).bitwiseAND(mask))
        flip = F.when(mine.bitwiseAND(q) != 0, mask).otherwise(F.lit(0))
        out = []
        for i, x in enumerate(xs):
            if i == 0:
                out.append(x.bitwiseXOR(flip).bitwiseXOR(swap))
            else:
                out.append(x.bitwiseXOR(F.when(at == i, swap).otherwise(F.lit(0))))
        return pack(out)

    def gray(state: Column) -> Column:
        out, last = [], None
        for x in low(state):
            last = x if last is None else x.bitwiseXOR(last)
            out.append(last)
        fold = F.lit(0)
        for b in range(bits - 1, 0, -1):
            fold = fold.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return pack([x.bitwiseXOR(fold) for x in out])

    def interleave(state: Column) -> Column:
        at = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for x in low(state):
                at = F.shiftleft(at, 1).bitwiseOR(F.shiftright(x, b).bitwiseAND(F.lit(1)))
        return at

    # each part is a lambda's body, so its input is computed once
    done = F.aggregate(steps, pack([a.cast("int") for a in axes]), undo)
    grayed = F.transform(F.array(done), gray)
    return F.element_at(F.transform(grayed, interleave), 1)


def _ordered(measured: DataFrame, shards: int, dimensions: tuple[str, ...]) -> DataFrame:
    """measured with curve, shard and slot."""
    valued = tuple(d for d in dimensions if d != "place")
    bounds = cell_bounds(measured.select("size", "source", "lang"), valued) if valued else {}
    span = measured.agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), F.count("*").alias("_rows"))
    width = (F.col("_high") - F.col("_low") + 1).cast("decimal(38,0)")
    place = F.floor((F.col("doc_id") - F.col("_low")).cast("decimal(38,0)") * (1 << BITS) / width).cast("int")
    axes = [F.coalesce(place, F.lit(0)) if d == "place" else _cell(d, bounds[d]) for d in dimensions]
    celled = measured.crossJoin(F.broadcast(span)).withColumn("curve", hilbert_index(axes)).drop("_low", "_high")
    placed = numbered(celled, ["curve", "text_crc32", "doc_id"], "shard-order")
    cut = placed.withColumn("shard", F.expr(f"(pos * {shards}) div _rows").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * _rows + {shards - 1}) div {shards}")
    return cut.withColumn("slot", F.col("pos") - first).drop("_rows", "pos")


def shard_documents(documents: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row per document: its measures, curve index, shard and slot; shards differ by one row at most."""
    return _ordered(stage(_measured(documents), "shard-in"), shards, dimensions)


def write_shards(documents: DataFrame, path: str, shards: int = 24, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Write whole documents as Parquet, a folder for each shard, and return each shard's ranges.

    A shard may be cut into several files, each a run of the curve as well. The result has a row for each
    shard that holds rows: `shard`, `rows`, and for size, doc_id, source and lang the least and greatest value.
    """
    ordered = _ordered(_measured(documents, F.struct("*").alias("_row")), shards, dimensions)
    name = free_name(documents, "shard")
    dealt = ordered.repartitionByRange(shuffle_width(documents.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("_row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    ends = [f(c).alias(f"{n}_{c}") for c in ("size", "doc_id", "source", "lang") for n, f in (("min", F.min), ("max", F.max))]
    return ordered.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def op3_hilbert(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
