"""Pairwise alignments as blocks: arrays of (lo, hi, shift), residues lo..hi-1 of the row map to lo+shift..hi-1+shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCKS = "array<struct<lo:int,hi:int,shift:int>>"


def _runs(ali: Column) -> Column:
    """An emission text such as +3-3+2 as (sign, length, columns before, residues before)."""
    tokens = F.regexp_extract_all(ali, F.lit(r"[+-][0-9]+"), F.lit(0))
    size = lambda t: F.substring(t, F.lit(2), F.length(t)).cast("int")
    start = F.struct(F.array().cast("array<struct<gap:boolean,n:int,col:int,res:int>>").alias("out"), F.lit(0).alias("col"), F.lit(0).alias("res"))

    def step(a: Column, t: Column) -> Column:
        n, gap = size(t), F.substring(t, 1, 1) == "-"
        run = F.struct(gap.alias("gap"), n.alias("n"), a["col"].alias("col"), a["res"].alias("res"))
        return F.struct(F.concat(a["out"], F.array(run)).alias("out"), (a["col"] + n).alias("col"), (a["res"] + F.when(gap, 0).otherwise(n)).alias("res"))

    return F.filter(F.aggregate(tokens, start, step, lambda a: a["out"]), lambda r: ~r["gap"])


def from_emissions(row_from: Column, row_ali: Column, col_from: Column, col_ali: Column) -> Column:
    """Blocks of two emission texts: columns in which both have residues."""
    rows, cols = _runs(row_ali), _runs(col_ali)

    def meet(x: Column, y: Column) -> Column:
        lo, hi = F.greatest(x["col"], y["col"]), F.least(x["col"] + x["n"], y["col"] + y["n"])
        row, col = row_from + x["res"] + lo - x["col"], col_from + y["res"] + lo - y["col"]
        return F.struct(row.cast("int").alias("lo"), (row + hi - lo).cast("int").alias("hi"), (col - row).cast("int").alias("shift"))

    pairs = F.flatten(F.transform(rows, lambda x: F.transform(F.filter(cols, lambda y: (y["col"] < x["col"] + x["n"]) & (y["col"] + y["n"] > x["col"])), lambda y: meet(x, y))))
    return pairs.cast(BLOCKS)


def from_lists(sizes: Column, row_starts: Column, col_starts: Column) -> Column:
    """Blocks of three texts of numbers with a comma behind each."""
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    zipped = F.arrays_zip(numbers(sizes).alias("n"), numbers(row_starts).alias("r"), numbers(col_starts).alias("c"))
    return F.transform(zipped, lambda z: F.struct(z["r"].alias("lo"), (z["r"] + z["n"]).alias("hi"), (z["c"] - z["r"]).alias("shift"))).cast(BLOCKS)


def aligned_pairs(blocks: Column) -> Column:
    """(row residue, column residue) of every aligned pair."""
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.sequence(b["lo"], b["hi"] - 1), lambda x: F.struct(x.alias("row"), (x + b["shift"]).alias("col")))))


def map_right(blocks: Column, residue: Column) -> Column:
    """The column residue of the first aligned residue at or after this one, 0 if there is none."""
    able = F.filter(blocks, lambda b: b["hi"] > residue)
    return F.coalesce(F.array_min(F.transform(able, lambda b: F.struct(F.greatest(b["lo"], residue).alias("row"), (F.greatest(b["lo"], residue) + b["shift"]).alias("col"))))["col"], F.lit(0))


def map_left(blocks: Column, residue: Column) -> Column:
    """The column residue of the last aligned residue at or before this one, 0 if there is none."""
    able = F.filter(blocks, lambda b: b["lo"] <= residue)
    return F.coalesce(F.array_max(F.transform(able, lambda b: F.struct(F.least(b["hi"] - 1, residue).alias("row"), (F.least(b["hi"] - 1, residue) + b["shift"]).alias("col"))))["col"], F.lit(0))


def compose(first: Column, second: Column) -> Column:
    """Blocks of the map that goes through both; empty where nothing is mapped."""

    def meet(x: Column, y: Column) -> Column:
        lo, hi = F.greatest(x["lo"], y["lo"] - x["shift"]), F.least(x["hi"], y["hi"] - x["shift"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), (x["shift"] + y["shift"]).alias("shift"))

    able = lambda x: F.filter(second, lambda y: (y["lo"] < x["hi"] + x["shift"]) & (y["hi"] > x["lo"] + x["shift"]))
    return F.flatten(F.transform(first, lambda x: F.transform(able(x), lambda y: meet(x, y)))).cast(BLOCKS)


def split(alignments: DataFrame, keys: list[str], blocks: str, max_gap: int) -> DataFrame:
    """A row for each part of an alignment without a longer gap in row or column: keys, part, lo, hi, col_lo, col_hi."""
    flat = alignments.select(*keys, F.posexplode(F.array_sort(blocks)).alias("k", "b")).select(*keys, "k", "b.lo", "b.hi", "b.shift")
    order = W.partitionBy(*keys).orderBy("k")
    gap = F.greatest(F.col("lo") - F.lag("hi").over(order), F.col("lo") + F.col("shift") - F.lag(F.col("hi") + F.col("shift")).over(order))
    parts = flat.withColumn("fresh", F.coalesce(gap > max_gap, F.lit(False)).cast("int")).withColumn("part", F.sum("fresh").over(order).cast("int"))
    return parts.groupBy(*keys, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("lo") + F.col("shift")).alias("col_lo"), F.max(F.col("hi") + F.col("shift")).alias("col_hi"))


def bounds(blocks: Column) -> tuple[Column, Column, Column, Column]:
    """First and last residue (exclusive) of row and column."""
    low, high = (lambda f: F.array_min(F.transform(blocks, f))), (lambda f: F.array_max(F.transform(blocks, f)))
    return low(lambda b: b["lo"]), high(lambda b: b["hi"]), low(lambda b: b["lo"] + b["shift"]), high(lambda b: b["hi"] + b["shift"])
