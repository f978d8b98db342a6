"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order.

A text's k-mers are its windows of three words. Equal k-mers are numbered by occurrence, each (k-mer, number)
gets one hash; its low bits choose one of 32 sketches, the rest is its rank there. A sketch takes the two of
lowest rank and hashes them in the order they have in the text, so moving a passage changes it where a set
sketch would not see it. A sketch that got fewer than two k-mers borrows the lowest of the next sketches, in a
ring, so every sketch of a text with two k-mers is an ordered pair, in short texts too. Everything runs as
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domainforge.plans.scratch import pieces

KMER, SKETCHES = 3, 32
#: Text to one shuffle partition, and the most id ranges (four to a partition).
RANGE_BYTES, RANGES = 8 << 20, 1 << 15
#: Rows of one id that are dealt over ``SALTS`` keys, if they are over a thousandth of all rows too.
HOT, SALTS = 1000, 64


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sketches of ``text`` as an ascending array of longs: sketch number and 24 bits."""
    w, g, s = f"_{name}_w", f"_{name}_g", f"_{name}_s"
    df = df.withColumn(w, F.transform(F.split(text, r"[\x09-\x0D\x20]+", -1), lambda x: F.xxhash64(x)))
    df = df.withColumn(g, F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, KMER)))), 1, F.greatest(F.size(w) - (KMER - 1), F.lit(1))))
    code = lambda h, p: (
        F.shiftleft(h.bitwiseAND(F.lit(SKETCHES - 1)), 58).bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, 5).bitwiseAND(F.lit(0xFFFFFFFF)), 26)).bitwiseOR(p.cast("long").bitwiseAND(F.lit(0x3FFFFFF)))
    )
    once = F.transform(g, lambda x, i: code(F.xxhash64(x, F.lit(0)), i))
    # repeated k-mers: sorted by (k-mer, place), a place's number is the length of its run before it, which
    # doubling finds in log2(repeats) steps
    # (columns of their own: an expression inside a lambda would be computed again for every element)
    o, n = f"_{name}_o", f"_{name}_n"
    repeats = F.size(g) - F.size(F.array_distinct(g))
    df = df.withColumn(f"_{name}_r", repeats)
    again = F.col(f"_{name}_r") > 0
    df = df.withColumn(o, F.when(again, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    df = df.withColumn(n, F.transform(o, lambda e, i: F.when((i > 0) & (F.get(o, i - 1)["h"] == e["h"]), 1).otherwise(0)))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col(f"_{name}_r") + 2)).cast("int"))
    double = lambda a, _: F.struct(
        F.transform(a["n"], lambda v, i: F.when(v == a["w"], v + F.get(a["n"], i - a["w"])).otherwise(v)).alias("n"),
        (a["w"] * 2).alias("w"),
    )
    zero = F.struct(F.col(n).alias("n"), F.lit(1).alias("w"))
    df = df.withColumn(n, F.when(again, F.aggregate(steps, zero, double, lambda a: a["n"])))
    numbered = F.transform(o, lambda e, i: code(F.xxhash64(e["h"], F.get(n, i)), e["p"]))
    df = df.withColumn(s, F.sort_array(F.when(again, numbered).otherwise(once)))
    bucket = lambda x: F.shiftrightunsigned(x, 58)
    df = df.withColumn(s, F.filter(s, lambda x, i: F.coalesce(bucket(F.get(s, i - 2)) != bucket(x), F.lit(True))))
    place, rank = (lambda x: x.bitwiseAND(F.lit(0x3FFFFFF))), (lambda x: F.shiftrightunsigned(x, 26))

    def pair(x: Column, i: Column) -> Column:
        other = F.when(i + 1 < F.size(s), F.get(s, i + 1)).otherwise(F.get(s, F.lit(0)))
        return F.when(F.size(s) == 1, F.xxhash64(rank(x))).when(place(x) < place(other), F.xxhash64(rank(x), rank(other))).otherwise(F.xxhash64(rank(other), rank(x)))

    # the first k-mer of a sketch, with the one behind it, also serves the empty sketches before it
    serves = lambda x, i: bucket(x).cast("int") - F.when(i == 0, F.lit(-1)).otherwise(bucket(F.get(s, i - 1)).cast("int"))
    df = df.withColumn(n, F.flatten(F.transform(s, lambda x, i: F.array_repeat(pair(x, i), serves(x, i)))))
    ring = F.concat(n, F.array_repeat(F.get(n, F.lit(0)), SKETCHES - F.size(n)))
    return df.withColumn(name, F.transform(ring, lambda x, i: F.shiftleft(i.cast("long"), 24).bitwiseOR(x.bitwiseAND(F.lit(0xFFFFFF))))).drop(w, g, s, o, n, f"_{name}_r")


def fingerprint(sketch: Column) -> Column:
    """The sketches as text: eight hexadecimal digits each."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches."""
    return F.size(F.array_intersect(a, b)) / F.lit(SKETCHES)


def _range_of(o: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` lie below ``o``, by binary search."""
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        below = (a["lo"] < a["hi"]) & (F.get(table, mid) < o)
        return F.struct(F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(F.least(mid, a["hi"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, halve, lambda a: a["lo"])


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's rows for ``docs`` (doc_id, text).

    A null text is empty, and an empty text has one empty k-mer. A row with a null id has no next document: its
    second half is cut off, and its likeness to the next is null. Repeated ids give a row each, and of their
    texts the one of the smallest hash is the next document of the id before. Other columns are ignored.

    Ids are dealt into ranges, and texts meet their successors in one shuffle by range; only the first text of
    each range meets the range before. Rows of an id that has over a thousandth of all rows stay where they are
    and get their successor by a salted join."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("o", F.bitwise_not("doc_id")).withColumn("th", F.xxhash64("text"))  # ascending o: descending id
    parts = pieces(docs, RANGE_BYTES, most=RANGES // 4)
    ids = docs.select("doc_id", "o").where("doc_id is not null")
    share = F.split(F.lit(",".join(str(k / (4 * parts)) for k in range(1, 4 * parts))), ",").cast("array<double>")
    cuts = sorted(set(ids.agg(F.percentile_approx("o", share, max(10_000, 16 * parts))).first()[0] or []))
    each = ids.groupBy("doc_id").agg(F.count("*").alias("n"))
    total, most = each.agg(F.sum("n"), F.max("n")).first()
    hot = [r.doc_id for r in each.where(F.col("n") > max(total / 1000, HOT)).collect()] if (most or 0) > HOT else []

    docs = docs.withColumn("range", _range_of(F.col("o"), cuts))
    keyed = docs.where("doc_id is not null")
    tops = keyed.groupBy("range").agg(F.min(F.struct("o", "th")).alias("t")).orderBy("range").collect()  # at most RANGES rows
    after = [(r.range, q.t.o, q.t.th) for r, q in zip(tops, tops[1:] + tops[:1], strict=True)]
    sketched = with_sketch(docs, "text", "a")
    first = docs.sparkSession.createDataFrame(after, "of int, o long, th long")
    edge = keyed.join(F.broadcast(first), ["o", "th"]).groupBy("of").agg(F.min("text").alias("text"))
    none = F.lit(None).cast("bigint")
    edge = with_sketch(edge, "text", "a").select(none.alias("doc_id"), "text", none.alias("o"), none.alias("th"), F.col("of").alias("range"), "a", F.lit(True).alias("ghost"))

    # ghosts: rows that only give their text to the row before; the first of the next range stands last
    warm = sketched.where("doc_id is not null").withColumn("ghost", F.lit(False)).unionByName(edge)
    if hot:
        one = sketched.where(F.col("doc_id").isin(hot)).groupBy("doc_id", "o", "range").agg(F.min(F.struct("th", "text", "a")).alias("m"))
        one = one.select("doc_id", "m.text", "o", "m.th", "range", "m.a", F.lit(True).alias("ghost"))
        warm = warm.where(F.col("doc_id").isNull() | ~F.col("doc_id").isin(hot)).unionByName(one)
    in_range = W.partitionBy("range").orderBy(F.asc_nulls_last("o"), "th")
    led = warm.repartition(parts, "range").withColumn("m", F.lead(F.struct(F.col("text").alias("t"), F.col("a").alias("s"))).over(in_range))
    if (most or 0) > 1:  # of repeated ids the last row meets the next id
        led = led.withColumn("m", F.last("m").over(W.partitionBy("range", "o").orderBy("th").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    led = led.select("doc_id", "text", "a", "ghost", F.col("m.t").alias("next"), F.col("m.s").alias("c"))
    whole = led.where(~F.col("ghost")).drop("ghost")
    if hot:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        wanted = led.where("ghost and doc_id is not null").select(F.col("doc_id").alias("id"), "next", "c", salts.alias("salt"))
        salted = sketched.where(F.col("doc_id").isin(hot)).select("doc_id", "text", "a", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("s"))
        whole = whole.unionByName(salted.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("s") == F.col("salt"))).select(whole.columns))
    loose = sketched.where("doc_id is null").select("doc_id", "text", "a", F.lit("").alias("next"), F.lit(None).cast("array<bigint>").alias("c"))
    whole = whole.unionByName(loose).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    whole = whole.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next", F.lit(1), half)))
    out = with_sketch(whole.select("doc_id", "n_chars", "edited", "a", "c"), "edited", "b")
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
