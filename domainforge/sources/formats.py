"""Readers and writers of the engine's text formats. Everything is parsed by column expressions.

Lines that begin with # and empty lines are skipped everywhere; a header is recognised by its first field. A row
with too few fields is an error, or left out with ``bad="drop"``. Gzip and bzip2 files are told by their suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Paths = str | Sequence[str]
#: First fields of header lines.
HEADERS = ("nid", "id", "pid", "query", "query_nid", "qdomain", "query_token", "class", "bin")
LINKS = "query string, sbjct string, evalue double, query_from int, query_to int, query_ali string, sbjct_from int, sbjct_to int, sbjct_ali string"
TESTED = "qdomain string, sdomain string, weight double, passed string, qstart int, qend int, qali string, sstart int, send int, sali string, score double, naligned int, ngaps int, zscore double"
SEGMENTS = "nid long, node int, parent int, level int, start int, end int"
COMPLEMENT = ("ACGTacgtNnXx-", "TGCAtgcaNnXx-")


def lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(value): lines that are no comments."""
    return spark.read.text(paths).where("value <> '' AND NOT startswith(value, '#')")


def fields(rows: DataFrame, schema: str, bad: str = "fail", separator: str = "\t", missing: str = "na") -> DataFrame:
    """Tab-separated lines as columns; further fields are ignored, ``missing`` is null, and any other text that is
    no number where one belongs is an error."""
    part = F.split("value", separator)
    names = [tuple(x.split()) for x in schema.split(",")]
    known = rows.where(~part[0].isin(*HEADERS)).withColumn("_p", part)
    if bad == "drop":
        known = known.where(F.size("_p") >= len(names))
        read = lambda c, kind: c.try_cast(kind)
    else:
        known = known.where(F.when(F.size("_p") < len(names), F.raise_error(F.concat(F.lit("too few fields: "), "value")).cast("boolean")).otherwise(True))
        read = lambda c, kind: c.cast(kind)
    return known.select(*(read(F.nullif(F.col("_p")[k], F.lit(missing)), kind).alias(name) for k, (name, kind) in enumerate(names)))


def write_lines(df: DataFrame, columns: Sequence[str], path: str, header: bool = True, mode: str = "errorifexists", compression: str = "none") -> None:
    """Tab-separated lines, null as na, with the names as a comment line in front of each part."""
    body = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("na")) for c in columns))
    first = F.when(F.row_number().over(W.partitionBy("_part").orderBy("_n")) == 1, F.concat(F.lit("#" + "\t".join(columns) + "\n"), body)).otherwise(body) if header else body
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    placed.select(first.alias("value")).write.mode(mode).option("compression", compression).text(path)


# ---- sequences ----


def read_fasta(spark: SparkSession, paths: Paths) -> DataFrame:
    """(pid, title, sequence): records that begin with >; sequences over several lines are joined, and pid is the
    title up to the first white space. Files are split between records."""
    records = spark.read.option("lineSep", "\n>").text(paths)
    kept = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    parts = records.select(kept.alias("p")).where(F.size("p") > 0)
    title = F.regexp_replace(F.col("p")[0], "^>", "")
    return parts.select(F.regexp_extract(title, r"^\S+", 0).alias("pid"), title.alias("title"), F.regexp_replace(F.array_join(F.slice("p", 2, F.size("p")), ""), r"\s", "").alias("sequence"))


def write_fasta(df: DataFrame, title: str, sequence: str, path: str, width: int = 60, mode: str = "errorifexists") -> None:
    body = F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(title).cast("string"), F.lit("\n"), body).alias("value")).write.mode(mode).text(path)


def get_sequences(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (pid, strand, start, end) with the sequence of each stretch. An end of 0 is the whole rest; the
    minus strand is reversed and complemented; a stretch beyond the sequence is an error."""
    found = wanted.join(store.select("pid", F.col("sequence").alias("_s")), "pid")
    end = F.when(F.col("end") == 0, F.length("_s")).otherwise(F.col("end"))
    wrong = (F.col("start") < 0) | (end > F.length("_s")) | (F.col("start") > end)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("stretch beyond sequence "), F.col("pid")))).otherwise(F.substring("_s", F.col("start") + 1, end - F.col("start")))
    turned = F.when(F.col("strand") == "-", F.reverse(F.translate(checked, *COMPLEMENT))).otherwise(checked)
    return found.withColumn("sequence", turned).drop("_s")


# ---- links ----


def read_links(spark: SparkSession, paths: Paths, layout: str = "pairsdb", bad: str = "fail") -> DataFrame:
    """Links in one of the layouts: pairsdb (natural logarithms of e-values, emission texts), pairsdb-old (starts
    from 1), pairsdb-realign (alignments are to be made again), pairsdb-blocks (e-values as they are, 0 being
    -200, and lists of blocks), simap (coordinates only)."""
    rows = lines(spark, paths)
    if layout in ("pairsdb", "pairsdb-old", "pairsdb-realign"):
        out = fields(rows, LINKS, bad)
        if layout == "pairsdb-old":
            out = out.withColumn("query_from", F.col("query_from") - 1).withColumn("sbjct_from", F.col("sbjct_from") - 1)
        return out.drop("query_ali", "sbjct_ali") if layout == "pairsdb-realign" else out
    short = "query string, sbjct string, evalue double, query_from int, query_to int, sbjct_from int, sbjct_to int"
    if layout == "simap":
        return fields(rows, short, bad)
    if layout != "pairsdb-blocks":
        raise ValueError(f"no layout {layout}")
    out = fields(rows, short + ", block_sizes string, query_starts string, sbjct_starts string", bad)
    out = out.withColumn("evalue", F.when(F.col("evalue") == 0, -200.0).otherwise(F.log("evalue")))
    for c in ("block_sizes", "query_starts", "sbjct_starts"):
        out = out.withColumn(c, F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int")))
    return out


def translated(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links between known sequences, with nids (of ``ids``: pid, nid) for names; empty stretches are dropped."""
    q, s = (ids.select(F.col("pid").alias(side), F.col("nid").alias(f"{side}_nid")) for side in ("query", "sbjct"))
    return links.where("query_from < query_to AND sbjct_from < sbjct_to").join(q, "query").join(s, "sbjct")


def neighbours(links: DataFrame) -> DataFrame:
    """(query_nid, neighbours): all links of a query. One row holds a query's links, so callers bound their number."""
    cells = F.struct("sbjct_nid", "evalue", "query_from", "query_to", "sbjct_from", "sbjct_to")
    return links.groupBy("query_nid").agg(F.array_sort(F.collect_list(cells)).alias("neighbours"))


def write_graph(links: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Links as a store for access by query: one folder for each bucket of queries, sorted by query."""
    placed = links.withColumn("bucket", F.pmod(F.hash("query_nid"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").sortWithinPartitions("query_nid").write.mode(mode).partitionBy("bucket").parquet(path)


def read_graph(spark: SparkSession, path: str, nids: Sequence[int] | None = None, buckets: int = 64) -> DataFrame:
    """The links of a store, or those of some queries; then only their buckets are read."""
    graph = spark.read.parquet(path)
    if nids is None:
        return graph.drop("bucket")
    kind = graph.schema["query_nid"].dataType
    wanted = spark.createDataFrame([(n,) for n in nids], "n long").select(F.pmod(F.hash(F.col("n").cast(kind)), F.lit(buckets)).alias("b")).distinct()
    return graph.where(F.col("bucket").isin([r.b for r in wanted.collect()]) & F.col("query_nid").isin(list(nids))).drop("bucket")


# ---- other tables ----


def read_domains(spark: SparkSession, paths: Paths, ids: DataFrame | None = None, include: str | None = None) -> DataFrame:
    """(nid, start, end, family): domains, ids translated by (pid, nid), families that contain a pattern."""
    out = fields(lines(spark, paths), "id string, start int, end int, family string")
    out = out.where(F.col("family").rlike(include)) if include else out
    return out.join(ids.select(F.col("pid").alias("id"), "nid"), "id").drop("id") if ids is not None else out.withColumnRenamed("id", "nid")


def read_segments(spark: SparkSession, paths: Paths) -> DataFrame:
    """Tree nodes with ``child``: 1 for the left and 2 for the right child, by the order of their numbers."""
    out = fields(lines(spark, paths), SEGMENTS)
    nodes = out.select("nid", "node", "parent").distinct().withColumn("child", F.row_number().over(W.partitionBy("nid", "parent").orderBy("node")))
    return out.join(nodes, ["nid", "node", "parent"])


def read_parameters(spark: SparkSession, paths: Paths) -> DataFrame:
    """(bin, value) for every bin from 0 to the largest, 0 where the file has none."""
    known = fields(lines(spark, paths), "bin int, value double").cache()
    most = known.agg(F.max("bin")).first()[0]
    every = spark.range(0, (most if most is not None else -1) + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(known, "bin", "left").fillna(0.0, ["value"])


def read_pfam(spark: SparkSession, paths: Paths) -> DataFrame:
    """(nid, start, end, family) of a flat file of proteins: a line ``>protein ...`` and below it a line for each
    family with its accession and ranges a-b, counted from 1; automatic families (PB...) are skipped."""
    records = spark.read.option("lineSep", "\n>").text(paths)
    protein = F.regexp_extract("value", r"^>?(\S+)", 1)
    rows = records.select(protein.alias("nid"), F.explode(F.split("value", "\n")).alias("line"))
    known = rows.withColumn("family", F.regexp_extract("line", r"\b(PF[0-9]+)", 1)).where("family <> ''")
    ranges = F.regexp_extract_all("line", F.lit(r"(?<=\s)[0-9]+-[0-9]+"), F.lit(0))
    flat = known.select("nid", "family", F.explode(ranges).alias("r"))
    return flat.select("nid", (F.split("r", "-")[0].cast("int") - 1).alias("start"), F.split("r", "-")[1].cast("int").alias("end"), "family")


def read_table(spark: SparkSession, paths: Paths, header: bool = True, ragged: str = "PERMISSIVE", separator: str = "\t") -> DataFrame:
    """A table with inferred types; ``ragged`` is PERMISSIVE, DROPMALFORMED or FAILFAST."""
    return spark.read.option("sep", separator).option("header", header).option("comment", "#").option("inferSchema", True).option("mode", ragged).option("nullValue", "na").csv(paths)


def column_types(df: DataFrame) -> DataFrame:
    """(column, type): int, float or string, by the texts of all rows; a column without values is empty."""
    tests = []
    for c in df.columns:
        text = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        whole, number = F.sum((text.isNotNull() & text.try_cast("bigint").isNull()).cast("int")), F.sum((text.isNotNull() & text.try_cast("double").isNull()).cast("int"))
        tests.append(F.struct(F.lit(c).alias("column"), F.when(F.count(text) == 0, "empty").when(whole == 0, "int").when(number == 0, "float").otherwise("string").alias("type")))
    return df.agg(F.array(*tests).alias("t")).select(F.explode("t").alias("t")).select("t.*")


def read_matrix(spark: SparkSession, paths: Paths, low: float | None = None, high: float | None = None) -> DataFrame:
    """(name, values): rows of numbers behind a name, limited to a range; texts that are no numbers are null."""
    clip = lambda v: F.least(F.greatest(v, F.lit(low if low is not None else float("-inf"))), F.lit(high if high is not None else float("inf")))
    part = F.split("value", "\t")
    return lines(spark, paths).select(part[0].alias("name"), F.transform(F.slice(part, 2, F.size(part)), lambda x: F.when(x.try_cast("double").isNotNull(), clip(x.try_cast("double")))).alias("values"))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a written folder is whole: its writer has committed it."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def merge(spark: SparkSession, path: str, target: str, parts: int = 1) -> bool:
    """Rewrite a folder of lines as ``parts`` files; False if that is done already, an error if the folder isn't whole."""
    if is_complete(spark, target):
        return False
    if not is_complete(spark, path):
        raise ValueError(f"{path} is incomplete")
    spark.read.text(path).coalesce(parts).write.text(target)
    return True


def grouped_lines(rows: DataFrame, key: Column) -> DataFrame:
    """(key, n, lines): the lines of each key in their order."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("value")).alias("lines"))
