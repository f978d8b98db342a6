"""Queries that write the engine's formats into the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from domainforge.operators.views import view, with_views
from domainforge.plans.scratch import scratch_dir
from domainforge.sources import formats as fm

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, source: str, sql: str):
    """Register ``f(spark, path, *views)``; ``path`` is a new folder."""

    def put(f):
        QUERIES[name] = lambda spark, d: f(spark, f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}", *(view(spark, d, v) for v in source.split()))
        ORACLES[name] = with_views(sql)
        return f

    return put


def _name(a: str = "ali", b: str = "rid"):
    return F.concat(F.col(a).cast("string"), F.lit("."), F.col(b).cast("string"))


def _stored(spark, path, mali):
    fm.write_fasta(mali.select(F.concat(_name(), F.lit(" row of an alignment")).alias("t"), "aligned"), "t", "aligned", path, 10)
    return fm.read_fasta(spark, path)


_FASTA = "SELECT concat(ali, '.', rid) AS pid, concat(ali, '.', rid, ' row of an alignment') AS title, aligned AS sequence FROM mali"
query("SRC-01", "mali", _FASTA)(_stored)
query("SRC-04", "mali", "SELECT concat(ali, '.', rid) AS pid, length(aligned) AS length FROM mali")(lambda spark, path, m: (_stored(spark, path, m).write.parquet(path + "-store"), spark.read.parquet(path + "-store").select("pid", F.length("sequence").alias("length")))[1])
query("SRC-05", "mali", "SELECT concat(ali, '.', rid) AS pid, count(*) AS n FROM mali CROSS JOIN range(2) t GROUP BY ali, rid")(
    lambda spark, path, m: ([m.select(_name().alias("pid"), F.col("aligned").alias("sequence")).write.mode("append").parquet(path) for _ in range(2)], spark.read.parquet(path).groupBy("pid").agg(F.count("*").alias("n")))[1]
)


@query("SRC-02", "mali", "SELECT concat(ali, '.', rid) AS pid, replace(aligned, '-', '') AS sequence FROM mali WHERE replace(aligned, '-', '') <> ''")
def commented(spark, path, mali):
    """Comments and empty lines inside of records."""
    bare = F.translate("aligned", "-", "")
    mali.where(bare != "").select(F.concat(F.lit("# note\n>"), _name(), F.lit("\tx\n\n"), F.substring(bare, 1, 3), F.lit("\n# more\n  "), F.substring(bare, 4, 99)).alias("value")).write.text(path)
    return fm.read_fasta(spark, path).select("pid", "sequence")


@query("SRC-06", "mali", """SELECT concat(ali, '.', rid) AS pid, CASE WHEN rid % 2 = 0 THEN '-' ELSE '+' END AS strand, rid AS start, CASE WHEN rid = 3 THEN 0 ELSE 12 END AS end,
    CASE WHEN rid % 2 = 0 THEN reverse(translate(aligned[rid + 1:12], 'ACGTacgtNnXx-', 'TGCAtgcaNnXx-')) WHEN rid = 3 THEN aligned[4:] ELSE aligned[rid + 1:12] END AS sequence FROM mali""")
def stretches(spark, path, mali):
    wanted = mali.select(_name().alias("pid"), F.when(F.col("rid") % 2 == 0, "-").otherwise("+").alias("strand"), F.col("rid").alias("start"), F.when(F.col("rid") == 3, 0).otherwise(12).alias("end"))
    return fm.get_sequences(_stored(spark, path, mali), wanted)


@query("SRC-09", "mali", "SELECT concat(ali, '.', rid) AS pid FROM mali WHERE rid = 4 AND aligned[1:1] <> 'A'")
def verified(spark, path, mali):
    """Rows that differ between two stores."""
    other = mali.select(_name().alias("pid"), F.when(F.col("rid") == 4, F.concat(F.lit("A"), F.substring("aligned", 2, 99))).otherwise(F.col("aligned")).alias("b"))
    return _stored(spark, path, mali).join(other, "pid").where("sequence <> b").select("pid")


def _links(blocked):
    hi = F.col("a") + F.col("b")
    return blocked.select(F.concat(F.lit("p"), F.col("q").cast("string")).alias("query"), F.concat(F.lit("p"), F.col("t").cast("string")).alias("sbjct"), (-F.col("g") * 1.5).alias("evalue"), F.col("q_from").alias("query_from"), (F.col("q_from") + hi).alias("query_to"), F.col("q_ali").alias("query_ali"), F.col("s_from").alias("sbjct_from"), (F.col("s_from") + hi + F.col("g")).alias("sbjct_to"), F.col("s_ali").alias("sbjct_ali"), "sizes", "q_starts", "s_starts")


_NINE = "query sbjct evalue query_from query_to query_ali sbjct_from sbjct_to sbjct_ali".split()
_SEVEN = "query sbjct evalue query_from query_to sbjct_from sbjct_to".split()
_SQL = "SELECT concat('p', q) AS query, concat('p', t) AS sbjct, {evalue} AS evalue, q_from - {d} AS query_from, q_from + a + b AS query_to, {qa} s_from - {d} AS sbjct_from, s_from + a + g + b AS sbjct_to {sa} FROM blocked"


def _written(layout: str, columns: list[str], change=lambda x: x):
    def read(spark, path, blocked):
        fm.write_lines(change(_links(blocked)), columns, path)
        return fm.read_links(spark, path, layout)

    return read


_whole = {"evalue": "-1.5e0 * g", "d": 0, "qa": "q_ali AS query_ali,", "sa": ", s_ali AS sbjct_ali"}
query("SRC-10", "blocked", _SQL.format(**_whole))(_written("pairsdb", [*_NINE, "sizes"]))
query("SRC-11", "blocked", _SQL.format(**{**_whole, "d": 1}))(_written("pairsdb-old", _NINE))
query("SRC-13", "blocked", _SQL.format(**{**_whole, "qa": "", "sa": ""}))(_written("simap", _SEVEN))
query("SRC-14", "blocked", _SQL.format(**{**_whole, "qa": "", "sa": ""}))(_written("pairsdb-realign", _NINE))


@query("SRC-12", "blocked", """SELECT concat('p', q) AS query, concat('p', t) AS sbjct, CASE WHEN g = 1 THEN -200e0 ELSE round(ln(g * 1e-5), 9) END AS evalue, a + b AS total, q_from + a AS second, s_from + a + g AS other FROM blocked""")
def blocks(spark, path, blocked):
    raw = _links(blocked.withColumn("sizes", F.col("sizes"))).withColumn("evalue", F.when(F.col("evalue") == -1.5, 0.0).otherwise(F.col("evalue") / -1.5 * 1e-5))
    fm.write_lines(raw, [*_SEVEN, "sizes", "q_starts", "s_starts"], path)
    got = fm.read_links(spark, path, "pairsdb-blocks")
    return got.select("query", "sbjct", F.round("evalue", 9).alias("evalue"), F.aggregate("block_sizes", F.lit(0), lambda a, x: a + x).alias("total"), F.col("query_starts")[1].alias("second"), F.col("sbjct_starts")[1].alias("other"))


def _graph(spark, path, blocked):
    fm.write_lines(_links(blocked), _NINE, path)
    ids = blocked.select(F.concat(F.lit("p"), F.col("q").cast("string")).alias("pid"), F.col("q").alias("nid")).where("nid <> 3").distinct()
    return fm.translated(fm.read_links(spark, path), ids)


_KNOWN = "(SELECT b.* FROM blocked b WHERE q <> 3 AND t <> 3 AND t IN (SELECT q FROM blocked))"
query("SRC-15", "blocked", f"SELECT q AS query_nid, CAST(t AS BIGINT) AS sbjct_nid, -1.5e0 * g AS evalue FROM {_KNOWN} x")(lambda spark, path, b: _graph(spark, path, b).select("query_nid", "sbjct_nid", "evalue"))
query("SRC-16", "blocked", f"SELECT q AS query_nid, CAST(count(*) AS INT) AS n, CAST(min(t) AS BIGINT) AS first_nid, sum(a + b) AS residues FROM {_KNOWN} x GROUP BY q")(
    lambda spark, path, b: fm.neighbours(_graph(spark, path, b)).select("query_nid", F.size("neighbours").alias("n"), F.col("neighbours")[0]["sbjct_nid"].alias("first_nid"), F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, x: a + x["query_to"] - x["query_from"]).alias("residues"))
)


def _store(spark, path, blocked, nids=None):
    fm.write_graph(blocked.select(F.col("q").alias("query_nid"), F.col("t").alias("sbjct_nid"), "g"), path, 16)
    return fm.read_graph(spark, path, nids, 16)


query("SRC-17", "blocked", "SELECT q AS query_nid, count(*) AS links FROM blocked GROUP BY q")(lambda spark, path, b: _store(spark, path, b).groupBy("query_nid").agg(F.count("*").alias("links")))
query("SRC-19", "blocked", "SELECT q AS query_nid, t AS sbjct_nid, g FROM blocked WHERE q IN (1, 2, 5, 7)")(lambda spark, path, b: _store(spark, path, b, [1, 2, 5, 7, -9]))
query("SRC-20", "blocked", "SELECT q AS query_nid, t AS sbjct_nid, g FROM blocked")(_store)
query("SRC-25", "blocked", "SELECT q AS query_nid, 'missing' AS problem FROM blocked WHERE t = 1 AND q % 50 = 0")(
    lambda spark, path, b: b.select(F.col("q").alias("query_nid"), F.col("t").alias("sbjct_nid"), "g").exceptAll(_store(spark, path, b.where("NOT (t = 1 AND q % 50 = 0)"))).select("query_nid", F.lit("missing").alias("problem"))
)


@query("SRC-26", "lengths", "SELECT nid, length FROM lengths")
def streams(spark, path, lengths):
    """Plain, gzip and bzip2 files as one."""
    for k, kind in enumerate(("none", "gzip", "bzip2")):
        fm.write_lines(lengths.where(F.pmod("nid", F.lit(3)) == k), ["nid", "length"], f"{path}-{k}", compression=kind)
    return fm.fields(fm.lines(spark, [f"{path}-{k}" for k in range(3)]), "nid long, length long")


query("SRC-28", "sequences", "SELECT nid, pid FROM sequences")(lambda spark, path, s: (fm.write_lines(s, ["nid", "pid", "length"], path), fm.fields(fm.lines(spark, path), "nid long, pid string"))[1])


@query("SRC-29", "domains", "SELECT nid, family, CAST(count(*) AS INT) AS n, min(s) AS lo, max(e) AS hi FROM domains WHERE family LIKE '%F%' AND nid % 2 = 0 GROUP BY nid, family")
def domain_lists(spark, path, domains):
    fm.write_lines(domains.select(F.concat(F.lit("p"), F.col("nid").cast("string")).alias("id"), F.col("s").alias("start"), F.col("e").alias("end"), "family"), ["id", "start", "end", "family"], path)
    ids = domains.where("nid % 2 = 0").select(F.concat(F.lit("p"), F.col("nid").cast("string")).alias("pid"), "nid").distinct()
    lists = fm.read_domains(spark, path, ids, "F").groupBy("nid", "family").agg(F.collect_list(F.struct("start", "end")).alias("l"))
    return lists.select("nid", "family", F.size("l").alias("n"), F.array_min(F.transform("l", lambda x: x["start"])).alias("lo"), F.array_max(F.transform("l", lambda x: x["end"])).alias("hi"))


@query("SRC-30", "tested", "SELECT concat(q, '_0_9') AS qdomain, concat(t, '_0_9') AS sdomain, weight, passed, naligned, CASE WHEN naligned > 25 THEN naligned / 2e0 END AS zscore FROM tested")
def tested_links(spark, path, tested):
    one = F.lit(1)
    rows = tested.select(F.concat(F.col("q").cast("string"), F.lit("_0_9")).alias("qdomain"), F.concat(F.col("t").cast("string"), F.lit("_0_9")).alias("sdomain"), "weight", "passed", one.alias("qstart"), one.alias("qend"), F.lit("+1").alias("qali"), one.alias("sstart"), one.alias("send"), F.lit("+1").alias("sali"), F.lit(2.5).alias("score"), "naligned", one.alias("ngaps"), F.when(F.col("naligned") > 25, F.col("naligned") / 2).alias("zscore"))
    fm.write_lines(rows, rows.columns, path)
    return fm.fields(fm.lines(spark, path), fm.TESTED).select("qdomain", "sdomain", "weight", "passed", "naligned", "zscore")


@query("SRC-31", "trees", "SELECT nid, node, parent, level, s AS start, e AS end, CAST(row_number() OVER (PARTITION BY nid, parent ORDER BY node) AS INT) AS child FROM trees")
def trees(spark, path, nodes):
    fm.write_lines(nodes.select("nid", "node", "parent", "level", F.col("s").alias("start"), F.col("e").alias("end")), ["nid", "node", "parent", "level", "start", "end"], path)
    return fm.read_segments(spark, path)


query("SRC-32", "domains", "SELECT nid, s AS start, e AS end FROM domains")(lambda spark, path, d: (fm.write_lines(d, ["nid", "s", "e"], path), fm.fields(fm.lines(spark, path), "nid long, start int, end int"))[1])
query("SRC-33", "refs", "SELECT CAST(r.bin AS INT) AS bin, coalesce(1e0 * n, 0e0) AS value FROM range(0, (SELECT max(e - s) + 1 FROM refs WHERE (e - s) % 3 <> 1)) r(bin) LEFT JOIN (SELECT e - s AS b, count(*) AS n FROM refs WHERE (e - s) % 3 <> 1 GROUP BY 1) h ON h.b = r.bin")(
    lambda spark, path, d: (fm.write_lines(d.where("(e - s) % 3 <> 1").groupBy(F.expr("e - s").alias("bin")).agg(F.count("*").cast("double").alias("value")), ["bin", "value"], path), fm.read_parameters(spark, path))[1]
)


@query("SRC-35", "lengths", "SELECT nid, length FROM lengths")
def merged(spark, path, lengths):
    """Parts into one file; a second merge does nothing."""
    fm.write_lines(lengths.repartition(5), ["nid", "length"], path)
    if not fm.merge(spark, path, path + "-merged") or fm.merge(spark, path, path + "-merged"):
        raise ValueError("merged twice or not at all")
    return fm.fields(fm.lines(spark, path + "-merged"), "nid long, length long")


query("SRC-36", "lengths", "SELECT true AS written, false AS other")(lambda spark, path, x: (x.write.parquet(path), spark.range(1).select(F.lit(fm.is_complete(spark, path)).alias("written"), F.lit(fm.is_complete(spark, path + "-x")).alias("other")))[1])
query("SRC-40", "domains", "SELECT CAST(nid AS VARCHAR) AS key, count(*) AS n, min(concat(nid, chr(9), s)) AS first_line FROM domains GROUP BY nid")(
    lambda spark, path, d: (fm.write_lines(d, ["nid", "s"], path), fm.grouped_lines(fm.lines(spark, path), F.split("value", "\t")[0]).select("key", "n", F.col("lines")[0].alias("first_line")))[1]
)
query("SRC-48", "tested", "SELECT q, t, weight, passed FROM tested WHERE naligned > 40")(lambda spark, path, x: (x.where("naligned > 40").select("q", "t", "weight", "passed").write.option("sep", "\t").option("header", True).csv(path), fm.read_table(spark, path))[1])
query("SRC-50", "tested", "SELECT * FROM (VALUES ('q', 'int'), ('t', 'int'), ('weight', 'float'), ('passed', 'string'), ('none', 'empty')) x(\"column\", type)")(lambda spark, path, x: fm.column_types(x.select("q", "t", "weight", "passed", F.lit("").alias("none"))))
query("SRC-51", "tested", "SELECT concat(q, '.', t) AS name, sum(CASE WHEN weight > 5e4 THEN 5e4 ELSE greatest(weight, 1e4) END) AS total FROM tested GROUP BY q, t")(
    lambda spark, path, x: (fm.write_lines(x.select(_name("q", "t").alias("name"), "weight", F.lit("x").alias("y")), ["name", "weight", "y"], path), fm.read_matrix(spark, path, 1e4, 5e4).groupBy("name").agg(F.sum(F.col("values")[0]).alias("total")))[1]
)
query("SRC-54", "tested", "SELECT naligned AS value FROM tested WHERE passed = '+'")(lambda spark, path, x: (fm.write_lines(x.select(F.when(F.col("passed") == "+", F.col("naligned").cast("string")).otherwise("none").alias("v")), ["v"], path), fm.lines(spark, path).select(F.col("value").try_cast("int").alias("value")).where("value IS NOT NULL"))[1])
query("SRC-55", "domains", "SELECT family, nid, s FROM domains WHERE family IN ('AF', 'NO')")(lambda spark, path, d: (d.select("family", "nid", "s").write.partitionBy("family").parquet(path), spark.read.parquet(f"{path}").where("family IN ('AF', 'NO')").select("family", "nid", "s"))[1])
query("SRC-56", "domains", "SELECT nid, count(*) AS n FROM domains GROUP BY nid HAVING count(*) > 3")(lambda spark, path, d: (d.groupBy("nid").agg(F.count("*").alias("n")).where("n > 3").write.option("sep", "\t").csv(path), spark.read.schema("nid long, n long").option("sep", "\t").csv(path))[1])
query("SRC-57", "domains", "SELECT nid, s, e, family FROM domains")(lambda spark, path, d: (d.write.option("sep", "\t").csv(path), spark.read.schema("nid long, s int, e int, family string").option("sep", "\t").csv(path))[1])
query("SRC-59", "mali", "SELECT concat(ali, '.', rid) AS name, CAST(4 AS INT) AS n, 1e0 * (s + e + ali + rid) AS total FROM mali")(
    lambda spark, path, m: (fm.write_lines(m.select(_name().alias("name"), "s", "e", "ali", "rid"), ["name", "s", "e", "ali", "rid"], path), fm.read_matrix(spark, path).select("name", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))[1]
)
query("SRC-60", "mali", "SELECT concat(ali, chr(9), rid, chr(9), s, chr(9), e) AS value FROM mali")(lambda spark, path, m: (fm.write_lines(m, ["ali", "rid", "s", "e"], path, header=False), spark.read.text(path))[1])


@query("SRC-64", "mali", "SELECT concat('P', ali) AS nid, s AS start, e AS end, printf('PF%05d', rid) AS family FROM mali WHERE rid <> 2 UNION ALL SELECT concat('P', ali), s + 100, e + 100, printf('PF%05d', rid) FROM mali WHERE rid <> 2")
def pfam(spark, path, mali):
    line = F.concat(F.lit("name\t1 (5) "), F.when(F.col("rid") == 2, "PB").otherwise("PF"), F.format_string("%05d", "rid"), F.lit(".3 text "), *(x for d in (0, 100) for x in ((F.col("s") + 1 + d).cast("string"), F.lit("-"), (F.col("e") + d).cast("string"), F.lit(" "))))
    mali.groupBy("ali").agg(F.array_join(F.collect_list(line), "\n").alias("l")).select(F.concat(F.lit(">P"), F.col("ali").cast("string"), F.lit(" |===| 100 a.a.\n"), F.col("l")).alias("value")).write.text(path)
    return fm.read_pfam(spark, path)
