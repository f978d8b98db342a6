"""Every query of the newer modules against its SQL on the smallest tables, and the parts behind them by plain loops."""

import math
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from domainforge.functions import maps, statistics
from domainforge.operators import aligned, files, mapped, rules, tables
from domainforge.plans.ranges import with_previous
from domainforge.sources import formats
from domainforge.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark labels".split():
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("module", [aligned, files, mapped, rules, tables], ids=lambda m: m.__name__.rsplit(".", 1)[1])
def test_queries_against_sql(spark, db, module):
    for name, run in module.QUERIES.items():
        got = run(spark, SF)
        names = sorted(got.columns)
        found = db.execute(module.ORACLES[name])
        own = [d[0] for d in found.description]
        want = sorted([plain(r[own.index(c)]) for c in names] for r in found.fetchall())
        assert sorted([plain(r[c]) for c in names] for r in got.collect()) == want and want, name


def test_fasta_layouts(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("# head\n>one first of all\nABC\n\n# note\n DE F\n>two\n>three\tx\nGG>H\n")
    got = sorted(tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "a.fasta")).collect())
    assert got == [("one", "one first of all", "ABCDEF"), ("three", "three\tx", "GG>H"), ("two", "two", "")]


def test_rows_with_too_few_fields(spark, tmp_path):
    (tmp_path / "links.tsv").write_text("query\tsbjct\tevalue\nq\ts\t-1.5\t0\t9\t+9\t1\t10\t+9\textra\nshort\ts\t-1\n")
    path = str(tmp_path / "links.tsv")
    assert [r.query for r in formats.read_links(spark, path, bad="drop").collect()] == ["q"]
    with pytest.raises(Exception, match="too few fields"):
        formats.read_links(spark, path).collect()


def test_emissions(spark):
    """ABCDE against +3-3+2 and the like, by a walk over the columns."""
    r = random.Random(3)

    def text(n):
        out, signs = [], "+-" if r.random() < 0.5 else "-+"
        for k in range(n):
            out.append(f"{signs[k % 2]}{r.randint(1, 4)}")
        return "".join(out)

    def walk(ali, at):
        import re

        for sign, n in re.findall(r"([+-])([0-9]+)", ali):
            for _ in range(int(n)):
                yield at if sign == "+" else None
                at += sign == "+"

    rows = [(k, r.randint(0, 9), text(r.randint(1, 5)), r.randint(0, 9), text(r.randint(1, 5))) for k in range(200)]
    frame = spark.createDataFrame(rows, "k int, a int, x string, b int, y string")
    got = {x.k: [tuple(p) for p in x.p] for x in frame.select("k", F.array_sort(maps.aligned_pairs(maps.from_emissions(F.col("a"), F.col("x"), F.col("b"), F.col("y")))).alias("p")).collect()}
    for k, a, x, b, y in rows:
        assert got[k] == [(p, q) for p, q in zip(walk(x, a), walk(y, b)) if p is not None and q is not None], (x, y)


def test_chi_squared_tail(spark):
    """Known values, and the closed form for even degrees of freedom."""
    frame = spark.createDataFrame([(x, d) for x in (0.01, 0.5, 3.841458820694124, 20.0, 90.0) for d in range(1, 12)], "x double, d int")
    for r in frame.select("x", "d", statistics.chi_squared_tail(F.col("x"), F.col("d")).alias("p")).collect():
        want = math.erfc(math.sqrt(r.x / 2)) if r.d % 2 else math.exp(-r.x / 2)
        for k in range(2 - r.d % 2, r.d, 2):
            want += math.exp(-r.x / 2 + k / 2 * math.log(r.x / 2) - math.lgamma(k / 2 + 1))
        assert abs(r.p - want) < 1e-9, r


def test_even_tail_is_a_short_sum(spark):
    """Some hundred thousand rows with even degrees of freedom take seconds: no 400 steps for each of them."""
    began = time.time()
    x = F.col("id") % 97
    found = spark.range(400_000).select(statistics.chi_squared_tail(x.cast("double"), F.lit(4)).alias("p")).agg(F.sum("p")).first()[0]
    assert time.time() - began < 20
    assert abs(found - sum(math.exp(-v / 2) * (1 + v / 2) * len(range(v, 400_000, 97)) for v in range(97))) < 1e-6


def test_order_over_ranges(spark, monkeypatch):
    from domainforge.plans import ranges

    monkeypatch.setattr(ranges, "RANGE_BYTES", 1000)
    r = random.Random(2)
    values = [(k, r.randint(0, 9)) for k in r.sample(range(10**6), 3000)]
    got = {x.k: x.before for x in with_previous(spark.createDataFrame(values, "k long, v int").repartition(7), "k", "v", "before").collect()}
    ordered = sorted(values)
    assert got == {k: (ordered[i - 1][1] if i else None) for i, (k, _) in enumerate(ordered)}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("t", "k long, v string")
    with pytest.raises(ValueError):
        store.create("t", "k long")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    store.load("t", new, ["k"])
    store.load("t", spark.createDataFrame([(2, "x"), (None, "y"), (3, "z")], "k long, v string"), ["k"])
    assert sorted(map(tuple, store.read("t").collect()), key=str) == [(1, "a"), (2, "b"), (3, "z"), (None, "c")]
    store.load("t", spark.createDataFrame([(2, "x"), (None, "y")], "k long, v string"), ["k"], "replace")
    assert sorted(map(tuple, store.update("t", {"v": F.lit("!")}, F.col("k") > 2).collect()), key=str) == [(1, "a"), (2, "x"), (3, "!"), (None, "y")]
    assert store.delete("t", F.col("k") > 1).count() == 2 and store.tables() == ["t"]
    with pytest.raises(ValueError):
        store.read("nothing")
