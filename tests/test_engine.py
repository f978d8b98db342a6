"""Fixtures and brute-force tests of the interval, graph and relational operators."""

import random

import pytest
from pyspark.sql import functions as F

from domainforge.operators import catalog, spanning
from domainforge.operators import intervals as iv
from domainforge.operators.graph import components


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_components_fixture(spark):
    got = dict(rows(components(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 3), (4, 5), (5, 6), (9, 9)], "a long, b long")), "node", "component"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 9: 9}


def test_components_of_strings_and_chains(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "component")) == {n: find(n) for n in root}


def test_forest_is_kruskals(spark):
    r = random.Random(4)
    edges = [(r.randrange(25), r.randrange(25), float(r.randrange(6))) for _ in range(90)] + [(50, 51, 1.0), (51, 50, 1.0), (52, 52, 1.0)]
    best = {}
    for a, b, w in edges:
        if a != b:
            k = (min(a, b), max(a, b))
            best[k] = min(w, best.get(k, w))
    root = {n: n for k in best for n in k}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = []
    for w, a, b in sorted((w, a, b) for (a, b), w in best.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert rows(spanning.spanning_forest(spark.createDataFrame(edges, "a long, b long, weight double")), "a", "b", "weight") == sorted(want)


def test_interval_fixtures(spark):
    df = spark.createDataFrame([(1, s, e) for s, e in [(10, 100), (20, 50), (70, 120), (130, 200), (10, 50), (140, 210), (150, 200)]], "nid long, s int, e int")
    assert rows(iv.outermost(df, ["nid"]), "s", "e") == [(10, 100), (70, 120), (130, 200), (140, 210)]
    one = lambda *p: spark.createDataFrame([(1, *x) for x in p], "nid long, s int, e int")
    assert rows(iv.subtract(one((0, 5)), one((0, 3))), "s", "e") == [(3, 5)]
    assert rows(iv.islands(one((0, 5), (5, 8), (9, 12)), ["nid"]), "s", "e") == [(0, 8), (9, 12)]
    lengths = spark.createDataFrame([(1, 200), (2, 50)], "nid long, length int")
    assert rows(iv.gaps(one((31, 60), (60, 150)), lengths, least=30), "nid", "s", "e") == [(1, 0, 31), (1, 150, 200), (2, 0, 50)]


def test_chain(spark):
    r = random.Random(6)
    links, at = [], {}
    for _ in range(160):
        k = (r.randrange(3), r.randrange(3))
        q, s = at.get(k, (0, 0))
        q, s = q + r.choice([1, 30, 31, 0, -5, 12]), s + r.choice([1, 30, 31, 0, -5, 12])
        n = r.randrange(5, 40)
        links.append((*k, -float(r.randrange(50)), q, q + n, s, s + n))
        at[k] = (q + n, s + n)
    want = []
    for k in {x[:2] for x in links}:
        out = []
        for q, e, s, t, v in sorted((x[3], x[4], x[5], x[6], x[2]) for x in links if x[:2] == k):
            if out and 1 <= q - out[-1][1] <= 30 and 1 <= s - out[-1][3] <= 30:
                out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2], max(out[-1][3], t), min(out[-1][4], v))
            else:
                out.append((q, e, s, t, v))
        want += [(*k, *x) for x in out]
    df = spark.createDataFrame(links, "query_nid long, sbjct_nid long, evalue double, qs int, qe int, ss int, se int")
    assert rows(iv.chain(df), "query_nid", "sbjct_nid", "qs", "qe", "ss", "se", "evalue") == sorted(want)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["AGG-02", "JOI-01", "JOI-33", "INT-03", "INT-13", "WIN-16", "RPT-08", "RPT-16", "HST-29", "MKF-17", "SCL-01", "ALG-21"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    plain = lambda v: round(float(v), 4) if not isinstance(v, (str, int, type(None))) else v
    key = lambda t: tuple(str(x) for x in t)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*[F.col(f"`{c}`") for c in cols]).collect()), key=key)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=key)
    assert [tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in mine] == [tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in theirs]


def test_every_oracle_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, whole", [
    ("JOI-31", "SELECT a.nid, b.nid, a.family FROM units a JOIN units b ON a.family = b.family AND a.nid < b.nid GROUP BY a.nid, b.nid, a.family"),
    ("MKF-08", "SELECT 1 FROM sequences s JOIN units d ON d.nid = s.nid"), ("HST-19", "SELECT 1 FROM lineitem"), ("HST-29", "SELECT 1 FROM lineitem"), ("WIN-21", "SELECT 1 FROM lineitem"),
])
def test_whole_tables(spark, name, whole):
    """Every row of the tables takes part, and DuckDB gives the same."""
    from domainforge.operators.views import run_sql

    assert catalog.QUERIES[name](spark, SMALL).count() == run_sql(spark, SMALL, whole).count()
    test_against_duckdb(spark, name)


def test_distances_to_the_end(spark, tmp_path):
    lines = [(k, n + 1, k + n, 0.1) for k in range(12) for n in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert dict(rows(catalog.QUERIES["GRF-13"](spark, str(tmp_path)), "node", "depth")) == {k: k for k in range(13)}


@pytest.mark.parametrize("name", ["INT-05", "TBL-68", "INT-01"])
def test_islands_of_rows_without_values(spark, tmp_path, name):
    """Rows without a start or an end come last in the order of a family, as in the SQL; no two rows are equal."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(5)
    lines = {(r.randrange(60), r.choice([None, *range(1, 8)]), r.choice([None, *map(float, range(1, 51))]), r.choice("AN"), "F") for _ in range(1500)}
    spark.createDataFrame(sorted(lines, key=str), "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    plain = lambda row: tuple(str(v) for v in row)
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(plain, got)) == sorted(map(plain, found.fetchall()))
