"""Layouts of archives, damage, and the registered query against its SQL."""

import glob
import gzip
import random
import zlib

import duckdb
import pytest

from domainforge.llm import warc


def made(n, r):
    return [warc.record(k, f"u{k}", "response", bytes(20), 5, r.randbytes(r.choice([0, 3, 5000, 70_000])), None) for k in range(n)]


def test_every_layout_gives_every_record(monkeypatch):
    r = random.Random(3)
    own = made(30, r)
    whole = b"".join(own)
    layouts = [gzip.compress(whole), b"".join(map(gzip.compress, own)), gzip.compress(b"".join(own[:7])) + gzip.compress(b"") + gzip.compress(b"".join(own[7:]))]
    cuts = sorted(r.sample(range(len(whole)), 9))
    layouts.append(b"".join(gzip.compress(whole[a:b]) for a, b in zip([0, *cuts], [*cuts, len(whole)])))
    layouts.append(layouts[1] + bytes(1000))
    for chunk in (1 << 20, 1000, 17):
        monkeypatch.setattr(warc, "CHUNK_BYTES", chunk)
        for data in layouts if chunk > 17 else layouts[1:2]:
            assert list(warc.records(data)) == own


def test_damage_is_an_error():
    whole = gzip.compress(b"".join(made(4, random.Random(1))))
    for data in (whole + b"rubbish", whole[:-9], gzip.compress(made(1, random.Random(1))[0][:-8]), gzip.compress(b"HTTP/1.1 200\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(data))
    assert list(warc.records(b"")) == []


def test_files_of_others(spark, tmp_path):
    """Archives that were not written here, a member for each record, and back as normalised files."""
    r = random.Random(5)
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    target.mkdir()
    every = []
    for k in range(3):
        own = made(4, r)
        every += own
        (source / f"f{k}.warc.gz").write_bytes(b"".join(map(gzip.compress, own)))
    warc.export(warc.normalise(warc.archives_in(spark, str(source))), str(target))
    got = [gzip.decompress(open(p, "rb").read()) for p in sorted(glob.glob(f"{target}/*.warc.gz"))]
    assert b"".join(got) == b"".join(every)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, warc.op4_warc_normaliser(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(db.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE})").fetchall(), key=str)
    assert got == want and got
