"""Stages of the pipeline on awkward rows, and personal data by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from domainforge.llm import sanitise

SF = "/root/testdata/sf0.001"


def spans_of(text):
    """The contract's base spans by its own patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out)


def test_private_spans_against_the_patterns(spark):
    r = random.Random(4)
    parts = ["a", "b.c", "@", "x-y", ".", "..", "org", "192.168.0.1", "256.1.1.1", "007", "4111 1111 1111 1111", "4111-1111-1111-1112", "+", "+1 (212) 555-0100", "12", " ", "  ", "-", "(", ")", "é", "😀", "%", "_", "\n", "1.2.3.4.5", "+49"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2500)] + ["a@b.c" + "x" * 30_000, "1" * 30_000, "1." * 20_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in sanitise.find_private(frame).select("doc_id", "_base").collect():
        assert sorted((x.k, x.s, x.e) for x in row._base) == spans_of(texts[row.doc_id]), texts[row.doc_id][:200]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None, None, "en", "s", None), (90_001, "", "en", "s", 0), (90_002, "word " * 20_000, None, None, 100_000), (90_003, "one two three four five six seven", "en", "s", 33), (90_003, "one two three four five six seven", "en", "s", 33)], docs.schema)
    return docs.unionByName(more)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, rows, name):
    """Nulls, empty and long texts, repeated rows and an empty table: columns stay, and nothing is made up."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, rows, SF).cache()
    if name == "packing":
        assert out.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    else:
        assert out.columns == rows.columns and out.count() <= rows.count()
        known = {r.doc_id for r in rows.select("doc_id").collect()}
        assert {r.doc_id for r in out.select("doc_id").collect()} <= known
        if name == "personal data":
            assert out.count() == rows.count()
        if name == "near duplicates":
            assert out.where("doc_id = 90003").count() == 1 and out.where("doc_id = 90001").count() == 1
    out.unpersist()
    empty = stage(spark, rows.limit(0), SF)
    assert empty.count() == 0 and (name == "packing" or empty.columns == rows.columns)
