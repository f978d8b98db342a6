"""Components against brute force: null keys, and the way of large candidate families."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from domainforge.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    # rows of one text are one, whatever their keys
    out = []
    for i, (k, _) in enumerate(rows):
        keys = [q for j, (q, _) in enumerate(rows) if find(j) == find(i) and q is not None] if sets[i] else [k]
        out.append((k, len(sets[i]), min(keys) if keys and keys[0] is not None else None))
    return sorted(out, key=str)


def corpus(seed, keyless):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(25):
        words = [r.choice(vocabulary) for _ in range(r.choice([2, 6, 30, 120, 300]))]
        for _ in range(r.choice([1, 2, 7])):
            copy = list(words)
            for _ in range(r.randint(0, max(0, len(copy) // 40))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((None if r.random() < keyless else len(rows), " ".join(copy)))
    return [*rows, (None, None), (None, " "), (9000, "")]


@pytest.mark.parametrize("keyless", [0.0, 0.4, 1.0])
def test_null_keys_keep_their_links(spark, keyless):
    rows = corpus(3, keyless)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit(1)).withColumn("n", F.lit(2))
    assert sorted(map(tuple, jaccard_join.similarity_components(frame).collect()), key=str) == plain(rows)


def test_large_families(spark, monkeypatch):
    """With no family small enough for one task, stars give the same components."""
    monkeypatch.setattr(jaccard_join, "FAMILY", 0)
    monkeypatch.setattr(jaccard_join, "SLICE_BYTES", 3000)
    rows = corpus(8, 0.1)
    assert sorted(map(tuple, jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == plain(rows)


def test_disk_at_size(spark, monkeypatch):
    """Where no table is small enough to be broadcast, texts are not shuffled to find the chosen ones, and the
    shuffles of a finished step are given up before the next ones write theirs."""
    plans, steps = {}, []
    write, release = jaccard_join.materialize, jaccard_join.release_shuffles
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), steps.append(name), write(df, name))[-1])
    monkeypatch.setattr(jaccard_join, "release_shuffles", lambda s: (steps.append("release"), release(s))[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus(5, 0.0)
        assert sorted(map(tuple, jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plans["sets"]
    for name in ("profile", "sets", "candidates", "links"):
        assert steps[steps.index(name) + 1] == "release", steps


def test_counts_of_many_buckets():
    """A bucket's rows for a block of many texts take two bytes a shared shingle, not four a text."""
    rows, grams = np.arange(0, 30_000, 3000, dtype=np.uint16), np.arange(10, dtype=np.uint32)
    one = {"rows": rows.tobytes(), "grams": grams.tobytes(), "docs": None}
    out = jaccard_join._shared_in_bucket(pd.DataFrame([{"block": 0, **one}, {"block": 1, **one}]))
    assert sum(len(x) for c in ("counts", "hits") if c in out for x in out[c].dropna()) <= 2 * 2 * len(rows)


def test_filter_of_ids(spark):
    ids = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    words = jaccard_join.id_filter(spark.createDataFrame([(int(x),) for x in ids], "id long"), len(ids))
    assert jaccard_join.passes(words, ids).all()
    assert jaccard_join.passes(words, np.arange(20_000)).mean() < 0.02
    assert not jaccard_join.passes(jaccard_join.id_filter(spark.createDataFrame([], "id long"), 0), ids).any()


def crowd(seed, members=50):
    """Texts that share a line and little else, some with a near copy."""
    r = random.Random(seed)
    line = " ".join(f"c{k}" for k in range(14))
    rows = []
    for k in range(members):
        own = [f"w{r.randrange(400)}" for _ in range(r.randint(24, 30))]
        rows.append((2 * k, f"{line} {' '.join(own)}"))
        if k % 5 == 0:
            rows.append((2 * k + 1, f"{line} {' '.join(own[:-1])}"))
    return rows


@pytest.mark.parametrize("portions", [False, True])
def test_crowds_are_not_paired_as_sets(spark, monkeypatch, portions):
    """In a large family only pairs that may link are brought together as sets; portions give the same."""
    monkeypatch.setattr(jaccard_join, "FAMILY", 0)
    verified, pairs = jaccard_join._verified, []
    monkeypatch.setattr(jaccard_join, "_verified", lambda p, *more: (pairs.append(p.count()), verified(p, *more))[-1])
    if portions:
        monkeypatch.setattr(jaccard_join, "ROOM", 40_000)
        monkeypatch.setattr(jaccard_join, "size_hint", lambda df: 0)
    rows = crowd(4)
    assert sorted(map(tuple, jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == plain(rows)
    assert sum(pairs) < 4 * len(rows), pairs


def test_portions_of_small_families(spark, monkeypatch):
    """Signatures and families in several portions, with rows that repeat."""
    monkeypatch.setattr(jaccard_join, "ROOM", 60_000, raising=False)
    monkeypatch.setattr(jaccard_join, "size_hint", lambda df: 0, raising=False)
    rows = corpus(6, 0.1)
    rows = rows + rows[:40]
    steps, write = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: (steps.append(name), write(df, name))[-1])
    assert sorted(map(tuple, jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == plain(rows)
    assert steps.count("candidates") > 1 and steps.count("links") > 1


def test_parities_bound_what_sets_share():
    r = np.random.default_rng(2)
    for _ in range(300):
        n, common = int(r.integers(1, 700)), r.random()
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[: int(common * len(x))], r.integers(0, 2**63, int(r.integers(1, n + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(x, y))
        link = 100 * both >= 75 * (len(x) + len(y) - both)
        assert not link or jaccard_join.may_link(len(x) + len(y), *jaccard_join._folded([jaccard_join.parities(x), jaccard_join.parities(y)]))


def test_lists_of_unlike_sets_give_no_pairs():
    """A list's members that share too little are not handed on to be compared as sets; like ones are."""
    r = np.random.default_rng(7)
    sets = [np.unique(r.integers(0, 2**63, 200, dtype=np.uint64)) for _ in range(40)]
    sets.append(sets[0][:-4])
    n = [len(x) for x in sets]
    columns = [pa.array([list(range(41))], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([list(range(41))], pa.list_(pa.int64())), pa.array([[jaccard_join.parities(x) for x in sets]], pa.list_(pa.binary()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["c", "n", "label", "marks"])
    for forest in (True, False):
        pairs = [p for out in jaccard_join._across(forest)([batch]) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert (0, 40) in pairs and len(pairs) < 4
