"""Fingerprints against a plain version, order sensitivity, hot and repeated ids."""

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from domainforge.llm import order_minhash


def longs(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if v is not None else b"", seed) if v is not None else seed
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sketch(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x09-\x0D\x20]+", text)]
    grams = [signed(longs(*words[i : i + 3])) for i in range(max(1, len(words) - 2))]
    seen, items = {}, []
    for place, g in enumerate(grams):
        n = seen[g] = seen.get(g, -1) + 1
        h = xxhash.xxh64_intdigest(struct.pack("<i", n), longs(g))
        items.append((h & 31, h >> 5 & 0xFFFFFFFF, place))
    items.sort()
    kept = [x for i, x in enumerate(items) if i < 2 or items[i - 2][0] != x[0]]
    out = []
    for j in range(32):
        k = next((i for i, x in enumerate(kept) if x[0] >= j), 0)
        a, b = kept[k], kept[(k + 1) % len(kept)]
        if len(kept) == 1:
            h = longs(a[0] << 32 | a[1])
        else:
            first, second = (a, b) if a[2] < b[2] else (b, a)
            h = longs(first[0] << 32 | first[1], second[0] << 32 | second[1])
        out.append(j << 24 | h & 0xFFFFFF)
    return out


def printed(s):
    return "".join(f"{x:08X}" for x in s)


def alike(a, b):
    return len(set(a) & set(b)) / 32


def plain(rows):
    ids = sorted({k for k, _ in rows if k is not None}, reverse=True)
    chosen = {k: min((t or "" for i, t in rows if i == k), key=lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))) for k in ids}
    out = []
    for k, t in rows:
        t = t or ""
        after = chosen[ids[(ids.index(k) + 1) % len(ids)]] if k is not None else ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        near = alike(sketch(t), sketch(after)) if k is not None else None
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(sketch(t)), printed(sketch(edited)), alike(sketch(t), sketch(edited)), near))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def texts(r, n):
    words = [f"w{k}" for k in range(60)]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 4, 9, 30, 200]))) for _ in range(n)]


def test_against_plain(spark):
    r = random.Random(4)
    rows = list(zip([None, None, 3, 3, 3, *r.sample(range(-500, 500), 80)], [None, *texts(r, 84)], strict=True))
    rows.append((2**63 - 1, "é😀ß " * 9))
    rows.append((-(2**63), "a  \t b\nc d"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("a", F.lit(2))
    assert rows_of(order_minhash.edited_fingerprints(frame)) == plain(rows)


def test_hot_ids(spark, monkeypatch):
    """Ids that hold much of the rows take the salted way, with the same rows."""
    monkeypatch.setattr(order_minhash, "HOT", 3)
    r = random.Random(9)
    rows = list(zip([7] * 30 + [90] * 10 + list(range(60)), texts(r, 100), strict=True))
    assert rows_of(order_minhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == plain(rows)


def test_order_counts(spark):
    """A moved passage changes the fingerprint, in short texts too; a set sketch would hardly see it."""
    r = random.Random(6)
    pairs = []
    for n in (12, 24, 60, 400):
        words = [f"{r.random():.6f}" for _ in range(n)]
        pairs.append((n, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2]), " ".join([*words[: n - 1], "other"])))
    frame = spark.createDataFrame(pairs, "n int, a string, b string, c string")
    for name in "abc":
        frame = order_minhash.with_sketch(frame, name, f"s_{name}")
    for row in frame.select("n", order_minhash.likeness(F.col("s_a"), F.col("s_b")).alias("moved"), order_minhash.likeness(F.col("s_a"), F.col("s_c")).alias("ended")).collect():
        assert row.moved < 0.85, row
        assert row.ended > row.moved or row.n < 20, row


def test_range_search(spark):
    cuts = [-5, 0, 0 + 3, 8, 2**62]
    values = [-(2**62), -5, -4, 0, 1, 3, 4, 8, 9, 2**62, 2**62 + 1]
    got = [x.r for x in spark.createDataFrame([(v,) for v in values], "v long").select(order_minhash._range_of(F.col("v"), cuts).alias("r")).collect()]
    assert got == [sum(c < v for c in cuts) for v in values]
