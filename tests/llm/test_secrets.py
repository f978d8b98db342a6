"""Base spans against the contract's patterns, and what the Markov models report."""

import base64
import hashlib
import random
import re
import uuid

import pytest

from domainforge.llm import secrets

WORDS = "river stone winter paper request handler config value buffer index table column account session user name list map server client proxy thread queue event signal window frame socket stream".split()


@pytest.fixture(scope="module")
def model():
    return secrets.SecretModel(secrets.random_strings(), secrets.identifiers(WORDS))


def plain(text):
    """The contract's base spans by its own patterns."""
    found = []
    for m in re.finditer(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_against_the_patterns(spark, model):
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "\u017fecret", "TOKEN", "to\u212aen", "api_key", "apikey", "\"", "'", " ", "  ", ":", "=", "abc123", "x", "a.b-c/d", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "deadbeef" * 3, "é", "😀", "\n", "g", ""]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in secrets.find_secrets(frame, model=model).collect():
        want = plain(texts[row.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[row.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))


def test_ordinary_tokens_are_no_secrets(model):
    prose = base64.b64encode(b"the river runs through the old paper town").decode()
    ordinary = ["-" * 20, "=" * 24, "_" * 30, "ABCDEFGHIJKLMNOPQRSTUVWX", "abcdefghijklmnopqrstuvwxyz", "0123456789" * 3, "/usr/lib/x86_64-linux-gnu/libstdc", str(uuid.UUID(int=0x1234567890ABCDEF1234567890ABCDEF)), "requestHandlerConfigValueBuffer", "MAX_BUFFER_INDEX_TABLE_COLUMN", "user-session-account-list-map", "2024-01-15-10-30-00-2024", prose, "xyxyxyxyxyxyxyxyxyxyxyxy"]
    assert [x for x in ordinary if model.ratio(x) > model.threshold] == []


def test_threshold_is_fitted(model):
    """On samples of another seed: few false positives of any kind, and most keys are found."""
    for kind, own in secrets.identifiers(WORDS, 1000, seed=99).items():
        long = [x for x in own if len(x) >= secrets.MIN_TOKEN]
        assert sum(model.ratio(x) > model.threshold for x in long) <= 0.01 * len(long), kind
    fresh = secrets.random_strings(500, seed=98)
    assert set(model.recall) == set(fresh)
    for kind in ("letters and digits", "base64", "base64 for addresses", "capitals and digits"):
        assert sum(model.ratio(x) > model.threshold for x in fresh[kind]) >= 0.8 * len(fresh[kind]), kind


def test_keys_outside_of_assignments_are_added(spark, model):
    r = random.Random(1)
    key = "".join(r.choice(secrets.ALPHABET[:62]) for _ in range(44))
    frame = spark.createDataFrame([(1, f"see {key} there"), (2, f"token={key}"), (3, "-" * 60), (4, "/usr/lib/" + "/".join(WORDS[:4]))], "doc_id long, text string")
    got = {row.doc_id: row.spans for row in secrets.find_secrets(frame, model=model).collect()}
    assert got == {1: "random:4:48", 2: "assign:0:50", 3: "", 4: ""}
