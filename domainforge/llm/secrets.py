"""Secret scan: fixed patterns, and a log-likelihood ratio of character Markov models.

One side is fitted to random strings, the other to ordinary identifiers; each side is an even mixture of a model
for each kind of its labelled samples (keys over several alphabets; names, paths, numbers, rulers, sequences,
UUIDs, encoded prose). Every long token of a text gets the difference of its log-likelihoods. The threshold is
fitted on held-out ordinary samples to a false-positive rate; a token above it is reported besides the pattern
matches.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainforge.llm import textkit as tk

#: The patterns of the contract, and the order of kinds.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")
#: Whether a text may hold an assignment or an access key at all; on lower-cased bytes.
MAYBE = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']? *[:=]|akia")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_TEXTS = 2000
MIN_TOKEN = 20
#: Text that is scanned at once, in whole documents.
BLOCK_BYTES = 1 << 20
#: Distinct words of the sample's texts that make identifiers, at most, those of the smallest checksums.
SAMPLE_WORDS = 20_000
#: Share of the held-out ordinary samples of any kind that the threshold lets through.
FALSE_RATE = 0.001
#: The least threshold: one long token in a thousand is taken for a key beforehand.
LEAST_RATIO = math.log(1000)

CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[[ord(c) for c in ALPHABET]] = True


class MarkovModel:
    """First-order character model with additive smoothing; the start is a state of its own."""

    def __init__(self, samples: list[str], smooth: float = 0.5):
        n = len(ALPHABET)
        counts = np.full((n + 1, n), smooth)
        for text in samples:
            codes = CODE[np.frombuffer(text.encode("ascii", "ignore"), np.uint8)]
            codes = codes[codes < n]
            if len(codes):
                np.add.at(counts, (np.concatenate(([n], codes[:-1])), codes), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))

    def score(self, token: str) -> float:
        codes = CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.log[np.concatenate(([len(ALPHABET)], codes[:-1])), codes].sum())


class RepeatModel:
    """Characters that mostly repeat the one ``d`` places before; an even mixture of the periods ``d``."""

    PERIODS, SHARE = (1, 2, 3, 4), 0.9

    def score(self, token: str) -> float:
        codes = CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
        fresh, other = -np.log(len(ALPHABET)), np.log((1 - self.SHARE) / len(ALPHABET))
        again = np.log(self.SHARE + (1 - self.SHARE) / len(ALPHABET))
        own = [min(d, len(codes)) * fresh + float(np.where(codes[d:] == codes[:-d], again, other).sum()) for d in self.PERIODS]
        return float(np.logaddexp.reduce(own)) - float(np.log(len(own)))


class Mixture:
    """Even mixture of a model for each kind of samples; rulers have the model of repeats."""

    def __init__(self, kinds: dict[str, list[str]]):
        self.models = [RepeatModel() if kind == "rulers" else MarkovModel(samples) for kind, samples in kinds.items()]

    def score(self, token: str) -> float:
        return float(np.logaddexp.reduce([m.score(token) for m in self.models])) - float(np.log(len(self.models)))


class SecretModel:
    """``random`` and ``ordinary`` are labelled samples by kind. Every fourth sample is held out: the threshold is
    the ratio that at most ``false_rate`` of any ordinary kind's held-out samples exceed, and never below ``LEAST_RATIO``."""

    def __init__(self, random: dict[str, list[str]], ordinary: dict[str, list[str]], false_rate: float = FALSE_RATE):
        learned = lambda kinds: {k: [x for i, x in enumerate(v) if i % 4] for k, v in kinds.items()}
        held = lambda kinds: {k: [x for x in v[::4] if len(x) >= MIN_TOKEN] for k, v in kinds.items()}
        self.random, self.ordinary = Mixture(learned(random)), Mixture(learned(ordinary))
        ratios = [np.sort([self.ratio(x) for x in v]) for v in held(ordinary).values() if v]
        self.threshold = max([LEAST_RATIO, *(float(r[min(len(r) - 1, int(len(r) * (1 - false_rate)))]) for r in ratios)])
        self.recall = {k: float(np.mean([self.ratio(x) > self.threshold for x in v])) for k, v in held(random).items() if v}

    def ratio(self, token: str) -> float:
        return self.random.score(token) - self.ordinary.score(token)


def random_strings(count: int = 1500, seed: int = 7) -> dict[str, list[str]]:
    """Labelled random strings over the alphabets that keys are written in."""
    rng = np.random.default_rng(seed)
    kinds = {"hexadecimal": "0123456789abcdef", "letters and digits": ALPHABET[:62], "base64": ALPHABET[:64], "base64 for addresses": ALPHABET[:62] + "_-", "capitals and digits": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "small letters and digits": "abcdefghijklmnopqrstuvwxyz0123456789"}
    return {kind: ["".join(rng.choice(list(letters), rng.integers(20, 64))) for _ in range(count)] for kind, letters in kinds.items()}


def identifiers(words: list[str], count: int = 2000, seed: int = 11) -> dict[str, list[str]]:
    """Labelled ordinary tokens: identifiers and paths of ordinary words, and what else stands in texts as a long
    token without being a key."""
    rng = np.random.default_rng(seed)

    def some(low: int, high: int) -> list[str]:
        return [words[i] for i in rng.integers(0, len(words), rng.integers(low, high))]

    def mixed() -> str:
        return "".join(rng.choice([w, w.capitalize(), w.upper(), f"{w}{rng.integers(0, 100)}"]) for w in some(2, 7))

    def path() -> str:
        own = [w.lower() + str(rng.choice(["", "", "-", "_"])) + str(rng.integers(0, 100) if rng.random() < 0.2 else "") for w in some(2, 7)]
        return "/" + "/".join([*rng.choice(["usr", "lib", "home", "var", "x86_64-linux-gnu", "src", "data"], 2), *own])

    def ruler() -> str:
        unit = "".join(rng.choice(list(ALPHABET), rng.choice([1, 1, 1, 2, 3])))
        return unit * int(rng.integers(20, 80) // len(unit) + 1)

    def sequence() -> str:
        line = (ALPHABET[:26] * 3, ALPHABET[26:52] * 3, "0123456789" * 8, "0123456789abcdef" * 5)[rng.integers(4)]
        at = rng.integers(0, 26)
        return line[at : at + rng.integers(20, 50)]

    def uuid() -> str:
        h = "".join(rng.choice(list("0123456789abcdef"), 32))
        h = h.upper() if rng.random() < 0.3 else h
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))

    makers = {
        "words": lambda: str(rng.choice(["_", "-", "/", "=", ""])).join(some(1, 8)),
        "capitals": lambda: "_".join(some(2, 7)).upper(),
        "camel case": mixed,
        "paths": path,
        "numbers": lambda: "".join(rng.choice(list("0123456789"), rng.integers(20, 40))),
        "dates and versions": lambda: "-".join(f"{rng.integers(0, 10000):0{rng.integers(1, 5)}d}" for _ in range(rng.integers(5, 10))),
        "rulers": ruler,
        "sequences": sequence,
        "identifiers by number": uuid,
        "encoded prose": lambda: base64.b64encode(" ".join(some(4, 12)).encode()).decode(),
        "prose in hexadecimal": lambda: " ".join(some(3, 7)).encode().hex(),
    }
    return {kind: [make() for _ in range(count)] for kind, make in makers.items()}


def scan(text: str, model: SecretModel) -> tuple[dict[str, int], list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(counts, base spans, added spans); spans are (start, kind number, end) in code points."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    counts = {name: sum(k == i for _, k, _ in base) for i, name in enumerate(KINDS[:3])}
    added = []
    for m in TOKEN.finditer(text):
        if not any(s < m.end() and m.start() < e for s, _, e in base) and model.ratio(m[0]) > model.threshold:
            added.append((m.start(), 3, m.end()))
    return counts, sorted(base), added


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _suspects(part_text: pa.Array) -> np.ndarray:
    """Rows that may hold a span of any kind."""
    raw, at = tk.text_buffers(part_text)
    inside = TOKEN_BYTE[raw]
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    hits = first[last - first >= MIN_TOKEN]
    low = tk.LOWER[raw].tobytes()
    hits = np.concatenate((hits, np.array([m.start() for m in MAYBE.finditer(low)], np.int64)))
    rows = np.searchsorted(at, hits, "right") - 1
    # a run over a boundary of texts belongs to both sides
    ends = np.searchsorted(at, (last[last - first >= MIN_TOKEN] - 1), "right") - 1
    marked = np.zeros(len(at) - 1, bool)
    marked[rows[rows < len(marked)]] = True
    for a, b in zip(rows[: len(ends)], ends, strict=True):
        marked[a : b + 1] = True
    return marked


def _scanner(model, text: str, out_schema: pa.Schema):
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        known = model.value
        for batch in batches:
            for part in tk.blocks(batch, text, BLOCK_BYTES):
                at = part.schema.get_field_index(text)
                column = part.column(at)
                marked = _suspects(column)
                rows = [(0, 0, 0, 0, empty, "")] * part.num_rows
                for k in np.flatnonzero(marked):
                    counts, base, added = scan(column[int(k)].as_py() or "", known)
                    if base or added:
                        rows[k] = (counts["assign"], counts["access"], counts["hex"], len(added), hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + added))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out_schema)[-6:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns) if k != at), *columns], schema=out_schema)

    return run


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE_TEXTS, most: int = SAMPLE_WORDS) -> SecretModel:
    """Models from labelled samples: random strings, and identifiers of ``most`` words of at most ``sample`` texts
    (the bounds of this fit), both chosen by hash. Words inside pattern matches are left out."""
    words: set[str] = set()
    for t in tk.sample_texts(docs, text, sample):
        clean = HEX.sub(" ", ACCESS.sub(" ", ASSIGN.sub(" ", t)))
        words.update(re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,15}(?![A-Za-z0-9+/_=-])", clean))
    chosen = sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:most]
    return SecretModel(random_strings(), identifiers(chosen or ["value", "name", "index"]))


def find_secrets(docs: DataFrame, *, text: str = "text", model: SecretModel | None = None) -> DataFrame:
    """The other columns of ``docs`` with n_assign, n_access, n_hex, n_random, base_sha256 and spans.

    A null text counts as empty; repeated rows are scanned each; input columns with the names of results are
    replaced."""
    spark = docs.sparkSession
    model = model or fit(docs, text)
    names = ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")
    source = docs.drop(*(n for n in names if n != text))
    ddl = f"{tk.ddl(source.drop(text))}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string".lstrip(", ")
    return source.mapInArrow(_scanner(spark.sparkContext.broadcast(model), text, tk.arrow_schema(ddl)), ddl)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
