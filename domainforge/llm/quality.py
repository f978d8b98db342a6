"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention weighs the encodings; the weighted
sum is scored. Only document labels are used. The network is fitted in numpy on a bounded sample of labelled
documents; every passage of every document is encoded for its score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainforge.llm import textkit as tk

#: At most so many labelled documents fit the model: the bound of the fit.
SAMPLE = 6000
PASSAGE_BYTES = 512
#: Text that is encoded at once, in whole documents.
BLOCK_BYTES = 1 << 20
BIGRAMS, EXTRA = 384, 6
HIDDEN, GATE = 24, 16
THRESHOLD = 0.7
_BUCKET = np.random.default_rng(5).integers(0, BIGRAMS, 65536).astype(np.int64)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~tk.ALNUM & tk.NOT_SPACE


def passages(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passage offsets of the texts). A text has at least one passage."""
    size = np.diff(at)
    count = np.maximum(1, -(-size // PASSAGE_BYTES))
    cut = np.concatenate(([0], np.cumsum(count)))
    total = int(cut[-1])
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(raw)) - np.repeat(at[:-1], size)
    passage = cut[owner] + place // PASSAGE_BYTES
    features = np.zeros((total, BIGRAMS + EXTRA), np.float32)
    if not len(raw):
        return features, cut
    pair = _BUCKET[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    same = owner[1:] == owner[:-1]
    grams = np.bincount(passage[:-1][same] * BIGRAMS + pair[same], minlength=total * BIGRAMS).reshape(total, BIGRAMS)
    length = np.maximum(1, np.bincount(passage, minlength=total))
    features[:, :BIGRAMS] = np.sqrt(grams / length[:, None])
    for k, member in enumerate((_UPPER, _DIGIT, _MARK)):
        features[:, BIGRAMS + k] = np.bincount(passage, weights=member[raw], minlength=total) / length
    words = tk.Words(raw, at, tk.NOT_SPACE)
    if len(words.first):
        home = passage[words.first]
        n = np.maximum(1, np.bincount(home, minlength=total))
        features[:, BIGRAMS + 3] = n / length * 4
        gram, row = tk.grams(words.hash, words.row, 3)
        of = np.repeat(np.arange(len(row) - 1), np.diff(row))
        order = np.lexsort((gram, of))
        again = np.zeros(len(gram), bool)
        equal = (gram[order][1:] == gram[order][:-1]) & (of[order][1:] == of[order][:-1])
        again[order[1:][equal]] = True
        start = words.row[of] + np.arange(len(gram)) - row[of]
        features[:, BIGRAMS + 4] = np.bincount(home[start], weights=again, minlength=total) / n
    features[:, BIGRAMS + 5] = np.repeat(np.log1p(size) / 12, count)
    return features, cut


class AttentionModel:
    """Encoder, gated attention and scorer, with their gradients."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = BIGRAMS + EXTRA
        self.p = {
            "E": rng.normal(0, 1 / np.sqrt(d) * 3, (d, HIDDEN)),
            "e": np.zeros(HIDDEN),
            "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
            "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
            "w": rng.normal(0, 0.3, GATE),
            "o": rng.normal(0, 0.3, HIDDEN),
            "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, cut: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        a = np.exp(a - np.maximum.reduceat(a, cut[:-1])[bag])
        a /= np.add.reduceat(a, cut[:-1])[bag]
        z = np.add.reduceat(h * a[:, None], cut[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"][0], -30, 30)))
        return y, z, a, h, t, s, bag

    def gradient(self, x: np.ndarray, cut: np.ndarray, label: np.ndarray) -> dict:
        p = self.p
        y, z, a, h, t, s, bag = self.forward(x, cut)
        dy = ((y - label) / len(label)).astype(np.float32)
        dz = dy[:, None] * p["o"]
        da = (dz[bag] * h).sum(axis=1)
        da = a * (da - np.add.reduceat(a * da, cut[:-1])[bag])
        dt, ds = da[:, None] * p["w"] * s * (1 - t * t), da[:, None] * p["w"] * t * s * (1 - s)
        dh = (dz[bag] * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ da, "o": z.T @ dy, "b": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, cut: np.ndarray, label: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 0.006, decay: float = 1e-4) -> AttentionModel:
        rng = np.random.default_rng(17)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for start in range(0, len(order), batch):
                rows = order[start : start + batch]
                index = np.concatenate([np.arange(cut[r], cut[r + 1]) for r in rows])
                own = np.concatenate(([0], np.cumsum(cut[rows + 1] - cut[rows])))
                step += 1
                pace = rate * (1 - epoch / epochs) + 1e-4
                for k, g in self.gradient(x[index].astype(np.float32), own, label[rows]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def remainder(column: str, modulus: int):
    """crc32 of a value's text, by a modulus."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def _features(text: str):
    schema = pa.schema([("label", pa.int32()), ("n", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in tk.blocks(batch, text, BLOCK_BYTES):
                x, cut = passages(*tk.text_buffers(part.column(part.schema.get_field_index(text))))
                rows = [x[cut[k] : cut[k + 1]].astype(np.float16).tobytes() for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("label")), pa.array(np.diff(cut), pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> AttentionModel | None:
    """A model from at most ``sample`` labelled documents whose key's remainder is not held out, chosen by hash."""
    marked = labels.where(F.col(label).isin(0, 1) & (remainder(key, 4) != 2)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    marked = marked.orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(marked), key).select("label", "text").mapInArrow(_features("text"), "label int, n int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.x, r.label))
    if len(rows) > 2 * sample:
        rows = rows[:: -(-len(rows) // (2 * sample))]
    x = np.concatenate([np.frombuffer(r.x, np.float16).reshape(r.n, -1) for r in rows])
    return AttentionModel().fit(x, np.concatenate(([0], np.cumsum([r.n for r in rows]))), np.array([r.label for r in rows], np.float32))


def _scorer(model, text: str, schema: pa.Schema):
    def run(batches):
        known = model.value
        for batch in batches:
            for part in tk.blocks(batch, text, BLOCK_BYTES):
                x, cut = passages(*tk.text_buffers(part.column(part.schema.get_field_index(text))))
                score = known.forward(x, cut)[0].astype(np.float64) if known else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], schema=schema)

    return run


def with_score(docs: DataFrame, model: AttentionModel | None, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of its whole text in column ``name``, which replaces one of that name.

    A null text is empty and is scored as such; repeated rows have equal scores; without any usable label
    every score is 0.5."""
    spark = docs.sparkSession
    source = docs.drop(name)
    ddl = f"{tk.ddl(source)}, `{name}` double"
    return source.mapInArrow(_scorer(spark.sparkContext.broadcast(model), text, tk.arrow_schema(ddl)), ddl)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
