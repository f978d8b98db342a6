"""Benchmark decontamination with a positional inverted index that is partitioned by document.

Every block of documents becomes a shard: postings (sorted positions) of the test terms in the shard's
texts. A test window is looked up from its rarest term in the shard; each further term's list is intersected
after adjusting for its offset. Shards need no shuffle, and a window with an absent term costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainforge.llm import textkit as tk
from domainforge.plans.scratch import materialize

#: Benchmark text in one broadcast. A larger benchmark is searched block by block.
BLOCK_BYTES = 24 << 20
STATE = ("_n_words", "_hits", "_items", "_near")
#: Words by which a term may stand off its place, and terms that may be missing, in a proximity match.
SLOP, MISSES = 3, 2


class TestSet:
    """The distinct windows of some items. Window k has the term ids ``terms[at[k]:at[k+1]]``."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        texts = pa.array([text or "" for _, text in items], pa.large_string())
        words = tk.Words(*tk.text_buffers(texts), tk.ALNUM)
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        found: dict[tuple, set] = {}
        for k, (name, _) in enumerate(items):
            own = ids[words.row[k] : words.row[k + 1]].tolist()
            size = min(window, len(own))
            for s in range(len(own) - size + 1 if own else 0):
                found.setdefault(tuple(own[s : s + size]), set()).add(number[name])
        self.windows = [np.array(w, np.int64) for w in found]
        self.owners = list(found.values())
        width = max((len(w) for w in self.windows), default=1)
        self.matrix = np.full((len(self.windows), width), -1, np.int64)
        for k, w in enumerate(self.windows):
            self.matrix[k, : len(w)] = w

    def allowed(self, misses: int) -> np.ndarray:
        """How many terms of each window may be missing: none in windows of fewer than ten words."""
        return np.where((self.matrix >= 0).sum(axis=1) >= 10, misses, 0)


class Shard:
    """Positional postings of the test terms in some documents."""

    def __init__(self, words: tk.Words, vocabulary: np.ndarray):
        self.row = words.row
        place = np.searchsorted(vocabulary, words.hash)
        place[place == len(vocabulary)] = 0
        self.ids = np.where(vocabulary[place] == words.hash, place, -1) if len(vocabulary) else np.full(len(words.hash), -1)
        known = np.flatnonzero(self.ids >= 0)
        self.postings = known[np.argsort(self.ids[known], kind="stable")]
        self.sizes = np.bincount(self.ids[known], minlength=len(vocabulary))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.doc = np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.starts[term] : self.starts[term + 1]]

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase, rarest term first."""
        order = np.argsort(self.sizes[window], kind="stable")
        at = self.list_of(window[order[0]]) - order[0]
        at = at[(at >= 0) & (at + len(window) <= len(self.ids))]
        for k in order[1:]:
            if not len(at):
                return at
            at = at[self.ids[at + k] == window[k]]
        return at[self.doc[at] == self.doc[at + len(window) - 1]] if len(at) else at

    def near(self, window: np.ndarray, slop: int, misses: int = 0) -> np.ndarray:
        """Positions of one of the ``misses`` + 1 rarest terms around which all terms but ``misses`` lie at most
        ``slop`` words from their places in the phrase, within one document."""
        order = np.argsort(self.sizes[window], kind="stable")
        out = []
        for lead in order[: misses + 1]:
            at = self.list_of(window[lead])
            lost = np.zeros(len(at), np.int64)
            for k in order:
                if not len(at):
                    break
                if k == lead:
                    continue
                own, want = self.list_of(window[k]), at + (k - lead)
                low = np.maximum(want - slop, self.row[self.doc[at]])
                high = np.minimum(want + slop, self.row[self.doc[at] + 1] - 1)
                left = np.searchsorted(own, low)
                lost += (left >= len(own)) | (own[np.minimum(left, len(own) - 1)] > high) | (high < low) if len(own) else 1
                at, lost = at[lost <= misses], lost[lost <= misses]
            out.append(at)
        return np.unique(np.concatenate(out))

    def search_near(self, tests: TestSet, slop: int, misses: int) -> Iterator[tuple[int, np.ndarray]]:
        if not tests.windows or not len(self.ids):
            return
        terms = np.maximum(tests.matrix, 0)
        sizes = np.where(tests.matrix >= 0, self.sizes[terms], len(self.ids) + 1)  # filling comes last
        allowed = tests.allowed(misses)
        live = np.flatnonzero((sizes == 0).sum(axis=1) <= allowed)
        order = np.argsort(sizes, axis=1, kind="stable")
        length = len(self.ids)
        keys = self.ids[self.postings] * length + self.postings
        found: dict[int, list] = {}
        for nth in range(misses + 1):
            own = live[(allowed[live] >= nth) & (tests.matrix[live, order[live, nth]] >= 0)] if nth < order.shape[1] else live[:0]
            lead = order[own, nth]
            count = self.sizes[tests.matrix[own, lead]]
            ends, s = np.cumsum(count), 0
            while s < len(own):  # so many postings at once that the work arrays stay small
                e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 200_000)))
                n = count[s:e]
                window, place = np.repeat(own[s:e], n), np.repeat(lead[s:e], n)
                at = self.postings[np.repeat(self.starts[tests.matrix[own[s:e], lead[s:e]]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                lost = np.zeros(len(at), np.int64)
                for k in range(order.shape[1]):
                    if not len(at):
                        break
                    col = order[window, k]
                    term = tests.matrix[window, col]
                    want = at + col - place
                    low = np.maximum(want - slop, self.row[self.doc[at]])
                    high = np.minimum(want + slop, self.row[self.doc[at] + 1] - 1)
                    left = np.searchsorted(keys, term * length + low)
                    none = (high < low) | (left >= len(keys)) | (keys[np.minimum(left, len(keys) - 1)] > term * length + high)
                    lost += none & (term >= 0) & (col != place)
                    keep = lost <= allowed[window]
                    window, place, at, lost = window[keep], place[keep], at[keep], lost[keep]
                for w in np.unique(window).tolist():
                    found.setdefault(w, []).append(at[window == w])
                s = e
        for w, parts in found.items():
            yield w, np.unique(np.concatenate(parts))

    def search(self, tests: TestSet) -> Iterator[tuple[int, np.ndarray]]:
        if not tests.windows or not len(self.ids):
            return
        sizes = np.where(tests.matrix >= 0, self.sizes[np.maximum(tests.matrix, 0)], 1)
        for k in np.flatnonzero(sizes.min(axis=1) > 0):
            if len(at := self.phrase(tests.windows[k])):
                yield k, at


def _searcher(tests, text: str, slop: int, misses: int, schema: pa.Schema):
    def run(batches):
        known: TestSet = tests.value
        for batch in batches:
            for part in tk.blocks(batch, text, 2 << 20):
                words = tk.Words(*tk.text_buffers(part.column(part.schema.get_field_index(text))), tk.ALNUM)
                shard = Shard(words, known.vocabulary)
                marks = np.zeros(len(words.hash) + 1, np.int64)
                items: dict[int, set] = {}
                for k, at in shard.search(known):
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + len(known.windows[k]), -1)
                    for d in np.unique(shard.doc[at]).tolist():
                        items.setdefault(d, set()).update(known.owners[k])
                close: dict[int, set] = {}
                for k, at in shard.search_near(known, slop, misses):
                    for d in np.unique(shard.doc[at]).tolist():
                        close.setdefault(d, set()).update(known.owners[k])
                hit = np.cumsum(marks[:-1]) > 0
                names = part.schema.names
                old_hits = part.column(names.index("_hits")).to_pylist() if "_hits" in names else None
                old_items = part.column(names.index("_items")).to_pylist() if "_items" in names else None
                old_near = part.column(names.index("_near")).to_pylist() if "_near" in names else None
                hits, found, near = [], [], []
                for d in range(part.num_rows):
                    own = hit[words.row[d] : words.row[d + 1]] if d in items else None
                    if old_hits and old_hits[d]:
                        before = np.unpackbits(np.frombuffer(old_hits[d], np.uint8)).astype(bool)[: words.row[d + 1] - words.row[d]]
                        own = before if own is None else own | before
                    hits.append(np.packbits(own).tobytes() if own is not None else b"")
                    found.append(sorted({known.names[i] for i in items.get(d, ())} | set(old_items[d] if old_items else ())))
                    near.append(sorted({known.names[i] for i in close.get(d, ())} | set(found[-1]) | set(old_near[d] if old_near else ())))
                kept = [part.column(k) for k, name in enumerate(names) if name not in STATE]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words.counts(), pa.int64()), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))], schema=schema)

    return run


def _blocks(spark: SparkSession, benchmark: DataFrame, item: str, text: str, window: int, limit: int) -> Iterator[TestSet]:
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("string").alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // limit))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield TestSet([tuple(r) for r in part.collect()], window), k + 1 == count


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, slop: int = SLOP, misses: int = MISSES) -> DataFrame:
    """``docs`` with ``_n_words``, ``_hits`` (bits of the words inside an occurring window, as bytes; empty: none),
    ``_items`` (names of the items with an occurring window) and ``_near`` (those and the items with a window that
    all terms but ``misses`` approach to ``slop`` words; an item with a null id has the name "null").

    A null text has no words; an item without words has no windows; repeated rows are searched each for
    itself. The benchmark is read in blocks of about ``block_bytes`` text, so what is broadcast is bounded;
    after each but the last block the state is written to the shared folder. Columns of the input named like
    the state columns are replaced."""
    spark = docs.sparkSession
    out = docs.drop(*STATE)
    for tests, last in _blocks(spark, benchmark, item, item_text, window, block_bytes):
        base = out.drop(*STATE)
        schema = f"{tk.ddl(base)}, _n_words long, _hits binary, _items array<string>, _near array<string>"
        arrow = tk.arrow_schema( schema)
        out = out.mapInArrow(_searcher(spark.sparkContext.broadcast(tests), text, slop, misses, arrow), schema)
        if not last:
            out = materialize(out, "decontaminate")
    return out


def contamination_report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: words, words inside a window, items and their digest, items by proximity."""
    items = F.array_sort(F.array_distinct("_items"))
    return found.select(
        doc_id,
        F.col("_n_words").alias("n_words"),
        _ones("_hits").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (_ones("_hits") > 0).alias("contaminated"),
        F.size(F.array_distinct("_near")).cast("long").alias("n_near"),
    )


def _ones(column: str):
    """Bits set in a binary column."""
    bits = F.hex(column)
    weight = {"1": "1248", "2": "3569AC", "3": "7BDE", "4": "F"}
    return sum((F.length(F.regexp_replace(bits, f"[^{chars}]", "")) * int(n) for n, chars in weight.items()), F.lit(0)).cast("long")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all benchmark items: windows of ten words, exact phrases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination_report(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
