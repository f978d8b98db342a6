"""Best-fit packing by linear grouping.

The plan needs only how many pieces there are of each length, so it is made on a histogram of at most
``capacity`` numbers, whatever the size of the corpus. Large lengths are cut into groups of equal cardinality
and rounded up to the largest of their group; configurations of the few sizes are optimised by column
generation; actual pieces take the rounded places, the last place of a sequence the longest piece that fits;
what is left is grouped again, and the rest and all small pieces go best-fit, longest first. The result is a list of runs ("so many sequences with these lengths"), which pieces join by their rank
within their length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domainforge.llm import textkit as tk
from domainforge.plans.scratch import materialize

CAPACITY = 1024
END_ID = 2
#: Pieces longer than this share of a sequence are grouped; shorter ones are placed last.
LARGE_SHARE = 6
GROUPS = 192
#: How often what the whole configurations leave is grouped again.
ROUNDS = 4
#: Encoded parts that a task keeps.
CACHE = 1_000_000
#: Text that is cut into pieces at once, in whole documents.
BLOCK_BYTES = 1 << 20
#: Printed bytes of ASCII, its letters and digits, first bytes of two-byte characters but those with white
#: space of Unicode among them, and marks that begin a token behind a letter or digit.
PRINTED, ASCII_WORD, TWO_BYTES, POINT = (np.zeros(256, bool) for _ in range(4))
PRINTED[33:127] = True
ASCII_WORD[48:58] = ASCII_WORD[65:91] = ASCII_WORD[97:123] = True
TWO_BYTES[0xC3:0xE0] = True
POINT[[ord(","), ord(".")]] = True


# ---- the plan on a histogram ----


def best_fit(counts: dict[int, int], free: dict[int, list], out: dict[tuple, int], capacity: int) -> None:
    """Best-fit-decreasing on whole classes: ``free`` has by free space the open (contents, sequences)."""
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in free if r >= length and free[r]), default=None)
            contents, n = free[room].pop() if room is not None else ((), left)
            space = capacity if room is None else room
            each = min(space // length, left)
            full = min(n, left // each)
            if room is not None and n > full:
                free[room].append((contents, n - full))
            free[space - each * length].append((contents + (length,) * each, full))
            left -= each * full
    for classes in free.values():
        for contents, n in classes:
            if n:
                out[tuple(sorted(contents, reverse=True))] += n


def _simplex_master(columns: np.ndarray, demand: np.ndarray, basis: list[int]) -> tuple[np.ndarray, np.ndarray]:
    matrix = columns[:, basis]
    return np.linalg.solve(matrix, demand), np.linalg.solve(matrix.T, np.ones(len(demand)))


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 4000) -> list[tuple[tuple[int, ...], float]]:
    """(how often each size, how many sequences) of the relaxed few-size problem, by column generation."""
    k = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    basis, b = list(range(k)), np.array(demand, float)
    for _ in range(rounds):
        x, price = _simplex_master(columns, b, basis)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):  # unbounded knapsack, one size after the other
            if price[i] <= 1e-9:
                continue
            for start in range(s, capacity + 1, s):
                stop = min(start + s, capacity + 1)
                value = best[start - s : stop - s] + price[i]
                better = value > best[start:stop] + 1e-12
                best[start:stop] = np.where(better, value, best[start:stop])
                choice[start:stop] = np.where(better, i, choice[start:stop])
        if best[capacity] <= 1 + 1e-7:
            break
        new, at = np.zeros(k), capacity
        while at > 0 and choice[at] >= 0:
            new[choice[at]] += 1
            at -= sizes[choice[at]]
        if new @ price <= 1 + 1e-7:
            break
        d = np.linalg.solve(columns[:, basis], new)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        columns = np.column_stack((columns, new))
        basis[int(np.argmin(ratio))] = columns.shape[1] - 1
    x, _ = _simplex_master(columns, b, basis)
    return [(tuple(columns[:, j].astype(int)), v) for j, v in zip(basis, x, strict=True) if v > 1e-9]


def equal_groups(left: dict[int, int], lengths: list[int], groups: int) -> list[list[int]]:
    """The descending ``lengths`` in groups of about equal cardinality. Equal lengths stay together, and one that
    would overfill a group begins the next, so a frequent length is not rounded up to a rare one."""
    each, out, filled = -(-sum(left[s] for s in lengths) // groups), [], 0
    for s in lengths:
        if not out or filled + left[s] > each:
            out.append([])
            filled = 0
        out[-1].append(s)
        filled += left[s]
    return out


def substitute(slots: list[int], members: list[list[int]], live: list[int], left: dict[int, int], capacity: int) -> dict[int, int] | None:
    """Actual lengths for a configuration: each place takes the longest that its group has left, and the last
    one the longest length of any group that the rounding leaves room for. None if a place stays empty."""
    room, took = capacity, {}
    for j, group in enumerate(slots):
        s = next((x for x in (members[group] if j + 1 < len(slots) else live) if x <= room and left[x] > took.get(x, 0)), None)
        if s is None:
            return None
        took[s] = took.get(s, 0) + 1
        room -= s
    return took


def grouped(counts: dict[int, int], capacity: int, groups: int, rounds: int = ROUNDS) -> dict[tuple, int]:
    """The plan with ``groups`` groups of large lengths.

    Configurations are taken whole; what their fractions leave is grouped again, ``rounds`` times at most, and
    a round in which no configuration is worth one whole sequence takes those worth a third once. The rest of
    the large lengths and all small ones go best-fit into the free spaces."""
    left = {s: n for s, n in counts.items() if n}
    free: dict[int, list] = defaultdict(list)
    out: dict[tuple, int] = defaultdict(int)
    live = sorted((s for s in left if s * LARGE_SHARE > capacity), reverse=True)
    for _ in range(rounds):
        live = [s for s in live if left[s]]
        if not live:
            break
        members = equal_groups(left, live, groups)
        sizes = [group[0] for group in members]
        found = configurations(sizes, [sum(left[s] for s in group) for group in members], capacity)
        whole = any(v > 1 - 1e-6 for _, v in found)
        todo = [([g for g, c in enumerate(pattern) for _ in range(c)], int(v + 1e-6) if whole else int(v > 1 / 3)) for pattern, v in found]
        todo.sort(key=lambda x: -sum(sizes[g] for g in x[0]))
        placed = False
        for slots, n in todo:
            while n and slots and (took := substitute(slots, members, live, left, capacity)):
                run = min(n, *(left[s] // c for s, c in took.items()))
                contents = tuple(s for s, c in took.items() for _ in range(c))
                for s, c in took.items():
                    left[s] -= c * run
                free[capacity - sum(contents)].append((contents, run))
                n, placed = n - run, True
        if not placed:
            break
    best_fit({s: n for s, n in left.items() if n}, free, out, capacity)
    return dict(out)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> dict[tuple, int]:
    """How many sequences of which lengths. The grouping is refined until it meets the bound of total length;
    the best of the refinements counts."""
    best, bound = {}, -(-sum(s * c for s, c in counts.items()) // capacity)
    for k in (groups // 2, groups):
        made = grouped(counts, capacity, k)
        if not best or sum(made.values()) < sum(best.values()):
            best = made
        if sum(best.values()) <= bound:
            break
    return best


# ---- tokens and pieces ----


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if ids stand in the order of the merges; else None."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printed]
    byte_of = {chr(x): x for x in printed} | {chr(256 + k): x for k, x in enumerate(others)}
    ids = [model["vocab"]["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")] for pair in model["merges"]]
    if ids != sorted(ids):
        return None
    made = {token: i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
    return {bytes(byte_of[c] for c in token): i for token, i in made.items()}


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as the tokenizers library gives them. The pre-tokenizer always
    cuts before a space that stands behind a non-space and before an ASCII letter or digit, so texts are cut
    there. Parts are told apart by a 64-bit hash; each distinct one is encoded once and kept. A part without a
    special token goes through the same merges in tiktoken, which takes half the time."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        plain = file["normalizer"] is None and (file["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not file["pre_tokenizer"]["add_prefix_space"] and file["pre_tokenizer"]["use_regex"]
        ranks = _byte_ranks(file["model"]) if plain and file["model"]["type"] == "BPE" else None
        self.special = tuple(x["content"] for x in file["added_tokens"])
        if ranks:
            for x in self.special:
                ranks.pop(x.encode(), None)
        self.fast = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        self._forget()

    def _part(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def _forget(self) -> None:
        self.hashes, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.sizes, self.starts, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _learn(self, raw: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Encode the parts ``raw[first:last]`` of the given new hashes."""
        memory = raw.tobytes()
        made = [self._part(memory[x:y].decode("utf-8")) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        ids = np.fromiter(chain.from_iterable(made), "<u4", int(sizes.sum()))
        slots = len(self.sizes) + np.arange(len(hashes))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.slot = np.insert(self.hashes, at, hashes[order]), np.insert(self.slot, at, slots[order])
        self.sizes = np.concatenate((self.sizes, sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets) of the texts with these UTF-8 bytes."""
        if not len(raw):
            return np.empty(0, "<u4"), np.zeros(len(at), np.int64)
        first = np.flatnonzero(_cuts(raw, at))
        last = np.append(first[1:], len(raw))
        hashes = _hashes(raw, first, last)
        known, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self._forget()
        found = np.searchsorted(self.hashes, known)
        fresh = np.ones(len(known), bool)
        inside = found < len(self.hashes)
        fresh[inside] = self.hashes[found[inside]] != known[inside]
        self._learn(raw, known[fresh], first[where[fresh]], last[where[fresh]])
        slot = self.slot[np.searchsorted(self.hashes, known)][back]
        size = self.sizes[slot]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.starts[slot] - (end - size), size) + np.arange(int(end[-1]))]
        return ids, np.concatenate(([0], end))[np.searchsorted(first, at)]


def _cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a part begins. Every such place is a border of two tokens, whatever stands around it."""
    word, after = ASCII_WORD[raw], np.zeros(len(raw), bool)
    after[1:] = PRINTED[raw[:-1]]  # behind a byte that is surely no white space
    after[2:] |= (raw[1:-1] >= 128) & TWO_BYTES[raw[:-2]]
    before = np.zeros(len(raw), bool)
    before[:-1] = word[1:]
    out = (raw == 32) & after & before
    line = (raw == 10) & after & before  # a single line break between two texts is a token
    out |= line
    out[1:] |= line[:-1]
    out[1:] |= POINT[raw[1:]] & word[:-1]
    starts = at[:-1][np.diff(at) > 0]
    # nothing that stands in another text decides
    for k in (0, 1):
        near = starts + k
        out[near[near < len(raw)]] = False
    short = starts[starts > 0] - 1
    out[short] = False
    out[starts] = True
    return out


def _hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of adjacent byte ranges, in portions of bounded work arrays."""
    size = last - first
    out, a = np.empty(len(size), np.uint64), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(first, first[a] + tk.HASH_CHARS)))
        own = size[a:b]
        starts = np.cumsum(own) - own
        power = np.full(int(own.max()), tk.PRIME)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        value = tk.BYTE_KEY[raw[first[a] : last[b - 1]]]
        value *= power[np.arange(len(value)) - np.repeat(starts, own)]
        out[a:b] = np.add.reduceat(value, starts)
        a = b
    return tk.mix(out + size.astype(np.uint64) * tk.PRIME)


def _pieces(path: str, capacity: int, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())])

    def run(batches):
        encoder = Encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in tk.blocks(batch, "text", BLOCK_BYTES):
                ids, at = encoder.encode(*tk.text_buffers(part.column(1)))
                ids = np.insert(ids, at[1:], np.uint32(end))
                at = at + np.arange(len(at))
                n = np.diff(at)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * capacity  # of a cut document the first piece is the shorter one
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                memory = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                low = 4 * (at[doc] + start)
                crc = [zlib.crc32(memory[x:y]) for x, y in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order])
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - run_start
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                keys = part.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task)), pa.array(nth)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives the end id alone; repeated rows are packed each; a null key stays null. Only
    a document of more than ``capacity`` ids is cut, its first piece being the shorter one. The vocabulary
    file's path is a parameter; the file has to be there on every executor."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = source.mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long")
    made = materialize(made, "pieces")
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # rank of a piece among all of its length: its place in its task after those of earlier tasks
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("length", "task", "before")
    runs, used, base = [], defaultdict(int), 0
    for contents, n in sorted(plan(counts, capacity).items()):
        at = 0
        for length in contents:
            runs.append((length, used[length], base - used[length], at))
            used[length] += n
            at += length
        base += n
    # the runs follow from a histogram of ``capacity`` numbers, so their table does not grow with the documents
    # (867 runs for 1,507 pieces, 2,531 for 15,401, 2,741 for 95,332)
    shared = spark.sparkContext.broadcast(np.array(sorted(runs), np.int64).reshape(-1, 4))
    ranked = made.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("doc_id", key)


def _placed(shared):
    """Sequence and offset of each piece: its run is the last one of its length that begins at or below its rank."""

    def run(batches):
        table = shared.value
        length, low, shift, offset = table.T if len(table) else np.empty((4, 0), np.int64)
        first = np.searchsorted(length, np.arange(int(length.max(initial=0)) + 2))
        for batch in batches:
            own, rank = (np.asarray(batch.column(name)) for name in ("length", "rank"))
            lo, hi = first[own], first[own + 1] - 1
            while (lo < hi).any():  # binary search in all rows at once
                mid = (lo + hi + 1) // 2
                fits = low[mid] <= rank
                lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
            columns = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rank + shift[lo]), pa.array(offset[lo])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
