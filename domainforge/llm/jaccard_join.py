"""Exact similarity self-join of word-shingle sets by universe partition and the pigeonhole principle.

1. Every text becomes its set of hashed five-word shingles. Texts with equal sets form a class.
2. A class can only have a partner if three quarters of its shingles occur in some other text as well; the
   shingles are counted in hash buckets, as packed arrays.
3. For the classes left, sizes fall into bands of ratio 4/3. Within a band's scheme all shingles are hashed to
   ``m`` segments. Two sets that link differ in at most ``H`` shingles, so if the probing set spends ``H + 1``
   units, one on a segment that must be equal and two on one that may differ by one shingle, some segment
   matches. The smaller set indexes all its segments, and for some of them also the one-deletion
   neighbourhood; the larger chooses the cheapest allocation: its largest segments, whose lists are shortest,
   and a second unit on segments with indexed neighbourhoods only where empty segments leave it short.
4. Candidates are verified exactly on the sets. A long list gives a star to its first member; afterwards only
   members that are still in different components meet, so copies are never expanded into all pairs, and no
   link between different components is lost. Where a component is too large for one place, parities of its sets
   bound what two of them share, and only pairs that the bound leaves meet as sets.
5. What is dealt by signature or family goes in portions, so that the disk holds one of them at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainforge.llm import textkit as tk
from domainforge.operators.graph import components
from domainforge.plans.scratch import discard, materialize, pieces, release_shuffles, size_hint

SHINGLE = 5
#: One bucket of counted shingles for so many bytes of input.
BUCKET_BYTES = 6 << 20
#: Every such segment indexes its one-deletion neighbourhood; in bands of small sets every segment does.
NEIGHBOURHOOD_EVERY, SMALL_SET = 8, 40
#: One bucket of signatures for so many bytes of sets.
SIGNATURE_BYTES = 16 << 20
#: A candidate component of at most so many shingles (8 bytes each) is verified in one place; larger ones in
#: pairs, as stars.
FAMILY = 2 << 20
#: Sets whose signatures are made at once.
SLICE_BYTES = 2 << 20
#: The filter of wanted ids has at least so many bits for each id, and at most so many in all; a text that it lets
#: pass needlessly costs time and changes no result.
FILTER_BITS, FILTER_MOST = 16, 1 << 29
#: Bytes of sets or signatures that are shuffled at once: as many as the input is estimated to have, and at least these.
ROOM = 256 << 20
#: Bits of a set's parities: a power of two from its size up, within these bounds.
PARITY_LEAST, PARITY_MOST = 64, 1 << 17
SALT = np.uint64(0xA24BAED4963EE407)


def shingle_sets(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    words = tk.Words(*tk.text_buffers(part.column(part.schema.get_field_index(text))), tk.NOT_SPACE)
    return tk.distinct_per_row(*tk.grams(words.hash, words.row, SHINGLE))


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def set_keys(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two signed columns."""
    return tk.mix(_row_sums(tk.mix(v), at)).view(np.int64), _row_sums(tk.mix(v ^ SALT), at).view(np.int64)


# ---- texts to (bucket, block) arrays of shingles, and from these to counts by text ----


def _to_buckets(text: str, key: str, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("rows", pa.binary()), ("grams", pa.binary()), ("docs", pa.binary())])

    def run(batches):
        block = TaskContext.get().partitionId() << 28
        for batch in batches:
            for part in tk.blocks(batch, text):
                v, at = shingle_sets(part, text)
                n = np.diff(at)
                h1, h2 = set_keys(v, at)
                ids = np.asarray(part.column(part.schema.get_field_index(key)).fill_null(0).cast(pa.int64()))
                null = np.asarray(part.column(part.schema.get_field_index(key)).is_null())
                head = np.column_stack((ids, null, n, h1, h2)).astype(np.int64).tobytes()
                bucket = ((v >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                rows = np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
                low = (v[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = [b for b in range(buckets) if cut[b + 1] > cut[b] or b == 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([block] * len(used), pa.int64()),
                        pa.array([rows[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()),
                        pa.array([low[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()),
                        pa.array([head if b == 0 else None for b in used], pa.binary()),
                    ],
                    schema=schema,
                )
                block += 1

    return run


def _shared_in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which shingles of the bucket occur in two texts at least, counted by text."""
    rows = [np.frombuffer(x, np.uint16) for x in pdf["rows"]]
    grams = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["grams"]])
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cut = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    hits = [r[twice[cut[k] : cut[k + 1]]] for k, r in enumerate(rows)]
    # the more buckets, the fewer shingles of a block are in each: a list of its rows is then shorter than counts of all
    dense = [len(r) > 2 * (int(r.max()) + 1) if len(r) else False for r in hits]
    counts = [np.bincount(r).astype(np.int32).tobytes() if d else None for r, d in zip(hits, dense)]
    return pd.DataFrame({"block": pdf["block"], "counts": counts, "hits": [None if d else r.tobytes() for r, d in zip(hits, dense)], "docs": pdf["docs"]})


def _by_text(pdf: pd.DataFrame) -> pd.DataFrame:
    head = np.frombuffer(next(x for x in pdf["docs"] if x is not None), np.int64).reshape(-1, 5)
    shared = np.zeros(len(head), np.int64)
    for x in pdf["counts"].dropna():
        own = np.frombuffer(x, np.int32)
        shared[: len(own)] += own
    shared += np.bincount(np.frombuffer(b"".join(pdf["hits"].dropna()), np.uint16), minlength=len(head))
    ids = pd.array(head[:, 0], "Int64")
    ids[head[:, 1] == 1] = pd.NA
    return pd.DataFrame({"id": ids, "n": head[:, 2], "h1": head[:, 3], "h2": head[:, 4], "shared": shared})


# ---- the partition scheme ----


def bands(largest: int) -> list[int]:
    """Lower bounds of the size bands: a set of band b links only with bands b - 1, b and b + 1."""
    out = [1]
    while out[-1] <= largest:
        out.append(4 * out[-1] // 3 + 1)
    return out


def scheme(lows: list[int], b: int) -> tuple[int, int]:
    """(H, m) when the smaller set is of band b."""
    small = lows[b + 1] - 1
    most = (small + 4 * small // 3) // 7
    return most, most + 1 + (most * 2 + 24) // 25 + 2


def signatures(v: np.ndarray, at: np.ndarray, lows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, probing) of the sets. Row r has the sorted values ``v[at[r]:at[r+1]]``."""
    sizes = np.diff(at)
    band = np.searchsorted(np.array(lows), sizes, "right") - 1
    out: list[tuple] = []
    for index_band in sorted({*band.tolist(), *(band - 1).tolist()} - {-1}):
        most, m = scheme(lows, index_band)
        rows = np.flatnonzero((band == index_band) | (band == index_band + 1))
        own = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        place = ((v[own] >> np.uint64(17)) % np.uint64(m)).astype(np.int64)
        cell = owner * m + place
        weight = tk.mix(v[own] + SALT)
        order = np.argsort(cell, kind="stable")
        size = np.bincount(cell, minlength=len(rows) * m)
        total = _row_sums(weight[order], np.concatenate(([0], np.cumsum(size))))
        label = tk.mix(np.arange(m, dtype=np.uint64) + np.uint64(index_band << 32))
        exact = tk.mix(total + np.tile(label, len(rows)))
        small = lows[index_band + 1] <= SMALL_SET
        fuzzy = np.tile((np.arange(m) % NEIGHBOURHOOD_EVERY == 0) | small, len(rows)) & (size >= 2)
        reduced = tk.mix(total[cell] - weight + label[place])  # of each shingle: its segment without it
        cells_of = np.repeat(np.arange(len(rows)), m)
        indexing = band[rows] == index_band
        pick = np.flatnonzero(indexing[cells_of])
        out.append((exact[pick], rows[cells_of[pick]], False))
        pick = np.flatnonzero(fuzzy[cell] & indexing[owner])
        out.append((reduced[pick], rows[owner[pick]], False))
        # allocation of the probing sets: their largest segments first
        need = np.minimum(most, 2 * sizes[rows] // 7) + 1
        by_size = np.lexsort((np.tile(np.arange(m), len(rows)), -size, cells_of))
        rank = np.empty(len(size), np.int64)
        rank[by_size] = np.tile(np.arange(m), len(rows))
        chosen = (rank < need[cells_of]) & (size > 0)
        short = need - chosen.reshape(len(rows), m).sum(axis=1)
        doubled = np.zeros(len(size), bool)
        for r in np.flatnonzero(short > 0):
            mine = by_size[r * m : (r + 1) * m]
            upgrade = mine[chosen[mine] & fuzzy[mine]][: short[r]]
            doubled[upgrade] = True
            if (left := short[r] - len(upgrade)) > 0:  # tiny sets: both may lack the segment
                chosen[mine[size[mine] == 0][:left]] = True
        pick = np.flatnonzero(chosen)
        out.append((exact[pick], rows[cells_of[pick]], True))
        pick = np.flatnonzero(doubled[cell])
        out.append((reduced[pick], rows[owner[pick]], True))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([np.full(len(x[0]), x[2]) for x in out])


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    """The four bits of each id in a filter of ``size`` bits, a power of two, one row an id."""
    h = tk.mix(np.asarray(ids).astype(np.int64).view(np.uint64) ^ SALT)
    return np.column_stack([(tk.mix(h + np.uint64(k)) & np.uint64(size - 1)).astype(np.int64) for k in range(4)])


def _filter_words(size: int):
    def run(batches):
        for batch in batches:
            at = np.sort(_bits(batch.column(0), size).ravel())
            if len(at):
                word, first = np.unique(at >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return run


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the ``n`` long ids of a one-column table, as 64-bit words."""
    size = min(FILTER_MOST, max(64, 1 << (FILTER_BITS * n - 1).bit_length())) if n else 64
    found = ids.mapInArrow(_filter_words(size), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bits(ids, len(words) << 6)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def parities(v: np.ndarray) -> bytes:
    """Of each cell of the universe, whether an odd number of the set's shingles is in it."""
    width = min(max(PARITY_LEAST, 1 << (len(v) - 1).bit_length()), PARITY_MOST)
    odd = np.bincount(((v >> np.uint64(11)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(marks: list[bytes]) -> np.ndarray:
    """Parities of several sets, brought to the fewest cells that one of them has, as 64-bit words."""
    words = min(len(m) for m in marks) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0) for m in marks])


def may_link(total, x: np.ndarray, y: np.ndarray):
    """Whether sets of ``total`` shingles together may link: every cell that differs has a shingle of one set only,
    so 2 * intersection <= total - cells."""
    return total >= 7 * np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


SETS = "c long, n long, set binary, marks binary"


def _chosen(words, keep: bool = True):
    """Rows whose column ``c`` passes the broadcast filter, or fails it."""

    def run(batches):
        for batch in batches:
            ok = passes(words.value, batch.column(batch.schema.get_field_index("c")).to_numpy())
            yield batch.filter(pa.array(ok if keep else ~ok))

    return run


def _sets(text: str, key: str, wanted=None):
    """(c, n, set, marks): the class key, size, shingles and parities of each text, of those whose id passes the
    broadcast filter ``wanted`` if there is one. Texts that pass by chance are of other classes or copies."""
    schema = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("marks", pa.binary())])

    def run(batches):
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(passes(wanted.value, batch.column(batch.schema.get_field_index(key)).to_numpy())))
            for part in tk.blocks(batch, text):
                v, at = shingle_sets(part, text)
                h1, _ = set_keys(v, at)
                ok = np.unique(h1, return_index=True)[1]
                ok = ok[np.diff(at)[ok] > 0]
                own = [v[at[r] : at[r + 1]] for r in ok]
                yield pa.RecordBatch.from_arrays([pa.array(h1[ok]), pa.array(np.diff(at)[ok]), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([parities(x) for x in own], pa.binary())], schema=schema)

    return run


def _signature_rows(buckets: int, lows: list[int], portion: int = 0, portions: int = 1):
    """The signatures of the sets by bucket, of every ``portions``-th bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("rows", pa.binary()), ("docs", pa.binary())])

    def run(batches):
        for batch in batches:
            total, start = np.cumsum(pc.binary_length(batch.column(2)).to_numpy()), 0
            while start < batch.num_rows:
                end = int(np.searchsorted(total, (total[start - 1] if start else 0) + SLICE_BYTES, "right"))
                end = min(max(end, start + 1), start + 2000, batch.num_rows)
                part, start = batch.slice(start, end - start), end
                raw = part.column(2).to_pylist()
                at = np.concatenate(([0], np.cumsum([len(x) // 8 for x in raw])))
                sig, row, probing = signatures(np.frombuffer(b"".join(raw), np.uint64), at, lows)
                docs = np.column_stack((np.asarray(part.column(0)), np.asarray(part.column(1)))).astype(np.int64)
                bucket = ((sig >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                sig, flag = sig[order], (row.astype(np.uint16) | (probing.astype(np.uint16) << 15))[order]
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero((np.diff(cut) > 0) & (np.arange(buckets) % portions == portion))
                heads = []
                for b in used:
                    here = flag[cut[b] : cut[b + 1]]
                    own, back = np.unique(here & 0x7FFF, return_inverse=True)
                    flag[cut[b] : cut[b + 1]] = back.astype(np.uint16) | (here & 0x8000)
                    heads.append(docs[own].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array([sig[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()), pa.array([flag[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()), pa.array(heads, pa.binary())],
                    schema=schema,
                )

    return run


def fits(x, y):
    """Sizes that allow 100 * intersection >= 75 * union."""
    return 100 * np.minimum(x, y) >= 75 * np.maximum(x, y)


def _ordered(docs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ok = (docs[a, 0] != docs[b, 0]) & fits(docs[a, 1], docs[b, 1])
    x, y = docs[a[ok], 0], docs[b[ok], 0]
    return np.column_stack((np.minimum(x, y), np.maximum(x, y)))


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs to verify, and the longer lists whose members must end up compared across components."""
    sig = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["sigs"]])
    docs = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in pdf["docs"]]
    base = np.concatenate(([0], np.cumsum([len(x) for x in docs])))
    flags = [np.frombuffer(x, np.uint16) for x in pdf["rows"]]
    row = np.concatenate([(f & 0x7FFF).astype(np.int64) + base[k] for k, f in enumerate(flags)])
    probing = np.concatenate([(f >> 15).astype(bool) for f in flags])
    docs = np.concatenate(docs)
    order = np.argsort(sig, kind="stable")
    sig, row, probing = sig[order], row[order], probing[order]
    edge = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
    size = np.diff(edge)
    probes = np.add.reduceat(probing.astype(np.int64), edge[:-1]) if len(sig) else size
    content = np.add.reduceat(tk.mix((docs[row, 0] * 2 + probing).view(np.uint64)), edge[:-1]) if len(sig) else sig
    mixed = np.flatnonzero((size > 1) & (probes > 0) & (probes < size))
    mixed = mixed[np.unique(content[mixed], return_index=True)[1]]  # many segments make the same list
    two = edge[mixed[size[mixed] == 2]]
    pairs, lists = [_ordered(docs, row[two], row[two + 1])], set()
    for k in mixed[size[mixed] > 2]:
        who, role = row[edge[k] : edge[k + 1]], probing[edge[k] : edge[k + 1]]
        p, i = np.unique(who[role]), np.unique(who[~role])
        if len(p) * len(i) <= 4 * (len(p) + len(i)):
            a, b = np.repeat(p, len(i)), np.tile(i, len(p))
        else:
            members, first = np.unique(docs[who, 0], return_index=True)
            a, b = np.full(len(members), who[first[0]]), who[first]
            lists.add(members.tobytes())
        pairs.append(_ordered(docs, a, b))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    kept = [np.frombuffer(x, np.int64) for x in sorted(lists)]
    none = pd.Series([pd.NA] * len(kept), dtype="Int64")
    return pd.DataFrame(
        {
            "a": pd.concat([pd.Series(pairs[:, 0], dtype="Int64"), none], ignore_index=True),
            "b": pd.concat([pd.Series(pairs[:, 1], dtype="Int64"), none], ignore_index=True),
            "members": pd.Series([None] * len(pairs) + kept, dtype=object),
        }
    )


def _across(forest: bool):
    """Pairs of a list's members that are in different components and may link; if ``forest``, only as many as join
    all of these components should each pair link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("total", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                c, n, label = (batch.column(k)[row].values.to_numpy(zero_copy_only=False).copy() for k in range(3))
                marks = _folded(batch.column(3)[row].as_py())
                for k in range(len(c) - 1):
                    other = k + 1 + np.flatnonzero((label[k + 1 :] != label[k]) & fits(n[k], n[k + 1 :]))
                    other = other[may_link(n[k] + n[other], marks[other], marks[k])]
                    if forest and len(other):
                        joined, first = np.unique(label[other], return_index=True)
                        other = other[first]
                        label[np.isin(label, joined)] = label[k]
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c[k], c[other])), pa.array(np.maximum(c[k], c[other])), pa.array(n[k] + n[other])], schema=schema)

    return run


def _possible(batches):
    """Of pairs with sizes and parities those that may link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("total", pa.int64())])
    for batch in batches:
        a, b, total, x, y = (batch.column(k) for k in range(5))
        keep = [bool(may_link(total[k].as_py(), *_folded([x[k].as_py(), y[k].as_py()]))) for k in range(batch.num_rows)]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask), total.filter(mask)], schema=schema)


def _similar(p: np.ndarray, q: np.ndarray) -> bool:
    both = np.concatenate((p, q))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(p) + len(q) - common)


def _family(found: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """The links that join the members of one small candidate component: every candidate pair is verified
    unless links found before connect its ends already."""
    sets = sets.sort_values("c")
    ids = sets["c"].to_numpy()
    value = [np.frombuffer(x, np.uint64) for x in sets["set"]]
    size = np.array([len(v) for v in value])
    label = np.arange(len(ids))
    out, tried = [], set()

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        """Verify the pairs whose ends are apart when their turn comes."""
        for k in np.flatnonzero((label[a] != label[b]) & fits(size[a], size[b])).tolist():
            x, y = int(a[k]), int(b[k])
            if label[x] != label[y] and (x, y) not in tried:
                tried.add((x, y))
                if _similar(value[x], value[y]):
                    label[label == label[y]] = label[x]
                    out.append((ids[x], ids[y]))

    is_list = found["members"].notna().to_numpy()
    lists = sorted((np.searchsorted(ids, m) for m in found["members"][is_list]), key=len, reverse=True)
    for own in lists:  # the longest first: their stars join most of a group of copies at once
        meet(np.full(len(own) - 1, own[0]), own[1:])
    pairs = np.unique(found.loc[~is_list, ["a", "b"]].to_numpy(np.int64).reshape(-1, 2), axis=0)
    meet(np.searchsorted(ids, pairs[:, 0]), np.searchsorted(ids, pairs[:, 1]))
    for own in lists:
        if (label[own] != label[own[0]]).any():
            for k in range(len(own) - 1):
                rest = own[k + 1 :][label[own[k + 1 :]] != label[own[k]]]
                meet(np.full(len(rest), own[k]), rest)
    return pd.DataFrame(out, columns=["a", "b"])


def _verify(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        a, b, x, y = (batch.column(k) for k in range(4))
        keep = [_similar(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)) for k in range(batch.num_rows)]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], schema=schema)


def _words(ids: DataFrame):
    """The broadcast filter of a one-column table of classes."""
    return ids.sparkSession.sparkContext.broadcast(id_filter(ids, ids.count()))


def _portions(volume: int, room: int) -> int:
    return max(1, -(-int(volume or 0) // room))


def _verified(pairs: DataFrame, sets: DataFrame, room: int) -> DataFrame:
    """The links among written pairs, which have their common size ``total``. Each pair carries one of its sets
    to the other, so they go in portions."""
    spark = pairs.sparkSession
    portions = _portions(pairs.agg(F.sum("total")).first()[0] or 0, max(1, room // 8))
    out = None
    for k in range(portions):
        own = pairs.where(F.pmod(F.xxhash64("a"), F.lit(portions)) == k) if portions > 1 else pairs
        words = _words(own.select(F.col("a").alias("c")).unionAll(own.select("b")).distinct())
        near = sets.select("c", "set").mapInArrow(_chosen(words), "c long, set binary")
        with_b = own.join(near.select(F.col("c").alias("b"), F.col("set").alias("y")), "b")
        both = with_b.join(near.select(F.col("c").alias("a"), F.col("set").alias("x")), "a")
        part = materialize(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "verified")
        words.unpersist()
        release_shuffles(spark)
        out = part if out is None else out.unionAll(part)
    return out


def _resolve_wide(wide: DataFrame, links: DataFrame, sets: DataFrame, room: int) -> DataFrame:
    """Links that join the members of the large families, added to ``links``: first one partner of each set, then the
    pairs between what is apart, then the lists, first as if all that may link did."""
    spark = wide.sparkSession
    small = sets.select("c", "n", "marks")
    sizes = {k: sets.select(F.col("c").alias(k), F.col("n").alias(f"n{k}")) for k in "ab"}
    pairs = materialize(wide.where("a is not null").select("a", "b").distinct(), "pairs")
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).join(sizes["b"], "b").select("a", "b", (2 * F.col("nb")).alias("total"))
    links = links.unionAll(_verified(materialize(one, "partners"), sets, room))
    label = components(links)
    x, y = (label.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    apart = pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    marked = apart.join(small.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("y")), "b").join(small.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("marks").alias("x")), "a")
    possible = materialize(marked.select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "x", "y").mapInArrow(_possible, "a long, b long, total long"), "possible")
    release_shuffles(spark)
    links = links.unionAll(_verified(possible, sets, room))
    lists = materialize(wide.where("members is not null").select("members").distinct().select(F.xxhash64("members").alias("list"), F.explode("members").alias("c")), "lists")
    release_shuffles(spark)
    for forest in (True, False):
        label = components(links).select(F.col("node").alias("c"), "component")
        labelled = materialize(lists.join(label, "c", "left").select("list", "c", F.coalesce("component", "c").alias("label")), "labelled")
        release_shuffles(spark)
        # few lists are open still: only their members are looked at
        open_lists = labelled.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("list")
        members = (
            labelled.join(open_lists, "list")
            .join(small, "c")
            .groupBy("list")
            .agg(F.collect_list(F.struct("c", "n", "label", "marks")).alias("m"))
            .select("m.c", "m.n", "m.label", "m.marks")
        )
        across = materialize(members.mapInArrow(_across(forest), "a long, b long, total long").distinct(), "across")
        release_shuffles(spark)
        links = links.unionAll(_verified(across, sets, room))
        for used in (labelled, across):
            discard(used)
    for used in (pairs, possible, lists):
        discard(used)
    return links


def similarity_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row of ``docs``.

    Two texts link when 100 * intersection >= 75 * union of their shingle sets. A text of fewer than five words
    has its whole sequence as one shingle; a null or wordless text has no shingle, links with nothing, and is
    its own component. Repeated rows are returned each. A null key counts as a text but never names a
    component unless all of its texts have null keys. Sets are compared by 64-bit shingle hashes."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    buckets = pieces(docs, BUCKET_BYTES)
    counted = docs.mapInArrow(_to_buckets("text", "id", buckets), "bucket int, block long, rows binary, grams binary, docs binary")
    shared = counted.groupBy("bucket").applyInPandas(_shared_in_bucket, "block long, counts binary, hits binary, docs binary")
    profile = materialize(shared.groupBy("block").applyInPandas(_by_text, "id long, n long, h1 long, h2 long, shared long"), "profile")
    release_shuffles(spark)
    classes = materialize(profile.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.max("shared").alias("shared")), "classes")
    partnered = classes.where("100 * shared >= 75 * n").select("id", "h1", "h2")
    # a filter finds their texts where they are: texts are never shuffled
    named_ids = partnered.where("id is not null").select("id")
    wanted = spark.sparkContext.broadcast(id_filter(named_ids, named_ids.count()))
    sets = docs.where("id is not null").mapInArrow(_sets("text", "id", wanted), SETS)
    # a class whose texts all have null keys is found by its hash
    nameless = partnered.where("id is null").select(F.col("h1").alias("c"))
    if not nameless.isEmpty():
        sets = sets.unionAll(docs.where("id is null").mapInArrow(_sets("text", "id"), SETS).join(nameless, "c", "left_semi"))
    every = sets = materialize(sets, "sets")
    wanted.unpersist()
    release_shuffles(spark)
    # copies that passed the filter and repeated rows: only sets that may be of such a class are shuffled
    again = every.groupBy("c").count().where("count > 1").select("c")
    if not again.isEmpty():
        words = _words(again)
        copies = materialize(every.mapInArrow(_chosen(words), SETS).dropDuplicates(["c"]), "copies")
        sets = every.mapInArrow(_chosen(words, False), SETS).unionAll(copies)
        release_shuffles(spark)
    count, volume, largest = sets.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    volume, largest = volume or 0, largest or 1
    room = max(ROOM, size_hint(docs))
    narrow = pieces(sets, SIGNATURE_BYTES, 6)
    # about a signature for each shingle, of 10 bytes and a head of 16 for the bucket's signatures of a set
    portions = min(narrow, _portions(volume * 10 + 16 * min(volume, count * narrow), room))
    found = None
    for k in range(portions):
        rows = sets.mapInArrow(_signature_rows(narrow, [*bands(largest), 2**62], k, portions), "bucket int, sigs binary, rows binary, docs binary")
        part = materialize(rows.groupBy("bucket").applyInPandas(_candidates, "a long, b long, members array<long>"), "candidates")
        release_shuffles(spark)
        found = part if found is None else found.unionAll(part)
    spokes = found.where("members is not null").select(F.element_at("members", 1).alias("a"), F.explode("members").alias("b"))
    family = components(found.where("a is not null").select("a", "b").unionAll(spokes)).select(F.col("node").alias("c"), F.col("component").alias("family"))
    family = family.join(sets.select("c", "n"), "c")
    sized = materialize(family.join(family.groupBy("family").agg(F.sum("n").alias("count")), "family"), "families")
    release_shuffles(spark)
    tagged = found.withColumn("c", F.coalesce("a", F.element_at("members", 1))).join(sized.drop("n"), "c").drop("c")
    # small families: resolved where they are; their sets are shuffled twice
    few = sized.where(F.col("count") <= FAMILY).select("c", "n", F.col("family").alias("of"))
    n = max(narrow, int(spark.conf.get("spark.sql.shuffle.partitions")))
    portions = _portions(16 * (few.agg(F.sum("n")).first()[0] or 0), room)
    small = tagged.where(F.col("count") <= FAMILY).select("family", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), "members").distinct()
    links = None
    for k in range(portions):
        here, own = small, few.select("c", "of")
        if portions > 1:
            here, own = (x.where(F.pmod(F.xxhash64(y), F.lit(portions)) == k) for x, y in ((here, "family"), (own, "of")))
        words = _words(own.select("c"))
        with_sets = sets.select("c", "set").mapInArrow(_chosen(words), "c long, set binary").join(own, "c")
        part = here.repartition(n, "family").groupBy("family").cogroup(with_sets.repartition(n, "of").groupBy("of"))
        part = materialize(part.applyInPandas(lambda x, y: _family(x, y), "a long, b long"), "links")
        words.unpersist()
        release_shuffles(spark)
        links = part if links is None else links.unionAll(part)
    wide = tagged.where(F.col("count") > FAMILY)
    if not sized.where(F.col("count") > FAMILY).isEmpty():
        links = _resolve_wide(wide, links, sets, room)
    label = components(links)
    class_label = classes.join(label.select(F.col("node").alias("h1"), "component"), "h1", "left").withColumn("root", F.coalesce("component", "h1"))
    named = class_label.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = class_label.join(named, "root").select("h1", "h2", "component_id")
    full = profile.where("n > 0").join(by_class, ["h1", "h2"]).select("id", "n", "component_id")
    empty = profile.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    for used in (every, sized):
        discard(used)
    return full.unionAll(empty).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
