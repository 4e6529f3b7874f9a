"""N-gram Jaccard join by PartEnum signatures, and the groups it makes.

A document's set is its distinct word shingles, as 64-bit hashes. Sets link when
100 * |intersection| >= 100 * threshold * |union|, which for sizes n and m is the
same as a symmetric difference of at most (n + m) / 9 at 0.8.

Signatures. Sizes are cut into bands [L, 2L] that overlap by the factor 1/threshold,
so that two sets that can link lie in one band. In a band the domain of features is
split by a hash into groups of partitions. Two sets that differ in d features have,
among any d // (K + 1) + 1 groups, one in which no more than K partitions differ;
all ways to choose the other partitions are enumerated, and each choice together
with its features is a signature: one of them is shared. A set goes through the
groups in their order until it has met enough *usable* ones, in which every choice
holds features, and emits every signature with features on the way. Of two sets the
one that stops first has enough usable groups, and the other emits all that it
emits there, so nothing rests on partitions that are empty in both. A set that runs
out of groups takes part in a second split of the domain, and so on.

Candidates. Sets that share a signature form a bucket; buckets of the same sets are
one. Copies of a set are folded before all this. Then, each step on what is left:

1. a shingle that one candidate alone has is missing in every partner, so a set with
   more of those than a pair may differ in links with nothing and is dropped. This
   leaves near copies, and takes away sets that merely have passages in common;
2. each set of a bucket is compared with the bucket's representative alone, the set
   that meets most others, which of edited copies is the original. Buckets whose sets
   are in one component by then are done;
3. in the buckets that remain, sets of different components are told apart by size and
   by parity sketches of SKETCH bits, side by side in arrays, and the few pairs that
   these can't tell apart are compared whole. A task holds two blocks of BLOCK sets at
   most: a larger bucket is cut, blocks of one component aren't paired, and the rows of
   a block are repeated once for each partner block. No more than those few pairs
   leaves a task. Step 3 is the one whose comparisons, though not its rows, can grow
   with the square of a bucket, and no exact join of sets that are all about equally
   far apart can avoid them.

Comparing means intersecting the sets of 64-bit hashes, of which two different shingles
of a pair being equal is left out of account.

Defined results: a null or empty text, or one of white space, has 0 shingles, links
with nothing and is its own component; fewer words than a shingle has make one
shingle of all of them; a null doc_id never names a component, and its row gets the
component of the documents with the same set, or null; rows that repeat a doc_id
are one node, with the links of all its texts; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm._graph import components
from claimloom.llm._shared import text_of, written
from claimloom.llm.byte_bpe import small

WORDS = 5
PERCENT = 80
#: partitions in a group, and how many of them may differ; small sets have groups of one
GROUP, DIFFER, LEAST_SIZE = 3, 1, 64
SPLITS = 64
#: sets in a block of a large bucket
BLOCK = 4_096
#: shingles of candidates that are counted in one task
SLICE = 2_000_000
#: characters of texts that a task has in arrays at once
TEXT_AT_ONCE = 1_000_000
BLOOM_BITS = 26
SKETCH = 1024
U = np.uint64
_BASE, _SPACES = U(0x100000001B3), np.isin(np.arange(256), [32, *range(9, 14)])
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=U)
_powers = np.ones((2, 1), dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    """_BASE to the 0 .. n, and to the 0 .. -n, modulo 2^64."""
    global _powers
    if _powers.shape[1] <= n:
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        steps = np.repeat(np.array([[_BASE], [inverse]], dtype=U), n, axis=1)
        _powers = np.concatenate([np.ones((2, 1), dtype=U), np.cumprod(steps, axis=1, dtype=U)], axis=1)
    return _powers


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data = [(x or "").encode().lower() + b" " for x in texts]  # bytes: A-Z alone are lowered
    edges = np.cumsum([0, *map(len, data)])
    chars = np.frombuffer(b"".join(data), dtype=np.uint8)
    inside = ~_SPACES[chars]
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = turns[::2], turns[1::2]
    power, back = powers(len(chars))
    run = np.concatenate([np.zeros(1, dtype=U), np.cumsum(chars * power[: len(chars)], dtype=U)])
    hashed = mix((run[end] - run[begin]) * back[begin] + (end - begin).astype(U))
    at = np.searchsorted(begin, edges)  # the first word of each text
    count = max(0, len(hashed) - words + 1)
    grams = np.zeros(count, dtype=U)
    for i in range(words):
        grams += hashed[i : i + count] * _TURNS[i % 5] + U(i)
    grams = mix(grams)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            short = hashed[a:b] * _TURNS[: b - a]
            sets.append(mix(np.array([short.sum(dtype=U) + U(1000 + b - a)], dtype=U)))
        else:
            sets.append(np.zeros(0, dtype=U))
    return sets


def set_key(features: np.ndarray) -> bytes:
    return hashlib.blake2b(features.tobytes(), digest_size=16).digest()


def sketch_of(features: np.ndarray) -> np.ndarray:
    """SKETCH bits, each the parity of the features that a hash gives to it.

    Sketches differ in no more bits than their sets do in features."""
    bits = np.bincount((mix(features) % U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def bands(largest: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """[low, high] by band; a pair of sizes that can link lies in one of them."""
    found, low = [], 1
    while not found or low <= largest:
        found.append((low, max(2 * low, low + 2)))
        # the next band begins where this one no longer holds all partners
        low = found[-1][1] * percent // 100 + 1
    return found


def jobs_of(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Rows (index of the set, band, most features that a pair in it may differ by)."""
    rows = []
    all_bands = bands(int(sizes.max(initial=1)), percent)
    for j, (low, high) in enumerate(all_bands):
        onward = high * percent // 100 + 1  # from here on the next band holds a pair of such sizes
        for i in np.flatnonzero((sizes >= low) & (sizes <= high)).tolist():
            n = int(sizes[i])
            partner = min(n * 100 // percent, high) if n < onward else onward - 1
            rows.append((i, j, (n + partner) * (100 - percent) // (100 + percent)))
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def layout(high: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """groups, partitions in each, partitions of it that may differ, for a band up to high."""
    size, differ = (GROUP, DIFFER) if high >= LEAST_SIZE else (1, 0)
    most = 2 * high * (100 - percent) // (100 + percent)
    return int(1.12 * (most // (differ + 1) + 1)) + 3 * (most > 0), size, differ


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays: the index of a set, and a signature of it."""
    owners, found = [], []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    todo = jobs_of(sizes, percent)
    high = np.array([h for _, h in bands(int(sizes.max(initial=1)), percent)])
    for split in range(SPLITS):
        if not len(todo):
            break
        weak = []
        for group, differ in ((1, 0), (GROUP, DIFFER)):
            shapes = {j: layout(int(high[j]), percent) for j in np.unique(todo[:, 1]).tolist()}
            own = todo[[shapes[j][1:] == (group, differ) for j in todo[:, 1].tolist()]]
            if not len(own):
                continue
            groups = np.array([shapes[j][0] for j in own[:, 1].tolist()])
            cells = groups * group
            first = np.concatenate([[0], np.cumsum(cells)])
            lengths = sizes[own[:, 0]]
            features = np.concatenate([sets[i] for i in own[:, 0].tolist()])
            job = np.repeat(np.arange(len(own)), lengths)
            seed = mix((own[:, 1].astype(U) << U(8)) + U(split) + U(1))
            drawn = mix(features + seed[job])
            cell = first[job] + ((drawn >> U(32)) * cells[job].astype(U) >> U(32)).astype(np.int64)
            content, held = np.zeros(first[-1], dtype=U), np.bincount(cell, minlength=first[-1])
            np.add.at(content, cell, mix(drawn ^ U(0x5851F42D4C957F2D)))
            group_job = np.repeat(np.arange(len(own)), groups)
            content, full = content.reshape(-1, group), held.reshape(-1, group) > 0
            choices = list(combinations(range(group), group - differ))
            filled = np.stack([full[:, list(c)].any(axis=1) for c in choices], axis=1)
            usable = filled.all(axis=1)
            # groups with enough usable ones before them aren't gone through
            start = first[:-1] // group
            before = np.cumsum(usable) - usable
            needed = own[:, 2] // (differ + 1) + 1
            passed = before - before[start][group_job] < needed[group_job]
            met = np.add.reduceat(usable.astype(np.int64), start)
            weak.append(own[met < needed])
            number = np.arange(len(group_job)) - start[group_job]
            label = mix(seed[group_job] + number.astype(U) * U(64))
            for c, choice in enumerate(choices):
                at = np.flatnonzero(passed & filled[:, c])
                value = label[at] + U(c)
                for k in choice:
                    value = mix(value) + content[at, k]
                owners.append(own[group_job[at], 0])
                found.append(mix(value))
        todo = np.concatenate(weak) if weak else todo[:0]
    if len(todo):
        # out of splits: each feature is a signature. Of a pair both are here, or the other has enough usable groups.
        left = np.unique(todo[:, 0])
        owners.append(np.repeat(left, sizes[left]))
        found.append(mix(np.concatenate([sets[i] for i in left.tolist()]) + U(SPLITS)))
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    return np.concatenate(owners), np.concatenate(found)


def set_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_key and node (null for an empty set) for every row of docs.

    node is the first half of set_key. Two sets that had the same would be told
    apart when sets are compared, which is by the whole of them."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, TEXT_AT_ONCE):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            keys = [set_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([None if k is None else node_of(k) for k in keys], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "set_key", "node"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return read.mapInArrow(keyed, "doc_id long, n_shingles long, set_key binary, node long")


def signature_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """sig, node: the signatures of every set; a task emits a set that it meets again once."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in small(batches, TEXT_AT_ONCE):
            new = {}
            for features in shingle_sets(batch.column("text").to_pylist(), words):
                if len(features) and (key := set_key(features)) not in seen:
                    new[key] = features
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(new)
            owner, sig = signatures(list(new.values()), percent)
            nodes = np.array([node_of(k) for k in new] or [0], dtype=np.int64)
            for at in range(0, len(sig), 1 << 18):
                cut = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[cut].view(np.int64)), pa.array(nodes[owner[cut]])], names=["sig", "node"]
                )

    read = docs.filter(F.col("doc_id").isNotNull()).select(text_of().alias("text"))
    return read.mapInArrow(emitted, "sig long, node long")


def bucket_rows(rows: DataFrame) -> DataFrame:
    """sig, node of the signatures that two sets or more share, once for each set of sharers.

    Near copies share most of their signatures: buckets with the same nodes are one.
    They are told apart by the number of nodes and by 128 bits of hashes of them."""
    ordered, bucket = Window.partitionBy("sig").orderBy("node"), Window.partitionBy("sig")
    marked = rows.withColumn("before", F.lag("node").over(ordered)).filter(F.col("before").isNull() | (F.col("before") != F.col("node")))
    both = [F.bit_xor(F.xxhash64("node", F.lit(k))).over(bucket).alias(f"h{k}") for k in (1, 2)]
    held = marked.select("node", F.count("*").over(bucket).alias("n"), *both).filter("n > 1")
    return held.select(F.xxhash64("n", "h1", "h2").alias("sig"), "node").distinct()


def bitmap_of(wanted: DataFrame):
    """A bitmap, broadcast, of the doc_ids in wanted: 2^BLOOM_BITS bits however many they are."""
    parts = (
        wanted.select((slot_of() + 1).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    bitmap = np.zeros(1 << (BLOOM_BITS - 3), dtype=np.uint8)
    for row in parts.toLocalIterator():
        at = (row["part"] - 1) * len(row["bits"])
        bitmap[at : at + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(bitmap)


def slot_of() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << BLOOM_BITS))


def named_sets(batches: Iterator[pa.RecordBatch], bitmap, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows (doc_id, text, slot) that the bitmap lets through and that have shingles, and their sets."""
    for batch in small(batches, TEXT_AT_ONCE):
        slots = batch.column("slot").to_numpy()
        named = (bitmap.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1
        batch = batch.filter(pa.array(named.astype(bool)))
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        filled = [len(s) > 0 for s in sets]
        yield batch.filter(pa.array(filled, pa.bool_())), [s for s in sets if len(s)]


def slotted(docs: DataFrame) -> DataFrame:
    read = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return read.withColumn("slot", slot_of())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by keys, cut where keys change only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            last = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The values of binary rows, one after the other, without Python objects of them."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], "<i4")[chunk.offset : chunk.offset + len(chunk) + 1]
            if ends[0] < ends[-1]:
                parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).view(kind)


def lone_owners(nodes: np.ndarray, counts: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The owner of each shingle (32 bits) that one owner alone has; nodes are owners of counts shingles each.

    A shingle and the number of its owner make one word, so they are sorted in place, and take two such arrays at most."""
    owners, number = np.unique(nodes, return_inverse=True)
    pairs = features.astype("<u8")
    pairs <<= U(32)
    pairs |= np.repeat(number.astype("<u4"), counts)
    pairs.sort()
    pairs = pairs[np.concatenate([np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]])]
    number, shingle = pairs.view("<u4")[::2], pairs.view("<u4")[1::2]
    new = np.concatenate([[True], shingle[1:] != shingle[:-1], [True]]) if len(pairs) else np.zeros(1, bool)
    return owners[number[new[1:] & new[:-1]]]


def lone_shingles(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """node, lone: how many of its shingles no other candidate has, for each node of wanted (doc_id, node, n).

    The domain of shingles is cut into slices, more for more candidates, and a slice is
    counted in one task. What the slices found is added up in parts of the nodes; between
    the steps go arrays, a row for each batch and slice, or slice and part. A shingle is 32 bits within its slice: what these or the bitmap
    confuse counts as shared, so nothing that links is dropped."""
    slices = int((wanted.agg(F.sum("n")).first()[0] or 0) // SLICE) + 1
    parts = max(16, slices // 8)
    bitmap = bitmap_of(wanted)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in named_sets(batches, bitmap, words):
            if not sets:
                continue
            nodes = np.array([node_of(set_key(s)) for s in sets])
            features = mix(np.concatenate(sets) + U(7))
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            part = ((features >> U(32)) * U(slices) >> U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")  # the owners stay in order within a slice
            ends = np.cumsum(np.bincount(part, minlength=slices))
            out = []
            for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                if a < b:
                    own, counts = np.unique(owner[order[a:b]], return_counts=True)
                    out.append((k, nodes[own].tobytes(), counts.astype("<u4").tobytes(), features[order[a:b]].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 3))], names=["slice", "nodes", "counts", "features"]
            )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["slice"]):
            cuts = rows.column("slice").to_numpy()
            for k in np.unique(cuts).tolist():
                a, b = np.searchsorted(cuts, [k, k + 1]).tolist()
                nodes, counts, features = (joined(rows.column(c).slice(a, b - a), t) for c, t in (("nodes", "<i8"), ("counts", "<u4"), ("features", "<u4")))
                lone = lone_owners(nodes, counts, features)
                found, n = np.unique(lone, return_counts=True)
                part = (mix(found.view(U)) % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
                cut = [order[a:b] for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(parts), pa.int64()), pa.array([found[c].tobytes() for c in cut]), pa.array([n[c].astype("<u4").tobytes() for c in cut])],
                    names=["part", "nodes", "lone"],
                )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["part"]):
            nodes, lone = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("nodes", "<i8"), ("lone", "<u4")))
            found, at = np.unique(nodes, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, lone, len(found)).astype(np.int64))], names=["node", "lone"])

    cut = slotted(docs).mapInArrow(packed, "slice long, nodes binary, counts binary, features binary")
    found = cut.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(counted, "part long, nodes binary, lone binary")
    return found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(summed, "node long, lone long")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, node, n, sketch, text of the documents named in wanted (doc_id, node), so that
    a node has one doc_id: texts are shorter than their shingles.

    Documents that the bitmap lets through needlessly are joined away."""
    bitmap = bitmap_of(wanted)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in named_sets(batches, bitmap, words):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([node_of(set_key(s)) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch_of(s).tolist() for s in sets], pa.list_(pa.int64())),
                    batch.column("text"),
                ],
                names=["doc_id", "node", "n", "sketch", "text"],
            )

    held = slotted(docs).mapInArrow(found, "doc_id long, node long, n long, sketch array<long>, text string")
    return held.join(wanted, ["doc_id", "node"], "left_semi")


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def links_of(pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b of the pairs (x, y of nodes) whose sets link; a and b are doc_ids."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                x, y = (shingle_sets(some.column(c).to_pylist(), words) for c in ("ta", "tb"))
                yield some.select(["a", "b"]).filter(pa.array([links(p, q, percent) for p, q in zip(x, y)], pa.bool_()))

    whole = lambda node, doc, text: sets.select(F.col("node").alias(node), F.col("doc_id").alias(doc), F.col("text").alias(text))
    both = pairs.join(whole("x", "a", "ta"), "x").join(whole("y", "b", "tb"), "y").select("a", "b", "ta", "tb").filter("a != b")
    return both.mapInArrow(compared, "a long, b long")


def hub_pairs(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y: the nodes of each bucket with its representative, unless size or sketches tell them apart."""
    sizes = buckets.groupBy("sig").agg(F.count("*").alias("met"))
    reach = buckets.join(sizes, "sig").groupBy("node").agg(F.sum("met").alias("reach"))
    hubs = buckets.join(reach, "node").groupBy("sig").agg(F.max(F.struct("reach", "node")).alias("hub"))
    pairs = buckets.join(hubs, "sig").filter("node != hub.node").select(F.col("hub.node").alias("x"), F.col("node").alias("y")).distinct()
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    differ = F.aggregate(F.zip_with("sx", "sy", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    near = (
        pairs.join(side("x"), "x").join(side("y"), "y")
        .filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        .filter((100 + percent) * differ <= (100 - percent) * (F.col("nx") + F.col("ny")))
    )
    return near.select("x", "y")


def in_blocks(buckets: DataFrame, block: int) -> DataFrame:
    """sig, left, right, side, node, component: the rows of buckets by the pairs of blocks to compare.

    A bucket of up to block nodes is one block, its own partner. In a larger one
    components of more than block nodes have blocks of their own, which aren't paired."""
    sized = buckets.join(buckets.groupBy("sig").agg(F.count("*").alias("held")), "sig")
    zero = [F.lit(0).cast("long").alias(c) for c in ("left", "right", "side")]
    whole = sized.filter(F.col("held") <= block).select("sig", *zero, "node", "component")
    large = sized.filter(F.col("held") > block).select("sig", "node", "component", "held")
    large = large.join(large.groupBy("sig", "component").agg(F.count("*").alias("own")), ["sig", "component"])
    big = F.col("own") > block
    parts = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("long")
    cell = F.when(big, F.xxhash64("component", F.pmod(F.xxhash64("node"), parts("own")))).otherwise(F.xxhash64(F.pmod(F.xxhash64("component"), parts("held"))))
    placed = large.select("sig", "node", "component", cell.alias("cell"), F.when(big, F.col("component")).alias("home"))
    cells = placed.select("sig", "cell", "home").distinct()
    x, y = cells.alias("x"), cells.alias("y")
    met = x.join(y, F.expr("x.sig = y.sig AND x.cell <= y.cell AND (x.home IS NULL OR y.home IS NULL OR x.home != y.home)"))
    pairs = met.select("x.sig", F.col("x.cell").alias("left"), F.col("y.cell").alias("right"))
    ended = pairs.withColumn("cell", F.explode(F.array_distinct(F.array("left", "right"))))
    cut = placed.join(ended, ["sig", "cell"]).select("sig", "left", "right", (F.col("cell") == F.col("right")).cast("long").alias("side"), "node", "component")
    return whole.unionByName(cut)


def near_pairs(buckets: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """x, y: nodes that share a bucket (sig, node, component), not a component, and that size and sketches don't tell apart."""
    keys = ["sig", "left", "right"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys):
            sig, left, right, side, node, component, n = (rows.column(c).to_numpy() for c in (*keys, "side", "node", "component", "n"))
            bits = rows.column("sketch").combine_chunks().flatten().to_numpy().view(U).reshape(len(n), -1)
            new = (sig[1:] != sig[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            end = np.repeat([*starts[1:], len(n)], np.diff([*starts, len(n)]))
            at, step, found = np.arange(len(n)), 0, []
            while len(at):  # all rows with the one step places on; sizes rise within a group
                step += 1
                at = at[at + step < end[at]]
                at = at[100 * n[at] >= percent * n[at + step]]
                apart = (component[at] != component[at + step]) & ((left[at] == right[at]) | (side[at] != side[at + step]))
                a = at[apart]
                for cut in range(0, len(a), 100_000):
                    i = a[cut : cut + 100_000]
                    j = i + step
                    differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                    near = (100 + percent) * differ <= (100 - percent) * (n[i] + n[j])
                    found.append(np.stack([node[i[near]], node[j[near]]]))
            both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["x", "y"])

    rows = in_blocks(buckets, block).join(sets.select("node", "n", "sketch"), "node")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n").mapInArrow(compared, "x long, y long").distinct()


def _apart(buckets: DataFrame, sets: DataFrame, component: DataFrame | None) -> DataFrame:
    """sig, node, component of the buckets whose nodes are in several components."""
    at = sets.select("node", "doc_id")
    if component is None:
        at = at.withColumn("component", F.col("doc_id"))
    else:
        at = at.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = buckets.select("sig", "node").join(at.select("node", "component"), "node")
    several = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return written(rows.join(several, "sig").select("sig", "node", "component"), "buckets-apart")


def link_components(docs: DataFrame, classes: DataFrame, words: int, percent: int, block: int = BLOCK) -> DataFrame | None:
    """id, component of the documents that link with another set; None if there are none."""
    buckets = written(bucket_rows(signature_rows(docs, words, percent)), "buckets")
    wanted = classes.select("node", "n", F.col("rep").alias("doc_id")).join(buckets.select("node").distinct(), "node")
    wanted = written(wanted, "candidates")
    # a partner has at most n * 100 / percent shingles
    most = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent))
    hopeless = lone_shingles(docs, wanted, words).join(wanted, "node").filter(F.col("lone") > most).select("node")
    sets = written(sets_of(docs, wanted.join(hopeless, "node", "left_anti"), words), "candidate-sets")
    buckets = _apart(buckets, sets, None)
    if buckets.isEmpty():
        return None
    component = written(components(links_of(hub_pairs(buckets, sets, percent), sets, words, percent)), "components")
    buckets = _apart(buckets, sets, component)
    if buckets.isEmpty():
        return component
    more = links_of(near_pairs(buckets, sets, percent, block), sets, words, percent)
    before = component.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return written(components(more.unionByName(before)), "components")


def repeated_ids(table: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: each doc_id that has rows with different sets, with the representatives of these."""
    keyed = table.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    several = keyed.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low != high")
    return keyed.join(several, "doc_id").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def ngram_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    table = written(set_table(docs, words), "sets")
    classes = table.filter("set_key IS NOT NULL").groupBy("set_key", "node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    classes = written(classes, "set-classes")
    component = link_components(docs, classes.filter("rep IS NOT NULL"), words, percent, block)
    again = written(repeated_ids(table, classes), "repeated-ids")
    if not again.isEmpty():
        before = [] if component is None else [component.select(F.col("id").alias("a"), F.col("component").alias("b"))]
        component = written(components(reduce(DataFrame.unionByName, before, again)), "components")
    if component is not None:
        classes = classes.join(component, F.col("rep") == F.col("id"), "left")
        classes = classes.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    else:
        classes = classes.select("set_key", F.col("rep").alias("component_id"))
    empty = table.filter("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    held = table.filter("set_key IS NOT NULL").join(classes, "set_key").select("doc_id", "n_shingles", "component_id")
    return held.unionByName(empty)


ORACLE = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})]) END AS s FROM worded),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach(id, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT id, b FROM reach JOIN links ON a = root)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(root) FROM reach WHERE id = doc_id) AS component_id FROM sets
"""
