"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Two 64-bit fingerprints that differ in at most 3 bits agree on at least 2 of 5 blocks
(13, 13, 13, 13 and 12 bits), so each of the 10 pairs of blocks is a table whose key is about
26 bits long. Equal fingerprints meet before that and count once. Inside a bucket a
spanning forest is sought by Hamming distance, so a bucket of k close fingerprints gives
k - 1 links and not k * k. Every link between different fingerprints is reachable.

Defined cases: null and blank texts have fingerprint zero and link like any other; equal
rows share a component; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import minhash
from folioflow.llm.common import ROW, bounded, components, gives_back, numbered, release, rows_of, store, united, whole_text

SEED = 42
SHINGLE = 3
DISTANCE = 3
BITS = 64
#: Shingles whose bits are unpacked at once.
AT_ONCE = 1 << 16
#: Buckets beyond this many fingerprints are linked by shared neighbours instead of scans.
SCAN_LIMIT = 20_000
#: (first bit, bits) of each block.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Words of 64 bits in the fingerprints of :func:`keep_first`: 128 blocks of 16 bits. At a similarity of 0.8 a bit agrees with
#: a chance of 0.85, so none of the blocks does with one of 0.0001 (0.009 for the worst of sets, of 4 and 5 shingles).
WORDS64 = 32
#: Blocks taken in one turn: few at first, which connect most of what is near.
TURNS = [(0, 8), (8, 40), (40, 84), (84, 128)]
#: Words that are compared in a bucket, and bits of them that may differ: five standard deviations from what 0.8 gives.
NEAR_WORDS, NEAR = 2, 40
#: Bits of whole fingerprints that may differ in a link: the same share. Sets with nothing in common differ in 0.5, the
#: least ones (of two shingles, whose bits are rarely set) in 0.375, six standard deviations more than this.
NEAR_WHOLE = NEAR * WORDS64 // NEAR_WORDS
_ODD = np.random.default_rng(11).integers(1, 1 << 63, WORDS64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of one text: the majority of each bit over its shingle hashes."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    hash64, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, AT_ONCE):
        part = np.array([hash64(joined[s:e], SEED) for s, e in zip(starts[k : k + AT_ONCE], ends[k : k + AT_ONCE], strict=True)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@gives_back
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        prints = np.array([fingerprint(t.encode()) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit integer."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all of a bucket's fingerprints at most DISTANCE bits apart."""
    left, links = prints, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue[-1]) <= DISTANCE
            at = queue.pop()
            if near.any():
                found = left[near]
                links += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def _forest_of_many(prints: np.ndarray, free: list[int]) -> list[tuple[int, int]]:
    """The same for a large bucket, in time that grows with its size and not with its square.

    Two prints at most 3 bits apart share a point that is at most 1 bit from the one and at
    most 2 from the other, in the bits the bucket leaves free. Each point names one print
    that is at most 1 bit from it; every print at most 2 bits from the point links to that
    one, which is at most 3 bits away.
    """
    one = [np.uint64(0), *(np.uint64(1) << np.uint64(b) for b in free)]
    points = np.concatenate([prints ^ m for m in one])
    points, first = np.unique(points, return_index=True)
    owner = prints[first % len(prints)]
    links = set()
    for m in [*one, *(x | y for x, y in combinations(one[1:], 2))]:
        sought = prints ^ m
        at = np.minimum(np.searchsorted(points, sought), len(points) - 1)
        hit = (points[at] == sought) & (owner[at] != prints)
        links.update(zip(owner[at][hit].tolist(), prints[hit].tolist(), strict=True))
    return list(links)


def _free_bits(table: int) -> list[int]:
    i, j = list(combinations(range(len(BLOCKS)), 2))[table]
    return [b for k, (at, n) in enumerate(BLOCKS) if k not in (i, j) for b in range(at, at + n)]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp), sorted; a bucket's fingerprints (8 bytes each) are held until it ends."""
    held_key, held = None, []

    def done(key: int, parts: list[np.ndarray]) -> list[tuple[int, int]]:
        prints = np.concatenate(parts)
        if len(prints) < 2:
            return []
        return _forest(prints) if len(prints) <= SCAN_LIMIT else _forest_of_many(prints, _free_bits(key >> 32))

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        prints = batch.column(1).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        links = []
        if held and held_key != keys[0]:
            links += done(held_key, held)
            held = []
        if held:
            held.append(prints[: ends[0]].copy())
            starts, ends, inner = starts[1:], ends[1:], len(starts) > 1
            if inner:
                links += done(held_key, held)
                held = []
        if len(starts):
            for s, e in zip(starts[:-1], ends[:-1], strict=True):
                if e - s > 1:
                    links += done(int(keys[s]), [prints[s:e]])
            held_key, held = int(keys[-1]), [prints[starts[-1] :].copy()]
        if links:
            yield out(links)
    if held and (links := done(held_key, held)):
        yield out(links)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect whatever is at most DISTANCE bits apart."""
    fp = F.col("fp")

    def block(k: int):
        at, n = BLOCKS[k]
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))

    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(block(i), 13)).bitwiseOR(block(j)) for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    rows = prints.select(F.explode(F.array(*keys)).alias("bucket"), "fp")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach, itself included."""
    prints = store(fingerprints(docs), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(nodes.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _spread(hashes: np.ndarray) -> np.ndarray:
    """WORDS64 hashes of each."""
    x = hashes[:, None] * _ODD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def wide(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles in WORDS64 words: the majority of each bit, as in :func:`fingerprint`."""
    counts = np.zeros(BITS * WORDS64, dtype=np.int64)
    for k in range(0, len(hashes), 255):  # counts of so many fit into a byte
        bits = np.unpackbits(_spread(hashes[k : k + 255]).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


@gives_back
def _blocks(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, root, sig) to a row for each of the blocks low .. high, with the words that are compared in a bucket."""
    for batch in rows_of(batches):
        prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)
        keys = (np.arange(low, high) << 16 | prints[:, low:high].astype(np.int64)).ravel()
        rows = pa.array(np.repeat(np.arange(batch.num_rows), high - low))
        words = prints[:, : 4 * NEAR_WORDS].copy().view("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(k).take(rows) for k in range(2)), *(pa.array(words[:, k].copy()).take(rows) for k in range(NEAR_WORDS))], ["bucket", "node", "root", "x", "y"])


@gives_back
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, root, x, y), sorted: links (a, b) that connect those of a bucket that are near each other and of different roots."""

    def forest(nodes: np.ndarray, roots: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
        _, first = np.unique(roots, return_index=True)
        if len(first) < 2:
            return []
        left, found = np.arange(len(nodes)), []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(words[left] ^ words[at]).sum(axis=1) <= NEAR
                known = roots[left] == roots[at]
                found += [(int(nodes[at]), int(nodes[k])) for k in left[near & ~known]]
                queue += left[near | known].tolist()
                left = left[~(near | known)]
        return found

    held, held_key, out = [], None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        same = columns[0][1:] == columns[0][:-1]
        met = np.concatenate(([True], same)) | np.concatenate((same, [True]))  # others are alone; the ends may go on
        columns = [c[met] for c in columns]
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        for part in zip(*(np.split(c, cuts) for c in columns), strict=True):
            if held and held_key != part[0][0]:
                out += forest(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
            held_key = part[0][0]
            held.append((part[1].copy(), part[2].copy(), np.stack(part[3:], axis=1).view(np.uint64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            out = []
    if held and (out := forest(*(np.concatenate(c) for c in zip(*held, strict=True)))):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


@gives_back
def _near_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, x, y) with both whole fingerprints: the links (a, b) that these bear out."""
    for batch in rows_of(batches):
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1) for k in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= NEAR_WHOLE))


def borne_out(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored (a, b): those of stored links whose whole fingerprints are near each other, too.

    Few words are near by chance in a share of all pairs that meet, and a larger table has more of these for each node: left
    to connect, they would join much of it to one group whose members all ask each other. Texts that are somewhat alike stay linked.
    """
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    met = nodes.select("node", "sig").join(bounded(ends), "node").groupBy("a", "b").agg(F.min("sig").alias("x"), F.max("sig").alias("y"))
    return store(met.mapInArrow(_near_whole, "a long, b long"), "simhash-links")


def stars(nodes: DataFrame, least: float) -> DataFrame:
    """Stored (a, b, close): each group of nodes that near fingerprints connect, as its first and each other.

    Blocks are taken in turns; what earlier ones connect is one root, and later ones link only what has different roots.
    """
    roots = None
    for low, high in TURNS:
        rows = nodes.join(bounded(roots), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "sig") if roots is not None else nodes.select("node", F.col("node").alias("root"), "sig")
        rows = rows.mapInArrow(partial(_blocks, low=low, high=high), "bucket long, node long, root long, x long, y long")
        found = store(rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_near, "a long, b long").distinct(), "simhash-near")
        found = borne_out(found, nodes)
        if roots is not None:
            found = found.unionByName(roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")))
        roots = united(found)
    return store(roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(True).alias("close")), "simhash-stars")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, texts of a Jaccard similarity of 0.8 or more over five-word shingles.

    By SimHash with more bits than op10's, of which 3 in 64 cannot tell that similarity: fingerprints of BITS * WORDS64
    bits over the set of shingles, blocks of 16 bits of which one must agree, the Hamming distance in a bucket, that of the whole, and
    the exact similarity of whole texts (:func:`folioflow.llm.minhash.linked`). Rows are told apart by number: of
    a group the row of the smallest doc_id stays (nulls last), among equals the first.
    """
    rows = numbered(docs, "simhash-rows")
    texts = rows.select(F.col(ROW).alias("key"), whole_text().alias("text"), "doc_id")
    prints = minhash.signed(texts, wide)
    roots = minhash.linked(prints, texts, candidates=stars, connected=united)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = prints.groupBy("kind").agg(F.min(order).alias("least")).join(roots, "kind")
    kept = firsts.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("key"))
    gone = store(prints.select("key").join(kept, "key", "left_anti").withColumnRenamed("key", ROW), "simhash-gone")
    release(prints, roots)
    return rows.join(bounded(gone), ROW, "left_anti").select(*docs.columns)
