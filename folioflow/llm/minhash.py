"""MinHash fingerprints of documents, banded and verified near-duplicates, likeness of neighbours.

A text's shingles are its runs of five lower-cased words (fewer words: all of them). Words are
hashed once; a shingle's hash mixes its words' hashes; PERMUTATIONS multiply-add hashes of
the shingles are taken in vectorised numpy, and each one's minimum gives 16 bits of the
signature. The share of equal places estimates the Jaccard similarity of the shingle sets.

Near-duplicates: equal shingle sets collapse to one node, and signatures are cut into BANDS bands of ROWS
places, which Spark joins. Nodes that share a band form a bucket. Its members meet its first one: those whose
signatures are not far apart are compared on whole texts, and a link holds only if the exact Jaccard
similarity of the shingle sets is JACCARD or more. Members that links do not join to it so are then held against all others that have the same first one:
these are dealt to tasks by a bounded number of shingles, whose sorted hashes tell a member's exact overlap with
all of them at once; no pairs are made but those that link. So what a bucket's pairs connect is connected, and a
bucket of k near copies costs k - 1 comparisons and not k * k.

Defined cases: null and blank texts have no shingle; their signature is that of the empty set
(all 0xffff), alike only to each other; equal texts have equal fingerprints; a document is
followed by the next row in order of (doc_id, a hash of the text), the last by the first, a single one by
itself; null doc_ids come first and are smallest to no class; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import FIRST, Ranges, bounded, components, gives_back, release, rows_of, store, whole_text

SHINGLE = 5
PERMUTATIONS = 128
#: 25 bands of 5: a pair at similarity 0.8 shares none with a chance below 0.0001.
BANDS, ROWS = 25, 5
JACCARD = 0.8
#: A pair whose likeness is this much below the similarity sought is over four standard deviations off.
MARGIN = 0.15
#: Texts that are compared with one in a task, and shingles of texts that a task holds, about.
PART_ROWS = 2_000
PART_SHINGLES = 2_000_000
SEED = 20_240_501
#: Shingles that are hashed at once: PERMUTATIONS x 8 bytes of each.
AT_ONCE = 256
#: Documents aimed at in a range of doc_ids.
RANGE_ROWS = 4_000

_draw = np.random.default_rng(SEED)
_A = _draw.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = [np.uint64(x) for x in _draw.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)]


def shingle_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the shingles of a whole text, repeats included."""
    words = text.lower().encode().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(SHINGLE, len(own))
    n = len(own) - span + 1
    mixed = own[:n] * _MIX[0]
    for k in range(1, span):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[k] + own[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 16-bit minima of the permutations over a set of hashes; the empty set gives 0xffff."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    x = hashes >> np.uint64(32)
    for k in range(0, len(x), AT_ONCE):
        table = x[k : k + AT_ONCE, None] * _A
        table += _B
        np.minimum(least, table.min(axis=0), out=least)
    # a minimum's upper bits are small numbers; the lower half of its upper word is spread evenly
    return ((least >> np.uint64(24)) & np.uint64(0xFFFF)).astype("<u2") if len(x) else np.full(PERMUTATIONS, 0xFFFF, dtype="<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places of two signatures."""
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def edited(text: str, following: str) -> str:
    """The text, its last half (rounded down) replaced by as many first characters of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NEXT = "doc_id long, kind binary, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def kind_of(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of distinct sorted hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _dealt(batches: Iterator[pa.RecordBatch], ranges: Ranges, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tie, text) to their range; the first of a range also goes to the one before, marked as later."""
    buckets = firsts["bucket"]
    for batch in rows_of(batches):
        keys, ties = batch.column(0).fill_null(FIRST).to_numpy(), batch.column(1).to_numpy()
        own = ranges.of(keys, ties)
        at = np.searchsorted(buckets, own)
        leads = np.flatnonzero((firsts["key"][at] == keys) & (firsts["tie"][at] == ties))
        rows = pa.array(np.concatenate((np.arange(len(own)), leads)))
        bucket = np.concatenate((own, buckets[at[leads] - 1]))  # before the first of all: the last
        later = np.arange(len(bucket)) >= len(own)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(later), *(batch.column(k).take(rows) for k in range(3))], ["bucket", "later", "doc_id", "tie", "text"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, later, doc_id, text) in order; those that come later only follow others."""
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _NEXT.split(", ")]

    def row(now: tuple, following: tuple) -> tuple:
        (doc_id, text, kind, own), (_, next_text, _, next_own) = now, following
        changed = edited(text, next_text)
        after = own if changed == text else signature(shingle_hashes(changed))
        return (doc_id, kind, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), after.tobytes().hex(), likeness(own, after), likeness(own, next_own))

    held, bucket, out = None, None, []
    for batch in rows_of(batches):
        for b, later, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if b != bucket:
                bucket, held = b, None
            if later and held is None:
                continue  # the row after the bucket's last has been met
            found = np.unique(shingle_hashes(text))
            now = (doc_id, text, kind_of(found), signature(found))
            if held is not None:
                out.append(row(held, now))
            held = None if later else now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, both likenesses, and the kind of its shingle set.

    Texts are shuffled once, into ranges of doc_id. The first row of a range also goes to the
    range before, behind its last row; which rows those are takes numbers for each range, at most MAX_RANGES.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ranges = Ranges(rows, "doc_id", round(docs.count() / RANGE_ROWS))
    tie = F.xxhash64("text") if ranges.split else F.lit(0).cast("long")  # where no key spans ranges, keys alone tell firsts

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = batch.column(0).fill_null(FIRST).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(keys, ties)), pa.array(keys), pa.array(ties)], ["bucket", "key", "tie"])

    rows = rows.withColumn("tie", tie)
    found = rows.select("doc_id", "tie").mapInArrow(least, "bucket int, key long, tie long").groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("f")).select("bucket", "f.*").collect()
    if not found:
        return docs.sparkSession.createDataFrame([], _NEXT)
    firsts = np.array(sorted(map(tuple, found)), dtype=[("bucket", np.int32), ("key", np.int64), ("tie", np.int64)])
    dealt = rows.select("doc_id", "tie", "text").mapInArrow(partial(_dealt, ranges=ranges, firsts=firsts), "bucket int, later boolean, doc_id long, tie long, text string")
    order = F.col("tie") if ranges.split else F.xxhash64("text")
    dealt = dealt.repartitionById(ranges.n, "bucket").sortWithinPartitions("bucket", "later", F.col("doc_id").asc_nulls_first(), order)
    return dealt.select("bucket", "later", "doc_id", "text").mapInArrow(_neighbours, _NEXT)


@gives_back
def _signed(batches: Iterator[pa.RecordBatch], sign: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (text, key, further columns) to (key, further columns, kind, size, sig)."""
    for batch in rows_of(batches):
        sets = [np.unique(shingle_hashes(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([kind_of(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([sign(x).tobytes() for x in sets], pa.binary())], [*batch.schema.names[1:], "kind", "size", "sig"])


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of least or more; empty sets are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return union == 0 or common >= least * union


@gives_back
def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, member, b, kind, text) in order: the text of a, then those to compare with it."""
    own, held = None, None
    for batch in rows_of(batches):
        out = {"a": [], "b": [], "alike": []}
        for a, member, b, kind, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
            found = np.unique(shingle_hashes(text))
            if kind_of(found) != kind:
                continue  # another text of the same key
            if not member:
                own, held = a, found
            elif a == own:
                for c, x in zip(out.values(), (a, b, alike(held, found, least)), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()), pa.array(out["alike"], pa.bool_())], list(out))


def _compare(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, alike) of stored pairs of nodes, by the whole texts (key, text) that stand for them, which are shuffled once."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    asked = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    asked = asked.select("a", "part", F.lit(True).alias("member"), "b")
    first = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("a").alias("b"))
    roles = store(asked.unionByName(first).join(nodes.select(F.col("node").alias("b"), "key", "kind"), "b"), "minhash-roles")
    met = texts.select("key", "text").join(bounded(roles), "key").select("a", "part", "member", "b", "kind", "text")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", "member")
    tested = store(met.mapInArrow(partial(_compared, least=least), "a long, b long, alike boolean").groupBy("a", "b").agg(F.max("alike").alias("alike")), "minhash-tested")
    release(roles)
    return tested


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, close): whether the signatures of pairs (a, b) are at least as alike as ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(-1, PERMUTATIONS) for k in (2, 3))
            close = np.count_nonzero(x == y, axis=1) >= least * PERMUTATIONS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(close)], ["a", "b", "close"])

    met = pairs.join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, close boolean")


@gives_back
def _overlaps(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, asks, node, root, kind, text) in order, askers last: links (a, b) of an asker with a member of each other root, but where earlier links of the part join them."""
    place, held, table, up = None, [], None, {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for batch in rows_of(batches):
        out = []
        for a, part, asks, node, root, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = np.unique(shingle_hashes(text))
            if kind_of(found) != kind:
                continue  # another text of the same key
            if (a, part) != place:
                place, held, table, up = (a, part), [], None, {}
            if not asks:
                held.append((node, root, found))
                continue
            if not held:
                continue
            if table is None:
                sizes = np.array([len(x) for _, _, x in held])
                hashes, owner = np.concatenate([x for _, _, x in held]), np.repeat(np.arange(len(held)), sizes)
                order = np.argsort(hashes, kind="stable")
                table = (hashes[order], owner[order], sizes, *(np.array([h[k] for h in held]) for k in range(2)))
            hashes, owner, sizes, nodes, roots = table
            low, high = (np.searchsorted(hashes, found, side=side) for side in ("left", "right"))
            times = high - low
            at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            common = np.bincount(owner[at], minlength=len(sizes))
            hit = np.flatnonzero((common >= least * (sizes + len(found) - common)) & (roots != root))
            _, one = np.unique(roots[hit], return_index=True)
            for other, there in zip(nodes[hit[one]].tolist(), roots[hit[one]].tolist(), strict=True):
                if (x := top(root)) != (y := top(there)):
                    up[max(x, y)] = min(x, y)
                    out.append((node, other))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _met(stars: DataFrame, asks: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): verified links of askers (a, node) with the members (a, b) of their stars whose root is another."""
    near = stars.join(asks.select("a").distinct(), "a", "left_semi").select("a", F.col("b").alias("node")).join(nodes.select("node", "size"), "node")
    parts = near.groupBy("a").agg(F.greatest(F.ceil(F.sum("size") / PART_SHINGLES), F.ceil(F.count("*") / PART_ROWS)).cast("int").alias("parts"))
    members = near.join(parts, "a").select("a", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "node")
    askers = asks.join(parts, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "node")
    roles = members.unionByName(askers).join(nodes.select("node", "key", "kind"), "node").join(roots.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
    roles = store(roles.select("a", "part", "asks", "node", F.coalesce("root", "node").alias("root"), "kind", "key"), "minhash-askers")
    met = texts.select("key", "text").join(bounded(roles), "key").select("a", "part", "asks", "node", "root", "kind", "text")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", "asks")
    out = store(met.mapInArrow(partial(_overlaps, least=least), "a long, b long").distinct(), "minhash-met")
    release(roles)
    return out


def signed(texts: DataFrame, sign: Callable[[np.ndarray], np.ndarray] = signature) -> DataFrame:
    """Stored (key, further columns, kind, size, sig) of rows (key, text, further columns); kind stands for the shingle set, which ``sign`` signs."""
    rest = [c for c in texts.columns if c not in ("key", "text")]
    rows = texts.select("text", "key", *rest)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return store(rows.mapInArrow(partial(_signed, sign=sign), f"{kinds}, kind binary, size long, sig binary"), "minhash")


def banded(nodes: DataFrame, least: float) -> DataFrame:
    """Stored (a, b, close): nodes b that share a band with others, of which a is the first."""
    keys = [F.xxhash64(F.lit(k), F.substring("sig", k * 2 * ROWS + 1, 2 * ROWS)) for k in range(BANDS)]
    bands = nodes.select("node", F.explode(F.array(*keys)).alias("bucket"))
    firsts = bands.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    stars = bands.join(firsts, "bucket").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    return store(_likely(stars, nodes, least - MARGIN), "minhash-stars")


def linked(
    prints: DataFrame, texts: DataFrame, least: float = JACCARD, candidates: Callable[[DataFrame, float], DataFrame] = banded, connected: Callable[[DataFrame], DataFrame] = components
) -> DataFrame:
    """(kind, root) of every kind of a table made by :func:`signed`: kinds have one root if verified links connect them.

    ``texts`` has (key, text); a key should stand for one text, and others that share it do no harm. ``candidates``
    gives stars of nodes, whose members are then verified; ``connected`` finds the components of links.
    """
    nodes = store(prints.groupBy("kind", "size", "sig").agg(F.min("key").alias("key")).withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    stars = candidates(nodes, least)
    tested = _compare(stars.where("close").select("a", "b"), nodes, texts, least)
    links = tested.where("alike").select("a", "b")
    roots = connected(links)
    # members of a star whose root is not its first's ask all others of the star
    own = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    asks = stars.join(own("a"), "a", "left").join(own("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    asks = store(asks.select("a", F.col("b").alias("node")), "minhash-asks")
    classes = nodes.select("node", "kind").join(roots, "node", "left").select("kind", F.coalesce("root", "node").alias("root"))
    if not asks.isEmpty():  # what they find links whole classes, of which the roots are all that is joined
        met = _met(stars, asks, roots, nodes, texts, least)
        across = met.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        wider = connected(across).select(F.col("node").alias("root"), F.col("root").alias("wider"))
        classes = classes.join(wider, "root", "left").select("kind", F.coalesce("wider", "root").alias("root"))
    release(asks)
    out = store(classes, "minhash-roots")
    release(nodes, stars, tested)
    return out


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Stored (key, doc_id, kind, size, sig) of every row, and stored (kind, component_id) of every kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    prints = signed(rows)
    roots = linked(prints, rows, least)
    kinds = prints.groupBy("kind").agg(F.min("doc_id").alias("first")).join(roots, "kind")
    ids = store(kinds.join(kinds.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("kind", "first", "component_id"), "minhash-classes")
    release(roots)
    return prints, ids


def near_duplicates(docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id that verified links reach, null where none has one."""
    prints, ids = _classes(docs, least)
    return prints.select("doc_id", "kind").join(ids.select("kind", "component_id"), "kind").select("doc_id", "component_id")


def fingerprinted(docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """The columns of :func:`with_next` of every row, and its component_id among near-duplicates."""
    prints, ids = _classes(docs, least)
    release(prints)
    rows = with_next(docs)
    return rows.join(bounded(ids.select("kind", "component_id")), "kind").select(*[c for c in rows.columns if c != "kind"], "component_id")
