"""Exact removal of repeated passages by a sparse suffix array.

Every byte is removed that lies in a WINDOW-byte string which also starts earlier: in a document
with a smaller key, or earlier in the same one. Strings are judged on the input.

Which suffixes are sorted. A window's anchor is the place in it whose GRAM-byte hash is least
(the first such). Equal windows have their anchors at equal offsets, so suffixes that start at
anchors (about one in 35) are enough to meet every repeat. Neighbouring windows with one
anchor form a unit: the anchor's gram, and the bytes from the first window to the end of the last.

1. Units are dealt by the hash of their gram and sorted. A gram that occurs once ends there. A
   unit equal to an earlier one is covered whole; that is decided by 128 bits of hash (64 of the gram, 64 of the
   unit), not by comparing bytes. Of each group of equal units the first remains; if its gram has no other
   unit, nothing more is due. Grams that are frequent in a sample of documents are dealt to several tasks, and the
   first units of those meet once more; the sample decides balance, never results.
2. Units that share a gram but differ hold windows that may be equal in part. Their suffixes are
   range-partitioned by leading bytes, with splitters that Spark samples; each bucket sorts its windows by multikey
   quicksort on characters of 8 bytes: one character at a time, going on only within groups still tied. What is tied
   over WINDOW bytes is equal; all but the earliest are covered. Equal leading grams stay together.
   A lead with more than HELD units is not held but cut: its windows are suffixes of their own, range-partitioned by
   all their bytes and place, sorted by Spark and compared with their neighbours, at last across the boundaries
   between buckets, so a class of equal windows may span many tasks.
3. Covered intervals meet their documents and are cut out.

A group of copies collapses in step 1 to its first units; a task of step 2 holds a bounded number of units.

Defined cases: null text is empty; texts under WINDOW bytes lose nothing; rows of equal
doc_id and equal text are one document and each is returned with its result; rows of equal
doc_id and other text are documents of their own, in order of a hash of the text; null
doc_ids come first; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import ROW, gives_back, numbered, release, rows_of, store, whole_text

WINDOW = 100
GRAM = 32
PLACES = WINDOW - GRAM + 1
#: Bytes that are hashed at once; a longer text is hashed in parts, whose edges step 2 heals.
AT_ONCE = 1 << 22
#: Windows that are sorted at once, and units that are gathered for that.
SORTED = 1 << 20
GATHERED = 1 << 14
#: Units of one lead that a task holds, at most.
HELD = 20_000
#: One in so many documents tells which grams are frequent; a gram is if it has this share of their units.
SAMPLED = 64
SHARE = 1 / 2_000
LEAST_HOT = 64

#: A column unlike any of the tables'.
SPANS = "__spans"

_POSITION = np.uint64((1 << 30) - 1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BYTE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _M[4]
    x ^= x >> np.uint64(29)
    x *= _M[5]
    return x ^ (x >> np.uint64(32))


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, first window, its anchor, last window, gram hash, unit hash) of segments of a buffer.

    Places are counted from the segment's start.
    """
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    long = ends - starts >= WINDOW
    if not long.any():
        return none
    h, width, by_width = _BYTE[data], 1, {}
    for m in _M[:5]:  # hashes of 2, 4, 8, 16, 32 bytes from each place
        h = h[:-width] * m + h[width:]
        width *= 2
        by_width[width] = h
    key = _mix(h)
    gram = key.copy()
    key &= ~_POSITION
    key |= np.arange(len(key), dtype=np.uint64)
    span = 1
    while 2 * span <= PLACES:  # least key of 2, 4, ... places from each
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[: len(key) - (PLACES - span)], key[PLACES - span :])
    valid = np.zeros(len(key), dtype=bool)
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        valid[s : e - WINDOW + 1] = True
    window = np.flatnonzero(valid)
    anchor = (key[window] & _POSITION).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first, last = window[np.concatenate(([0], cut))], window[np.concatenate((cut, [len(window)])) - 1]
    anchor = anchor[np.concatenate(([0], cut))]

    def whole(i: np.ndarray) -> np.ndarray:
        """Hashes of the windows at i, from parts of 32, 32, 32 and 4 bytes."""
        x = by_width[32][i]
        for k, m in ((32, _M[0]), (64, _M[1])):
            x = _mix(x) * m + by_width[32][i + k]
        return _mix(x) * _M[2] + by_width[4][i + 96]

    unit = _mix(_mix(whole(first)) * _M[3] + whole(last)) + (last - first).astype(np.uint64)
    segment = np.searchsorted(starts, first, side="right") - 1
    base = starts[segment]
    return segment, first - base, anchor - base, last - base, gram[anchor], unit


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and the bounds of its values in them."""
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], dtype=size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), bounds


_UNIT = pa.schema([("gram", pa.int64()), ("unit", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])


def _packed(first: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << 16) | ((anchor - first) << 8) | (last - first)


@gives_back
def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to units; place holds the first window, its anchor's offset and the windows after it."""
    for batch in rows_of(batches):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        data, bounds = _bytes(batch.column(1))
        starts, ends = bounds[:-1], bounds[1:]
        jobs, small = [], []
        room = 0
        for k, n in enumerate((ends - starts).tolist()):
            if n < WINDOW:
                continue
            if n > AT_ONCE:
                if small:
                    jobs.append((small, [0] * len(small), None))
                    small, room = [], 0
                jobs += [([k], [at], [min(at + AT_ONCE + WINDOW - 1, n)]) for at in range(0, n - WINDOW + 1, AT_ONCE)]
            else:
                if room + n > AT_ONCE:
                    jobs.append((small, [0] * len(small), None))
                    small, room = [], 0
                small.append(k)
                room += n
        if small:
            jobs.append((small, [0] * len(small), None))
        for members, begins, stops in jobs:
            members = np.array(members)
            if stops is None:  # whole texts, which lie one behind another but for short ones
                low, high = starts[members[0]], ends[members[-1]]
                got = units(data[low:high], starts[members] - low, ends[members] - low)
                offset = 0
            else:
                low = starts[members[0]] + begins[0]
                high = starts[members[0]] + stops[0]
                got = units(data[low:high], np.array([0]), np.array([high - low]))
                offset = begins[0]
            segment, first, anchor, last, gram, unit = got
            if len(first):
                place = _packed(first + offset, anchor + offset, last + offset)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(unit.view(np.int64)), pa.array(keys[members[segment]]), pa.array(place)], schema=_UNIT)


#: What step 1 finds: a first unit whose gram has others, a covered unit, and the first of a part of a frequent gram.
CANDIDATE, COVERED, PART = 0, 1, 2
_JUDGED = pa.schema([("state", pa.int8()), ("gram", pa.int64()), ("unit", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])


@gives_back
def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units (gram, salt, unit, key, place) in order to their state; salt is -1 but for frequent grams."""

    def out(state: int, gram: np.ndarray, unit: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), state, dtype=np.int8)), pa.array(gram), pa.array(unit), pa.array(key), pa.array(place)], schema=_JUDGED)

    last = None  # gram, salt and unit of the row before
    held = None  # the first unit met last (gram, unit, key, place), and whether its gram had another before
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, salt, unit, key, place = (c.to_numpy() for c in batch.columns)
        again = np.zeros(len(gram), dtype=bool)
        again[1:] = (gram[1:] == gram[:-1]) & (salt[1:] == salt[:-1]) & (unit[1:] == unit[:-1])
        again[0] = last is not None and last == (gram[0], salt[0], unit[0])
        last = (gram[-1], salt[-1], unit[-1])
        for state, at in ((COVERED, again), (PART, ~again & (salt >= 0))):
            if at.any():
                yield out(state, gram[at], unit[at], key[at], place[at])
        single = ~again & (salt < 0)
        rows = [x[single] for x in (gram, unit, key, place)]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(([h], x)) for h, x in zip(held[0], rows, strict=True)]
        same = rows[0][1:] == rows[0][:-1]
        other = np.concatenate(([held is not None and held[1]], same)) | np.concatenate((same, [False]))
        held = ([x[-1] for x in rows], bool(other[-1]))
        if (at := other[:-1]).any():
            yield out(CANDIDATE, *(x[:-1][at] for x in rows))
    if held is not None and held[1]:
        yield out(CANDIDATE, *(np.array([x], dtype=np.int64) for x in held[0]))


_SUFFIX = pa.schema([("lead", pa.binary()), ("content", pa.binary()), ("key", pa.int64()), ("place", pa.int64())])


@gives_back
def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, places, text) to each unit's bytes, led by the suffix at its anchor."""
    for batch in rows_of(batches):
        out = []
        for key, places, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            for place in places:
                first, anchor, more = place >> 16, (place >> 8) & 255, place & 255
                content = data[first : first + more + WINDOW]
                out.append((content[anchor : anchor + GRAM], content, key, place))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SUFFIX.types, strict=True)], schema=_SUFFIX)


def equal_classes(data: bytes, at: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """Windows (places in data, with a group that only equals its own) in classes of equal bytes.

    Multikey quicksort: groups are parted by one character of 8 bytes after another; whatever
    is alone in its group leaves. Yields index arrays of at least two.
    """
    words = np.ndarray(shape=(max(0, len(data) - 7),), dtype=">u8", buffer=data, strides=(1,))
    live = np.arange(len(at))
    for depth in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
        if not len(live):
            return
        word = words[at[live] + depth].astype(np.uint64)
        order = np.lexsort((word, group))
        live, group, word = live[order], group[order], word[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
        group = np.cumsum(new)
        alone = new & np.concatenate((new[1:], [True]))
        live, group = live[~alone], group[~alone]
    if len(live):
        yield from np.split(live, np.flatnonzero(np.diff(group)) + 1)


_SPAN = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


@gives_back
def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units sorted by lead; covered spans of windows that are equal to an earlier one's."""

    def meet(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = b"".join([r[1] for r in rows])
        sizes = np.array([len(r[1]) for r in rows])
        bases = np.cumsum(sizes) - sizes
        keys, places = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        firsts, anchors, more = places >> 16, (places >> 8) & 255, places & 255
        # equal windows have equal offsets from their anchors, so offsets are sorted apart
        count = np.array([np.count_nonzero((anchors >= o) & (anchors - more <= o)) for o in range(PLACES)])
        low = 0
        while low < PLACES:
            high, n = low + 1, count[low]
            while high < PLACES and n + count[high] <= SORTED:
                n, high = n + count[high], high + 1
            row, step = [], []
            for o in range(low, high):
                own = np.flatnonzero((anchors >= o) & (anchors - more <= o))
                row.append(own)
                step.append(anchors[own] - o)
            row, step = np.concatenate(row), np.concatenate(step)
            low = high
            if not len(row):
                continue
            key, start = keys[row], firsts[row] + step
            covered = []
            for same in equal_classes(data, bases[row] + step, anchors[row] - step):
                order = np.lexsort((start[same], key[same]))
                covered.append(same[order[1:]])
            if covered:
                hit = np.concatenate(covered)
                hit = hit[np.lexsort((start[hit], key[hit]))]
                k, s = key[hit], start[hit]
                gap = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] > s[:-1] + WINDOW)))
                ends = np.concatenate((np.flatnonzero(gap)[1:] - 1, [len(k) - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(k[gap]), pa.array(s[gap]), pa.array(s[ends] + WINDOW)], schema=_SPAN)

    lead, held, run = None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != lead:
                if len(run) > 1:
                    held += run
                run, lead = [], row[0]
                if len(held) >= GATHERED:
                    yield from meet(held)
                    held = []
            run.append(row)
    if len(run) > 1:
        held += run
    if held:
        yield from meet(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units (content, key, place) to a row for each of their windows."""
    for batch in rows_of(batches):
        out = {"window": [], "key": [], "start": []}
        for content, key, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in range((place & 255) + 1):
                out["window"].append(content[k : k + WINDOW])
                out["key"].append(key)
                out["start"].append((place >> 16) + k)
        yield pa.RecordBatch.from_arrays([pa.array(out["window"], pa.binary()), pa.array(out["key"], pa.int64()), pa.array(out["start"], pa.int64())], list(out))


_ADJACENT = pa.schema([("bucket", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("key", pa.int64()), ("start", pa.int64())])


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order: those equal to the one before; at the end the bucket's first row with its first and last window."""
    bucket, first, last = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        windows = batch.column(0).to_pylist()
        first = first or (windows[0], batch.column(1)[0].as_py(), batch.column(2)[0].as_py())
        same = pa.array([a == b for a, b in zip([last, *windows[:-1]], windows, strict=True)], pa.bool_())
        last, hit = windows[-1], batch.filter(same)
        if hit.num_rows:
            nothing = pa.nulls(hit.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(hit.num_rows, pa.int32()), nothing, nothing, hit.column(1), hit.column(2)], schema=_ADJACENT)
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((bucket, first[0], last, *first[1:]), _ADJACENT.types, strict=True)], schema=_ADJACENT)


def _hot(suffixes: DataFrame, leads: DataFrame) -> DataFrame:
    """(key, start, end): windows of units with the given leads that are equal to an earlier one's."""
    spark = suffixes.sparkSession
    rows = suffixes.join(leads, "lead", "left_semi").select("content", "key", "place").mapInArrow(_windows, "window binary, key long, start long")
    rows = store(rows, "suffix-windows")  # the splitters are sampled from it
    buckets = rows.repartitionByRange("window", "key", "start").sortWithinPartitions("window", "key", "start")
    found = store(buckets.mapInArrow(_adjacent, "bucket int, first binary, last binary, key long, start long"), "suffix-adjacent")
    release(rows)
    edges, before = [], None  # a row for each bucket
    for r in found.where("bucket is not null").orderBy("bucket").collect():
        if r["first"] == before:
            edges.append((r["key"], r["start"]))
        before = r["last"]
    hits = found.where("bucket is null").select("key", "start").unionByName(spark.createDataFrame(edges, "key long, start long"))
    return hits.select("key", "start", (F.col("start") + WINDOW).alias("end"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of merged spans."""
    data = text.encode()
    if not spans:
        return data
    ends = [0, *(e for _, e in spans)]
    starts = [*(s for s, _ in spans), len(data)]
    return b"".join([data[e:s] for e, s in zip(ends, starts, strict=True)])


def _distinct_integers(rows: DataFrame) -> bool:
    integers = rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return integers and rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): a key for each document in ascending order of doc_id; the doc_id itself where that can be one."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    if _distinct_integers(rows):
        return rows.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text")
    ids = rows.select("doc_id", F.xxhash64("text").alias("th")).distinct().orderBy(F.col("doc_id").asc_nulls_first(), "th")
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, key long"
    ids = store(docs.sparkSession.createDataFrame(ids.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), kind), "suffix-keys")
    rows = rows.withColumn("th", F.xxhash64("text")).alias("r").join(ids.alias("i"), F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("r.th") == F.col("i.th")))
    return rows.select("key", "r.doc_id", "text")


def frequent(units: DataFrame) -> list[tuple[int, int]]:
    """(gram, parts) of the grams that have SHARE of the units or more: at most 1 / SHARE rows."""
    counts = store(units.groupBy("gram").count(), "suffix-grams")
    least = max(LEAST_HOT, (counts.agg(F.sum("count")).first()[0] or 0) * SHARE)
    found = [(r["gram"], math.ceil(r["count"] / least)) for r in counts.where(F.col("count") > least).collect()]
    release(counts)
    return found


def spans(rows: DataFrame) -> DataFrame:
    """(key, start, end): covered spans of documents (key, text); they may overlap."""
    spark, unit_columns = rows.sparkSession, "gram long, unit long, key long, place long"
    rows = rows.select("key", "text")
    hot = frequent(rows.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0).mapInArrow(_units, unit_columns))
    found = rows.mapInArrow(_units, unit_columns)
    if hot:
        parts = F.broadcast(spark.createDataFrame(hot, "gram long, parts int"))
        found = found.join(parts, "gram", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key", "place"), "parts").cast("int"), F.lit(-1)))
    else:
        found = found.withColumn("salt", F.lit(-1))
    found = found.select("gram", "salt", "unit", "key", "place").repartition("gram", "salt").sortWithinPartitions("gram", "salt", "unit", "key", "place")
    found = store(found.mapInArrow(_judge, "state byte, gram long, unit long, key long, place long"), "suffix-units")
    states = found.select("state", "key", "place")
    if hot:  # the first units of the parts meet: a row for each part and unit
        firsts = found.where(F.col("state") == PART).withColumn("n", F.row_number().over(Window.partitionBy("gram", "unit").orderBy("key", "place")))
        firsts = firsts.select(F.when(F.col("n") > 1, COVERED).otherwise(CANDIDATE).cast("byte").alias("state"), "key", "place")
        states = states.where(F.col("state") != PART).unionByName(firsts)
    first, more = F.shiftright("place", 16), F.col("place").bitwiseAND(255)
    whole = states.where(F.col("state") == COVERED).select("key", first.alias("start"), (first + more + WINDOW).alias("end"))
    rest = states.where(F.col("state") == CANDIDATE).groupBy("key").agg(F.collect_set("place").alias("places"))
    suffixes = rest.join(rows, "key").select("key", "places", "text").mapInArrow(_suffixes, "lead binary, content binary, key long, place long")
    suffixes = store(suffixes, "suffixes")  # the splitters are sampled from it
    leads = store(suffixes.groupBy("lead").count().where(F.col("count") > HELD).select("lead"), "suffix-leads")
    many = not leads.isEmpty()
    held = suffixes.join(leads, "lead", "left_anti") if many else suffixes
    buckets = held.repartitionByRange("lead").sortWithinPartitions("lead")
    out = whole.unionByName(buckets.mapInArrow(_sorted, "key long, start long, end long"))
    return out.unionByName(_hot(suffixes, leads)) if many else out


def _joined(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text, spans) of every document."""
    rows = keyed(docs)
    lists = spans(rows).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return rows.join(lists, "key", "left")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    joined = _joined(docs).select("doc_id", "text", "spans")
    kind = joined.schema["doc_id"].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n_bytes, n_removed, n_spans, sha = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = merged([(x["start"], x["end"]) for x in found or ()])
                rest = cut(text, own)
                removed = sum(e - s for s, e in own)
                n_bytes.append(len(rest) + removed)
                n_removed.append(removed)
                n_spans.append(len(own))
                sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame) -> DataFrame:
    """Documents without what repeats: all columns, n_chars counted anew.

    The document of the smallest doc_id keeps what repeats. Null doc_ids come first; rows of one
    doc_id are documents of their own, in the order in which they are read. Where a cut parts a character, what is left of the character goes too. Documents of which a
    cut leaves only white space go.
    """
    if _distinct_integers(docs):
        rows = docs.withColumn(ROW, F.col("doc_id").cast("long"))
    else:
        rows = numbered(docs, "suffix-rows")
        ids = rows.select("doc_id", ROW).orderBy(F.col("doc_id").asc_nulls_first(), ROW).select(ROW)
        keys = docs.sparkSession.createDataFrame(ids.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), f"{ROW} long, key long")
        rows = rows.join(store(keys, "suffix-keys").withColumnRenamed("key", "__key"), ROW).drop(ROW).withColumnRenamed("__key", ROW)
    lists = spans(rows.select(F.col(ROW).alias("key"), whole_text().alias("text"))).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    lists = lists.select(F.col("key").alias(ROW), F.col("spans").alias(SPANS))
    joined = rows.join(lists, ROW, "left").select(*docs.columns, SPANS)
    at, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            columns, spans_ = batch.columns[:-1], batch.column(len(batch.columns) - 1).to_pylist()
            texts = columns[at].to_pylist()
            keep, counts = [], columns[n_chars].to_pylist() if n_chars is not None else None
            for k, found in enumerate(spans_):
                if found:
                    texts[k] = cut(texts[k], merged([(x["start"], x["end"]) for x in found])).decode(errors="ignore")
                    if counts is not None:
                        counts[k] = len(texts[k])
                keep.append(not found or bool(texts[k].strip()))
            columns[at] = pa.array(texts, columns[at].type)
            if counts is not None:
                columns[n_chars] = pa.array(counts, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
