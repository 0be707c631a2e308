"""The pipeline on a small table, stage by stage."""

from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest

from folioflow.llm import common, mixing, packing, simhash, suffix_dedup, tokens, toxicity
from folioflow.llm.common import store


def test_stages_keep_columns_and_pack_what_is_left(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert out.columns == columns
            docs = out
            sizes.append(out.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    assert out.agg({"doc_tokens": "max"}).first()[0] > 0
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    again = corpus_pipeline.run(spark, sf_dir)
    assert again.count() == out.count()


def odd_rows():
    """(doc_id, text, source): null and repeated doc_ids, some with a text of their own and some with a copy."""
    texts = [" ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 50_000, 80)) for k in range(7)]
    return [(None, texts[0], "a"), (None, texts[1], "a"), (3, texts[1], "a"), (5, texts[2], "b"), (5, texts[3], "b"), (5, texts[3], "a"), (None, texts[4], "a"), (None, texts[4], "b"), (1, texts[5], "b"), (2, texts[5], "b"), (9, texts[6], None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, source string").coalesce(1)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_near_copies_of_odd_ids(spark, odd):
    groups = {}
    for k, (d, t, s) in enumerate(odd_rows()):
        groups.setdefault(t, []).append((d is None, d or 0, k, (d, t, s)))
    assert rows_of(simhash.keep_first(odd)) == Counter(min(g)[-1] for g in groups.values())


def test_repeats_of_odd_ids(spark, odd):
    shared = "a passage that two documents of one number share and that is longer than any hundred bytes, so that it goes from the later one. "
    rows = [(d, f"{t} {shared}{k}", s) for k, (d, t, s) in enumerate(odd_rows()[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = rows_of(suffix_dedup.clean(docs))
    kept, seen, plain = set(), set(), Counter()
    for d, t, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = t.encode()
        windows = [data[k : k + 100] for k in range(len(data) - 99)]
        gone = set()
        for k, w in enumerate(windows):
            if w in seen:
                gone.update(range(k, k + 100))
            seen.add(w)
        rest = bytes(b for k, b in enumerate(data) if k not in gone).decode()
        if rest.strip():
            plain[(d, rest, s)] += 1
            kept.add(t)
    assert got == plain and len(kept) == 5


@pytest.mark.parametrize("share", [1, 2])
def test_mix_of_odd_ids(spark, odd, share):
    once = odd.withColumn("source", odd["source"].substr(1, 0))  # one source and the null one: whole passes
    weights = {"": sum(len(t.split()) for _, t, s in odd_rows() if s is not None), None: sum(len(t.split()) for _, t, s in odd_rows() if s is None)}
    got = rows_of(mixing.mixed(once, share=Fraction(share), weights=weights).select("doc_id", "text"))
    assert got == Counter({k: n * share for k, n in Counter((d, t) for d, t, _ in odd_rows()).items()})


def test_toxicity_and_packing_of_odd_ids(spark, odd):
    assert rows_of(toxicity.keep_clean(odd, toxicity.Model(-50.0, np.zeros(1 << toxicity.BUCKET_BITS)))) == Counter(odd_rows())
    pieces = packing.pack(odd, tokens.default_path()).groupBy("doc_id").agg({"length": "sum"}).collect()
    alone = {d: packing.pack(odd.where(odd["doc_id"].eqNullSafe(d)), tokens.default_path()).agg({"length": "sum"}).first()[0] for d in {d for d, _, _ in odd_rows()}}
    assert {r[0]: r[1] for r in pieces} == alone


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, stage):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names the stages use, and no rows."""
    names = ["key", "spans", "turn", "passes", "size", "row", "queue", "kind", "members", "bucket", "root", "part", "a", "b"]
    long = " ".join(f"w{x}" for x in np.random.default_rng(9).integers(0, 50_000, 60_000))
    own = [(1, "x y z"), (1, "x y z"), (None, None), (None, "only here and nowhere else is this said"), (4, ""), (5, long), (6, None), (7, "\u65e5\u672c\u8a9e \u00fc")]
    rows = [(d, t, None, None if d == 5 else "s", None, *(k for _ in names)) for k, (d, t) in enumerate(own)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame(rows, schema)
    run = dict(corpus_pipeline.STAGES)[stage]
    sf_dir = "/root/testdata/sf0.001"
    out, none = run(spark, docs, sf_dir), run(spark, docs.limit(0), sf_dir)
    assert none.count() == 0
    if stage == "packing":
        assert {r["doc_id"] for r in out.collect()} == {d for d, _ in own}
        return
    assert out.columns == docs.columns == none.columns
    got = Counter(r["row"] for r in out.select("row").collect())
    if stage == "toxicity":
        assert set(got.values()) == {1} and len(got) >= 7
    elif stage == "simhash":  # equal texts, and those without words, are copies of each other
        assert len(got) == 5 and {3, 4, 5, 7} <= set(got) and set(got.values()) == {1}
    elif stage == "suffix_dedup":
        assert set(got) == set(range(8)) and set(got.values()) == {1}
    else:
        assert {2, 4, 6} <= set(got) and all(got[k] == 1 for k in (2, 4, 6)) and max(got.values()) <= 2


def test_near_copies_are_met_by_wide_fingerprints(spark):
    """Pairs at a similarity just over 0.8, short and long, and as many just under it."""
    rng, rows, over = np.random.default_rng(21), [], 0
    for k in range(300):
        n = int(rng.integers(30, 200))
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        own = n - 4
        cut = int(0.8 * own) + (k % 2 == 0)  # shingles that are left of the text's own: prefixes are sets within sets
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: cut + 4]))]
        over += cut >= 0.8 * own
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r[0] for r in simhash.keep_first(docs).select("doc_id").collect()}
    linked = sum(2 * k + 1 not in kept for k in range(300))
    alike = {k for k in range(300) if (m := len(rows[2 * k + 1][1].split()) - 4) >= 0.8 * (len(rows[2 * k][1].split()) - 4)}
    assert len(alike) == over and {2 * k for k in range(300)} <= kept
    assert all(k in alike for k in range(300) if 2 * k + 1 not in kept) and linked >= 0.99 * over


def test_near_copies_come_from_simhash(spark, odd, monkeypatch):
    called = []
    own = simhash.stars
    monkeypatch.setattr(simhash, "stars", lambda nodes, least: called.append(least) or own(nodes, least))
    simhash.keep_first(odd).count()
    assert called == [0.8]


@pytest.mark.parametrize("at_once", [common.BROADCAST_ROWS, 3])
def test_words_compared_in_a_bucket_alone_connect_nothing(spark, monkeypatch, at_once):
    """Two of 40 fingerprints that agree in the words compared in a bucket are near as a whole, the others by chance."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", at_once)
    prints = np.random.default_rng(8).integers(0, 1 << 64, (40, simhash.WORDS64), dtype=np.uint64)
    prints[:, : simhash.NEAR_WORDS] = prints[0, : simhash.NEAR_WORDS]
    prints[31] = prints[30]
    prints[31, 6:] ^= np.uint64(0x8421084210842100)  # 312 bits; some blocks are those of the two alone
    nodes = store(spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(prints)], "node long, sig binary"), "test-nodes")
    assert [tuple(r) for r in simhash.stars(nodes, 0.8).collect()] == [(30, 31, True)]


@pytest.mark.parametrize("at_once", [common.BROADCAST_ROWS, 3])
def test_links_united_are_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "BROADCAST_ROWS", at_once)
    rng = np.random.default_rng(5)
    links = [*map(tuple, rng.integers(-60, 60, (50, 2)).tolist()), *((9_000 - k, 9_001 - k) for k in range(40)), (1 << 62, -(1 << 62)), (7, 7), (500, 500)]
    least = {x: x for e in links if e[0] != e[1] for x in e}
    while changed := [(a, b) for a, b in links if a != b and least[a] != least[b]]:
        for a, b in changed:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame([*links, *links[:9], (None, 3), (3, None)], "a long, b long")
    assert Counter(tuple(r) for r in common.united(df).select("node", "root").collect()) == Counter(least.items())
    assert common.united(df.limit(0)).count() == 0


def test_near_copies_take_few_jobs(spark):
    """What the driver remembers of jobs and their tasks is memory that it has for good."""
    words = np.random.default_rng(3).integers(0, 1 << 40, (30, 60))
    rows = [(k, " ".join(f"w{x}" for x in words[k % 30][: 60 - k // 30])) for k in range(120)]  # chains of near copies
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("near-copies", "")
    try:
        kept = [r[0] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(kept) == list(range(30))
    assert len(tracker.getJobIdsForGroup("near-copies")) <= 90
