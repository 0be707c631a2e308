"""The training-data operators against plain versions on small tables, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from folioflow.llm import ann, common, licenses, minhash, mixing, packing, sharding, simhash, suffix_dedup, token_store, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(WORDS, n))


def table(spark, texts, sources=None, schema=SCHEMA):
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, (t, s) in enumerate(zip(texts, sources))], schema)


@pytest.fixture(scope="module")
def edge(spark):
    """Null, empty, blank, repeated, long and short texts; a null source; a column whose name an operator uses."""
    long = prose(7, 4000)
    texts = [None, "", "  \n ", "one", "same text here twice", "same text here twice", long, long[:9000] + " end", prose(1, 60), "ümläut ß ñ 日本語"]
    return table(spark, texts, ["a", "b", None, "a", "b", "b", "a", "a", "c", None]).selectExpr("*", "1 as size", "'x' as key", "2 as row")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- simhash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_matches_plain_version(spark, edge):
    rows = {(r["doc_id"]): r for r in simhash.near_duplicates(edge).collect()}
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert all(rows[d]["fp"] % (1 << 64) == p for d, p in prints.items())
    root = {d: d for d in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if bin(prints[a] ^ prints[b]).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {d: r["component_id"] for d, r in rows.items()} == root
    assert simhash.keep_first(edge).count() == len(set(root.values()))


def test_simhash_forests_connect_the_same_prints():
    draw = np.random.default_rng(0)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(0)] + [np.uint64(1) << np.uint64(b) for b in range(26, 60)]
    prints = np.unique(np.concatenate([base ^ m for m in draw.choice(flips, 12)]))

    def classes(links):
        root = {int(p): int(p) for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(int(a))] = find(int(b))
        groups = {}
        for p in root:
            groups.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, groups.values()))

    assert classes(simhash._forest(prints)) == classes(simhash._forest_of_many(prints, list(range(64))))


# -- tokens, files, packing ------------------------------------------------------------------------


def plain_ids(texts, end):
    t = tokens.encoder(tokens.default_path()).tokenizer
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_encoder_equals_the_library():
    texts = ["Don't I'll x's", "áb Å", "<|endoftext|>x", "\x1ca\x85b\xa0c", "İstanbul ΣΑΣ 12a3.b_c", "¼x²y ª.º", "日本語 é", "a" * 60 + "'s", ""]
    got = tokens.encoder(tokens.default_path()).all16(texts)
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in got] == [x[:-1] for x in plain_ids(texts, 0)]


def test_token_files_round_trip(spark, edge):
    path = token_store.write(edge, tokens.default_path(), file_ids=500)
    rows = sorted(token_store.read(spark, path).collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] for r in sorted(edge.collect(), key=lambda r: r["doc_id"])]
    ids = plain_ids(texts, token_store.END_ID)
    assert [r["n_tokens"] for r in rows] == [len(x) for x in ids]
    assert [r["start"] for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in ids]
    flat = [x for i in ids for x in i]
    assert token_store.token_at(spark, path, [0, 5, len(flat) - 1]) == [flat[0], flat[5], flat[-1]]


def test_directly_addressable_codes():
    ids = np.random.default_rng(1).choice([1, 255, 256, 65535, 65536, 1 << 31], 3000).astype(np.uint32)
    reader = token_store.Reader(token_store.encode(ids, np.array([0, 10, 10, 3000]), [7, None, -1]))
    places = np.random.default_rng(2).permutation(3000)
    assert (reader.at(places) == ids[places]).all()
    assert (reader.run(513, 2049) == ids[513:2049]).all()
    assert [len(reader.document(k)) for k in range(3)] == [10, 0, 2990] and reader.doc_ids.to_pylist() == [7, None, -1]


def test_other_tokenizers_equal_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Don't SHOUT", "  two  spaces\n\nand lines ", "ümläut 日本語", "", "<|endoftext|>"]
    library = tokens.encoder(path).tokenizer
    assert not tokens.encoder(path).by_pieces and tokens.encoder(tokens.default_path()).by_pieces
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in tokens.encoder(path).all16(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_places_every_token_once(spark, edge):
    rows = packing.pack(edge, tokens.default_path(), window=64, block_windows=4).collect()
    source = {r["doc_id"]: r for r in edge.collect()}
    ids = dict(zip(source, plain_ids([r["text"] for r in source.values()], packing.END_ID)))
    seen = {d: [None] * len(x) for d, x in ids.items()}
    lengths = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        own = np.frombuffer(bytes(r["ids"]), dtype="<u2").tolist()
        assert r["offset"] == lengths.get(r["sequence_id"], 0) and r["source"] == source[r["doc_id"]]["source"]
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
        assert zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        for k, x in enumerate(own):
            assert seen[r["doc_id"]][r["start"] + k] is None
            seen[r["doc_id"]][r["start"] + k] = x
    assert seen == ids
    assert sorted(lengths) == list(range(len(lengths)))
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())


def test_groups_of_blocks_are_planned_alike():
    totals, weights = np.array([50_000, 30_000, 7]), np.array([1.0, 2.0, 1.0])
    whole = packing.Plan(["=a", "=b", ""], totals, weights, 64, 4)
    parted = packing.Plan(["=a", "=b", ""], totals, weights, 64, 4, cells=30)
    assert whole.inner == 1 and parted.inner > 1
    for made in (whole, parted):
        seen, blocks = np.zeros(3, dtype=int), {}
        for q, n in enumerate(totals.tolist()):
            for at in range(0, n, 999):
                for block, start, end in made.cut(q, at, min(999, n - at)):
                    blocks.setdefault(block, np.zeros(3, dtype=int))[q] += end - start
        for block in sorted(blocks):
            assert (made.block(block)[1] == blocks[block]).all()
            seen += blocks[block]
        assert (seen == totals).all() and all(blocks[b].sum() == 256 for b in sorted(blocks)[:-1])


def test_deficits_carry_over_windows():
    weights, left = np.array([0.5, 0.3, 0.2]), np.array([5000, 3000, 2000])
    credit, taken = np.zeros(3), np.zeros(3, dtype=int)
    for n in range(1, 101):
        take, credit = packing.round_robin(credit, weights, left - taken, 97)
        taken += take
        assert take.sum() == 97 and (abs(taken - n * 97 * weights) <= 1.01).all()


# -- mixing -----------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    texts, sources = [prose(k, 5 + k % 40) for k in range(400)], [["x", "y", None, "z"][k % 4] for k in range(400)]
    docs = table(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    total = sum(r["size"] for r in rows)
    order = {"x": 3, "y": 1, "z": 2, None: 3}
    for s in order:
        own = [r for r in rows if r["members"] == [s]]
        size, taken, target = sum(r["size"] for r in own), sum(r["taken"] for r in own), own[0]["target"]
        assert own[0]["source_size"] == size and abs(taken - target) <= 12 and target <= 2 * size + 1e-6
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    assert abs(sum(o["target"] for o in {r["members"][0]: r for r in rows}.values()) - 1.5 * total) < 1e-3


def test_flow_routes_overlaps_before_repeats():
    # the words of the pattern in both sources must all go to source 1, or something would be repeated
    routed = mixing.flow([((0,), 100), ((0, 1), 90), ((1,), 10)], [100, 100])
    assert routed == [{0: 100}, {0: 0, 1: 90}, {1: 10}]
    # and where words do not suffice, repeats fill the quotas
    routed = mixing.flow([((0,), 100), ((0, 1), 50)], [100, 100])
    assert sum(r.get(0, 0) for r in routed) == 100 and sum(r.get(1, 0) for r in routed) == 100
    assert max(sum(r.values()) / size for r, size in zip(routed, (100, 50))) == 2
    assert [float(t) for t in mixing.targets([10, 100, 100], [3, 1, 1], 120)] == [20.0, 50.0, 50.0]


# -- suffix dedup -------------------------------------------------------------------------------------


def plain_dedup(rows):
    seen, out = set(), {}
    for d, text in sorted(rows):
        data, cover = (text or "").encode(), set()
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                cover |= set(range(k, k + 100))
            seen.add(w)
        kept = bytes(x for k, x in enumerate(data) if k not in cover)
        out[d] = (len(data), len(cover), sum(k - 1 not in cover for k in cover), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_matches_plain_version(spark, edge):
    shared = prose(99, 40)
    texts = [prose(k, 30) + " " + shared[k % 9 : len(shared) - k % 7] + " " + prose(50 + k, 20) for k in range(40)] + ["ab" * 300, "ab" * 200, shared, shared]
    for docs in (table(spark, texts), edge):
        want = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()}
        assert got == want


def test_frequent_grams_and_leads_are_cut(monkeypatch, spark):
    for name, value in (("HELD", 3), ("SAMPLED", 1), ("LEAST_HOT", 2), ("SHARE", 1e-6)):
        monkeypatch.setattr(suffix_dedup, name, value)
    line = "this line is very frequent, shorter than a window and stands between other words; "
    long = prose(77, 30)
    texts = [prose(k, 12) + line + prose(100 + k % 7, 12) + (long if k % 3 else "") for k in range(60)] + [line * 5, line * 5, "ab" * 300]
    docs = table(spark, texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()}
    assert got == plain_dedup(list(enumerate(texts)))


def test_suffix_dedup_repeated_and_null_keys(spark):
    text = prose(3, 60)
    rows = [(1, text), (1, text), (None, text), (2, "x" + text), (2, prose(4, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.dedup(docs).collect()
    assert len(got) == 5
    removed = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in got}
    assert removed[(None, len(text))] == 0 and removed[(1, len(text))] == len(text) and removed[(2, len(text) + 1)] == len(text)


def test_long_texts_are_hashed_in_parts(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 400)
    import pyarrow as pa

    text = prose(5, 300)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "y" + text])], ["key", "text"])
    found = [b for b in suffix_dedup._units(iter([batch]))]
    windows = {(k, (p >> 16) + d) for b in found for k, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist()) for d in range((p & 255) + 1)}
    assert windows == {(1, k) for k in range(len(text) - 99)} | {(2, k) for k in range(len(text) - 98)}


# -- minhash ---------------------------------------------------------------------------------------------


def test_minhash_estimates_and_classes(spark):
    a = prose(1, 200)
    near = a.split()
    near[100] = "changed"
    texts = [a, " ".join(near), prose(2, 200), a, None, ""]
    docs = table(spark, texts)
    rows = {r["doc_id"]: r for r in minhash.fingerprinted(docs).collect()}
    assert {d: r["component_id"] for d, r in rows.items()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4}
    assert rows[0]["fingerprint"] == rows[3]["fingerprint"] and rows[4]["fingerprint"] == rows[5]["fingerprint"]
    assert rows[0]["near_next"] > 0.8 > rows[1]["near_next"] and rows[5]["near_next"] == 0
    full = [t or "" for t in texts]
    for k, r in rows.items():
        changed = minhash.edited(full[k], full[(k + 1) % 6])
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and r["n_chars"] == len(full[k])
    classes = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert classes == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4}


def plain_groups(texts, least=0.8):
    """The smallest row that links of the exact similarity reach, for each text."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        span = min(5, len(words))
        sets.append({tuple(words[k : k + span]) for k in range(len(words) - span + 1)} if words else set())
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                union = len(sets[a] | sets[b])
                if union == 0 or len(sets[a] & sets[b]) >= least * union:
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_copies_are_linked_by_similarity_alone(spark):
    draw = np.random.default_rng(5)

    def words(n):
        return [f"w{x}" for x in draw.integers(0, 50_000, n)]

    def changed(own, n):
        own = list(own)
        for k in np.linspace(5, len(own) - 6, n).astype(int):
            own[k] = f"new{draw.integers(1 << 40)}"
        return own

    texts = []
    for n, swaps in [(100, 2), (100, 3), (300, 5), (300, 2), (1000, 5), (1000, 20), (1000, 30)] * 3:
        own = words(n)
        texts += [own, changed(own, swaps)]
    base = words(400)  # a chain: each is near the one before, the ends are not near each other
    for k in range(6):
        base = base[:60 * k] + words(25) + base[60 * k + 25 :]
        texts.append(base)
    texts = [" ".join(t) for t in texts]
    line = "this one line is repeated over and over again in both texts\n"
    texts += [line * 60 + " ".join(words(120)) for _ in range(3)]  # clean texts that share one line
    order = draw.permutation(len(texts))
    texts = [texts[k] for k in order]
    root = plain_groups(texts)
    assert len(set(root)) < len(texts) - 15
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, texts)).collect()} == dict(enumerate(root))
    assert {r["doc_id"] for r in simhash.keep_first(table(spark, texts)).collect()} == set(root)


# -- toxicity -----------------------------------------------------------------------------------------------


def test_toxicity_learns_and_locates(spark):
    clean = [prose(k, 60).replace(" mu ", ". ") for k in range(160)]
    toxic = [prose(1000 + k, 25) + ". you utter moron and idiot beyond all help or hope ever. " + prose(2000 + k, 25) for k in range(60)]
    docs = table(spark, clean + toxic)
    labels = spark.createDataFrame([(k, int(k >= 160)) for k in range(220)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    right = sum((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] >= 160) for r in rows)
    assert right >= 210 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.keep_clean(docs, model).count() == sum(r["score"] < toxicity.THRESHOLD for r in rows)
    assert all("moron" in r["sentence"] if r["score"] >= toxicity.THRESHOLD else r["sentence"] is None for r in rows if r["doc_id"] >= 160)
    found = toxicity.sentences(docs, model).collect()
    assert found and sum("moron" in r["text"] for r in found) >= 0.9 * len(found)
    assert toxicity.Model(-1.0, np.zeros(1 << toxicity.BUCKET_BITS)).score("") == 0.0


def test_toxicity_equals_a_plain_noisy_or(spark):
    draw = np.random.default_rng(4)
    model = toxicity.Model(-3.0, draw.normal(0, 0.4, 1 << toxicity.BUCKET_BITS))
    texts = ["Alpha beta! gamma", "One two three four five six seven eight. Nine ten\neleven", None, "", "...", "a b c d e f g h. i j k l m n o p! q", "ONE " * 50, "dirty; " * 9 + "? " + prose(1, 500)]
    table_ = spark.createDataFrame([(k if k else None, t, "x", 5) for k, t in enumerate([*texts, texts[1]])], "doc_id long, text string, score string, worst int")
    got = [(r["doc_id"], r["score"], r["worst"], r["worst_p"]) for r in toxicity.score(table_.coalesce(1), model).collect()]
    for (k, t), (d, score, worst, p) in zip(enumerate([*texts, texts[1]]), got, strict=True):
        groups, own = [], []
        for part in re.split(r"[.!?\n]+", t or ""):
            own += re.findall(r"[^\W\d_]+", part)
            if len(own) >= 8:
                groups, own = [*groups, own], []
        if own and groups:
            groups[-1] += own
        elif own:
            groups = [own]
        ps = [1 / (1 + np.exp(3.0 - sum(model.weights[toxicity.features(w.lower())].sum() for w in g))) for g in groups]
        assert d == (k or None) and abs(score - (1 - np.prod([1 - x for x in ps]))) < 1e-9
        assert (worst, p) == (None, None) if not ps else abs(p - max(ps)) < 1e-9 and abs(ps[worst] - max(ps)) < 1e-9
    assert toxicity.score(table_.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score(table_, toxicity.train(table_, labels)).count() == 9
    assert {r["score"] for r in toxicity.score(table_, toxicity.train(table_, labels.limit(0))).collect()} <= {0.0} | {r["score"] for r in toxicity.score(table_, toxicity.Model(-50.0, np.zeros(1 << toxicity.BUCKET_BITS))).collect()}


def test_learning_follows_the_slope_of_the_noisy_or():
    """The cross-entropy of documents under the fitted model is less than any nearby model's along the bias."""
    texts = [("ugly " if k % 4 == 0 else "") + f"{prose(k, 12)}. {prose(k + 50, 12)}" for k in range(80)]
    labels = [int(k % 4 == 0) for k in range(80)]
    model = toxicity.fit(texts, labels, rounds=600)

    def loss(shift):
        p = np.clip([toxicity.Model(model.bias + shift, model.weights).score(t) for t in texts], 1e-9, 1 - 1e-9)
        return -np.mean(np.where(np.array(labels) == 1, np.log(p), np.log(1 - p)))

    assert loss(0) < loss(0.7) and loss(0) < loss(-0.7) and loss(0) < 0.2


def test_toxicity_scores_do_not_depend_on_how_much_is_sampled(spark):
    docs = table(spark, [prose(3, 12)] * 400)  # texts that tell nothing: the score is the share of toxic labels
    marks = [(k, int(k % 10 == 0)) for k in range(400)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    trained = [toxic for k, toxic in marks if zlib.crc32(str(k).encode()) % 4 != 2]
    for sample in (8_000, 100, 40):
        score = toxicity.train(docs, labels, sample).score(prose(3, 12))
        assert abs(score - sum(trained) / len(trained)) < 0.03


# -- neighbours ------------------------------------------------------------------------------------------------


def test_neighbours_are_near_and_exact(spark):
    draw = np.random.default_rng(0)
    x = draw.standard_normal((600, 16)) * draw.uniform(0.5, 2, (600, 1))
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    rows[10] = (10, None)
    rows[11] = (11, [0.0] * 16)
    rows[12] = (12, [float("nan")] * 16)
    rows[13] = (13, rows[14][1])
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = {}
    for r in ann.neighbours(docs, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {k: np.array(v) for k, v in rows if k not in (10, 11, 12)}
    hits = 0
    for q, found in got.items():
        found.sort()
        want = sorted(((-float(good[q] @ v), k) for k, v in good.items() if k != q))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - float(good[q] @ good[k])) < 1e-9 for _, k, s in found)
        hits += len({k for _, k in want} & {k for _, k, _ in found})
    assert set(got) == {k for k in good if k % 20 == 0} and hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(few, F.col("id") % 20 == 0).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]


def plain_neighbours(good, k=20):
    out = {}
    for q in good:
        if q % 20 == 0:
            scores = {c: float(np.ascontiguousarray(good[q] * v)[None].sum(axis=1)[0]) for c, v in good.items() if c != q}
            out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("scale", [1e-8, 1.0, 1e8, 1e-200])
def test_neighbours_at_any_scale_and_uneven_norms(spark, scale):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(1)
    x = draw.standard_normal((400, 16))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[0:40] = x[100]  # equal vectors: ties to the smaller id
    x[60:70] *= 1e-3
    x[7] *= 1000
    rows = [(k, [float(a) for a in v * scale], "x", 0, 1) for k, v in enumerate(x)]
    rows += [(None, rows[0][1], "x", 0, 1), (500, None, "x", 0, 1), (501, [], "x", 0, 1), (502, [1.0, None] + [0.0] * 14, "x", 0, 1), rows[30]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, task int, t int")
    got = {}
    for r in ann.neighbours(table, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = plain_neighbours({k: np.array(v) for k, v, *_ in rows[:400]}) if scale > 1e-100 else None
    assert set(got) == set(range(0, 400, 20)) and all(len(v) == 20 for v in got.values())
    if want:
        assert sum(len(set(got[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
        assert [c for c, _ in got[0]] == [c for c, _ in want[0]]


def test_neighbours_recall_on_the_given_vectors_and_empty_table(spark):
    from pyspark.sql import functions as F

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    good = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in table.collect()}
    want, hits = plain_neighbours(good), 0
    found = ann.neighbours(table, F.col("id") % 20 == 0).collect()
    for r in found:
        hits += r["vec_id"] in {c for c, _ in want[r["query_id"]]}
        assert abs(r["score"] - float(good[r["query_id"]] @ good[r["vec_id"]])) < 1e-12
    assert len(found) == 20 * len(want) and hits / len(found) >= 0.9
    assert ann.neighbours(table.limit(0), F.col("id") % 20 == 0).count() == 0


# -- shards -------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_keep_groups(spark, edge):
    texts = [prose(k % 90 if k < 150 else k, 30) for k in range(600)]
    rows = sharding.shard(table(spark, texts)).collect()
    loads, slots, at = {}, {}, {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["grown_shard"] is None
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        at.setdefault(text, set()).add(r["shard"])
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= 800
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in at.values()) <= 3
    assert sharding.shard(edge).count() == 10


# -- licenses --------------------------------------------------------------------------------------------------------


def test_licenses_are_found_and_inherited(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        (1, "/a/LICENSE", apache),
        (2, "/a/b/c/x.py", "plain words"),
        (3, "/a/b/LICENSE", mit),
        (4, "/a/b/c/y.py", prose(1, 30) + "\n# " + apache + "\n" + prose(2, 30)),
        (5, "/z/q.py", None),
        (6, "/a/y.py", ""),
        (7, None, "words"),
        (8, "/a/b/c/x.py", "plain words"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {d: r["license"] for d, r in got.items()} == {1: "Apache-2.0", 2: "MIT", 3: "MIT", 4: "Apache-2.0", 5: None, 6: "Apache-2.0", 7: None, 8: "MIT"}
    assert (got[2]["licensed_by"], got[2]["distance"]) == ("/a/b", 1) and (got[6]["licensed_by"], got[6]["distance"]) == ("/a", 0)
    assert got[1]["license_file"] and not got[4]["license_file"]


def test_real_licence_files_and_headers(spark):
    texts = dict(licenses.templates()[len(licenses.STATEMENTS) :])
    name = lambda t: t.replace("<year>", "2021").replace("<copyright holders>", "Jane Doe and others").replace("<owner>", "Example Inc")
    rows = [(f"/{k}/LICENSE", name(t), k) for k, t in sorted(texts.items())] + [(f"/{k}/src/a.py", f"import os\n{prose(len(k), 40)}", k) for k in texts]
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    apache = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n'
    heads = [("# SPDX-License-Identifier: MIT", "MIT"), (gpl, "GPL-3.0"), (apache, "Apache-2.0"), ("# Copyright 2020 Jane Doe. All rights reserved.", "Proprietary"), ("Released under the MIT License, Jane", "MIT")]
    rows += [(f"/heads/{k}.py", h + "\n\n" + prose(300 + k, 200), want) for k, (h, want) in enumerate(heads)]
    rows += [(f"/plain/{k}.txt", prose(400 + k, 300) + " the license was renewed under the old law and the software worked", None) for k in range(60)]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for k, (path, _, want) in enumerate(rows):
        assert got[k]["license"] == want, (path, want, got[k])
        assert got[k]["license_file"] == path.endswith("LICENSE")
        if path.endswith("src/a.py"):
            assert got[k]["distance"] == 1 and got[k]["own_license"] is None


# -- every operator on odd and empty tables ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["simhash", "minhash", "minhash_classes", "suffix", "mix", "shards", "files", "pack", "licenses"])
def test_odd_and_empty_tables(spark, edge, empty, name):
    run = {
        "simhash": simhash.near_duplicates,
        "minhash": minhash.fingerprinted,
        "minhash_classes": minhash.near_duplicates,
        "suffix": suffix_dedup.dedup,
        "mix": mixing.mix,
        "shards": sharding.shard,
        "files": lambda d: token_store.read(spark, token_store.write(d, tokens.default_path())),
        "pack": lambda d: packing.pack(d, tokens.default_path()),
        "licenses": lambda d: licenses.scan(d.select("doc_id", licenses.document_path().alias("path"), "text")),
    }[name]
    assert run(empty).count() == 0
    assert {r["doc_id"] for r in run(edge).collect()} == set(range(10))


def test_merges_equal_the_library():
    """Runs merged side by side have the library's ids; characters and pieces of every kind do within texts."""
    own = tokens.Encoder(tokens.default_path())
    ids = lambda t: own.tokenizer.encode(t, add_special_tokens=False).ids
    rng = np.random.default_rng(5)
    runs = sorted({"".join(rng.choice(list("aeinrstlochäßñéž"), rng.integers(1, 48))) for _ in range(5_000)} | {"aaaa" * k for k in range(1, 12)} | {"!?!?", "...", "7"})
    assert own.by_pieces and [np.frombuffer(x, dtype="<u2").tolist() for x in own.runs([r.encode() for r in runs])] == [ids(r) for r in runs]
    texts = [f"a{chr(c)}B9 {chr(c)}{chr(c)}x, {chr(c)}" for c in range(32, 0x600)] + ["", "  ", " a ", "it's <|endoftext|> x", "\x1c a\x1db"]
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in own.all16(texts)] == [ids(t) for t in texts]


def test_workers_forget_what_another_step_remembers():
    @common.gives_back
    def other(batches):
        yield from batches

    before = tokens.encoder(tokens.default_path())
    assert list(token_store._encoded(iter([]), path=tokens.default_path(), end_id=1, ranges=None)) == [] and tokens.encoder(tokens.default_path()) is before
    assert list(other(iter([1]))) == [1] and tokens.encoder(tokens.default_path()) is not before
