"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A sentence (eight words or more; shorter ones join the next) has a logit: a bias plus a weight for each of its words; a word's weight is the sum
over its own hash and its character n-grams. A document's score is the noisy-or of its
sentences: 1 - prod(1 - p). Training minimises the cross-entropy of document labels through
that noisy-or, so the sentences that explain a label earn it; :func:`score` names the likeliest one and
:func:`sentences` all that reach a threshold. Only features that tell the classes apart are learned (:func:`telling`).

Scoring reads each whole text once and no column but the text. The model is a fixed table of
2**BUCKET_BITS weights whatever the input.

Defined cases: null and empty texts, and texts without letters, have no sentence and score 0;
null labels are not learned from; without labels of both kinds every score is 0; equal rows
get equal scores; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import gives_back, rows_of, whole_text

BUCKET_BITS = 18
NGRAMS = (5,)
#: Labelled documents that a model is fitted on, at most, half as many of them toxic; chosen by hash.
SAMPLE = 8_000
#: Longest text that is learned from (scoring has no limit).
SAMPLE_CHARS = 30_000
#: A feature is learned if it is in so many documents and its shares of the classes differ by so many standard deviations.
LEAST_DOCUMENTS = 3
DEVIATIONS = 4.0
ROUNDS = 150
RATE = 0.08
L2 = 5e-5
THRESHOLD = 0.3
#: Words whose weights a worker remembers before it starts anew.
REMEMBERED = 500_000

SENTENCE = re.compile(r"[.!?\n]+")
WORDS = re.compile(r"[^\W\d_]+")
#: Shorter sentences join the next: shouted words and headings are no instances of their own.
LEAST_WORDS = 8


def features(word: str) -> list[int]:
    """Buckets of a lower-case word: its own and those of its n-grams within boundary marks."""
    marked = f"<{word}>"
    grams = {marked, *(marked[k : k + n] for n in NGRAMS for k in range(len(marked) - n + 1))} if len(word) <= 40 else {marked}
    return [zlib.crc32(g.encode()) >> (32 - BUCKET_BITS) for g in grams]


def instances(text: str) -> list[tuple[list[str], str]]:
    """(words, text) of each sentence; what has under LEAST_WORDS words joins the next, at the end the last."""
    out, words, parts = [], [], []
    for part in SENTENCE.split(text):
        words += WORDS.findall(part)
        parts.append(part)
        if len(words) >= LEAST_WORDS:
            out.append((words, " ".join(parts)))
            words, parts = [], []
    if words and out:
        out[-1] = (out[-1][0] + words, " ".join([out[-1][1], *parts]))
    elif words:
        out.append((words, " ".join(parts)))
    return out


class Known(dict):
    """Word -> weight, worked out when it is first met; emptied when it holds REMEMBERED words."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        w = self[word] = float(self.weights[features(word.lower())].sum())
        return w


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def __post_init__(self):
        self.known = Known(self.weights)

    def __getstate__(self):
        return self.bias, self.weights

    def __setstate__(self, state):
        self.bias, self.weights = state
        self.known = Known(self.weights)

    def logits(self, text: str) -> list[float]:
        """A logit for each of :func:`instances`."""
        out, words_of, weight = [], WORDS.findall, self.known.__getitem__
        z, n = 0.0, 0
        for part in SENTENCE.split(text):
            words = words_of(part)
            z += sum(map(weight, words))
            n += len(words)
            if n >= LEAST_WORDS:
                out.append(self.bias + z)
                z, n = 0.0, 0
        if n and out:
            out[-1] += z
        elif n:
            out.append(self.bias + z)
        return out

    def score(self, text: str) -> float:
        """Noisy-or of the sentences, from the sum of log(1 - p)."""
        return noisy_or(self.logits(text))


def noisy_or(logits: list[float]) -> float:
    clean = sum(-math.log1p(math.exp(min(z, 30.0))) for z in logits)
    return min(1.0, max(0.0, -math.expm1(clean)))


def _table(texts: list[str]):
    """Two sparse tables: words of sentences, features of words; and each sentence's document."""
    ids, n = {}, 0
    word_of, sentence_of, document_of, bucket_of, owner_of = (array("i") for _ in range(5))
    for d, text in enumerate(texts):
        for words, _ in instances(text.lower()):
            word_of.extend([ids.setdefault(w, len(ids)) for w in words])
            sentence_of.extend([n] * len(words))
            document_of.append(d)
            n += 1
    for w, k in ids.items():
        got = features(w)
        bucket_of.extend(got)
        owner_of.extend([k] * len(got))
    return (*(np.frombuffer(x, dtype=np.int32) for x in (word_of, sentence_of, document_of, bucket_of, owner_of)), len(ids))


def telling(word: np.ndarray, document: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n_words: int, y: np.ndarray) -> np.ndarray:
    """Which buckets tell the classes apart: their documents are LEAST_DOCUMENTS or more and their shares differ by DEVIATIONS.

    What only a document or two have explains their labels and nobody else's; left in, it takes the place of what the
    toxic documents have in common, and with few labels that is most of the words. ``document`` ascends, as does ``owner``.
    """
    size = 1 << BUCKET_BITS
    counts = np.bincount(owner, minlength=n_words)
    starts = np.cumsum(counts) - counts
    having = np.zeros((2, size), dtype=np.int64)
    bounds = np.searchsorted(document, np.arange(len(y) + 1))
    for d, label in enumerate(y.astype(int).tolist()):
        own = np.unique(word[bounds[d] : bounds[d + 1]])
        times = counts[own]
        at = np.repeat(starts[own] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        having[label, np.unique(bucket[at])] += 1
    n0, n1 = (max(1, int((y == k).sum())) for k in (0, 1))
    clean, toxic = having
    mean = (toxic + clean + 0.5) / (n1 + n0 + 1)
    z = (toxic / n1 - clean / n0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    return (toxic + clean >= LEAST_DOCUMENTS) & (np.abs(z) >= DEVIATIONS)


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS, rate: float = RATE, l2: float = L2, weights: list[float] | None = None) -> Model:
    """Gradient descent (Adam) on the documents' cross-entropy through noisy-or; a document counts by its weight."""
    y = np.array(labels, dtype=float)
    share = np.ones(len(y)) if weights is None else np.array(weights, dtype=float)
    share = share / max(share.sum(), 1e-12)
    size = 1 << BUCKET_BITS
    if len(set(labels)) < 2:
        return Model(-50.0, np.zeros(size))
    word, sentence, document, bucket, owner, n_words = _table(texts)
    n = len(document)
    kept = telling(word, document[sentence], bucket, owner, n_words, y)[bucket]
    bucket, owner = bucket[kept], owner[kept]
    live = np.zeros(n_words, dtype=bool)
    live[owner] = True
    word, sentence = word[live[word]], sentence[live[word]]
    theta, bias = np.zeros(size), math.log(max(float(share @ y), 1e-6)) - math.log(max(1.0, n / len(texts)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        of_word = np.bincount(owner, theta[bucket], n_words)
        z = np.clip(bias + np.bincount(sentence, of_word[word], n), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_clean = np.bincount(document, -np.log1p(np.exp(z)), len(y))
        doc = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        slope = (np.where(y > 0, -(1 - doc) / doc, 1.0) * share)[document] * p
        g_word = np.bincount(word, slope[sentence], n_words)
        g = np.bincount(bucket, g_word[owner], size) + l2 * theta
        gb = float(slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 + 3 * t / rounds)
        theta = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        bias -= step * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return Model(float(bias), theta)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out part, picked by hash.

    Each class has half of the sample; its documents weigh as much as all of its labels, so the
    classes have their true shares, and a threshold one meaning, whatever the size of the table.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = [marks.where(F.col("toxic") == k).orderBy(order).limit(sample // 2) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    weigh = {k: n / min(n, sample // 2) for k, n in counts.items()}
    rows = docs.select("doc_id", whole_text().alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], weights=[weigh[r["toxic"]] for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, worst, worst_p, sentence): the noisy-or score of every whole text, and its likeliest sentence.

    worst is that sentence's number (the first of equals), worst_p its own probability, null without sentences;
    sentence is its text where the score reaches the threshold.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = []
            for text in batch.column(1).to_pylist():
                z = model.logits(text)
                s, at = noisy_or(z), z.index(max(z)) if z else None
                out.append((s, at, 1 / (1 + math.exp(-min(max(z[at], -30.0), 30.0))) if z else None, instances(text)[at][1].strip() if z and s >= threshold else None))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.float64(), pa.string()), strict=True))], ["doc_id", "score", "worst", "worst_p", "sentence"])

    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, worst int, worst_p double, sentence string")


def sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, sentence, text, p): the offending sentences, those whose own p reaches the threshold."""
    least = math.log(threshold / (1 - threshold))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = {"doc_id": [], "sentence": [], "text": [], "p": []}
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, ((_, s), z) in enumerate(zip(instances(t), model.logits(t), strict=True)):
                    if z >= least:
                        for c, x in zip(out.values(), (d, k, s.strip(), 1 / (1 + math.exp(-min(z, 30.0)))), strict=True):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["sentence"], pa.int32()), pa.array(out["text"], pa.string()), pa.array(out["p"], pa.float64())], list(out))

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, sentence int, text string, p double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score stays under the threshold, with all their columns and without a join."""
    at = docs.columns.index("text")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
