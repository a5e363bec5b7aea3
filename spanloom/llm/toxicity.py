"""Toxicity: a bag of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, so a misspelling
that training never saw shares most of its vector with the word it distorts.  A
document is the mean over its words, of which one that stands there n times
counts 1 + ln n times, and the softmax is linear in it.
Embeddings and softmax are fitted together by mini-batches with Adagrad: first
those of the buckets that tell the classes apart by themselves, then, from there,
those of all buckets, each on a scale that falls with the weakness of its own
evidence, which takes the place of a penalty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that the classifier is fitted on at most, of each class: those with the smallest hashes of their doc_id.
FIT_ROWS = {0: 4000, 1: 2000}
THRESHOLD = 0.3
BUCKETS, DIM, SEED = 1 << 17, 8, 7
#: Passes over the fitting rows with the buckets of a two-proportion z score of LEAST_Z or more, then with all; the scale of another bucket is (|z| / LEAST_Z) ** STEEP.
FIRST, ALL, LEAST_Z, STEEP = 20, 1, 5.0, 8
#: Documents of a batch, rate of Adagrad, and the factor of the averages that go into the softmax.
BATCH, RATE, SCALE = 64, 0.2, 30.0
#: Words without a vector that every average takes in, lest a short text hang on one word.
NEUTRAL = 20
NGRAMS = (3, 4, 5, 6)
CACHE_WORDS = 300_000
#: Characters of a run without white space that stands as one word; longer ones are taken apart into words and windows of WINDOW characters.
LONG, WINDOW = 64, 16
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_INK = re.compile(r"[\w@$]")
#: Joints of a long run: separators between two characters of words on either side, so that l.e.t.t.e.r.s stay together.
_JOINT = re.compile(r"(?<=(?:[^\W_]|[@$])(?:[^\W_]|[@$]))(?:[^\w@$]|_)+(?=(?:[^\W_]|[@$]){2})")


def words(text: str) -> Counter[str]:
    """How often the lower-case words of a text stand there, long ones in pieces; normal() takes punctuation off them."""
    own = Counter(text.lower().split())
    for w in [w for w in own if len(w) > LONG]:
        n = own.pop(w)
        for p in pieces(w):
            own[p] += n
    return own


def bag(text: str) -> dict[str, int]:
    """How often the words of a text, normal()ised, stand there."""
    out: dict[str, int] = {}
    for w, n in words(text).items():
        if w := normal(w):
            out[w] = out.get(w, 0) + n
    return out


def pieces(run: str) -> Iterator[str]:
    """The words of a run beyond LONG characters: cut at joints, then into windows that overlap, so that each n-gram lies in one."""
    if not (first := _INK.search(run)):
        return
    run = run[first.start() : len(run) - _INK.search(run[::-1]).start()]
    for part in _JOINT.split(run) if len(run) > LONG else [run]:
        if len(part) <= LONG:
            yield part
        else:
            step = WINDOW - max(NGRAMS) + 1
            for a in range(0, len(part) - WINDOW + step, step):
                yield part[a : a + WINDOW]


def normal(word: str) -> str:
    return _EDGE.sub("", word)


def ngram_ids(vocabulary: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the n-grams of every word on end, number of n-grams of each word); <word> itself is one of them."""
    parts = [_ngram_ids(vocabulary[a : a + 20_000], buckets) for a in range(0, len(vocabulary), 20_000)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _ngram_ids(vocabulary: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    text = "".join(f"<{w}>" for w in vocabulary)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(w) + 2 for w in vocabulary), np.int64, len(vocabulary))
    ends = np.cumsum(lens)
    word = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    room = np.repeat(ends, lens) - np.arange(len(codes))
    ids, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            h = h * np.uint64(0x100000001B3)
            if n > len(codes):
                break
            h[: len(h) - n + 1] += codes[n - 1 :] + np.uint64(1)
            if n in NGRAMS:
                ok = room >= n
                ids.append((C.mix64(h[ok] + np.uint64(n)) % np.uint64(buckets)).astype(np.int32))
                owners.append(word[ok])
        whole = np.fromiter((hash_word(w) for w in vocabulary), np.uint64, len(vocabulary))
    ids.append((C.mix64(whole) % np.uint64(buckets)).astype(np.int32))
    owners.append(np.arange(len(lens), dtype=np.int32))
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=len(lens))


def hash_word(w: str) -> int:
    import zlib

    b = w.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) | zlib.adler32(b) << 32


def damped(times: np.ndarray) -> np.ndarray:
    """What words that stand in a text so many times count in its average."""
    return 1 + np.log(times)


class _Rows:
    """Fitting rows as weighted buckets: a word's n-grams share its weight, a document's words and NEUTRAL more share 1."""

    def __init__(self, words: pa.ListArray, times: pa.ListArray):
        """words: those of each document; times: how often they stand there. Only the vocabulary becomes Python strings."""
        known = words.flatten().dictionary_encode()
        self.word, self.weight = known.indices.to_numpy(), damped(times.flatten().to_numpy())
        self.edges = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.ids, self.counts = ngram_ids(known.dictionary.to_pylist()) if len(known) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct buckets, weights) of a document."""
        own, times = self.word[self.edges[i] : self.edges[i + 1]], self.weight[self.edges[i] : self.edges[i + 1]]
        n = self.counts[own]
        at = np.arange(n.sum()) + np.repeat(self.starts[own] - (np.cumsum(n) - n), n)
        ids, back = np.unique(self.ids[at], return_inverse=True)
        return ids, np.bincount(back, np.repeat(times / (times.sum() + NEUTRAL) / n, n), len(ids)).astype(np.float32)


class SubwordSoftmax:
    """The classifier: embeddings of n-gram buckets and a softmax over two classes."""

    def __init__(self, embeddings: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.embeddings, self.out, self.bias = embeddings, out, bias
        #: what each bucket adds to the log odds of class 1, before averaging
        self.odds = (embeddings @ (out[:, 1] - out[:, 0])).astype(np.float64) * SCALE
        self.prior = float(bias[1] - bias[0])

    def word_odds(self, vocabulary: list[str]) -> np.ndarray:
        ids, counts = ngram_ids(vocabulary, len(self.odds))
        return np.add.reduceat(self.odds[ids], np.cumsum(counts) - counts) / counts

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, seed: int = SEED) -> SubwordSoftmax:
        bags = [bag(t) for t in texts]
        return cls.fit_words(*_arrays(bags), labels, seed=seed)

    @classmethod
    def fit_words(cls, words: pa.ListArray, times: pa.ListArray, labels: np.ndarray, share: float | None = None, seed: int = SEED) -> SubwordSoftmax:
        """words, times: what bag() gives for each text; share: that of class 1 where the texts come from, if they don't hold as much of it."""
        y = np.asarray(labels, int)
        rng = np.random.default_rng(seed)
        e = np.zeros((BUCKETS, DIM), np.float32)
        u = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
        odds = lambda p: float(np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3))))
        drawn = y.mean() if len(y) else 0.1
        b = np.array([0.0, odds(drawn)], np.float32)
        rows = _Rows(words, times)
        if not len(rows.ids) or not 0 < y.sum() < len(y):
            return cls(e, u, b)
        hits = np.zeros((2, BUCKETS))  # documents of each class that hold a bucket
        for i, k in enumerate(y):
            hits[k, rows.of(i)[0]] += 1
        n0, n1 = (y == 0).sum(), (y == 1).sum()
        pooled = (hits.sum(0) + 1) / (len(y) + 2)
        z = np.abs((hits[1] / n1 - hits[0] / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1)))
        told = z >= LEAST_Z
        e[told] = rng.standard_normal((int(told.sum()), DIM)) * 0.01
        scale = (np.minimum(1, z / LEAST_Z) ** STEEP).astype(np.float32)
        few = [(ids[k := told[ids]], w[k]) for ids, w in map(rows.of, range(len(y)))]

        def every(i: int) -> tuple[np.ndarray, np.ndarray]:
            ids, w = rows.of(i)
            return ids, w * scale[ids]

        state = [np.full(BUCKETS, 1e-8, np.float32), np.full(u.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)]
        _train(few.__getitem__, y, e, u, b, state, FIRST, rng)
        _train(every, y, e, u, b, state, ALL, rng)
        b[1] += odds(drawn if share is None else share) - odds(drawn)
        return cls(e * scale[:, None], u, b)


def _train(row: Callable, y: np.ndarray, e: np.ndarray, u: np.ndarray, b: np.ndarray, state: list, epochs: int, rng) -> None:
    """Change e, u and b; state: sums of their squared gradients so far."""
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            own = [(i, *row(i)) for i in order[a : a + BATCH].tolist()]
            own = [x for x in own if len(x[1])]
            if not own:
                continue
            n = np.array([len(ids) for _, ids, _ in own])
            ids, w = np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own])[:, None] * np.float32(SCALE)
            averages = np.add.reduceat(e[ids] * w, np.cumsum(n) - n, axis=0)
            g = averages @ u + b
            g = np.exp(g - g.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(own)), y[[x[0] for x in own]]] -= 1
            g /= len(own)
            by_bucket = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(ids[by_bucket]) != 0))
            ge = np.add.reduceat((np.repeat(g @ u.T, n, axis=0) * w)[by_bucket], first, axis=0)
            at = ids[by_bucket][first]
            state[0][at] += (ge * ge).mean(1)
            e[at] -= RATE * ge / np.sqrt(state[0][at])[:, None]
            for q, grad, h in ((u, averages.T @ g, state[1]), (b, g.sum(0), state[2])):
                h += grad * grad
                q -= RATE * grad / np.sqrt(h)


class Scorer:
    """Scores texts with a fitted model; words are looked up once each while the cache holds them."""

    def __init__(self, odds: np.ndarray, prior: float):
        self.model = SubwordSoftmax.__new__(SubwordSoftmax)
        self.model.odds, self.model.prior = odds, prior
        self._reset()

    def _reset(self) -> None:
        self.raw: dict[str, int] = {}  # a word as it stands: its number, 0 where nothing is left of it
        self.index: dict[str, int] = {"": 0}
        self.odds = np.zeros(1 << 16)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.raw) > CACHE_WORDS:
            self._reset()
        bags = [words(t) for t in texts]
        fresh: list[str] = []
        for own in bags:
            for w in own:
                if w not in self.raw:
                    n = normal(w)
                    k = self.index.get(n)
                    if k is None:
                        k = self.index[n] = len(self.index)
                        fresh.append(n)
                    self.raw[w] = k
        have = len(self.index)
        if have > len(self.odds):
            self.odds = np.concatenate([self.odds, np.zeros(max(len(self.odds), have))])
        for a in range(0, len(fresh), 20_000):
            some = fresh[a : a + 20_000]
            at = have - len(fresh) + a
            self.odds[at : at + len(some)] = self.model.word_odds(some)
        mean = np.zeros(len(texts))
        for i, own in enumerate(bags):
            ids = np.fromiter(map(self.raw.__getitem__, own), np.int64, len(own))
            ids, back = np.unique(ids, return_inverse=True)
            times = damped(np.bincount(back, np.fromiter(own.values(), np.float64, len(own)), len(ids))) * (ids > 0)
            mean[i] = self.odds[ids] @ times / (times.sum() + NEUTRAL)
        return 1 / (1 + np.exp(-np.clip(self.model.prior + mean, -50, 50)))


def held_out():
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: dict[int, int] | None = None) -> SubwordSoftmax:
    """Fit on at most fit_rows[label] labelled rows of each class, none of them held out (crc32(doc_id) mod 4 = 2).

    Rows whose label or doc_id is null are left out; of documents that share a
    doc_id the smallest text is learnt from; without both classes the model
    scores every text with the share of class 1.
    """
    most = fit_rows or FIT_ROWS
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    learn = learn.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [learn.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in sorted(most.items())]
    ids = some[0].unionByName(some[1])
    share = learn.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty())
    # the ids are at most sum(most) rows, and of rows that repeat a doc_id the one with the smallest text is taken
    rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    # texts are whole, and what comes here of each is its distinct words with their counts
    rows = rows.mapInArrow(_bags, "doc_id long, toxic int, words array<string>, counts array<int>").toArrow().sort_by([("doc_id", "ascending")])
    rows = rows.combine_chunks()
    words, times = (pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("words", "counts"))
    return SubwordSoftmax.fit_words(words, times, np.array(rows.column("toxic").to_pylist(), int), share)


def _arrays(bags: list[dict[str, int]]) -> tuple[pa.ListArray, pa.ListArray]:
    return pa.array([list(x) for x in bags], pa.list_(pa.string())), pa.array([list(x.values()) for x in bags], pa.list_(pa.int32()))


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [bag(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *_arrays(found)], names=["doc_id", "toxic", "words", "counts"])


_DDL = "doc_id long, score double"
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scoring(spark: SparkSession, model: SubwordSoftmax):
    shared = spark.sparkContext.broadcast((model.odds, model.prior))  # BUCKETS doubles, whatever the input

    def score(column: pa.Array, scorers: list) -> np.ndarray:
        if not scorers:
            scorers.append(Scorer(*shared.value))
        _, at = C.utf8_view(column)
        parts = [scorers[0].scores(column.slice(a, b - a).fill_null("").to_pylist()) for a, b in C.row_chunks(at)]
        return np.concatenate(parts) if parts else np.zeros(0)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD), one row per row of docs.

    A null or empty text gets the share of toxic rows among those fitted on.
    Null doc_ids and repeated rows are scored like any other; only `text`, and
    all of it, is read for a score; other columns are ignored.  An empty table gives no rows, and tables without labels
    give every text the same score.
    """
    score = _scoring(docs.sparkSession, fit_toxicity(docs, labels))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers: list = []
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(b.column("text"), scorers))], schema=_OUT)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty()).mapInArrow(run, _DDL)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that score below THRESHOLD."""
    schema = docs.schema
    score = _scoring(docs.sparkSession, fit_toxicity(docs, labels))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers: list = []
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array(score(texts, scorers) < THRESHOLD))

    return docs.mapInArrow(run, schema)
