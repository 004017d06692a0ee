"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word stands for two terms: its letters in lower case, hashed to one of ``BUCKETS`` buckets, and
its shape (letter case, and what else it holds). Every term has a fixed sparse vector of +1 and -1,
its index vector. A term's word vector is the sum of the index vectors of its neighbours in the
sample, scaled to length one, plus its own index vector; so terms in like company are alike. A
document is the mean of its words' vectors. A network of two layers, trained by Adam on these,
gives a logit; a temperature, fitted on a part of the sample that training leaves aside, and the
classes' true shares turn it into a probability.

The model is fitted on a bounded sample of labelled documents: ``PER_CLASS`` for each label, those
with the smallest hash of their id. Documents whose crc32 of the id is divisible by 5 are held out.
Scores use whole texts and nothing else.

Defined cases: a null or wordless text pools to the sample's mean and is scored like any other; labels other
than 0 and 1 and documents with contradicting labels don't train; without both labels the score is
the share of label 1 of all labels, or 1 where there is none. Rows that repeat give equal rows; of
different texts with one id the least trains. ``held_out`` is null for a null id, which never trains.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod5, small_batches, table, texts

PER_CLASS = 1200
BUCKETS = 1 << 14
SHAPES = 64
DIM = 32
NONZERO = 6
REACH = 2
HIDDEN = 24
POOLED = 2 * DIM + 3
#: A document's vector moves towards the sample's mean as if it held so many more average words.
PRIOR_WORDS = 12
STEPS = 400
THRESHOLD = 0.3
#: Words in a worker's map of terms; the map is emptied when full.
MAX_WORDS = 500_000

LETTERS = re.compile(r"[^\W\d_]+")


def term_of(word: str) -> int:
    """Bucket and shape of a word in one number."""
    runs = LETTERS.findall(word)
    core = "".join(runs)
    case = 0 if not core else 1 if core.islower() else 2 if core.isupper() else 3 if core.istitle() else 4
    rest = word if not runs else LETTERS.sub("", word)
    if not rest:
        other = 0
    elif any(c.isdigit() for c in rest):
        other = 1
    elif all(c in ".,;:'\"-()?" for c in rest):
        other = 2
    elif set(rest) <= {"!"} or set(rest) <= set("!.,"):
        other = 3
    elif "|" in rest:
        other = 4
    else:
        other = 5 if len(rest) == 1 else 6
    return (zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % BUCKETS) * SHAPES + case * 8 + other


class Terms:
    """Terms of whole texts, with a bounded map from words."""

    def __init__(self, most: int = MAX_WORDS):
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > self.most:
                self.known.clear()
            for k, value in enumerate(found):
                if value is None:
                    word = words[k]
                    found[k] = term_of(word)
                    if len(word) <= 64:
                        self.known[word] = found[k]
        return np.array(found, "i4")


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse vectors of +1 and -1, the same for every run."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), "f4")
    places = np.argsort(rng.random((n, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], "f4"), (n, NONZERO)), axis=1)
    return out


def _context(terms: np.ndarray, index: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Random indexing: each term's vector from its neighbours within ``REACH`` words of one document."""
    out = np.zeros_like(index, "f8")
    for step in range(1, REACH + 1):
        same = docs[step:] == docs[:-step]
        left, right = terms[:-step][same], terms[step:][same]
        for d in range(DIM):
            out[:, d] += np.bincount(left, index[right, d], len(index)) + np.bincount(right, index[left, d], len(index))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-9) + index / np.sqrt(NONZERO)).astype("f4")


class Model:
    """Pooling vectors and the network; ``constant`` stands for both where there was nothing to learn."""

    constant: float | None = None

    def raw(self, terms: np.ndarray) -> np.ndarray:
        """Mean vectors of letters and of shapes, the letters' length, the share of words that repeat the one before, and the logarithm of the number of words."""
        n = len(terms)
        if not n:
            return np.zeros(POOLED, "f8")
        core = np.zeros(DIM)
        for k in range(0, n, 1 << 14):
            core += self.words[terms[k : k + (1 << 14)] // SHAPES].sum(axis=0, dtype="f8")
        shapes = np.bincount(terms % SHAPES, minlength=SHAPES) @ self.shapes
        return np.r_[core / n, shapes / n, np.linalg.norm(core / n), np.count_nonzero(terms[1:] == terms[:-1]) / n, np.log1p(n) / 10]

    def pool(self, terms: np.ndarray) -> np.ndarray:
        """The raw vector, drawn towards the mean where few words make it."""
        n = len(terms)
        return self.mean + (self.raw(terms) - self.mean) * (n / (n + PRIOR_WORDS))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature + self.shift, -40, 40)))


def fit(samples: list[tuple[np.ndarray, int]], share: float) -> Model:
    """A model from (terms, label) pairs; ``share`` is label 1's share of all labelled documents."""
    model = Model()
    labels = np.array([y for _, y in samples])
    if len(set(labels.tolist())) < 2:
        model.constant = share
        return model
    terms = np.concatenate([t for t, _ in samples])
    docs = np.repeat(np.arange(len(samples)), [len(t) for t, _ in samples])
    model.words = _context(terms // SHAPES, index_vectors(BUCKETS, 1), docs)
    model.shapes = _context(terms % SHAPES, index_vectors(SHAPES, 2), docs).astype("f8")
    raw = np.stack([model.raw(t) for t, _ in samples])
    model.mean, model.scale = raw.mean(axis=0), raw.std(axis=0) + 1e-3
    x = np.stack([model.pool(t) for t, _ in samples])
    rng = np.random.default_rng(3)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    model.w1, model.b1 = rng.normal(0, POOLED**-0.5, (POOLED, HIDDEN)), np.zeros(HIDDEN)
    model.w2, model.b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
    z, y = (x[used] - model.mean) / model.scale, labels[used]
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    state = {k: (0.0, 0.0) for k in ("w1", "b1", "w2", "b2")}
    for step in range(1, STEPS + 1):
        hidden = np.tanh(z @ model.w1 + model.b1)
        error = (1 / (1 + np.exp(-np.clip(hidden @ model.w2 + model.b2, -40, 40))) - y) * weight
        back = np.outer(error, model.w2) * (1 - hidden**2)
        grads = {"w1": z.T @ back + 1e-4 * model.w1, "b1": back.sum(axis=0), "w2": hidden.T @ error + 1e-4 * model.w2, "b2": error.sum()}
        for name, grad in grads.items():
            first, second = state[name]
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            state[name] = first, second
            setattr(model, name, getattr(model, name) - 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8))
    logits, truth = model.logits(x[held]), labels[held]
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 60))
    loss = [np.logaddexp(0, -np.where(truth == 1, 1, -1) * logits / t).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0
    model.shift = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms.of(t).tobytes() for t in texts(batch)], pa.binary())], ["quality", "terms"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    usable = labels.withColumn("quality", F.col("quality").cast("long")).where("quality in (0, 1) and doc_id is not null").where(crc_mod5("doc_id") != 0)
    one_each = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in one_each.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    # the bound of what is broadcast; a sorted limit keeps so many rows of each task, where a window would send a class to one
    zero, one = (one_each.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for q in (0, 1))
    chosen = zero.unionAll(one)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").select("quality", "text")
    rows = found.mapInArrow(_terms, "quality long, terms binary").collect()
    return fit([(np.frombuffer(r["terms"], "<i4"), r["quality"]) for r in rows], counts.get(1, 0) / total if total else 1.0)


def scorer(model: Model, spark: SparkSession):
    """A function of a text column that gives the score; the model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, terms = shared.value, Terms()
        for texts_ in batches:
            pooled = [np.zeros(0) if own.constant is not None else own.pool(terms.of(t)) for t in texts_.to_pylist()]
            yield pa.array(own.scores(np.stack(pooled)) if pooled else [], pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    small_batches(docs.sparkSession)
    score = scorer(model, docs.sparkSession)
    found = docs.select("doc_id", (crc_mod5("doc_id") == 0).alias("held_out"), score("text").alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    model = train(docs, labels)
    return docs.where(scorer(model, docs.sparkSession)(F.col("text")) >= THRESHOLD)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
