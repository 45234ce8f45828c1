"""Toxicity classifier with counterfactual regularisation.

A logistic regression over words and beginnings of words (6 to 8 bytes), with the logarithm of one plus the count as
feature. Features are chosen by how far their document frequency differs between toxic and other labelled texts. For every labelled sentence with an identity
term, copies are made with the term swapped for another one of its group, and the squared change of the linear score is a
penalty, so a mention of a group alone moves no score.

The model is fitted on the driver, on a bounded sample: at most ``most_rows`` labelled texts (those of the smallest hash of
their id), at most ``most_words`` words. Word statistics are counted by Spark over that sample. Scoring reads every whole
text, in one narrow pass, with the words' weights alone.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from answerlens.llm.common import documents, set_aside, settled

THRESHOLD = 0.7
MOST_ROWS = 20_000
MOST_WORDS = 5_000
LEAST_Z = 5.0
LEAST_DOCS = 5
BEGINNINGS = (6, 7, 8)

# Identity terms by group; a term is swapped for the others of its group.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes"),
)

_SEPARATORS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and characters from U+0080 on, of the lower-cased text."""
    return text.lower().encode("utf-8", "replace").translate(_SEPARATORS).split()


def beginnings(word: bytes) -> list[bytes]:
    """The features of a word besides itself: its beginnings, marked by a star, which no word contains."""
    return [word[:k] + b"*" for k in BEGINNINGS if len(word) > k]


class Vocabulary:
    """Known features, by their kind, for counting them in a text."""

    def __init__(self, features):
        self.words = frozenset(f for f in features if not f.endswith(b"*"))
        self.beginnings = {k: frozenset(f[:-1] for f in features if f.endswith(b"*") and len(f) == k + 1) for k in BEGINNINGS}

    def counts(self, text: str) -> dict[bytes, int]:
        cut = words(text)
        found = Counter(filter(self.words.__contains__, cut))
        for k, known in self.beginnings.items():
            if known:
                for begin, n in Counter(filter(known.__contains__, [w[:k] for w in cut if len(w) > k])).items():
                    found[begin + b"*"] = n
        return found


class Model(NamedTuple):
    bias: float
    weights: dict[bytes, float]

    def scores(self, texts) -> list[float]:
        weights, vocabulary, out = self.weights, Vocabulary(self.weights), []
        for text in texts:
            total = self.bias + sum(weights[f] * math.log1p(n) for f, n in sorted(vocabulary.counts(text).items()))
            out.append(1 / (1 + math.exp(-min(max(total, -500.0), 500.0))))
        return out


def swaps(counts: dict[bytes, int], groups=IDENTITY_GROUPS) -> list[dict[bytes, int]]:
    """The counts of the counterfactual copies of a text: each identity term swapped for each other one of its group."""
    out = []
    for group in groups:
        terms = [t.encode() for t in group]
        for term in terms:
            if n := counts.get(term):
                for other in terms:
                    if other != term:
                        changed = Counter(counts)
                        for feature in (term, *beginnings(term)):
                            changed[feature] = max(0, changed[feature] - n)
                        changed.update(dict.fromkeys((other, *beginnings(other)), n))
                        out.append(changed)
    return out


class _Sparse:
    """Rows of (columns, values), enough for products with vectors."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows]) if rows else np.zeros(0, int)
        self.column = np.concatenate([c for c, _ in rows]) if rows else np.zeros(0, int)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.shape = len(rows), width

    def dot(self, w):
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed_dot(self, r):
        return np.bincount(self.column, self.value * r[self.row], self.shape[1])

    def norms(self):
        return np.bincount(self.row, self.value**2, self.shape[0])


def fit(counts: list[dict[bytes, int]], toxic: list[int], vocabulary: list[bytes], swap_penalty: float = 10.0, l2: float = 1e-5, steps: int = 800, groups=IDENTITY_GROUPS) -> Model:
    """Logistic regression by accelerated gradient descent; ``swap_penalty`` weighs the squared score changes of swaps.

    Without both classes there is nothing to learn, and every text gets the smoothed share of toxic ones.
    """
    y = np.array(toxic, float)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if not vocabulary or len(set(toxic)) < 2:
        return Model(float(np.log(prior / (1 - prior))), {})
    number = {w: i for i, w in enumerate(vocabulary)}

    def row(c):
        known = [(number[w], np.log1p(n)) for w, n in c.items() if w in number]
        return np.array([i for i, _ in known], int), np.array([v for _, v in known], float)

    def change(a, b):
        moved = {w: np.log1p(b.get(w, 0)) - np.log1p(a.get(w, 0)) for w in a.keys() | b.keys() if w in number and a.get(w) != b.get(w)}
        return np.array([number[w] for w in moved], int), np.array(list(moved.values()), float)

    x = _Sparse([row(c) for c in counts], len(vocabulary))
    d = _Sparse([change(c, s) for c in counts for s in swaps(c, groups)], len(vocabulary))
    n, m = len(y), max(1, d.shape[0])
    # A bound on the curvature, so that the step is safe.
    rate = 1 / (0.25 * (x.norms().mean() * min(n, 50) + 1) + l2 + 2 * swap_penalty * d.norms().max(initial=0))
    weights, bias = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior)))
    ahead, ahead_bias, t = weights.copy(), bias, 1.0

    def loss(w, b):
        z = x.dot(w) + b
        return np.mean(np.logaddexp(0, z) - y * z) + l2 * w @ w + swap_penalty * np.sum(d.dot(w) ** 2) / m

    best = loss(weights, bias)
    for _ in range(steps):
        residual = 1 / (1 + np.exp(-np.clip(x.dot(ahead) + ahead_bias, -500, 500))) - y
        slope = x.transposed_dot(residual) / n + 2 * l2 * ahead + 2 * swap_penalty * d.transposed_dot(d.dot(ahead)) / m
        new, new_bias = ahead - rate * slope, ahead_bias - rate * residual.mean()
        now = loss(new, new_bias)
        if now > best:  # gone too far: shorter steps, from the best point
            rate, t = rate / 2, 1.0
            ahead, ahead_bias = weights.copy(), bias
            continue
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - weights), new_bias + (t - 1) / t_new * (new_bias - bias)
        weights, bias, best, t, rate = new, new_bias, now, t_new, rate * 1.5
    return Model(bias, {w: float(v) for w, v in zip(vocabulary, weights, strict=True) if v})


def training_sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic) of labelled texts that may be learnt from: crc32(id as text) mod 3 is not 1. Equal texts count once.

    A label without a document, or with a null, is not used; contradicting labels of an id or text count as toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, swap_penalty: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The classifier for ``docs`` with ``labels`` (doc_id, toxic).

    Words of over 64 bytes are no features, and of the others the ``most_words`` that tell most, besides the identity terms.
    Without labels all scores are alike.
    """
    sample = settled(training_sample(docs, labels, most_rows, id_col, text_col), "toxicity-sample")

    def count(batches):
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                cut = {w for w in words(text.as_py()) if len(w) <= 64}
                for feature in cut | {b for w in cut for b in beginnings(w)}:
                    seen.setdefault(feature, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())],
                ["word", "clean", "toxic"],
            )

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    statistics = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "word binary, clean long, toxic long")
    statistics = statistics.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_DOCS)
    share = (F.col("clean") + F.col("toxic")) / F.lit(max(1, n0 + n1))
    z = (F.col("toxic") / max(1, n1) - F.col("clean") / max(1, n0)) / F.sqrt(share * (1 - share) * F.lit(1 / max(1, n0) + 1 / max(1, n1)) + 1e-12)
    identity = {t.encode() for group in IDENTITY_GROUPS for t in group}
    chosen = statistics.withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(most_words).select("word").collect()
    vocabulary = sorted({bytes(r["word"]) for r in chosen} | identity)

    def rows(batches):
        known = Vocabulary(vocabulary)
        for batch in batches:
            found = [known.counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32())],
                ["words", "counts", "toxic"],
            )

    # At most ``most_rows`` rows, of at most ``most_words`` words and the identity terms.
    data = sample.mapInArrow(rows, "words array<binary>, counts array<int>, toxic int").toPandas()
    counts = [dict(zip(map(bytes, w), c.tolist(), strict=True)) for w, c in zip(data["words"], data["counts"].map(np.asarray), strict=True)]
    return fit(counts, data["toxic"].tolist(), vocabulary, swap_penalty)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of ``docs``, all columns, with the score of the whole text; a null text counts as empty.

    A column named like ``score_col`` is replaced. An empty table gives no row.
    """
    docs = docs.drop(score_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = sent.value.scores(t.as_py() or "" for t in batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score_col, DoubleType()))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold; repeated rows all stay or go, an empty table gives no row."""
    plain, back = set_aside(docs, "text")
    scored = with_scores(plain, train(docs, labels), score_col="_toxicity")
    return back(scored.where(F.col("_toxicity") < threshold))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; labels are learnt from two thirds of the ids alone."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = with_scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
