"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

A text becomes a few statistics (lengths, shares of kinds of characters, repetition), which are all that is kept of it. Cosines
of random projections of the scaled statistics have inner products that approximate a Gaussian kernel. Ridge regression on
them needs the sums of their products only: every task gives one matrix for each fold, and Spark adds them up. The penalty
is the one of least squared error on the folds left out, which the sums give without another pass. Scores of the labelled
rows, each by the model that has not seen its fold, are counted in ``BINS`` bins, and pooling adjacent violators on the
bins makes them a rising curve of probabilities.

All labelled rows are learnt from, no sample; what reaches the driver is a few matrices and the bins. Texts are read once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, id_and_text, settled, task_sums

FEATURES = 192
BANDWIDTH = 1.0
PENALTIES = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
FOLDS = 4
BINS = 2000
SEED = 11
HELD_OUT = 5
KEEP_AT = 0.3
ROWS_PER_TASK = 50_000
_CLIP = 6.0
_LOW, _HIGH = -0.5, 1.5

_KINDS = {
    "symbols": b"#*$%&|<>=_~^+@{}[]\\/",
    "digits": b"0123456789",
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ends": b".!?",
    "stops": b",;:",
    "quotes": b"\"'()-",
    "line_ends": b"\n",
    "blanks": b" \t\r\n",
}
STATISTICS = (
    "words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_pairs", "doubled_words", "short_words",
    "lines", "repeated_lines", "entropy", "foreign", *_KINDS,
)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; zeros for one without words."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, counts = len(words), np.bincount(raw, minlength=256)
    own = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lengths = sum(len(w) * k for w, k in own.items())
    lines = [x for x in text.split("\n") if x.strip()]
    shares = counts[counts > 0] / len(raw)
    found = {
        "words": np.log1p(n),
        "word_length": lengths / n,
        "longest_word": np.log1p(max(map(len, own))),
        # Fewer words of a long text are new; measured against the square root, the statistic hardly depends on length.
        "distinct_words": np.log(len(own) / np.sqrt(n)),
        "top_word": max(own.values()) / n,
        "repeated_pairs": 1 - pairs / max(1, n - 1),
        "doubled_words": doubled / n,
        "short_words": sum(k for w, k in own.items() if len(w) <= 2) / n,
        "lines": np.log1p(n / len(lines)),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
        "entropy": float(-(shares * np.log2(shares)).sum()),
        "foreign": counts[128:].sum() / len(raw),
    }
    return [float(found[s]) if s in found else float(counts[list(_KINDS[s])].sum() / len(raw)) for s in STATISTICS]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, x) per row, x being the statistics; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "text_hash", "x"]
            )

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Features:
    """Random Fourier features of statistics that are scaled to mean 0 and deviation 1, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, n: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights = random.standard_normal((len(mean), n)) / (bandwidth * np.sqrt(len(mean)))
        self.phases = random.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.deviation, -_CLIP, _CLIP)
        cosines = np.cos(scaled @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([cosines, np.ones((len(x), 1))])


def solve(products: np.ndarray, targets: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights; the constant, the last feature, is not penalised."""
    eye = np.eye(len(targets)) * penalty
    eye[-1, -1] = 1e-9
    return np.linalg.solve(products + eye, targets)


def isotonic(centres: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability) of the rising curve of least squares: adjacent violators pooled, one point per pool."""
    pools: list[list[float]] = []
    for centre, positive, count in zip(centres, positives, counts, strict=True):
        pools.append([centre * count, float(positive), float(count)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    table = np.array(pools).reshape(-1, 3)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


class Model:
    """Statistics to a probability: features, weights and the calibration curve, or one share for all if there is no more to learn."""

    def __init__(self, features: Features | None, weights: np.ndarray | None, at: np.ndarray, share: np.ndarray):
        self.features, self.weights, self.at, self.share = features, weights, at, share

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), self.share[0])
        return np.interp(np.clip(self.features(x) @ self.weights, _LOW, _HIGH), self.at, self.share)


def fit(
    labelled: DataFrame, features: int = FEATURES, bandwidth: float = BANDWIDTH, penalties: Sequence[float] = PENALTIES, folds: int = FOLDS
) -> Model:
    """The model of written rows (x, y, fold). Without rows it says 0.5; where all labels are alike it says their share."""
    size = len(STATISTICS)

    def moments(batch):
        x, y = _matrix(batch), batch.column("y").to_numpy(zero_copy_only=False)
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)])

    total = task_sums(labelled, moments)
    if total is None or total[1] in (0, total[0]):
        return Model(None, None, np.zeros(1), np.array([0.5 if total is None else total[1] / total[0]]))
    n = total[0]
    mean = total[2 : 2 + size] / n
    made = Features(mean, np.sqrt(np.maximum(total[2 + size :] / n - mean * mean, 0)), features, bandwidth)
    width = features + 1
    upper = np.triu_indices(width)

    def equations(batch):
        z, y, fold = made(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy()
        out = []
        for k in range(folds):
            own = z[fold == k]
            out += [(own.T @ own)[upper], own.T @ y[fold == k], [(y[fold == k] ** 2).sum()]]
        return np.concatenate(out)

    sums = task_sums(labelled, equations).reshape(folds, -1)
    products = np.zeros((folds, width, width))
    for k in range(folds):
        products[k][upper] = sums[k, : len(upper[0])]
        products[k] += np.triu(products[k], 1).T
    targets, squares = sums[:, len(upper[0]) : -1], sums[:, -1]
    left_out = {
        p: [solve(products.sum(0) - products[k], targets.sum(0) - targets[k], p) for k in range(folds)] for p in penalties
    }

    def error(penalty):
        return sum(squares[k] - 2 * w @ targets[k] + w @ products[k] @ w for k, w in enumerate(left_out[penalty]))

    best = min(penalties, key=error)
    by_fold = np.stack(left_out[best])

    def bins(batch):
        z, y, fold = made(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy()
        score = np.clip((z * by_fold[fold]).sum(1), _LOW, _HIGH)
        at = np.minimum(((score - _LOW) / (_HIGH - _LOW) * BINS).astype(int), BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS), np.bincount(at, weights=score, minlength=BINS)])

    counts, positives, scores = task_sums(labelled, bins).reshape(3, BINS)
    some = counts > 0
    at, share = isotonic(scores[some] / counts[some], positives[some], counts[some])
    return Model(made, solve(products.sum(0), targets.sum(0), best), at, share)


def learnable(doc_id: Column, held_out: int = HELD_OUT) -> Column:
    """Whether a row may be learnt from: the others, one in ``held_out``, are kept to measure with."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % held_out != 0, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``, the probability of label 1, learnt from the rows of ``labels`` that may be.

    A null or empty text has the statistics 0 and a score by them. Labels of null, and rows without an id, are not learnt
    from; of several labels of an id the highest counts; every row of a labelled id is learnt from. Without labels all
    scores are 0.5. An empty table gives no row. Other columns are not looked at.
    """
    rows = settled(with_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.where(F.col(label_col).isNotNull() & learnable(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col(label_col).cast("double")).alias("y"))
    # Copies of a text are in one fold.
    joined = rows.join(known, "doc_id").select("x", "y", F.pmod("text_hash", F.lit(FOLDS)).cast("int").alias("fold"))
    labelled = settled(joined, "quality-labelled")
    # A task gives a matrix per fold, so there are as few tasks as the rows need.
    model = fit(labelled.repartition(1 + labelled.count() // ROWS_PER_TASK))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = np.clip(shared.value(_matrix(batch)), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def op11_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, whether it was held out, and whether it is kept."""
    found = scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted")
    )
