"""Toxicity by a classifier chain over labelled categories.

Categories are predicted one after another, here low quality, then toxic. Each model is a
logistic regression over which words ``[^\\x20\\x09-\\x0D]+`` (ASCII-lower-cased, without
punctuation at the ends) a text has and over the probabilities of all earlier categories. Later models are trained with out-of-fold
probabilities: each sampled row's come from a model that was fitted without its fold.

Training rows: at most ``SAMPLE`` labelled documents for each combination of labels, those
with the smallest digest of their id. Their texts, like those predicted, are read whole.

Defined results: null, empty and blank texts have probability 0 of each category; rows with
null labels or a null id are no training rows; of different labels, or texts, of one id the smallest
count; without training rows all probabilities are 0; a repeated row is predicted again; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.llm.common import written
from leadloom.llm.words import slices, words

SAMPLE = 1500
FOLDS = 5
STEPS = 200
#: A word counts only if so many sampled documents have it, and its share differs by so many standard errors between classes.
LEAST_DOCUMENTS = 8
LEAST_Z = 5.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: row r has the distinct word hashes ``hashes[bounds[r]:bounds[r + 1]]``."""
    codes, bounds, distinct = words(column, lower_ascii=True)
    bare = pc.utf8_trim(distinct, PUNCTUATION).to_pylist()
    hashed, number = np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in bare), np.uint64, len(bare)), return_inverse=True)
    rows, width = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), max(1, len(hashed))
    both = np.unique(rows * width + number[codes])
    return hashed[both % width] if len(hashed) else hashed, np.concatenate(([0], np.cumsum(np.bincount(both // width, minlength=len(bounds) - 1))))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0.0], np.cumsum(values)))
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights of the words that tell (by sorted hash), of earlier categories' probabilities, and a bias."""

    def __init__(self, earlier: int):
        self.keys, self.w, self.c, self.b = np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier), 0.0

    def _weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.w[at], 0.0)

    def predict(self, hashes: np.ndarray, bounds: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return _logistic(_sums(self._weights(hashes), bounds) + earlier @ self.c + self.b)

    def fit(self, hashes, bounds, earlier, y, rows) -> Model:
        """Full-batch descent with a step for each weight by its past gradients.

        Only words whose share of documents differs by ``LEAST_Z`` standard errors between the
        classes have weights: with noisy labels, others would be learned by heart.
        """
        y, n = y.astype(float), len(bounds) - 1
        use = np.zeros(n)
        use[rows] = 1
        owner = np.repeat(np.arange(n), np.diff(bounds))
        names, number = np.unique(hashes, return_inverse=True)
        have, good = np.bincount(number, use[owner], len(names)), np.bincount(number, (use * y)[owner], len(names))
        n1, n0 = max(1, (use * y).sum()), max(1, (use * (1 - y)).sum())
        share = have / (n1 + n0)
        z = (good / n1 - (have - good) / n0) / np.sqrt(np.maximum(1e-9, share * (1 - share)) * (1 / n1 + 1 / n0))
        tells = (np.abs(z) >= LEAST_Z) & (have >= LEAST_DOCUMENTS)
        self.keys, self.w = names[tells], np.zeros(int(tells.sum()))
        place = np.cumsum(tells) - 1
        kept = tells[number]
        column, row = place[number[kept]], owner[kept]
        sums = [np.full(len(self.w), 1e-8), np.full(len(self.c), 1e-8), 1e-8]
        for _ in range(STEPS):
            p = _logistic(np.bincount(row, self.w[column], n) + earlier @ self.c + self.b)
            error = use * (p - y) / (n1 + n0)
            for k, g in enumerate((np.bincount(column, error[row], len(self.w)) + 1e-4 * self.w, earlier.T @ error, error.sum())):
                sums[k] = sums[k] + g * g
                step = 0.5 * g / np.sqrt(sums[k])
                if k == 0:
                    self.w -= step
                elif k == 1:
                    self.c -= step
                else:
                    self.b -= step
        return self


def chain(hashes: np.ndarray, bounds: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Model]:
    """One model a column of ``labels``, in order."""
    out, earlier, everything = [], np.zeros((len(labels), 0)), np.arange(len(labels))
    for k in range(labels.shape[1]):
        out.append(Model(k).fit(hashes, bounds, earlier, labels[:, k], everything))
        held = np.zeros(len(labels))
        for f in np.unique(fold):
            at = fold == f
            held[at] = Model(k).fit(hashes, bounds, earlier, labels[:, k], np.flatnonzero(~at)).predict(hashes, bounds, earlier)[at]
        earlier = np.concatenate((earlier, held[:, None]), 1)
    return out


def sample(docs: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """``id``, ``text`` and the categories of the sampled rows; ids are drawn before texts are read.

    Digests are uniform, so those that may be among the ``SAMPLE`` smallest of a combination
    are told by its count before anything is sorted: twice as many rows as wanted reach the window.
    """
    known = labels.filter(" AND ".join(f"{c} IS NOT NULL" for c in categories) + " AND doc_id IS NOT NULL")
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct(*categories)).alias("c")).select("id", "c.*").withColumn("digest", F.md5(F.col("id").cast("string")))
    counts = written(known.groupBy(*categories).agg(F.count(F.lit(1)).alias("n")), "label-counts")
    share = F.conv(F.substring("digest", 1, 12), 16, 10).cast("double") / float(1 << 48)
    few = known.join(counts, categories).filter(share * F.col("n") <= 2 * SAMPLE + 100)
    at = F.row_number().over(W.partitionBy(*categories).orderBy("digest", "id"))
    drawn = written(few.withColumn("at", at).filter(F.col("at") <= SAMPLE).select("id", *categories), "labels-drawn")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(drawn, "id")
    return texts.groupBy("id", *categories).agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, categories: list[str]) -> list[Model] | None:
    schema = "id long, hashes array<long>, " + ", ".join(f"{c} int" for c in categories)

    def read(batches):
        for batch in slices(batches, "text"):
            h, bounds = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(bounds.astype(np.int32), h.view(np.int64)), *(batch.column(c).cast(pa.int32()) for c in categories)], ["id", "hashes", *categories])

    rows = sorted(sample(docs, labels, categories).mapInArrow(read, schema).toLocalIterator(), key=lambda r: r.id)
    if not rows:
        return None
    hashes = np.concatenate([np.array(r.hashes, np.int64) for r in rows]).view(np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(r.hashes) for r in rows])))
    fold = np.array([xxhash.xxh3_64_intdigest(str(r.id)) % FOLDS for r in rows])
    return chain(hashes, bounds, np.array([[r[c] for c in categories] for r in rows]), fold)


def predict(docs: DataFrame, models: list[Model] | None, categories: list[str]) -> DataFrame:
    """``doc_id`` and ``p_<category>``. The models, some hundred words each, go to the workers with the function."""

    def run(batches):
        for batch in slices(batches, "text"):
            h, bounds = features(batch.column("text"))
            earlier = np.zeros((batch.num_rows, 0))
            for m in models or []:
                earlier = np.concatenate((earlier, m.predict(h, bounds, earlier)[:, None]), 1)
            p = [earlier[:, k] * (np.diff(bounds) > 0) if models else np.zeros(batch.num_rows) for k in range(len(categories))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, p)], ["doc_id", *(f"p_{c}" for c in categories)])

    return docs.selectExpr("cast(doc_id as long) id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in categories))


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    given = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    names = ["low_quality", "toxic"]
    return predict(docs, fit(docs, given, names), names).withColumn("toxic", F.col("p_toxic") >= 0.5)
