"""Quality of documents by a regularised quadratic discriminant over statistics of their texts.

Each text becomes a short vector of transformed statistics, the same for every language. For
each class the sums of the vectors and of their products over all labelled documents are added
up in Spark; mean, shrunk covariance and its Cholesky factor follow on the driver and are a few
hundred numbers at any size of the corpus. A score is the logistic of the difference of the
classes' log densities, each from a Mahalanobis distance by the cached factor.
"""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.settle import settle

#: Groups of bytes whose shares are statistics.
LOWER, UPPER, DIGIT, STOP, MARK, NEWLINE, HIGH = range(7)
_KIND = np.full(256, 7, np.uint8)
_KIND[97:123] = LOWER
_KIND[65:91] = UPPER
_KIND[48:58] = DIGIT
_KIND[list(b".,;:?'\"-()")] = STOP
_KIND[list(b"!&$%*#|<>{}[]=_~^/\\@+")] = MARK
_KIND[10] = NEWLINE
_KIND[128:] = HIGH
N_STATS = 15
#: Shrinkage of a class covariance towards the pooled one, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.3, 0.1
#: A document is kept from this score on.
THRESHOLD = 0.7


def _logit(share, size):
    """Log odds of a share of ``size`` things, kept finite by half a thing."""
    hits = share * size
    return np.log((hits + 0.5) / (size - hits + 0.5))


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text; null counts as empty."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), len(data)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8)
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if n else 0
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    marked = sum(_KIND[w[-1]] == MARK for w in words)
    letters = kinds[LOWER] + kinds[UPPER] + kinds[HIGH]
    return np.array(
        [
            np.log1p(size),
            np.log((size + 1) / (n + 1)),
            np.log1p(lengths.std()) if n else 0.0,
            _logit(kinds[UPPER] / max(letters, 1), letters),
            _logit(kinds[DIGIT] / max(size, 1), size),
            _logit(kinds[STOP] / max(size, 1), size),
            _logit(kinds[MARK] / max(size, 1), size),
            _logit(kinds[NEWLINE] / max(size, 1), size),
            _logit(kinds[HIGH] / max(size, 1), size),
            _logit(len(counts) / max(n, 1), n),
            _logit(top / max(n, 1), n),
            _logit(same / max(n - 1, 1), max(n - 1, 0)),
            _logit(again / max(len(lines), 1), len(lines)),
            _logit(marked / max(n, 1), n),
            np.log1p(max(map(len, words), default=0)),
        ]
    )


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """Add the statistics as an array; a column of that name is replaced."""
    docs = docs.drop(name)
    schema = docs.select("*", F.array(F.lit(0.0)).alias(name)).schema

    def add(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(part.schema.get_field_index(text))
                values = [statistics(t.as_py()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(values, pa.list_(pa.float64()))],
                    [*part.schema.names, name],
                )

    return docs.mapInArrow(add, schema)


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows (label 0 or 1, stats) to count, sum and sum of products of each label.

    A task adds up its rows; the sums of the tasks meet by position, so the driver gets a fixed
    number of rows. Other labels and nulls are ignored.
    """
    size = N_STATS + 1

    def add(batches):
        sums = np.zeros((2, size, size))
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, N_STATS)
            x = np.hstack([np.ones((len(x), 1)), x])
            for label in (0, 1):
                own = x[labels == label]
                sums[label] += own.T @ own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], ["at", "value"]
        )

    rows = labelled.where("label in (0, 1)").select("label", "stats").mapInArrow(add, "at int, value double")
    sums = np.zeros(2 * size * size)
    for row in rows.groupBy("at").agg(F.sum("value").alias("value")).collect():
        sums[row["at"]] = row["value"]
    sums = sums.reshape(2, size, size)
    return {k: (sums[k, 0, 0], sums[k, 0, 1:], sums[k, 1:, 1:]) for k in (0, 1)}


class Discriminant:
    """Class means and inverse Cholesky factors of shrunk covariances."""

    def __init__(self, sums, to_pooled=TO_POOLED, to_diagonal=TO_DIAGONAL):
        self.known = all(sums[k][0] > 0 for k in (0, 1))
        if not self.known:
            return
        total = sums[0][0] + sums[1][0]
        means, scatters = {}, {}
        for k in (0, 1):
            n, total_k, products = sums[k]
            means[k] = total_k / n
            scatters[k] = products - n * np.outer(means[k], means[k])
        pooled = (scatters[0] + scatters[1]) / total + 1e-3 * np.eye(N_STATS)
        pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled))
        self.classes = []
        for k in (0, 1):
            n = sums[k][0]
            own = (1 - to_pooled) * scatters[k] / n + to_pooled * pooled
            factor = np.linalg.cholesky(own)
            log_density = np.log(n / total) - np.log(np.diag(factor)).sum()
            self.classes.append((means[k], np.linalg.inv(factor).T, log_density))

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1; 0.5 if a label was missing from the training rows."""
        if not self.known:
            return np.full(len(stats), 0.5)
        of = [
            const - 0.5 * (((stats - mean) @ factor) ** 2).sum(axis=1)
            for mean, factor, const in self.classes
        ]
        return 1 / (1 + np.exp(np.clip(of[0] - of[1], -500, 500)))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from rows (doc_id, stats) with labels (doc_id, quality) outside the held-out part.

    All labelled rows count, none is sampled; a document with several labels counts once for
    each. Null labels and ids are ignored.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    known = known.where(crc_mod(F.col("doc_id"), 4) != 2)
    return Discriminant(moments(rows.select("doc_id", "stats").join(known, "doc_id")))


def scored(rows: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """Add the score of each row's ``stats`` and drop those."""
    kept = [c for c in rows.columns if c != name]
    rows = rows.select(*(F.col(f"`{c}`") for c in kept))
    schema = rows.drop("stats").select("*", F.lit(0.0).alias(name)).schema

    def add(batches):
        for batch in batches:
            at = batch.schema.get_field_index("stats")
            stats = np.array(batch.column(at).to_pylist(), dtype=float).reshape(-1, N_STATS)
            rest = [c for n, c in enumerate(batch.columns) if n != at]
            names = [c for c in batch.schema.names if c != "stats"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(stats))], [*names, name])

    return rows.mapInArrow(add, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (doc_id, text) to rows (doc_id, held_out, score, predicted).

    Texts are read once; their statistics are a written table, from which labelled rows are
    learnt and all rows are scored. Null and empty texts are scored from the statistics of an
    empty text. Repeated rows are scored alike; a null doc_id is held out of training and
    counts as not held out (held_out false).
    """
    rows = settle(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "stats")
    found = scored(rows, fit(rows, labels))
    return found.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text scores at least ``threshold``, with all their columns.

    Texts are read once: rows are written with their statistics, from which the model is learnt and
    by which they are kept; only statistics go to Python again. Null and empty texts are scored as an
    empty text. Repeated rows are kept or go alike; rows without doc_id are scored like any other.
    An empty table stays empty, and without labels of both kinds every score is a half.
    """
    inside = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    rows = settle(with_statistics(inside).select("row", "stats"), "rows-stats")
    model = fit(rows.select("row.doc_id", "stats"), labels)

    @F.pandas_udf("double")
    def scores(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(stats.tolist(), dtype=float).reshape(-1, N_STATS)))

    kept = rows.where(scores("stats") >= threshold)
    return kept.select(*(F.col("row").getField(n).alias(n) for n in docs.columns))
