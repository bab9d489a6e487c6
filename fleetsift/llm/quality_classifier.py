"""Graded quality of texts: an ordinal cumulative-link regression over hashed text features.

One vector of weights over hashed tokens gives a text its score; ordered thresholds cut the scores
into grades: P(grade > k) = sigmoid(score - threshold k).  The model is fitted by gradient descent
on a bounded sample of rated texts, hashed in tasks; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import uniform, written
from fleetsift.shipping import ship_by_value

ship_by_value(__name__)

#: Hash buckets; rated texts a model is fitted on; texts of them that must hold a bucket for it to count; lengths of word beginnings.
BUCKETS, SAMPLE_ROWS, LEAST_TEXTS, BEGINNINGS = 1 << 18, 6_000, 3, (4, 5, 6)
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


def tokens(text: str) -> set[str]:
    """Distinct words in lower case and runs of symbols, and marks for how much of the text repeats the word before."""
    found = _TOKEN.findall(text.lower())
    out = set(found)
    if len(found) > 1:
        repeats = sum(map(operator.eq, found, found[1:])) / len(found)
        if repeats > 0.05:
            out.add(f"<again {min(9, int(repeats * 10))}>")
        out.add(f"<varied {min(9, int(10 * len(out) / len(found)))}>" if len(found) >= 50 else "<short>")
    return out


def bucket(token: str) -> int:
    return xxhash.xxh32_intdigest(token.encode()) % BUCKETS


def buckets(token: str) -> set[int]:
    """Buckets of a token and of its beginnings, by which rare composed words share weights."""
    return {bucket(token)} | ({bucket("^" + token[:n]) for n in BEGINNINGS if len(token) >= n} if token.isalpha() else set())


class _Table(dict):
    """Token -> value, computed once; emptied when large."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, token):
        if len(self) > 300_000:
            self.clear()
        self[token] = out = self.value(token)
        return out


class OrdinalModel:
    """Weights for buckets (a dict of those that count) and ascending thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - np.array(self.thresholds)[None, :], -500, 500)))


def _adam(row, column, size: int, grades_: np.ndarray, top: int, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the penalized likelihood (L1), by proximal Adam steps.  Thresholds stay in
    order: their distances are exponentials."""
    n = len(grades_)
    share = np.array([(grades_ > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    params = np.concatenate([np.zeros(size), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    first = second = np.zeros(len(params))
    for step in range(1, steps + 1):
        w, cuts = params[:size], params[size] + np.concatenate([[0], np.cumsum(np.exp(params[size + 1:]))])
        score = np.bincount(row, w[column], n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(edges[grades_ + 1] - score, -500, 500)))  # P(grade <= own)
        lower = 1 / (1 + np.exp(-np.clip(edges[grades_] - score, -500, 500)))
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_score = (d_upper - d_lower) / n
        by_cut = np.array([(d_lower[grades_ == k + 1].sum() - d_upper[grades_ == k].sum()) / n for k in range(top)])
        slope = np.concatenate([np.bincount(column, by_score[row], size), [by_cut.sum()],
                                np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(params[size + 1:])])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        pace = 0.05 / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        params = params - pace * first / (1 - 0.9 ** step)
        w = params[:size]
        params[:size] = np.sign(w) * np.maximum(np.abs(w) - pace[:size] * penalty, 0)
    return params[:size], params[size] + np.concatenate([[0], np.cumsum(np.exp(params[size + 1:]))])


def fit_ordinal(row: np.ndarray, bucket: np.ndarray, grades: np.ndarray, top: int, penalty: float = 0.12, steps: int = 400) -> OrdinalModel:
    """A model for texts 0 … with grades, text `row[i]` holding `bucket[i]`.

    Fits twice: with an L1 penalty of penalty / sqrt(n), about the slope that chance gives a bucket that says
    nothing, to find the buckets that count, then those alone almost without a penalty, as it shrinks them."""
    n = len(grades)
    names, column, held = np.unique(bucket, return_inverse=True, return_counts=True)
    counts = held >= LEAST_TEXTS
    for strength in (penalty, penalty / 20):
        use = counts[column]
        place = np.cumsum(counts) - 1
        w, cuts = _adam(row[use], place[column[use]], int(counts.sum()), grades, top, strength / np.sqrt(n), steps)
        names_now = names[counts]
        counts = counts.copy()
        counts[counts] = w != 0
    return OrdinalModel({int(b): float(x) for b, x in zip(names_now, w, strict=True) if x}, cuts.tolist())


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for bad quality, 1 for good but toxic, 2 for good and clean; the worst of repeated ratings."""
    return (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
            .agg(F.min(F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)).alias("grade")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets_of = _Table(buckets)
    for batch in batches:
        found = [sorted(set().union(*map(buckets_of.__getitem__, tokens(text.as_py() or "")))) for text in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "features"])


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """A model from at most `sample_rows` rated texts, drawn by a hash of their ids; None without ratings.

    `ratings` has doc_id and grade (0 and up).  Of a repeated rating the worst counts, of several
    texts with a drawn id the least one.  Only hashed features of the sample reach the driver, those
    that LEAST_TEXTS of its texts hold, as flat arrays of numbers.
    """
    drawn = (ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
             .orderBy(uniform("grade", "doc_id"), "doc_id").limit(sample_rows))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # The drawn ratings are at most sample_rows pairs of numbers.
    rated = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"), F.min("text").alias("text"))
    hashed = written(rated.mapInArrow(_hashed, "doc_id bigint, grade int, features array<int>"), "hashed")
    held = hashed.select("doc_id", F.explode("features").alias("bucket"))
    common = held.groupBy("bucket").agg(F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TEXTS).select("bucket")
    useful = held.join(common, "bucket").groupBy("doc_id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))  # as many as there are buckets, at most
    rows = hashed.select("doc_id", "grade").join(useful, "doc_id", "left").orderBy("doc_id").select("grade", F.coalesce("buckets", F.array().cast("array<int>")).alias("buckets")).toArrow()
    if not rows.num_rows:
        return None
    grade, lists = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
    row = np.repeat(np.arange(len(grade)), np.diff(lists.offsets.to_numpy()))  # of the type bincount takes without a copy
    return fit_ordinal(row, lists.flatten().to_numpy(), grade, max(1, int(grade.max())))


def score(docs: DataFrame, model: OrdinalModel | None, level: int, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
          keep_columns: bool = False) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept): one row per row of `docs`, or with
    `keep_columns` all columns of the rows that are kept.

    `tail_probability` is P(grade >= level), and `kept` whether it is `least` or more.  Null texts
    and texts without a word or symbol have grade 0 and are not kept.  Without a model grade and
    probability are null and every text is kept.  Whole texts are read; null ids, repeated rows
    and other columns do no harm.
    """
    columns = docs.columns if keep_columns else [id_col]
    if model is None:
        out = docs.select(*columns, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
        return docs if keep_columns else out.withColumnRenamed(id_col, "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        counted = _Table(lambda token: buckets(token) & own.weights.keys())
        for batch in batches:
            scores, empty = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                found = tokens(text.as_py() or "")
                empty[i] = not found
                scores[i] = sum(own.weights[b] for b in sorted(set().union(*map(counted.__getitem__, found))))
            tails = own.tails(scores)
            tails[empty] = 0
            expected, tail = tails.sum(axis=1), tails[:, level - 1]
            kept = tail >= least
            if keep_columns:
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], [f"c{k}" for k in range(len(columns))]).filter(pa.array(kept))
            else:
                yield pa.record_batch([batch.column(0), pa.array(expected), pa.array(tail), pa.array(kept)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.col(text_col).alias(f"c{len(columns)}"))
    if keep_columns:
        types = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(inner.schema.fields[:-1]))
        return inner.mapInArrow(run, types).toDF(*columns)
    return inner.select(F.col("c0").cast("bigint").alias("c0"), "c1").mapInArrow(run, "doc_id bigint, expected_grade double, tail_probability double, kept boolean")
