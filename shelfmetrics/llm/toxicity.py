"""A chain of linear classifiers over the words of a text."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, texts

BINS = 1 << 18  # hashed features: words, and first four letters of words
SEEN = 5  # a feature counts from so many training documents on
OFTEN = 0.5  # and up to this share of them
CACHE = 400_000
WORD = re.compile(r"\w+")


@functools.cache
def _known() -> dict[str, tuple[int, int]]:
    return {}


def features(text: str) -> np.ndarray:
    """Distinct bins of the words of a whole text and of their first four letters."""
    known, bins = _known(), set()
    for w in set(WORD.findall(text.lower())):
        pair = known.get(w)
        if pair is None:
            if len(known) >= CACHE:
                known.clear()
            pair = known[w] = (zlib.crc32(w.encode("utf-8", "replace")) % BINS, zlib.crc32(b"^" + w[:4].encode("utf-8", "replace")) % BINS)
        bins.update(pair)
    return np.fromiter(bins, np.int32, len(bins))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Documents as bins, with the columns that the chain adds."""

    def __init__(self, bins: list[np.ndarray], width: int = BINS):
        self.width, self.sizes = width, np.array([len(b) for b in bins])
        self.bins = np.concatenate([*bins, np.zeros(0, np.int32)])
        self.row = np.repeat(np.arange(len(bins)), self.sizes)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.bins], len(self.sizes))


def fit_linear(rows: Rows, extra: np.ndarray, y: np.ndarray, use: np.ndarray, rounds: int = 100, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by accelerated gradient steps over all rows of `use`; weights: bins, then the extra columns, then the constant.

    A bin is scaled by the log-ratio of its shares in the two classes, so that telling words move first. The step is the inverse of the
    curvature's bound, measured by a few power iterations.
    """
    n, m, d = max(1, use.sum()), extra.shape[1], rows.width
    in_class = [np.bincount(rows.bins, (use & (y == c))[rows.row], d) for c in (0, 1)]
    size = [(use & (y == c)).sum() for c in (0, 1)]
    ratio = np.log((in_class[1] + 1) / (size[1] + 2) * (size[0] + 2) / (in_class[0] + 1))
    share = min(max(y[use].mean() if use.any() else 0, 1e-3), 1 - 1e-3)

    def scores(w):
        return rows.sums(w[:d] * ratio) + extra @ w[d:-1] + w[-1]

    def slope(gap):
        gap = np.where(use, gap, 0) / n
        return np.concatenate([np.bincount(rows.bins, gap[rows.row], d) * ratio, gap @ extra, [gap.sum()]])

    v = np.concatenate([np.abs(ratio), np.ones(m + 1)])
    for _ in range(8):
        v /= max(np.linalg.norm(v), 1e-12)
        v = slope(scores(v))
    step = 1 / (0.25 * 1.1 * max(np.linalg.norm(v), 1e-9) + l2)
    w = np.zeros(d + m + 1)
    w[-1] = np.log(share / (1 - share))
    ahead = w.copy()
    for t in range(rounds):
        g = slope(sigmoid(scores(ahead)) - y)
        g[:-1] += l2 * ahead[:-1]
        last, w = w, ahead - step * g
        ahead = w + t / (t + 3) * (w - last)
    w[:d] *= ratio
    return w


def fit_chain(bins: list[np.ndarray], labels: np.ndarray, folds: int) -> list[np.ndarray]:
    """A model for each column of labels. Later models see the earlier categories' probabilities, which for training come from models that did
    not see the row (its fold was left out)."""
    n = len(bins)
    seen = np.bincount(np.concatenate([*bins, np.zeros(0, np.int32)]), minlength=BINS)
    kept = np.flatnonzero((seen >= SEEN) & (seen <= n * OFTEN))
    number = np.full(BINS, -1)
    number[kept] = np.arange(len(kept))
    rows = Rows([x[x >= 0] for x in (number[b] for b in bins)], len(kept))
    fold, extra, out = np.arange(n) % folds, np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        w = fit_linear(rows, extra, y, np.ones(n, bool))
        whole = np.zeros(BINS + k + 1)
        whole[kept], whole[BINS:] = w[:len(kept)], w[len(kept):]
        out.append(whole)
        if k + 1 < labels.shape[1]:
            held = np.zeros(n)
            for f in range(folds):
                w = fit_linear(rows, extra, y, fold != f)
                held[fold == f] = sigmoid(rows.sums(w[:rows.width]) + extra @ w[rows.width:-1] + w[-1])[fold == f]
            extra = np.column_stack([extra, held])
    return out


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """About `most` rows at the most, chosen by a hash of doc_id."""
    n = labels.count()
    return labels if n <= most else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))


def classify(docs: DataFrame, labels: DataFrame, chain: list[str], most: int = 6000, folds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one probability column p_<category> per category of the chain, one row per document.

    `labels` has doc_id and a 0/1 column per category; rows with a null are left out, several rows of a document count once (the largest value).
    The models are fitted on at most about `most` labelled rows, a fixed bound, so their features fit one task; every document is scored whole,
    without a shuffle. Null and empty texts have no words and get the constant's probability; without labelled rows the probabilities are null.
    Repeated rows are scored each; an empty table gives no rows.
    """
    ids = texts(docs, id_col, text_col)
    named = labels.select(F.col("doc_id"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(chain)]).dropna()
    chosen = _sample(named.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(chain))]), most)
    known = ids.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("at"), "text", F.array(*[f"y{i}" for i in range(len(chain))]).alias("y")).dropDuplicates(["at"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 4 << 20):
            found = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(found, pa.binary()), b.column("y")], names=["at", "bins", "y"])

    def train(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy(), kind="stable")
        bins = [np.frombuffer(x, np.int32) for x in table.column("bins").to_pylist()]
        y = np.array(table.column("y").to_pylist())
        models = fit_chain([bins[i] for i in order], y[order], folds)
        return pa.table({"k": pa.array(range(len(models)), pa.int32()), "w": pa.array([m.astype("<f4").tobytes() for m in models], pa.binary())})

    fitted = known.mapInArrow(extract, "at bigint, bins binary, y array<double>").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "k int, w binary")
    models = [np.frombuffer(r.w, "<f4").astype(float) for r in sorted(fitted.collect(), key=lambda r: r.k)]  # one fixed-size row per category
    columns = [f"p_{c}" for c in chain]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 4 << 20):
            rows = Rows([features(t) for t in b.column("text").to_pylist()])
            extra = np.zeros((b.num_rows, 0))
            for w in models:
                extra = np.column_stack([extra, sigmoid(rows.sums(w[:BINS]) + extra @ w[BINS:-1] + w[-1])])
            got = [pa.array(extra[:, i]) for i in range(len(models))] or [pa.nulls(b.num_rows, pa.float64()) for _ in chain]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *got], names=["doc_id", *columns])
        _known().clear()

    return ids.mapInArrow(score, ", ".join([f"doc_id {dict(ids.dtypes)['doc_id']}", *[f"`{c}` double" for c in columns]]))
