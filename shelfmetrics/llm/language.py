"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, ship, texts

BINS = 1 << 13  # hashed letter trigrams
WORD = re.compile(r"[^\W\d_]+")  # numerals such as ½ and Ⅷ too
# ASCII bytes that are no letters become blanks; other bytes belong to letters of some script.
BLANKS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
UNKNOWN = "und"
FULL = 200  # shorter texts show less of their language: their least cosine falls with the square root of their trigrams


def lettered(text: str) -> bool:
    """Whether a text has a letter of any script."""
    return any(any(map(str.isalpha, m[0])) for m in WORD.finditer(text))


class Model(NamedTuple):
    idf: np.ndarray  # BINS
    centroids: np.ndarray  # rows: unit vectors
    langs: list[str]  # of each row
    reach: np.ndarray  # of each row: the largest cosine distance that counts as this language, for texts of FULL trigrams or more


def counts(found: list[str]) -> np.ndarray:
    """Trigram counts, a row per whole text: lower case, words padded by one blank."""
    out = np.zeros((len(found), BINS), np.float32)
    for i, t in enumerate(found):
        words = t.lower().encode("utf-8", "replace").translate(BLANKS).split()
        a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        if len(a) > 2:
            h = ((a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]) * np.uint32(2654435761)
            out[i] = np.bincount(h >> np.uint32(32 - 13), minlength=BINS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def clusters(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of unit vectors by cosine; the start spreads out (each next one is the row farthest from those chosen)."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 800, per_language: int = 4, slack: float = 1.15, nearest: float = 0.7) -> Model:
    """Centroids from about `most` rows of each language at the most (a hash of id and text chooses, so that rows without
    an id are drawn as others; equal texts count once), texts taken whole.

    The bound is fixed, so a language's vectors fit one task and the driver gets `per_language` vectors of BINS numbers each. A centroid reaches
    as far as its own training rows lie from it, times `slack`, at least `nearest` (short texts farther, see FULL). Rows without text, language or letters teach nothing.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("draw"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    number = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not number:
        return Model(np.ones(BINS), np.zeros((0, BINS)), [], np.zeros(0))
    bar = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int((1 << 20) * min(1, most / n)))) for k, n in number.items()])
    chosen = rows.filter(F.pmod("draw", F.lit(1 << 20)) < bar).select("lang", "text").distinct()

    def vectors(table: pa.Table) -> tuple[str, np.ndarray]:
        found = sorted(t for t in table.column("text").to_pylist() if lettered(t))
        return table.column("lang")[0].as_py(), counts(found)

    def spread(table: pa.Table) -> pa.Table:
        lang, x = vectors(table)
        return pa.table({"n": pa.array([len(x)], pa.int64()), "df": pa.array([(x > 0).sum(axis=0).astype("<i8").tobytes()], pa.binary())})

    seen = chosen.groupBy("lang").applyInArrow(spread, "n bigint, df binary").collect()
    total, df = sum(r.n for r in seen), sum(np.frombuffer(r.df, "<i8") for r in seen)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def centre(table: pa.Table) -> pa.Table:
        lang, x = vectors(table)
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "c": pa.array([], pa.binary()), "reach": pa.array([], pa.float64())})
        full = np.sqrt(np.minimum(1, x.sum(axis=1) / FULL))
        x = unit(x * idf)
        c = clusters(x, per_language)
        cos = x @ c.T
        own, best = cos.argmax(axis=1), cos.max(axis=1)
        reach = [float((1 - best[own == i] / np.maximum(full[own == i], 1e-6)).max()) if (own == i).any() else 0.0 for i in range(len(c))]
        return pa.table({"lang": pa.array([lang] * len(c)), "c": pa.array([v.astype("<f4").tobytes() for v in c], pa.binary()), "reach": pa.array(reach)})

    got = sorted(chosen.groupBy("lang").applyInArrow(centre, "lang string, c binary, reach double").collect(), key=lambda r: (r.lang, r.c))
    vectors_ = np.stack([np.frombuffer(r.c, "<f4") for r in got]) if got else np.zeros((0, BINS))
    return Model(idf, vectors_, [r.lang for r in got], np.maximum(nearest, np.array([r.reach * slack for r in got])))


def _predictions(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The first column of each batch with lang_pred, score and rejected, from its column `text`."""
    langs = np.array([*model.langs, UNKNOWN], object)
    for whole in by_bytes(batches, 2 << 20):
        for at in range(0, whole.num_rows, 128):  # a dense row per text
            b = whole.slice(at, 128)
            found = b.column("text").to_pylist()
            best, score, far = np.full(len(found), -1), np.zeros(len(found)), np.ones(len(found), bool)
            if len(model.langs):
                x = counts(found)
                full = np.sqrt(np.minimum(1, x.sum(axis=1) / FULL))
                cos = unit(x * model.idf) @ model.centroids.T
                best, score = cos.argmax(axis=1), np.clip(cos.max(axis=1).astype(float), 0, 1)
                none = np.array([not lettered(t) for t in found], bool)
                far = (score < (1 - model.reach[best]) * full) | none
                best, score = np.where(none, -1, best), np.where(none, 0, score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs[best], pa.string()), pa.array(score), pa.array(far)],
                                             names=[b.schema.names[0], "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: the language of the nearest centroid, its cosine, and whether it lies beyond the centroid's reach.

    Only the text counts. Without letters, with a null or empty text, or with a model that learned nothing: `und`, 0 and rejected. Texts of any
    length are read whole; repeated rows are predicted each; an empty table gives no rows. There is no shuffle.
    """
    ids = texts(docs, id_col, text_col)
    return ids.mapInArrow(lambda batches: _predictions(batches, model), f"doc_id {dict(ids.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that `predict` does not reject. A model that learned nothing keeps all of them.

    Null and empty texts and those without letters are rejected, whole texts of any length are read, repeated rows are judged each; of two centroids
    equally near the first by language counts, which rejects alike. An empty table gives no rows, and names of other columns do not matter.
    """
    if not model.langs:
        return docs
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _predictions(batches, model), f"row {kind}, lang_pred string, score double, rejected boolean").filter(
        "NOT rejected").select("row.*")
