"""Language ID (operator 6): string-kernel classification with Nystrom landmarks and kernel ridge regression.

The kernel of two texts is the number of character n-grams of 1 to 4 characters (the blended spectrum)
that both contain, over the root of the product of their own numbers. n-grams of the lower-cased text are
hashed to 2**16 features; all features of the whole text count. A bounded sample of labelled rows is
fitted (about MAX_TRAIN, or LEAST of each language if that is more; every language keeps a row at least): LANDMARKS
of them span the Nystrom approximation, and one-versus-rest kernel ridge regression learns the coefficients. As a
text's kernel with every landmark is linear in its presence vector, landmarks and coefficients fold into one matrix (with
more languages than landmarks they stay two) and texts are scored by a product of presence vectors and it, batch by batch.

lang_pred is `und` (score 0) if the text is null or has no letters, or nothing could be learned. Ties go
to the language first by code point. score is a softmax over the languages' margins. Repeated rows are
predicted alike and learned from once; rows with a null doc_id are predicted but never learned from. Very long texts
count whole, bytes that are no valid UTF-8 are read as U+FFFD, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean, held, read, small, tidy

FEATURES, LONGEST = 1 << 16, 4
#: Rows fitted (shared among the languages), rows of each language at least, landmarks, ridge, softmax temperature, texts in a product.
MAX_TRAIN, LEAST, LANDMARKS, RIDGE, HEAT, BATCH = 2000, 8, 256, 1e-3, 0.2, 128
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def presence(text: str | None, out: np.ndarray) -> None:
    """Set out[f] for each feature f of the text."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.zeros(len(points), np.uint32)
    for n in range(min(LONGEST, len(points))):
        code = (code[: len(points) - n] ^ (points[n:] + np.uint32(n))) * _MULT[n]
        out[(code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)] = True


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """langs and the matrices whose product maps features to languages: one, or two of features x landmarks x languages."""

    def __init__(self, langs: list[str], weights: tuple[np.ndarray, ...]):
        self.langs, self.weights = langs, weights

    def margins(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = x @ w
        return x

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for i in range(0, len(texts), BATCH):
            part = texts[i : i + BATCH]
            x = np.zeros((len(part), FEATURES), bool)
            for row, text in zip(x, part, strict=True):
                presence(text, row)
            x = x.astype(np.float32)
            size = np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
            margin = (self.margins(x) if self.langs else np.zeros((len(part), 1))) / size
            soft = np.exp((margin - margin.max(axis=1, keepdims=True)) / HEAT)
            soft /= soft.sum(axis=1, keepdims=True)
            best = margin.argmax(axis=1)
            known = [bool(self.langs) and has_letters(t) for t in part]
            names += [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            scores += [float(s[b]) if k else 0.0 for s, b, k in zip(soft, best, known, strict=True)]
        return names, scores


def ridge(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, penalty: float = RIDGE) -> Model:
    """Fit presence vectors x (rows x features, bool) with their languages."""
    names = sorted(set(langs))
    size = np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None].astype(np.float32)
    marks = np.linspace(0, len(x) - 1, min(landmarks, len(x))).astype(int)
    base = x[marks].astype(np.float32) / size[marks]
    near = np.concatenate([x[i : i + 256].astype(np.float32) / size[i : i + 256] @ base.T for i in range(0, len(x), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(near[marks])
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nystrom map: near @ root
    phi = near @ root
    sign = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + penalty * len(x) * np.eye(phi.shape[1]), phi.T @ sign)
    last = root @ beta
    if len(names) > len(base):
        return Model(names, (np.ascontiguousarray(base.T), last.astype(np.float32)))
    return Model(names, ((base.T.astype(np.float64) @ last).astype(np.float32),))


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """labelled (text, lang, key): about max_train rows or LEAST of each language, as many of each, chosen by a hash of key and text."""
    rows = labelled.filter("text is not null and lang is not null").withColumn("h", F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40)))
    langs = rows.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first"))
    many = langs.count()
    if not many:
        return Model([], ())
    each = max(LEAST, max_train // many)
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.col("n"))
    chosen = rows.join(small(langs), F.col("lang") == F.col("name")).filter((F.col("h") <= F.col("first")) | (F.col("h") < share * (1 << 40))).select("key", "lang", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(2):
                row = np.zeros(FEATURES, bool)
                presence(text.as_py(), row)
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["key", "lang", "bits"])

    # 8 KB a row of the bounded sample.
    got = sorted(chosen.mapInArrow(tidy(run), "key string, lang string, bits binary").collect(), key=lambda r: (r.key, r.lang, bytes(r.bits)))
    x = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool) for r in got])
    return ridge(x, [r.lang for r in got])


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """rows (text first, others kept) -> the others, lang_pred, score."""
    # At most 64 MB and 1 KB a language.
    known = held(rows.sparkSession, (model.langs, model.weights))
    rest = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*known.value)
        for batch in batches:
            names, scores = own.predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang; others are ignored)."""
    key = F.col("doc_id").cast("string")
    rows = docs.select(clean(F.col("text")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(key) % 3 == 1, F.lit(False)).alias("held_out"), F.col("lang").cast("string").alias("lang"), key.alias("key"))
    model = fit(rows.filter(~F.col("held_out") & F.col("key").isNotNull()).select("text", "lang", "key"))
    return predict(rows.select("text", "doc_id", "held_out"), model)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
