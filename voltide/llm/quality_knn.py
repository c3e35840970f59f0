"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes counts of hashed byte trigrams, of trigrams of character classes, and a term for how well it
compresses; log counts, inverse document frequencies and a truncated singular value decomposition, fitted on a bounded
sample of labelled rows outside the held-out fold, give its vector. The sample's vectors and labels are broadcast (a
fixed number of rows and dimensions); every document's cosines with all of them are computed in blocks, and the labels
of its K nearest vote with similarity to the power SHARP.

Defined cases: a null or empty text has a zero vector and scores the sample's mean label; labels with null ids or
classes are not used; without labels every score is 0; repeated rows are scored each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, text_of
from .toxicity import labelled_sample

#: At most so many labelled rows of each class are learned from.
ROWS = 1000
TRIGRAMS, CLASSES, RATIOS = 1536, 8, 12
WIDTH = TRIGRAMS + CLASSES**3 + RATIOS
DIMS, K, SHARP = 48, 15, 4
BLOCK = 512


def _classes() -> np.ndarray:
    """Classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence marks, 6 other ASCII, 7 beyond ASCII."""
    of = np.full(256, 6, dtype=np.int64)
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = 0, 1, 2
    of[[32, 9]], of[[10, 13]], of[[ord(c) for c in ".,;:'\"?-"]], of[128:] = 3, 4, 5, 7
    return of


def features(texts: list[str]) -> np.ndarray:
    """A row of log counts a text; whole texts, each by itself."""
    out, of = np.zeros((len(texts), WIDTH), dtype=np.float32), _classes()
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            continue
        b = np.frombuffer(b"\n" + raw + b"\n", dtype=np.uint8)
        if len(b) >= 3:
            low = b.astype(np.uint32)
            low += 32 * ((b >= 65) & (b <= 90)).astype(np.uint32)
            code = (low[:-2] * 65536 + low[1:-1] * 256 + low[2:]) * np.uint32(2654435761)
            out[i, :TRIGRAMS] = np.bincount((code >> np.uint32(12)) % TRIGRAMS, minlength=TRIGRAMS)
            c = of[b]
            out[i, TRIGRAMS : TRIGRAMS + CLASSES**3] = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        # blocks of 32 KiB, the reach of deflate, so that the ratio doesn't follow the length
        packed = sum(len(zlib.compress(raw[k : k + 32768], 1)) for k in range(0, len(raw), 32768))
        level = min(RATIOS - 1, int(RATIOS * packed / (len(raw) + 40)))
        out[i, TRIGRAMS + CLASSES**3 + level] = 3.0 * np.sqrt(len(raw))
    return np.log1p(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(sample: DataFrame) -> dict | None:
    """The projection, the sample's vectors and their labels, from (doc_id, label, text) rows."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": [r.astype(np.float16).tobytes() for r in features(list(batch["text"]))]})

    rows = sample.select(F.col("doc_id").cast("long"), F.col("label").cast("int").alias("label"), "text").mapInPandas(counted, "doc_id long, label int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.doc_id)
    x = np.stack([np.frombuffer(r.x, dtype=np.float16) for r in rows]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(x * idf)
    dims = min(DIMS, *x.shape)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    top = vectors[:, ::-1][:, :dims].astype(np.float32)
    y = np.array([r.label for r in rows], dtype=np.float32)
    return {"project": idf[:, None] * top, "idf": idf, "near": _unit(x @ top), "labels": y}


def vote(texts: list[str], model: dict) -> np.ndarray:
    """Scores of a block of texts: exact cosines with all labelled vectors, then the nearest labels' weighted mean."""
    x = _unit(features(texts)) @ model["project"]
    some = np.linalg.norm(x, axis=1) > 1e-6
    cos = _unit(x) @ model["near"].T
    k = min(K, cos.shape[1])
    at = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    weight = np.clip(np.take_along_axis(cos, at, axis=1), 1e-3, None) ** SHARP
    score = (weight * model["labels"][at]).sum(axis=1) / weight.sum(axis=1)
    return np.where(some, score, model["labels"].mean())


def score(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of(text_col).alias("text"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = spread.value
        for batch in batches:
            texts = list(batch["text"])
            parts = [vote(texts[i : i + BLOCK], model) if model else np.zeros(len(texts[i : i + BLOCK])) for i in range(0, len(texts), BLOCK)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.clip(np.round(np.concatenate(parts or [np.zeros(0)]).astype(float), 6), 0, 1)})

    return kept.mapInPandas(scored, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", {1: ROWS, 0: ROWS}))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
