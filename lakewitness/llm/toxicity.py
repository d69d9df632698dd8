"""Toxicity by FTRL-proximal logistic regression.

Features are hashed words, word pairs, and pairs with one word between them, present or not. FTRL-proximal keeps a
learning rate per coordinate and sets most weights to exactly zero, so the model is a short list of weights that
every task can hold: at most 2**BITS of them, whatever the corpus.

The model is fitted on at most ``max_train`` labelled documents (a documented bound), drawn by a hash of doc_id from
those whose crc32(doc_id as text) mod 4 is not 2; their features are made in parallel. Every document is scored on
its whole text. Defined results: a null or empty text has no features and gets the score of the intercept; of
several labels of a document the highest counts, null labels don't; without labels of both kinds the score is the
share of toxic labels (0 if there are none); repeated rows score alike; a null doc_id is not held out; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewitness.llm.common import table, text_digest, whole_text
from lakewitness.llm.hashing import ngrams, word_hashes
from lakewitness.session import cut, ship_package

BITS = 18
MAX_TRAIN = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 10.0, 1.0
PREDICT_AT = 0.3
SEED = "tox-1"
_WORD = np.zeros(256, np.int8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


def features(text: str) -> np.ndarray:
    """Hashed features of a text, with repeats."""
    words = word_hashes(text.lower().encode("utf-8", "surrogatepass"), _WORD)
    found = np.concatenate([ngrams(words, (0,), 1), ngrams(words, (0, 1), 2), ngrams(words, (0, 2), 3)])
    return (found >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept; rows are the distinct features of each document, in training order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    bias = 0.0

    def weight(z, n):
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) > L1, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for idx, y in zip(rows, labels):
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[idx] = zi + g - sigma * w
            n[idx] = ni + g * g
            # the intercept has no penalty
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * bias
            n0 += g * g
            bias = -z0 / ((BETA + np.sqrt(n0)) / ALPHA)
    return weight(z, n), float(bias)


def _fit_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sample = pd.concat([*batches, pd.DataFrame({"draw": [], "doc_id": [], "toxic": [], "found": []})])
    sample = sample.sort_values(["draw", "doc_id"])
    labels = sample["toxic"].to_numpy(float)
    if len(labels) == 0 or labels.min() == labels.max():
        p = np.clip(labels.mean() if len(labels) else 0.0, 1e-9, 1 - 1e-9)
        yield pd.DataFrame({"idx": [-1], "weight": [float(np.log(p / (1 - p)))]})
        return
    weights, bias = fit([np.asarray(x, np.int64) for x in sample["found"]], labels)
    kept = np.flatnonzero(weights)
    yield pd.DataFrame({"idx": np.append(kept, -1), "weight": np.append(weights[kept], bias)})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict[int, float]:
    """Weights by feature, the intercept under -1."""
    ship_package(docs.sparkSession)
    draw = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(SEED)))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic")).withColumn("draw", draw)
    sample = cut(known.orderBy("draw", "doc_id").limit(max_train))

    @F.pandas_udf("array<bigint>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(features(t)) for t in texts])

    # at most max_train rows of three short columns
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")
    # of several texts under one doc_id the one with the least digest
    named = rows.select("draw", "doc_id", "toxic", text_digest(F.col("text")).alias("digest"), distinct("text").alias("found"))
    found = named.groupBy("doc_id").agg(F.min_by(F.struct("draw", "toxic", "found"), "digest").alias("x")).select("doc_id", "x.*")
    model = found.repartition(1).mapInPandas(_fit_one, "idx bigint, weight double")
    return {r["idx"]: r["weight"] for r in model.collect()}


def scored(text: Column, model: dict[int, float]) -> Column:
    bias = model.get(-1, 0.0)
    idx = np.array([i for i in model if i >= 0], np.int64)
    weights = np.array([model[i] for i in idx], float)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << BITS)
        table[idx] = weights
        for texts in batches:
            out = np.empty(len(texts))
            for k, t in enumerate(texts):
                found = features(t)
                found = np.unique(found[table[found] != 0])
                out[k] = table[found].sum() + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return score(text)


def op9_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(whole_text(), model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0))
