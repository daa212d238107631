"""Bounded samples of labelled documents for the classifiers, and a driver-side logistic fit."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of a training sample: documents of each label, characters of a document.
PER_LABEL, LONGEST = 1500, 20_000
#: Labels that a sample may have by default; more raise an error.
LABELS = 500
#: Candidates for a document of the sample: first, and once more while too few of them can be used.
CANDIDATES = (2, 8, 32)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = PER_LABEL,
    longest: int = LONGEST,
    most_labels: int = LABELS,
    heads: bool = False,
) -> tuple[list[str], list]:
    """(texts, labels): for each label at most `per_label` documents, whole, of at most `longest` characters.

    With `heads` longer documents are not left out, but stand with their first `longest` characters.
    More than `most_labels` labels raise ValueError.

    `labels` is (id, label), `learn` a condition on its id. An id with several labels teaches nothing,
    and rows that repeat an id count once; of its differing texts the smallest is taken. Which documents
    are taken depends on a hash of the id alone, so neither partitioning nor row order matters. Only ids
    of a small hash are looked at, as many per label as make CANDIDATES times `per_label`; if too few of
    them have a text that can be used, more are.
    """
    spark = docs.sparkSession
    at = F.xxhash64(F.lit("sample"), F.col("chosen_id").cast("string"))
    rows = labels.where(learn & F.col(id_col).isNotNull() & F.col("label").isNotNull()).select(F.col(id_col).alias("chosen_id"), "label")
    counts = rows.groupBy("label").agg(F.approx_count_distinct("chosen_id").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels + 1).collect()
    if not counts:
        return [], []
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels to learn; raise the bound to learn them all")
    fits = F.col(text_col).isNotNull() & (F.lit(True) if heads else F.length(text_col) <= longest)
    text = F.substring(text_col, 1, longest) if heads else F.col(text_col)
    usable = docs.where(fits).select(F.col(id_col).alias("sample_id"), text.alias("sample_text"))
    kind = T.StructType([T.StructField("of", rows.schema["label"].dataType), T.StructField("cut", T.LongType())])
    for times in CANDIDATES:
        cuts = [(r["label"], min(2**63 - 1, 2**64 * times * per_label // max(1, r["n"]) - 2**63)) for r in counts]
        near = rows.join(F.broadcast(spark.createDataFrame(cuts, kind)), F.col("label") == F.col("of")).where(at <= F.col("cut")).select("chosen_id").distinct()
        known = (
            rows.join(F.broadcast(near), "chosen_id", "left_semi")
            .groupBy("chosen_id")
            .agg(F.min("label").alias("label"), F.max("label").alias("other"))
            .where("label = other")
            .drop("other")
        )
        found = usable.join(F.broadcast(known), F.col("sample_id") == F.col("chosen_id")).select("chosen_id", "label").distinct()
        rank = F.row_number().over(Window.partitionBy("label").orderBy(at, "chosen_id"))
        ids = found.withColumn("rank", rank).where(F.col("rank") <= per_label).drop("rank").collect()
        have = Counter(r["label"] for r in ids)
        if all(have[label] == per_label or cut == 2**63 - 1 for label, cut in cuts):
            break
    if not ids:
        return [], []
    small = spark.createDataFrame(ids, known.schema)
    texts = usable.join(F.broadcast(small), F.col("sample_id") == F.col("chosen_id")).groupBy("chosen_id", "label").agg(F.min("sample_text").alias("sample_text"))
    out = sorted(texts.collect(), key=lambda r: str(r["chosen_id"]))
    return [r["sample_text"] for r in out], [r["label"] for r in out]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, of a ridge logistic regression of few columns by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ b)
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b
