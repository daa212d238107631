"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a Gaussian over transformed statistics of the whole text; its covariance is shrunk
toward the pooled one and toward a multiple of the identity. Scores are differences of log densities,
from Mahalanobis distances by Cholesky factors that are computed once and kept in the model.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import chars
from foliant.llm.common import append_arrow, fold
from foliant.llm.training import PER_LABEL, labelled_sample, logistic, sigmoid

STATISTICS = (
    "log_words", "word_chars", "word_chars_sd", "upper", "digit", "symbol", "stops", "commas", "quotes", "repeats",
    "distinct", "top_word", "log_line_words", "line_repeats", "bare_words",
)
#: Shrinkage toward the pooled covariance, and toward the identity times the mean variance.
TO_POOLED, TO_IDENTITY = 0.1, 0.05


def _statistics(text: str | None) -> list[float]:
    """Transformed statistics of the whole text; the empty text has a defined row too."""
    text = text or ""
    n = np.bincount(chars.classes()[chars.code_points(text)], minlength=9)
    words = text.split()
    k = len(words)
    seen = n.sum() - n[chars.SPACE] - n[chars.LINE]
    share = lambda part, whole: np.sqrt(part / whole) if whole else 0.0
    sizes = np.fromiter(map(len, words), np.int64, k)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    return [
        np.log1p(k),
        np.log1p(sizes.mean()) if k else 0.0,
        np.log1p(sizes.std()) if k else 0.0,
        share(n[chars.UPPER], n[chars.UPPER] + n[chars.LETTER]),
        share(n[chars.DIGIT], seen),
        share(n[chars.SYMBOL], seen),
        share(min(n[chars.STOP], 4 * k), k),
        share(min(n[chars.COMMA], 4 * k), k),
        share(n[chars.QUOTE], seen),
        share(sum(map(eq, words, words[1:])), k),
        np.log(len(counts) / k) / np.log1p(k) if k else 0.0,
        share(max(counts.values()), k) if k else 0.0,
        np.log1p(k / len(lines)) if lines else 0.0,
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(1 for w in counts if not w[0].isalnum()), len(counts)),
    ]


@dataclass
class Quadratic:
    """Means, Cholesky factors of inverse covariances and log terms of the two classes, and a calibration."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    calibration: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0."""
        x = (x - self.center) / self.scale
        d = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * g for m, w, g in zip(self.means, self.whiten, self.log_det, strict=True)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(_squash(self.difference(x)) * self.calibration[0] + self.calibration[1])


def _squash(d: np.ndarray) -> np.ndarray:
    """Log-density differences far from zero say little more than those at some distance."""
    return np.sign(d) * np.log1p(np.abs(d))


def fit_quadratic(x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Quadratic | None:
    """None if a class has fewer than two rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - center) / scale
    d = z.shape[1]
    own = [z[y == k] for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in own]
    pooled = sum(len(p) * c for p, c in zip(own, covs, strict=True)) / len(z)
    whiten, log_det = [], []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    model = Quadratic(center, scale, np.array([p.mean(axis=0) for p in own]), np.array(whiten), np.array(log_det), np.array([1.0, 0.0]))
    w = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    model.calibration = logistic(_squash(model.difference(x))[:, None], y, w, ridge=1.0)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", per_label: int = PER_LABEL,
) -> Quadratic | None:
    """Learns from at most `per_label` documents of each label whose fold is not `held_out`; labels but 0
    and 1 are no labels."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    texts, y = labelled_sample(docs, known, fold(id_col, parts) != held_out, id_col, text_col, per_label)
    if not texts:
        return None
    return fit_quadratic(np.array([_statistics(t) for t in texts]), np.array(y))


def with_quality(docs: DataFrame, model: Quadratic | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds quality_score (0 to 1, higher: label 1 likelier) of every whole text.

    A null text is scored as the empty one. Without a model, when nothing was labelled, every score is
    0.5. Rows are scored one by one; an input column of the new name is replaced.
    """

    def score(texts: list[str | None]) -> list:
        if model is None or not texts:
            return [[0.5] * len(texts)]
        return [pa.array(model.score(np.array([_statistics(t) for t in texts])))]

    return append_arrow(docs, [text_col], score, [T.StructField("quality_score", T.DoubleType())], keep)
