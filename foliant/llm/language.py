"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed letter n-grams
predicts which half the language is in; decoding adds up each bit's loss, weighted by how well the
bit was learnt, and takes the codeword of least loss. A text whose two best codewords lie close is
flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import chars
from foliant.llm.common import append_arrow, fold
from foliant.llm.training import LABELS, LONGEST, labelled_sample, sigmoid

UNDETERMINED = "und"
#: Hash buckets of the n-grams, characters that are hashed at once, texts that are decoded together,
#: documents learnt from in all.
BUCKETS, AT_ONCE, TOGETHER, SAMPLE = 8192, 1_000_000, 128, 4000
#: Share of the second-best codeword's probability from which a text is ambiguous.
CLOSE = 0.5


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """Codewords (-1, 1) of k classes: all different splits up to 6 classes, else a random code far apart."""
    if k <= 6:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if c == 0 or (b + 1) >> (c - 1) & 1 == 0 else -1 for b in range(bits)] for c in range(k)]).reshape(k, bits)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = max(15, int(np.ceil(10 * np.log2(k))))
    for _ in range(200):
        code = rng.choice([-1, 1], (k, bits))
        gap = ((bits - code @ code.T) // 2 + bits * np.eye(k, dtype=int)).min()
        if gap > far and (np.abs(code.sum(axis=0)) < k).all():
            best, far = code, gap
    return best


def _counts(text: str | None) -> np.ndarray | None:
    """Hellinger-scaled counts of hashed n-grams of 1 to 3 letters; None for a text without a letter."""
    low = (text or "").lower()
    total = np.zeros(BUCKETS)
    last = np.zeros(1, np.uint32)  # the symbols before, at most two; a boundary at first
    for i in range(0, len(low), AT_ONCE):
        c = chars.code_points(low[i : i + AT_ONCE])
        c = np.r_[last, np.where(chars.letters()[c], c, 0).astype(np.uint32)]
        k = len(last)
        c = c[(c != 0) | np.r_[True, c[:-1] != 0] | (np.arange(len(c)) < k)]  # one boundary between words
        c = np.r_[c, np.uint32(0)] if i + AT_ONCE >= len(low) else c
        a = c * np.uint32(2654435761)
        two = (a[:-1] >> np.uint32(7)) + c[1:] * np.uint32(40503) ^ a[1:]
        three = two[:-1] * np.uint32(31) + (a[2:] >> np.uint32(3))
        # n-grams whose last symbol is new
        for h, on, new in ((a, c != 0, k), (two, (c[:-1] != 0) | (c[1:] != 0), k - 1), (three, c[1:-1] != 0, max(0, k - 2))):
            total += np.bincount((h[new:][on[new:]] * np.uint32(2246822519)) >> np.uint32(19), minlength=BUCKETS)
        last = c[-2:]
    n = total.sum()
    return np.sqrt(total / n) if n else None


@dataclass
class Ecoc:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray, close: float = CLOSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, its probability, whether the second is close)."""
        margin = x @ self.weights + self.bias
        loss = (np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code, -30, 30))) * self.trust).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(p, axis=1)
        odd = ordered[:, -2] > close * ordered[:, -1] if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, ordered[:, -1], odd


def fit_ecoc(x: np.ndarray, y: list[str], steps: int = 150, rate: float = 8.0, ridge: float = 1e-5) -> Ecoc:
    """Logistic classifiers of all bits at once by accelerated gradient steps, classes weighing alike."""
    languages = sorted(set(y))
    k = np.array([languages.index(v) for v in y])
    code = codewords(len(languages))
    target = code[k]
    size = np.bincount(k)
    weight = (1 / (size[k] * len(languages)))[:, None]
    x = x.astype(np.float32, copy=False)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1])
    vw, vb = w.copy(), b.copy()
    for t in range(steps):
        m = t / (t + 3)
        aw, ab = w + m * vw, b + m * vb
        g = -target * sigmoid(-target * (x @ aw + ab)) * weight
        nw = aw - rate * (x.T @ g.astype(np.float32) + ridge * aw)
        nb = ab - rate * g.sum(axis=0)
        vw, vb, w, b = nw - w, nb - b, nw, nb
    right = ((target * (x @ w + b) > 0) * weight).sum(axis=0)
    trust = np.clip(np.log(np.clip(right, 0.5, 0.999) / (1 - np.clip(right, 0.5, 0.999))), 0.05, None)
    return Ecoc(languages, code, w.astype(np.float64), b, trust / trust.mean())


def fit(
    docs: DataFrame, parts: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE, most_languages: int = LABELS,
) -> Ecoc | None:
    """Learns from at most `sample` documents whose fold is not `held_out`, in equal numbers per language.

    Of a text of more than LONGEST characters the first LONGEST are learnt from. An id with several
    languages teaches nothing. More than `most_languages` languages raise ValueError.
    """
    known = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(lang_col).alias("label")).where(F.col("label").isNotNull())
    n = max(1, known.select("label").distinct().limit(sample).count())
    texts, y = labelled_sample(docs, known, fold(id_col, parts) != held_out, id_col, text_col, max(20, sample // n), LONGEST, most_languages, heads=True)
    x, kept = np.empty((len(texts), BUCKETS), np.float32), []
    for text, v in zip(texts, y, strict=True):
        if (c := _counts(text)) is not None:
            x[len(kept)] = c
            kept.append(v)
    return fit_ecoc(x[: len(kept)], kept) if kept else None


def with_language(
    docs: DataFrame, model: Ecoc | None, text_col: str = "text", keep: list[str] | None = None, close: float = CLOSE
) -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1) and lang_ambiguous for every whole text.

    Ambiguous is a text whose second-best language has more than `close` of the best one's probability.

    A null text, and one without a letter, is `und` with score 0, and ambiguous; so is every text when
    there is no model. Rows are scored one by one; input columns of the new names are replaced.
    """
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("lang_score", T.DoubleType()),
        T.StructField("lang_ambiguous", T.BooleanType()),
    ]

    def predict(texts: list[str | None]) -> list:
        pred, score, odd = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for s in range(0, len(texts) if model else 0, TOGETHER):
            found = [(i, c) for i, c in ((i, _counts(texts[i])) for i in range(s, min(s + TOGETHER, len(texts)))) if c is not None]
            if found:
                best, p, flags = model.decode(np.array([c for _, c in found]), close)
                for (i, _), k, q, o in zip(found, best.tolist(), p.tolist(), flags.tolist(), strict=True):
                    pred[i], score[i], odd[i] = model.languages[k], q, o
        return [pred, score, odd]

    return append_arrow(docs, [text_col], predict, fields, keep)
