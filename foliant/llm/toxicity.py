"""Toxicity: support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

Texts are folded to base letters and word boundaries; other characters are left out, so `i-d-i-o-t`
reads as the word. The kernel of two strings sums, over all subsequences of four symbols that lie
within SPAN symbols, the products of decay^gaps of their occurrences, so gapped and inserted letters
still match. Landmarks are the word beginnings and words that tell toxic from clean documents best;
K(landmarks)^-1/2 gives the Nyström features of a window of text, on which a linear machine is
trained. As the kernel is an inner product, the machine over the landmarks collapses to one weight for
each subsequence of four symbols, and every window of a text is scored exactly by table look-ups. A
document's score is that of its worst window.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import chars
from foliant.llm.common import append_arrow, fold
from foliant.llm.training import PER_LABEL, labelled_sample, logistic, sigmoid

#: Symbols (boundary, 26 letters, one that matches nothing), decay per gap, widest subsequence, starts of a window.
SYMBOLS, DECAY, SPAN, STARTS = 28, 0.5, 7, 10
NOTHING = SYMBOLS - 1
#: Offsets of the second to fourth symbol of a subsequence, by width.
PATTERNS = tuple((a, b, d) for d in range(3, SPAN) for a, b in combinations(range(1, d), 2))
#: Landmarks from toxic documents, landmarks from clean ones, rounds of choosing windows, symbols scored at once.
TOXIC_LANDMARKS, CLEAN_LANDMARKS, ROUNDS, AT_ONCE = 96, 32, 4, 1 << 18
#: Log-likelihood ratio from which a string may be a toxic landmark; times it must be as frequent in toxic documents
#: for that, and for every window that begins with it to count as toxic; weight of the toxic class in the calibration.
LEAST_WORTH, LEAN, SURE, TOXIC_WEIGHT = 10.0, 2, 20, 0.2
#: Windows of a toxic document, copies of each with a letter put in, windows that a round takes from a clean document.
PLACES, INSERTED, HARD = 4, 4, 3


def fold_text(text: str | None) -> np.ndarray:
    """Symbols of the text between two boundaries; runs of white space are one boundary.

    Letters that stand alone one after the other are a word that was spaced out, and are joined.
    """
    s = chars.folded()[chars.code_points(text or "")]
    s = np.r_[np.uint8(0), s[s != NOTHING], np.uint8(0)]
    s = s[(s != 0) | np.r_[True, s[:-1] != 0]]
    edge = np.r_[np.uint8(1), np.uint8(1), s == 0, np.uint8(1), np.uint8(1)].astype(bool)
    return s[~((s == 0) & edge[:-4] & edge[4:]) | np.r_[True, np.zeros(len(s) - 1, bool)] | np.r_[np.zeros(len(s) - 1, bool), True]]


def _subsequences(s: np.ndarray, at: np.ndarray, pattern: tuple[int, int, int]) -> np.ndarray:
    """Number of the four symbols of the pattern at each start, in base SYMBOLS."""
    a, b, d = pattern
    s = s.astype(np.int32)
    return ((s[at] * SYMBOLS + s[at + a]) * SYMBOLS + s[at + b]) * SYMBOLS + s[at + d]


def _padded(s: np.ndarray) -> np.ndarray:
    return np.r_[s, np.full(SPAN - 1, NOTHING, np.uint8)]


def features(s: np.ndarray) -> dict[int, float]:
    """Weight of each subsequence of a string of symbols: the kernel's feature map."""
    out: dict[int, float] = {}
    n, s = len(s), _padded(s)
    for p in PATTERNS:
        for u in _subsequences(s, np.arange(max(0, n - p[2])), p).tolist():
            out[u] = out.get(u, 0.0) + DECAY ** (p[2] - 3)
    return out


@dataclass
class StringMachine:
    """Weight of every subsequence, and the calibration of a document's worst window."""

    table: np.ndarray
    calibration: np.ndarray

    def windows(self, s: np.ndarray) -> np.ndarray:
        """Decision value of the window of STARTS starts at each symbol."""
        out = np.zeros(len(s))
        for i in range(0, len(s), AT_ONCE):
            n = min(AT_ONCE, len(s) - i)
            out[i : i + n] = self._windows(s[i : i + n + STARTS + SPAN - 2])[:n]
        return out

    def _windows(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        x = np.r_[s, np.full(STARTS + SPAN - 2, NOTHING, np.uint8)].astype(np.int32)
        m = n + STARTS - 1
        pair = {d: x[: len(x) - d] * SYMBOLS + x[d:] for d in range(1, SPAN)}
        total = np.zeros(m)
        for d in range(3, SPAN):
            here = np.zeros(m, np.float32)
            for a, b, _ in (p for p in PATTERNS if p[2] == d):
                here += self.table.take(pair[a][:m] * (SYMBOLS * SYMBOLS) + pair[d - b][b : b + m])
            total += here * DECAY ** (d - 3)
        run = np.r_[0.0, np.cumsum(total)]
        return run[STARTS:] - run[:-STARTS]

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """Largest decision value of each text's windows."""
        apart = np.full(STARTS + SPAN, NOTHING, np.uint8)
        out = np.empty(len(texts))
        group: list[np.ndarray] = []
        first, size = 0, 0
        for k, text in enumerate(texts):
            group += [fold_text(text), apart]
            size += len(group[-2])
            if size > 4 * AT_ONCE or k == len(texts) - 1:
                ends = np.cumsum([len(g) for g in group])
                spans = np.r_[0, ends[:-1]]  # of a text, then of what keeps it apart, whose windows reach into the next
                out[first : k + 1] = np.maximum.reduceat(self.windows(np.concatenate(group)), spans)[::2]
                group, first, size = [], k + 1, 0
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.worst(texts) * self.calibration[0] + self.calibration[1])


def _candidates(s: np.ndarray) -> set[bytes]:
    """Words, and word beginnings of four to six letters, behind their boundary."""
    out = set()
    for w in s.tobytes().split(b"\0"):
        for k in (4, 5, 6):
            if len(w) > k:
                out.add(b"\0" + w[:k])
        if 3 <= len(w) <= 12:
            out.add(b"\0" + w + b"\0")
    return out


def choose_landmarks(streams: list[np.ndarray], y: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(toxic, clean, sure) strings: those whose document counts lean most to the toxic class, the most
    frequent others, and the toxic ones that clean documents hardly have. Ties go to the smaller string."""
    counts = (Counter(), Counter())
    for s, k in zip(streams, y.tolist(), strict=True):
        counts[k].update(_candidates(s))
    n = np.maximum(1, np.bincount(y, minlength=2))
    total = n.sum()
    leans = lambda c, times: counts[1][c] / n[1] > times * counts[0][c] / n[0]

    def worth(c: bytes) -> float:
        """Log-likelihood ratio of the string's document counts, if it leans to the toxic class."""
        v, u = counts[1][c], counts[0][c]
        even = (v + u) * n[1] / total
        return 2 * (v * np.log(v / even) + (u * np.log(u / (v + u - even)) if u else 0.0)) if leans(c, LEAN) else 0.0

    worths = {c: w for c, v in counts[1].items() if v >= 2 and (w := worth(c)) > LEAST_WORTH}
    toxic = sorted(worths, key=lambda c: (-worths[c], c))[:TOXIC_LANDMARKS]
    clean = sorted((c for c, v in counts[0].items() if v >= 2 and c not in worths), key=lambda c: (-counts[0][c], c))[:CLEAN_LANDMARKS]
    return toxic, clean, [c for c in toxic if leans(c, SURE)]


class Landmarks:
    """The landmarks' normalised feature maps as a sparse-to-dense table, and the Nyström map."""

    def __init__(self, strings: list[bytes]):
        maps = [features(np.frombuffer(z, np.uint8)) for z in strings]
        seen = sorted({u for m in maps for u in m})
        self.row = np.zeros(SYMBOLS**4, np.int32)
        self.row[seen] = np.arange(1, len(seen) + 1)
        self.seen = np.array(seen)
        self.phi = np.zeros((len(seen) + 1, len(maps)))
        for j, m in enumerate(maps):
            norm = np.sqrt(sum(v * v for v in m.values()))
            for u, v in m.items():
                self.phi[self.row[u], j] = v / norm
        value, vector = np.linalg.eigh(self.phi.T @ self.phi)
        keep = value > 1e-6
        self.nystrom = vector[:, keep] / np.sqrt(value[keep])

    def of_windows(self, windows: np.ndarray) -> np.ndarray:
        """Nyström features of windows of STARTS + SPAN - 1 symbols, one a row."""
        kernel = np.zeros((len(windows), self.phi.shape[1]))
        w = windows.astype(np.int32)
        for a, b, d in PATTERNS:
            weight = DECAY ** (d - 3)
            for i in range(STARTS):
                u = ((w[:, i] * SYMBOLS + w[:, i + a]) * SYMBOLS + w[:, i + b]) * SYMBOLS + w[:, i + d]
                row = self.row[u]
                hit = np.flatnonzero(row)
                kernel[hit] += weight * self.phi[row[hit]]
        return kernel @ self.nystrom

    def table(self, machine: np.ndarray) -> np.ndarray:
        """One weight per subsequence for a linear machine on the Nyström features."""
        out = np.zeros(SYMBOLS**4, np.float32)
        out[self.seen] = (self.phi @ (self.nystrom @ machine))[1:]
        return out


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 10, seed: int = 5) -> np.ndarray:
    """Weights, the intercept last, of an L1-loss linear machine by dual coordinate descent."""
    x = np.c_[x, np.ones(len(x))]
    sign = np.where(y == 1, 1.0, -1.0)
    norm = np.maximum((x * x).sum(axis=1), 1e-12)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)).tolist():
            new = min(max(alpha[i] - (sign[i] * (w @ x[i]) - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def train(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, c: float = 1.0) -> StringMachine | None:
    """Multiple-instance training. None without documents of both labels or without a landmark.

    Of a toxic document the windows that begin with a sure landmark count as toxic, as they are and with a
    random letter put into their first word; without one its worst window does. Clean documents give
    some windows at random, and in each round their worst ones.
    """
    streams = [fold_text(t) for t in texts]
    if not len(y) or min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    toxic, clean, sure = choose_landmarks(streams, y)
    if not toxic:
        return None
    marks = Landmarks(toxic + clean)
    rng = np.random.default_rng(11)
    width = STARTS + SPAN - 1
    windows = lambda rows: marks.of_windows(np.array([_window(s, i) for s, i in rows], np.uint8).reshape(-1, width))
    known, weight, lone = [], [], []
    for k in np.flatnonzero(y == 1).tolist():
        text = streams[k].tobytes()
        places = sorted({text.find(z) for z in sure} - {-1})[:PLACES]
        if not places:
            lone.append(k)
        for i in places:
            whole = any(z.endswith(b"\0") and text.startswith(z, i) for z in sure)  # a stem is left as it stands
            known += [(streams[k], i), *((_with_insert(streams[k], i, rng), 0) for _ in range(INSERTED * whole))]
            weight += [1 / len(places)] + [1 / len(places) / INSERTED] * (INSERTED * whole)
    known_x = windows(known)
    weight = np.array(weight + [1.0] * len(lone))
    # The first choice of windows: by likeness to landmarks, each weighed by how toxic its documents are.
    first = np.array([_lean(z, streams, y) for z in toxic + clean])
    model = StringMachine(np.zeros(SYMBOLS**4, np.float32), np.array([1.0, 0.0]))
    model.table[marks.seen] = (marks.phi @ first)[1:]
    zero = np.flatnonzero(y == 0).tolist()
    hard = {(k, int(i)) for k in zero for i in rng.integers(0, len(streams[k]), 2)}
    for _ in range(rounds):
        toxic_x = np.r_[known_x, windows([(streams[k], int(model.windows(streams[k]).argmax())) for k in lone])]
        for k in zero:
            values = model.windows(streams[k])
            for _ in range(HARD):
                i = int(values.argmax())
                hard.add((k, i))
                values[max(0, i - SPAN) : i + SPAN + 1] = -np.inf
        clean_x = windows([(streams[k], i) for k, i in sorted(hard)])
        x, label = np.r_[toxic_x, clean_x], np.r_[np.ones(len(toxic_x), int), np.zeros(len(clean_x), int)]
        cost = c * len(x) / 2 * np.r_[weight / weight.sum(), np.full(len(clean_x), 1 / len(clean_x))]
        machine = linear_svm(x, label, cost)
        model = StringMachine(marks.table(machine[:-1]), np.array([1.0, machine[-1]]))
    worst = np.array([model.windows(streams[k]).max() for k in zero])
    value, label = np.r_[toxic_x @ machine[:-1], worst], np.r_[np.ones(len(toxic_x)), np.zeros(len(worst))]
    share = np.r_[TOXIC_WEIGHT * weight / weight.sum(), np.full(len(worst), (1 - TOXIC_WEIGHT) / len(worst))]
    model.calibration = logistic(value[:, None], label, share * len(value), ridge=1.0)
    return model


def _window(s: np.ndarray, i: int) -> np.ndarray:
    """The symbols that the window at `i` reads."""
    part = s[i : i + STARTS + SPAN - 1]
    return np.r_[part, np.full(STARTS + SPAN - 1 - len(part), NOTHING, np.uint8)]


def _with_insert(s: np.ndarray, i: int, rng: np.random.Generator) -> np.ndarray:
    """The symbols from the boundary at `i` on, with a random letter inside the word behind it."""
    rest = s[i : i + 2 * (STARTS + SPAN)]
    end = next((k for k in range(1, len(rest)) if rest[k] == 0), len(rest))
    at = int(rng.integers(2, max(3, end)))
    return np.r_[rest[:at], np.uint8(rng.integers(1, 27)), rest[at:]]


def _lean(z: bytes, streams: list[np.ndarray], y: np.ndarray) -> float:
    has = np.array([z in s.tobytes() for s in streams])
    n = np.bincount(y, minlength=2)
    return float(np.log(((has & (y == 1)).sum() + 0.5) / (n[1] + 1)) - np.log(((has & (y == 0)).sum() + 0.5) / (n[0] + 1)))


def fit(
    docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", per_label: int = PER_LABEL,
) -> StringMachine | None:
    """Learns from at most `per_label` documents of each label whose fold is not `held_out`; labels but 0
    and 1 are no labels."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    texts, y = labelled_sample(docs, known, fold(id_col, parts) != held_out, id_col, text_col, per_label)
    return train(texts, np.array(y, int))


def with_toxicity(docs: DataFrame, model: StringMachine | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds toxicity (0 to 1, higher: label 1 likelier) of every whole text.

    A null text is scored as the empty one. Without a model, when nothing was labelled, every score is
    0. Rows are scored one by one; an input column of the new name is replaced.
    """

    def score(texts: list[str | None]) -> list:
        if model is None or not texts:
            return [[0.0] * len(texts)]
        return [pa.array(model.score(texts))]

    return append_arrow(docs, [text_col], score, [T.StructField("toxicity", T.DoubleType())], keep)
