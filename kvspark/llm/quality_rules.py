"""Quality rules: base counts of a text and a calibrated n-gram logistic regression.

Words are runs of characters other than space and U+0009-U+000D. Base counts of
the whole text: words, code points in words, symbols, repeated lines, and words
inside 5-word windows that occur twice or more. A document fails the base rules
with fewer than ``MIN_WORDS`` words, or with over ``MAX_REPEAT_PERCENT`` % of
its words in repeated windows. The others are judged by a logistic regression
over hashed words, word pairs and character 3-grams (``hashed_text``), trained on
labelled rows, calibrated by Platt's method on held-out rows, and held against a
fixed probability.

Defined cases: a null text counts as an empty one (all counts 0, base_failed);
equal rows get equal results, one each; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are ignored by ``judge`` and kept by ``keep``;
a null doc_id is carried through; a document of any length is judged whole, one over
a slice (``vectext``) in pieces: beside the text itself, a byte a word and bounded
temporaries are held. Without labelled rows of
both kinds there is no model, and what passes the base rules is kept.

Windows and lines are compared by 64-bit hashes within one text; a text of a
million words has a chance of a wrong match of about 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashed_text as ht, vectext as vt
from .work import texts

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: A document is kept from this probability of good quality on. Chosen on labelled rows outside
#: the fit, where it drops 0.2 % of the good ones and all poor ones that pass the base rules.
KEEP_FROM = 0.2
#: Labelled rows of each kind that the model is fitted on, at most; a fifth of them calibrate it.
SAMPLE_PER_LABEL = 1000
STEPS, RATE, RIDGE = 80, 1.0, 1e-6

#: Hashes of a long document that are compared at a time.
PASS_HASHES = 1 << 21

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(s: vt.Slice | vt.Long) -> list[np.ndarray]:
    """The five counts of each document of a slice, in the order of COUNTS."""
    if isinstance(s, vt.Long):
        return [np.array([n]) for n in _long_counts(s)]
    starts, ends = ht.word_spans(s)
    doc_of_word = np.searchsorted(s.off, starts, "right") - 1
    n_words = np.bincount(doc_of_word, minlength=s.n)
    chars = s.count(~vt.WHITE[s.b] & ((s.b & 0xC0) != 0x80))
    symbols = s.count(_SYMBOL[s.b])

    doc_keys = vt.mix(np.arange(1, s.n + 1, dtype=np.uint64))
    # lines are the stretches between line feeds; those without a word don't count
    ls, le = s.spans(s.b != 10)
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[has_word], le[has_word]
    line_doc = np.searchsorted(s.off, ls, "right") - 1
    again = vt.later_copies(s.span_hash(ls, le) ^ doc_keys[line_doc])
    dup_lines = np.bincount(line_doc[again], minlength=s.n)

    repeat = np.zeros(s.n, np.int64)
    m = len(starts) - WINDOW + 1
    if m > 0:
        h = s.span_hash(starts, ends)
        win = _windows(h)
        whole = doc_of_word[:m] == doc_of_word[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        twice = at[vt.repeated(win[at] ^ doc_keys[doc_of_word[at]])]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        inside = np.cumsum(cover[:-1]) > 0
        repeat = np.bincount(doc_of_word[inside], minlength=s.n)
    return [n_words, chars, symbols, dup_lines, repeat]


def _windows(h: np.ndarray) -> np.ndarray:
    """Hashes of WINDOW words in a row."""
    m = max(0, len(h) - WINDOW + 1)
    win = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        win = vt.mix(win + h[k : k + m])
    return win


def _long_counts(doc: vt.Long) -> list[int]:
    """The counts of one long document. Hashes are compared a part of them at a time, by another pass over the text for each."""
    chars = symbols = 0
    for b in doc.pieces():
        chars += int((~vt.WHITE[b] & ((b & 0xC0) != 0x80)).sum())
        symbols += int(_SYMBOL[b].sum())
    n_words = sum(len(h) for h, _ in doc.spans(~vt.WHITE))
    lines = np.arange(256) != 10
    n_lines = sum(int(word.sum()) for _, word in doc.spans(lines))
    parts, distinct = _U(n_lines // PASS_HASHES + 1), 0
    for r in range(int(parts)):
        got = [h[word & (h % parts == _U(r))] for h, word in doc.spans(lines)]
        distinct += len(np.unique(np.concatenate(got))) if got else 0
    inside = np.zeros(n_words, bool)
    parts = _U(n_words // PASS_HASHES + 1)
    for r in range(int(parts)):
        wins, places, last, at = [], [], np.zeros(0, np.uint64), 0
        for h, _ in doc.spans(~vt.WHITE):
            h = np.append(last, h)
            win = _windows(h)
            mine = np.flatnonzero(win % parts == _U(r))
            wins.append(win[mine])
            places.append(mine + at)
            last = h[max(0, len(h) - WINDOW + 1) :]
            at += len(h) - len(last)
        if wins:
            twice = np.concatenate(places)[vt.repeated(np.concatenate(wins))]
            for k in range(WINDOW):
                inside[twice + k] = True
    return [n_words, chars, symbols, n_lines - distinct, int(inside.sum())]


@dataclass(frozen=True)
class QualityModel:
    """Weights of the hashed n-grams, bias, and Platt's slope and offset; ``weights`` None: no model."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, score: np.ndarray) -> np.ndarray:
        return ht.sigmoid(self.slope * (score + self.bias) + self.offset)


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with Platt's smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([score, np.ones_like(score)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = ht.sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t))
        w -= np.clip(step, -1, 1)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(rows: list) -> QualityModel:
    """A model from rows (doc_id, y, cols, vals); every fifth row only calibrates."""
    held = np.arange(len(rows)) % 5 == 4
    fit, check = (ht.Design([r for r, h in zip(rows, held) if h == want]) for want in (False, True))
    if not fit.y.any() or fit.y.all():
        return QualityModel(None)
    y = fit.y.astype(float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def grad(p: np.ndarray) -> np.ndarray:
        r = (ht.sigmoid(fit.dot(p[:-1]) + p[-1]) - y) * weight
        return np.append(fit.back(r) + RIDGE * p[:-1], r.sum())

    p = ht.adam(grad, ht.BUCKETS * ht.FAMILIES + 1, STEPS, RATE)
    slope, offset = _platt(check.dot(p[:-1]) + p[-1], check.y)
    return QualityModel(p[:-1].astype(np.float32), float(p[-1]), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> QualityModel:
    """Train on at most ``per_label`` rows of ``labels`` with quality 0 and as many with 1."""
    return train(ht.labelled_sample(docs, labels, F.col("quality"), (0, 1), per_label))


def judge(docs: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the counts, base_failed, quality (probability, null without a model), kept. One scan, no shuffle."""
    return texts(docs).mapInArrow(
        _worker(docs, model, keep_from, True),
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, quality double, kept boolean",
    )


def keep(docs: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return docs.mapInArrow(_worker(docs, model, keep_from, False), docs.schema)


def _worker(docs: DataFrame, model: QualityModel, keep_from: float, report: bool):
    # 3 * 65,536 float32 weights at most: a fixed size
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            parts, probs = [], []
            for s in vt.slices(b.column("text")):
                parts.append(base_counts(s))
                probs.append(np.full(s.n, np.nan) if m.weights is None else m.probability(ht.scores(s, m.weights)))
            if not parts:
                continue
            counts = [np.concatenate(c) for c in zip(*parts)]
            prob = np.concatenate(probs)
            failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_PERCENT * counts[0])
            kept = ~failed & ((prob >= keep_from) | np.isnan(prob))
            if report:
                quality = pa.array(prob, pa.float64(), mask=np.isnan(prob))
                cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), quality, pa.array(kept)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, "base_failed", "quality", "kept"])
            else:
                yield b.filter(pa.array(kept))

    return work
