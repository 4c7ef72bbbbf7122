"""Quality classifier: a regularised quadratic discriminant over statistics of documents.

Each class has a mean and a covariance of the transformed statistics, shrunk towards the pooled covariance and towards
a multiple of the unit matrix. A score is the logistic of the difference of the two log densities, each a Mahalanobis
distance and a log determinant from the class's cached Cholesky factor, plus the log odds of the classes. Both are
fitted on the standardised statistics that they score, within the same bound."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, WORD, arrow_map, between_words, cut, edges_between, slices, span_hashes, texts_of

STATISTICS = ["chars", "words", "word_length", "distinct_words", "repeats_next", "lines", "upper", "digits", "symbols", "exclaim", "other_marks", "wide", "sentence_ends", "line_spread"]
#: Letters added to a text's own when shares are taken, and the bound on standardised statistics: without them the
#: few words of a short text weigh as much as a long text's many.
EVEN, CLIP = 40, 3.0
PIECE = 1 << 20
_cls = {
    "upper": range(65, 91),
    "digits": range(48, 58),
    "symbols": b"#*$%&|<>",
    "exclaim": b"!",
    "other_marks": b"\"'()+,-/:;=@[\\]^_`{}~",
    "wide": range(192, 256),
    "sentence_ends": b".?",
}
_of = np.full(256, len(_cls), np.uint8)
for _k, _bytes in enumerate(_cls.values()):
    _of[list(_bytes)] = _k


def _counted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text (characters, line ends, bytes in words, marks of each class); all words' hashes, and which of
    them are each text's."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    width = len(_cls) + 1
    marks = np.bincount(doc * width + _of[data], minlength=n * width).reshape(n, width)
    chars = np.bincount(doc[(data & 0xC0) != 0x80], minlength=n)
    newlines = np.bincount(doc[data == 10], minlength=n)
    letters = np.bincount(doc[WORD[data]], minlength=n)
    begins, ends = edges_between(WORD[data], offs)
    return np.column_stack((chars, newlines, letters, marks)), span_hashes(data.astype(U64) + U64(1), begins, ends), np.searchsorted(begins, offs)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text: logs of sizes, square roots of shares. A long text is counted a
    piece at a time; of its words only the hashes are held."""
    if len(offs) == 2 and len(data) > PIECE:
        parts = [_counted(x, np.array([0, len(x)])) for x in between_words(data, PIECE)]
        sums, hashes = sum(p[0] for p in parts), np.concatenate([p[1] for p in parts])
        at = np.array([0, len(hashes)])
    else:
        sums, hashes, at = _counted(data, offs)
    n = len(sums)
    chars, newlines, letters, marks = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3:]
    words = np.diff(at)
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes):
        again = hashes[1:] == hashes[:-1]
        inner = at[1:-1]
        again[inner[(inner > 0) & (inner < len(hashes))] - 1] = False
        same[2:] = np.cumsum(again)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.int64)
    repeats = np.where(words > 0, same[at[1:]] - same[np.minimum(at[:-1] + 1, len(hashes))], 0)
    out = np.empty((n, len(STATISTICS)))
    over = lambda a, b: a / np.maximum(b, 1)
    out[:, 0] = np.log1p(chars)
    out[:, 1] = np.log1p(words)
    out[:, 2] = np.log1p(over(letters, words))
    out[:, 3] = np.log1p(over(distinct, np.sqrt(np.maximum(words, 1))))
    out[:, 4] = np.sqrt(np.maximum(repeats, 0) / (words + EVEN / 5))
    out[:, 5] = np.log1p(newlines)
    for k in range(len(_cls)):
        out[:, 6 + k] = np.sqrt(marks[:, k] / (letters + EVEN))
    out[:, 13] = np.log1p(over(chars, newlines + 1))
    return out


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.zeros((0, len(STATISTICS)))] + [statistics(data, offs) for _, _, data, offs in slices(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows).ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics, within the bound: what the densities are fitted on and scored with."""
    return np.clip((x - centre) / scale, -CLIP, CLIP)


def _moments(frame: tuple[np.ndarray, np.ndarray] | None):
    """Counts, sums and products of each label, as (label, slot, value); standardised by frame, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten()).reshape(len(label), -1)
            x = np.hstack((np.ones((len(x), 1)), x if frame is None else standard(x, *frame)))
            for k in np.unique(label).tolist():
                total[k] = total.get(k, 0) + x[label == k].T @ x[label == k]
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], names=["label", "slot", "value"])

    return run


def moments(rows: DataFrame, frame: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """For each label of rows (label, x) the matrix of counts, sums and products of (1, x); executors add up."""
    sums = arrow_map(rows, _moments(frame), "label int, slot int, value double").groupBy("label", "slot").agg(F.sum("value").alias("value")).collect()
    d = len(STATISTICS) + 1
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.label, np.zeros(d * d))[r.slot] = r.value
    return {k: v.reshape(d, d) for k, v in out.items()}


def frame_of(found: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale of the statistics over all labels."""
    both = sum(found.values())
    centre = both[0, 1:] / both[0, 0]
    return centre, np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - centre**2, 1e-6))


@dataclass
class Discriminant:
    """log p(x | label) for both labels, by mean, inverse Cholesky factor and log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray, float]]
    odds: float

    @staticmethod
    def fit(found: dict[int, np.ndarray], frame: tuple[np.ndarray, np.ndarray], towards_pooled: float = 0.1, towards_unit: float = 0.05) -> Discriminant:
        """found: for each label the moments of (1, z), z standardised by frame; without both labels only their odds."""
        d = len(STATISTICS)
        n = {k: found[k][0, 0] if k in found else 0.0 for k in (0, 1)}
        odds = float(np.log((n[1] + 1) / (n[0] + 1)))
        if not n[0] or not n[1]:
            return Discriminant(np.zeros(d), np.ones(d), [], odds)
        means = [found[k][0, 1:] / n[k] for k in (0, 1)]
        covs = [found[k][1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
        parts = []
        for mean, cov in zip(means, covs):
            cov = (1 - towards_pooled) * cov + towards_pooled * pooled
            cov = (1 - towards_unit) * cov + towards_unit * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            root = np.linalg.cholesky((cov + cov.T) / 2)
            parts.append((mean, np.linalg.inv(root), 2 * float(np.log(np.diag(root)).sum())))
        return Discriminant(*frame, parts, odds)

    def score(self, x: np.ndarray) -> np.ndarray:
        gap = np.full(len(x), self.odds)
        if self.parts:
            z = standard(x, self.centre, self.scale)
            logs = [-0.5 * ((((z - mean) @ inv.T) ** 2).sum(axis=1) + det) for mean, inv, det in self.parts]
            gap = gap + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def _score(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if len(x) else np.zeros(0))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score) for every row of docs, the id under its own name; score is that label 1 is likelier.

    Learns from all rows of labels whose id is in docs and for which the condition `learn` holds (all, if None), by sums
    that the executors add up. Labels other than 0 and 1 and null ids are passed over; repeated labels count again. A
    null text is an empty one. With a class missing, the score is the classes' ratio. Further columns are ignored."""
    x = texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col)
    x = cut(arrow_map(x, _map, "doc_id long, x array<double>"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    if learn is not None:
        known = known.where(learn)
    rows = cut(known.join(x, "doc_id").select("label", "x"))
    raw = moments(rows)
    frame = frame_of(raw) if raw else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    model = Discriminant.fit(moments(rows, frame) if raw else {}, frame)
    return arrow_map(x, _score(model), "doc_id long, score double").withColumnRenamed("doc_id", id_col)
