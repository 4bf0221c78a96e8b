"""Quality by compression: zstandard dictionaries of good and of bad text compete on each document.

One dictionary is trained on text labelled good, one on text labelled bad. A document is cut into
windows, each is compressed with either dictionary, and the difference of the two sums, in shares of
them, is the document's evidence: text that looks like the good labels gets smaller with the good
dictionary. Text that only repeats itself gets small with both, so the curve that turns the evidence into the
probability of label 1 also knows how far the text shrank. This logistic curve is fitted on labelled documents that
the dictionaries have not seen.

Fitting takes a bounded sample of labelled rows (``Fit.docs`` a class, ``Fit.pieces`` windows spread
over each text); scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, sample_per_class


@dataclass(frozen=True)
class Fit:
    """Bounds of the fit and the shape of what is compressed."""

    docs: int = 1500  # sampled documents of each class
    pieces: int = 32  # windows taken from each of them, spread evenly over the text
    window: int = 512  # characters of a window
    dictionary: int = 64 << 10
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    raw: bool
    weights: tuple  # of evidence, shrinkage and 1
    fit: Fit

    def compressors(self):
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        return [zstandard.ZstdCompressor(level=self.fit.level, write_content_size=False, write_dict_id=False,
                                         dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind)) if d else
                zstandard.ZstdCompressor(level=self.fit.level, write_content_size=False)
                for d in (self.good, self.bad)]


SMOOTH = 64  # bytes that keep the sizes of short texts from saying much


def evidence(text: str | None, good, bad, window: int) -> tuple[float, float]:
    """Over all windows of a text: (bad size - good size) / (bad size + good size), and the logarithm of the mean of both in shares of
    the text's size. Both are 0 for an empty text."""
    a = b = n = 0
    for at in range(0, len(text or ""), window):
        part = text[at: at + window].encode("utf-8", "replace")
        a += len(good.compress(part))
        b += len(bad.compress(part))
        n += len(part)
    return (b - a) / (b + a + SMOOTH), math.log((a + b + SMOOTH) / (2 * n + SMOOTH))


def probability(x: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights[:-1]) + weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple:
    """Newton's method on the weighted log-loss with a slight ridge; targets drawn in a little as Platt does."""
    pos, neg = w[y == 1].sum(), w[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.c_[x / scale, np.ones(len(x))]
    beta = np.zeros(design.shape[1])
    beta[-1] = math.log((pos + 1) / (neg + 1))
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design.T * (w * np.maximum(p * (1 - p), 1e-9))) @ design + ridge,
                               design.T @ (w * (t - p)) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in (*(beta[:-1] / scale), beta[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        settings: Fit = Fit()) -> Model:
    """Fit on the ``docs`` (id, text) that ``labels`` (id, label 0/1) names; other labels, and texts that are null or
    empty, are not used. The labels are sampled first, so at most ``4 * settings.docs`` ids are broadcast to the scan.
    Without rows of either class the score is the share of label 1 (0.5 if there are none at all)."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    rows = rows.join(F.broadcast(sample_per_class(marks, "y", "id", settings.docs)), "id")
    n, w = F.length("text"), settings.window
    gap = F.greatest(n - w, F.lit(0)) / F.lit(settings.pieces - 1)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(settings.pieces - 1)),
                                          lambda k: F.floor(k * gap).cast("int")))
    parts = F.when(n <= w * settings.pieces, F.array("text")).otherwise(
        F.transform(starts, lambda s: F.substring("text", s + 1, F.lit(w))))
    taken = rows.select("id", "y", parts.alias("parts")).limit(4 * settings.docs).collect()
    taken = sorted(((str(r.id), r.y, r.parts) for r in taken), key=lambda r: (r[1], r[0], r[2]))
    halves = {(y, h): [p for k, (_, _, p) in enumerate(t for t in taken if t[1] == y) if k % 2 == h]
              for y in (0, 1) for h in (0, 1)}
    cut = lambda docs: [part[at: at + w].encode("utf-8", "replace") for parts in docs for part in parts
                        for at in range(0, len(part), w)]
    samples = [cut(halves[y, 0]) for y in (1, 0)]
    try:
        good, bad = (zstandard.train_dictionary(settings.dictionary, s).as_bytes() for s in samples)
        raw = False
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        good, bad = (b"".join(s)[: settings.dictionary] for s in samples)
        raw = True
    model = Model(good, bad, raw, (0.0, 0.0, 0.0), settings)
    rest = [(y, parts) for y in (0, 1) for parts in halves[y, 1]] or [(y, parts) for _, y, parts in taken]
    y = np.array([r[0] for r in rest], dtype=int)
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(set(y.tolist())) < 2:
        return Model(good, bad, raw, (0.0, 0.0, math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))), settings)
    a, b = model.compressors()
    x = np.array([evidence("".join(parts), a, b, w) for _, parts in rest])
    weight = np.array([counts[k] / (y == k).sum() for k in y]) * len(y) / sum(counts.values())
    return Model(good, bad, raw, _logistic(x, y, weight), settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` columns, evidence and score of every row. Null and empty texts have evidence 0 and thus
    the score of text that favours neither dictionary; equal texts get equal scores; an empty table gives no rows."""
    cols = [id_col, *keep]
    src = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(cols)], F.col(text_col).alias("text"))
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in cols),
                           T.StructField("evidence", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        good, bad = model.compressors()
        for batch in byte_batches(batches):
            x = np.array([evidence(t, good, bad, model.fit.window) for t in batch.column("text").to_pylist()])
            p = probability(x, model.weights)
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{k}") for k in range(len(cols))), pa.array(x[:, 0]), pa.array(p)],
                                             names=[*cols, "evidence", "score"])

    return src.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more. Their order in a partition stays."""
    def run(batches):
        good, bad = model.compressors()
        for batch in byte_batches(batches):
            x = np.array([evidence(t, good, bad, model.fit.window) for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(probability(x, model.weights) >= least))

    return docs.mapInArrow(run, docs.schema)
