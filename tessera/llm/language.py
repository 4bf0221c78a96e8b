"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods.

Each language has a character n-gram model (hashed trigrams within words, smoothed). A document is a bag of
words, and each word has a log-likelihood in every language. Expectation-maximisation finds the
proportions of the languages that explain the words best. The set of languages is selected by
penalised likelihood: sets grow in the order of the proportions, and another language has to
raise the log-likelihood by more than its share of the penalty (``penalty`` * log(words) each).

Models are fitted on a bounded sample of labelled texts (``Fit.docs`` a language, ``Fit.pieces`` windows of
``Fit.window`` characters spread over each). Inference reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, sample_per_class

# what lies between words, runs of marks without a letter (as an emoji's variation selector) included
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+(?:\p{M}++(?!\p{L})[^\p{L}\p{M}]*)*")


@dataclass(frozen=True)
class Fit:
    docs: int = 1500
    pieces: int = 8
    window: int = 1024
    bits: int = 16  # hashed n-grams
    alpha: float = 0.5
    penalty: float = 2.0
    rounds: int = 12  # of expectation-maximisation


@dataclass(frozen=True)
class Model:
    languages: tuple
    logp: np.ndarray  # float32, n-grams x languages
    fit: Fit


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words of lower-cased texts (words: runs of letters and their marks), the first
    n-gram of each word, and the first word of each text; -1 stands for no n-gram."""
    words = [_NO_LETTER.sub(" ", f" {t.lower()}").strip() for t in texts]
    joined = "  ".join(words)  # two blanks: no n-gram holds letters of two texts, so a text's result does not depend on its neighbours
    code = np.frombuffer(f"  {joined}  ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ code[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    gram = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    middle = code[1:-1]
    blank = middle == 32
    starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]])))
    counts = np.array([w.count(" ") + 1 if w else 0 for w in words], dtype=np.int64)
    # n-grams centred on a blank belong to the word before it; the first one, before all words, to none, and so do those of
    # a second blank in a row, between texts
    gram[blank & (code[:-2] == 32)] = -1
    return gram, starts, np.concatenate([[0], np.cumsum(counts)])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", settings: Fit = Fit()) -> Model:
    """Language models of ``labelled``; rows without text or label are not used."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("y"))
    rows = rows.where(F.col("y").isNotNull() & (F.length("text") > 0))
    n, w = F.length("text"), settings.window
    gap = F.greatest(n - w, F.lit(0)) / F.lit(settings.pieces - 1)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(settings.pieces - 1)), lambda k: F.floor(k * gap).cast("int")))
    part = F.when(n <= w * settings.pieces, F.col("text")).otherwise(
        F.array_join(F.transform(starts, lambda s: F.substring("text", s + 1, F.lit(w))), " "))
    size = 1 << settings.bits
    counts: dict[str, np.ndarray] = {}
    for r in sample_per_class(rows, "y", "id", settings.docs).select("y", part.alias("t")).toLocalIterator():
        gram, first, _ = grams([r.t], settings.bits)
        if len(first):
            counts[r.y] = counts.get(r.y, 0) + np.bincount(gram[gram >= 0], minlength=size)
    languages = tuple(sorted(counts))
    logp = np.empty((size, len(languages)), dtype=np.float32)
    seen = sum((c > 0) for c in counts.values()).astype(bool).sum() if languages else 0
    for k, lang in enumerate(languages):
        c = counts[lang] + settings.alpha
        logp[:, k] = np.log(c / (counts[lang].sum() + settings.alpha * max(1, seen)))
    return Model(languages, logp, settings)


def mixtures(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages; unselected languages 0) and the number of words of each text."""
    k, fit_ = len(model.languages), model.fit
    gram, starts, first = grams(texts, fit_.bits)
    words = np.diff(first)
    out = np.zeros((len(texts), k))
    if not len(starts) or not k:
        return out, words
    rows = model.logp[gram]
    rows[gram < 0] = 0
    like = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
    has = np.flatnonzero(words)
    at, n = first[has], words[has].astype(np.float64)
    top = like.max(axis=1, keepdims=True)
    odds = np.exp(like - top)
    owner = np.repeat(np.arange(len(has)), words[has])

    def maximise(odds, owner, at, n, allowed):
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(fit_.rounds):
            joint = odds * pi[owner]
            joint /= joint.sum(axis=1, keepdims=True) + 1e-300
            pi = np.add.reduceat(joint, at, axis=0) / n[:, None]
        gain = np.add.reduceat(np.log((odds * pi[owner]).sum(axis=1) + 1e-300), at)
        return pi, gain

    every = np.ones((len(has), k))
    pi, full = maximise(odds, owner, at, n, every)
    single = np.add.reduceat(np.log(np.maximum(odds, 1e-300)), at, axis=0)
    best = single.argmax(axis=1)
    cost = fit_.penalty * np.log(n + 1)
    chosen = np.zeros_like(pi)
    chosen[np.arange(len(has)), best] = 1
    value = single.max(axis=1) - cost
    open_ = np.flatnonzero(full - 2 * cost > value)  # no larger set can win where even all languages together don't
    order = np.argsort(-pi, axis=1, kind="stable")
    for size in range(2, k + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
        index = np.concatenate([np.arange(at[d], at[d] + int(n[d])) for d in open_])
        sub = np.concatenate([[0], np.cumsum(n[open_].astype(np.int64))[:-1]])
        p, gain = maximise(odds[index], np.repeat(np.arange(len(open_)), n[open_].astype(np.int64)), sub, n[open_], allowed)
        gain -= size * cost[open_]
        better = gain > value[open_]
        chosen[open_[better]] = p[better]
        value[open_[better]] = gain[better]
    out[has] = chosen
    return out, words


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred (largest proportion, ties to the first name), score (that proportion), languages (name to
    proportion of the selected set). Texts that are null or hold no letter are ``und`` with score 0, as is every text
    if no language was learnt. Equal texts get equal results; an empty table gives no rows."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))])
    names = model.languages

    def run(batches):
        for batch in byte_batches(batches, 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pi, words = mixtures(texts, model)
            langs, scores, sets = [], [], []
            for row, n in zip(pi, words):
                if not n or not len(names):
                    langs.append("und"), scores.append(0.0), sets.append([])
                    continue
                k = int(row.argmax())
                langs.append(names[k]), scores.append(float(min(1.0, row[k]))), sets.append([(names[j], float(row[j])) for j in np.flatnonzero(row)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=schema.names)

    return src.mapInArrow(run, schema)
