"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity is one of ``grades`` ordered grades.  With weights w shared by all thresholds t1 < t2 < ..., the chance that a
text's grade is k or more is the logistic of w.x - t(k), and its severity is the expected grade, the sum of those
chances.  Features are words (ASCII lower case, without ASCII punctuation and digits), hashed to ``2 ** BITS`` places,
each with 1 + ln(count).

Labels say toxic or not; how severe, they don't.  Grade 0 is not toxic.  Toxic rows are told apart by how plain their
toxicity is to models that have not seen them: ``FOLDS`` two-grade models are fitted, each without one fold, and the
chances that they give to the toxic rows of that fold are cut into as many bands of equal size as there are grades.  So
severity is a proxy: the chance of grade 1 or more is that of a toxic label, and the higher grades rank toxic texts by it.

Training rows are drawn by a level of a hash of their id: the lowest at which there are at most ``SAMPLE_ROWS``, with texts
of at most ``SAMPLE_CHARS`` characters.  Their features come to the driver and weights are fitted by full-batch gradient
steps; those of words that don't mark toxic rows (by their log-odds) are held small by a penalty.  Scoring is one pass
over all documents, whole texts.

Defined results: a null or empty text has no features and severity by the thresholds alone; labels other than 0 and 1, null
ones and those without a document go unused; a document with several labels is toxic if one says so; without labels of
both kinds every severity is 0; an empty table gives an empty result; columns that clash with those added are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import level, small_batches

#: Labelled rows whose features come to the driver, and characters of their texts, at most.
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 32_000_000
BITS = 18
GRADES = 4
#: A word marks toxic rows where its log-odds are this many standard errors above 0 and it is in as many toxic rows.
MARK_ERRORS, MARK_ROWS = 3.0, 3
STEPS, RATE, PENALTY, OTHER_PENALTY = 400, 0.1, 0.0005, 2.5
#: Folds of the models that tell grades, and their steps.
FOLDS, FOLD_STEPS = 3, 120


@dataclass(frozen=True)
class Model:
    places: np.ndarray  # ascending, of the words that carry weight
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        chances = 1 / (1 + np.exp(-(score[:, None] - self.thresholds[None, :])))
        return chances.sum(axis=1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, offsets): each text's distinct features."""
    hashed, offsets = W.hashes(texts, W.LETTERS)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    key, count = np.unique((text << BITS) | (hashed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return key & ((1 << BITS) - 1), (1 + np.log(count)).astype("f4"), np.searchsorted(key >> BITS, np.arange(len(texts) + 1))


def sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(toxic, places, values) of labelled documents."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.withColumn("level", level(F.col("doc_id"), 10))
    sizes = documents.select("doc_id", F.coalesce(F.char_length(text), F.lit(0)).alias("size")).join(usable.select("doc_id", "level"), "doc_id")
    counts = {r.level: (r.n, r.size) for r in sizes.groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}  # 65 rows at most
    least, total, length = max(counts, default=0), 0, 0
    for at in sorted(counts, reverse=True):
        total, length = total + counts[at][0], length + counts[at][1]
        if total > rows or length > chars:
            break
        least = at
    chosen = F.broadcast(usable.filter(F.col("level") >= least).select("doc_id", "toxic"))  # at most ``rows``

    @F.arrow_udf("places binary, values binary")
    def extracted(column: pa.Array) -> pa.Array:
        one, two = [], []
        for group in W.groups(x.as_py() for x in column):
            places, values, offsets = features(group)
            for i, j in zip(offsets[:-1], offsets[1:], strict=True):
                one.append(places[i:j].astype("<i4").tobytes())
                two.append(values[i:j].astype("<f4").tobytes())
        return pa.StructArray.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["places", "values"])

    found = documents.select("doc_id", text).join(chosen, "doc_id").select("doc_id", "toxic", extracted(F.col(text)).alias("x"))
    got = sorted(((r.doc_id, r.toxic, bytes(r.x.places), bytes(r.x["values"])) for r in found.collect()))
    toxic = np.asarray([g[1] for g in got], np.int64)
    return toxic, [np.frombuffer(g[2], "<i4").astype(np.int64) for g in got], [np.frombuffer(g[3], "<f4").astype("f8") for g in got]


def marks(toxic: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """The places of words that toxic rows hold far more often than others."""
    size = 1 << BITS
    row = np.repeat(toxic, [len(p) for p in places]).astype(bool)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    bad, good = (np.bincount(at[row], minlength=size), np.bincount(at[~row], minlength=size))
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = np.log((bad + 0.5) / (n_bad - bad + 0.5)) - np.log((good + 0.5) / (n_good - good + 0.5))
    error = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return np.flatnonzero((odds > MARK_ERRORS * error) & (bad >= MARK_ROWS))


@dataclass(frozen=True)
class Rows:
    """Features of rows, one after another, of words that are in enough rows to tell anything."""

    used: np.ndarray
    value: np.ndarray
    column: np.ndarray
    row: np.ndarray
    penalty: np.ndarray

    @classmethod
    def of(cls, toxic: np.ndarray, places: list[np.ndarray], values: list[np.ndarray]) -> Rows:
        at, row = np.concatenate(places), np.repeat(np.arange(len(places)), [len(p) for p in places])
        used = np.flatnonzero(np.bincount(at, minlength=1 << BITS) >= MARK_ROWS)
        keep = np.isin(at, used)
        penalty = np.where(np.isin(used, marks(toxic, places)), PENALTY, OTHER_PENALTY)
        return cls(used, np.concatenate(values)[keep], np.searchsorted(used, at[keep]), row[keep], penalty)


def _ordinal(rows: Rows, grade: np.ndarray, grades: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model of the grades."""
    width, n = len(rows.used), len(grade)
    share = np.asarray([np.clip((grade >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, grades)])
    vector = np.concatenate([np.zeros(width), np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))])
    speed, size = np.zeros(len(vector)), np.zeros(len(vector))
    for step in range(1, steps + 1):
        w, t = vector[:width], vector[width:]
        score = np.bincount(rows.row, rows.value * w[rows.column], n)
        p = 1 / (1 + np.exp(-(score[:, None] - t)))
        # the chance of grade k is that of k or more less that of k + 1 or more
        upper = np.concatenate([np.ones((n, 1)), p], axis=1)
        lower = np.concatenate([p, np.zeros((n, 1))], axis=1)
        own_u, own_l = upper[np.arange(n), grade], lower[np.arange(n), grade]
        chance = np.maximum(own_u - own_l, 1e-9)
        d_u, d_l = own_u * (1 - own_u) / chance, own_l * (1 - own_l) / chance
        pull = d_u - d_l
        g_w = -np.bincount(rows.column, rows.value * pull[rows.row], width) / n + rows.penalty * w
        g_t = np.asarray([(d_u[grade == k + 1].sum() - d_l[grade == k].sum()) / n for k in range(grades - 1)])
        # Adam, with a rate that falls to nothing
        slope = np.concatenate([g_w, g_t])
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        move = speed / (1 - 0.9**step) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
        vector = vector - RATE * (1 - step / steps) * move
        vector[width:] = np.maximum.accumulate(vector[width:] + 1e-9 * np.arange(grades - 1))
    return vector[:width], vector[width:]


def cross_fitted(toxic: np.ndarray, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """The score of each row by a model of two grades that was fitted without its fold; folds go round in the rows' order."""
    out = np.zeros(len(toxic))
    for fold in range(FOLDS):
        own = np.arange(len(toxic)) % FOLDS == fold
        rest = np.flatnonzero(~own)
        if not len(rest) or toxic[rest].min() == toxic[rest].max():
            continue
        rows = Rows.of(toxic[rest], [places[i] for i in rest], [values[i] for i in rest])
        weights, thresholds = _ordinal(rows, toxic[rest], 2, FOLD_STEPS)
        dense = np.zeros(1 << BITS)
        dense[rows.used] = weights
        for i in np.flatnonzero(own):
            out[i] = values[i] @ dense[places[i]] - thresholds[0]
    return out


def grades_of(toxic: np.ndarray, scores: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for rows that aren't toxic, and for toxic ones the band of their score among them, bands of equal size."""
    grade = np.zeros(len(toxic), np.int64)
    bad = np.flatnonzero(toxic == 1)
    edges = np.quantile(scores[bad], [k / (grades - 1) for k in range(1, grades - 1)]) if len(bad) else []
    grade[bad] = 1 + np.searchsorted(edges, scores[bad], "left")
    return grade


def fit(toxic: np.ndarray, places: list[np.ndarray], values: list[np.ndarray]) -> Model:
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 60.0))
    grade = grades_of(toxic, cross_fitted(toxic, places, values))
    rows = Rows.of(toxic, places, values)
    w, t = _ordinal(rows, grade, GRADES, STEPS)
    strong = np.abs(w) > 1e-3
    return Model(rows.used[strong], w[strong], t)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with severity (0 to GRADES - 1), grade (the nearest) and toxic_pred (the chance of grade 1 or more is half at least)."""
    names = ("severity", "grade", "toxic_pred")
    dense = np.zeros(1 << BITS, "f8")
    dense[model.places] = model.weights
    shared = df.sparkSession.sparkContext.broadcast((dense, model))  # 2 MB, by BITS

    @F.arrow_udf("severity double, grade int, toxic_pred boolean")
    def scored(column: pa.Array) -> pa.Array:
        weights, fitted = shared.value
        totals = []
        for group in W.groups(x.as_py() for x in column):
            places, values, offsets = features(group)
            text_of = np.repeat(np.arange(len(group)), np.diff(offsets))
            totals.append(np.bincount(text_of, values * weights[places], len(group)))
        total = np.concatenate(totals) if totals else np.zeros(0)
        severity = fitted.severity(total)
        return pa.StructArray.from_arrays([pa.array(severity), pa.array(np.rint(severity).astype("i4")), pa.array(total >= fitted.thresholds[0])], ["severity", "grade", "toxic_pred"])

    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in names]
    out = df.select(*kept, scored(F.col(text)).alias("__s"))
    return out.select(*kept, *(F.col(f"__s.{n}").alias(n) for n in names))
