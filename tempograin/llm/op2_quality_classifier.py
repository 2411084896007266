"""Quality classifier by co-training.

Two views of a document, its text (hashed words and statistics) and its metadata (source, language, length), each get a logistic
model. In each of ROUNDS, each view scores all documents without a label, and hands the LESSONS best and LESSONS worst of those
that it is sure of to the other view, which is fitted again with them. Labelled documents of one fold (of FOLDS, dealt by class)
are kept from training. On them the views' log-odds are calibrated: for confidence in each round, so a view that
tells nothing about quality is sure of nothing and teaches nothing; and at the end for the combination, which scores every document.
A third model finds toxic documents from words and their starts by the toxic labels; a document is kept if it is good and not toxic.

Bounds: models are fitted on at most FIT_ROWS labelled documents of each class and on the lessons, all chosen by hash or by odds;
the weights (2^16 words, 2^16 sources) are broadcast. Everything else covers all documents.

Null text or metadata: an empty text, and categories of their own. Repeated labels of a document: the lower quality, the higher
toxicity. Null labels don't count. A target of which a class has fewer than two labelled documents: a null score, by which every
document passes. Repeated rows are all returned and teach once. Empty table: empty result. Texts may be of any length; ties of
odds are broken by hash. Extra columns of docs and labels are left out.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .hashing import PUNCTUATION, mix, word_hashes

ROUNDS, SURE, FOLDS, KEEP, TOXIC = 2, 0.95, 5, 0.5, 0.3
FIT_ROWS, LESSONS = 5_000, 1_000
WORD_BINS, SOURCE_BINS, LANG_BINS = 1 << 16, 1 << 16, 1 << 8
STATISTICS = 14
VIEWS = {"content": STATISTICS + WORD_BINS, "meta": 2 + SOURCE_BINS + LANG_BINS}
#: The bytes that a word's start has.
START = 4


def content_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): shares of character classes, word and line statistics, and the words that occur, by hash."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0)
    count = np.bincount(raw, minlength=256) / len(raw)
    words = word_hashes(data.lower(), PUNCTUATION)
    lines = [x for x in data.split(b"\n") if x.strip()]
    many = max(1, len(words))
    distinct = np.unique(words)
    statistics = (
        count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum(), count[[32, 9, 10]].sum(),
        count[[35, 42, 36, 37, 38, 124, 60, 62]].sum() * 10, count[[33, 63]].sum() * 10, count[[44, 46]].sum() * 10, len(raw) / many / 10,
        len(distinct) / many, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(words)) / 10, math.log1p(len(lines)) / 10,
        float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0,
    )
    bins = np.unique((distinct % np.uint64(WORD_BINS)).astype(np.int64))
    weight = np.full(len(bins), 3 / math.sqrt(max(1, len(bins))))
    return np.concatenate((np.arange(STATISTICS), STATISTICS + bins)), np.concatenate((statistics, weight))


def word_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): how often words and starts of words occur, by hash, as logarithms; not a share, so that a few words tell in a text of any length."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass") + b" " * START, np.uint8)
    words = word_hashes(data.tobytes(), PUNCTUATION)
    first = np.flatnonzero(np.diff(PUNCTUATION[data].astype(np.int8), prepend=1) < 0)
    starts = np.zeros(len(first), np.uint64)
    inside = np.ones(len(first), bool)
    for k in range(START):
        inside &= ~PUNCTUATION[data[first + k]]
        starts = starts * np.uint64(256) + np.where(inside, data[first + k], 0).astype(np.uint64)
    bins, n = np.unique(np.concatenate((words, mix(starts))) % np.uint64(WORD_BINS), return_counts=True)
    return bins.astype(np.int64), np.log1p(n)


def _bin(value: str | None, bins: int) -> int:
    known = word_hashes(value.encode("utf-8", "surrogatepass"), np.zeros(256, bool)) if value else np.zeros(0, np.uint64)
    return int(mix(known[:1])[0] % np.uint64(bins - 1)) + 1 if len(known) else 0


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    size = math.log1p(max(n_chars or 0, 0)) / 10
    return np.array([0, 1, 2 + _bin(source, SOURCE_BINS), 2 + SOURCE_BINS + _bin(lang, LANG_BINS)]), np.array([size, size * size, 1.0, 1.0])


@dataclasses.dataclass(frozen=True)
class Model:
    """Log-odds of a target from one view."""

    weights: np.ndarray
    bias: float

    def odds(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        return self.bias + float(self.weights[features[0]] @ features[1])


@F.udf(VectorUDT())
def _content_vector(text: str | None) -> SparseVector:
    return SparseVector(VIEWS["content"], *content_features(text))


@F.udf(VectorUDT())
def _word_vector(text: str | None) -> SparseVector:
    return SparseVector(WORD_BINS, *word_features(text))


@F.udf(VectorUDT())
def _meta_vector(source: str | None, lang: str | None, n_chars: int | None) -> SparseVector:
    return SparseVector(VIEWS["meta"], *meta_features(source, lang, n_chars))


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang, n_chars and key, which tells rows apart but for repeated ones."""
    size = F.coalesce(F.col("n_chars").cast("long"), F.length("text").cast("long"), F.lit(0).cast("long"))
    return docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), size.alias("n_chars"), F.xxhash64("doc_id", F.col("text").isNull(), "text").alias("key"))


def _vectors(rows: DataFrame, views: tuple[str, ...], *more: str) -> DataFrame:
    """key, more and a vector of each view of a bounded number of documents, written to the checkpoint folder."""
    made = {"content": _content_vector("text"), "meta": _meta_vector("source", "lang", "n_chars"), "words": _word_vector("text")}
    return checkpoint(rows.dropDuplicates(["key"]).select("key", *more, *(made[v].alias(v) for v in views)))


def _fit(rows: DataFrame, view: str, target: str) -> Model:
    model = LogisticRegression(maxIter=25, regParam=1e-3, standardization=False, featuresCol=view, labelCol=target).fit(rows.select(view, F.col(target).cast("double").alias(target)).coalesce(4))
    return Model(model.coefficients.toArray(), float(model.intercept))


def _odds(models: dict[str, tuple[str, Model]], rows: DataFrame) -> DataFrame:
    """rows with a column odds: struct of the log-odds of each model, given as name: (view, model)."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    fields = [(name, pa.float64()) for name in models]

    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in models) + ">")
    def odds(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        out: dict[str, list[float]] = {n: [] for n in shared.value}
        for text, source, lang, size in zip(texts, sources.to_pylist(), langs.to_pylist(), sizes.to_pylist(), strict=True):
            of = {"content": lambda x=text: content_features(x.as_py()), "words": lambda x=text: word_features(x.as_py()), "meta": lambda x=(source, lang, size): meta_features(*x)}
            seen = {view: of[view]() for view, _ in shared.value.values()}
            for name, (view, model) in shared.value.items():
                out[name].append(model.odds(seen[view]))
        return pa.StructArray.from_arrays([pa.array(out[n], pa.float64()) for n in out], fields=[pa.field(n, t) for n, t in fields])

    return rows.withColumn("odds", odds("text", "source", "lang", "n_chars"))


def _labelled(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame | None:
    """Vectors, y and fold of at most FIT_ROWS labelled documents of each class, the first ones by hash; None if a class has fewer than two."""
    least = F.min if target == "quality" else F.max
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(least(target).cast("int").alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("at", F.xxhash64("doc_id"))
    parts = [known.filter(F.col("y") > 0 if y else F.col("y") <= 0).withColumn("y", F.lit(y)).orderBy("at", "doc_id").limit(FIT_ROWS) for y in (0, 1)]
    # at most 2 * FIT_ROWS rows from here on
    order = Window.partitionBy("y").orderBy("at", "doc_id")
    chosen = checkpoint(parts[0].union(parts[1]).withColumn("fold", (F.row_number().over(order) - 1) % FOLDS))
    if {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).filter("n > 1").collect()}.keys() != {0, 1}:
        return None
    return _vectors(docs.join(F.broadcast(chosen), "doc_id"), tuple(VIEWS) if target == "quality" else ("words",), "y", "fold")


def _lessons(scored: DataFrame, docs: DataFrame, chance: Column) -> DataFrame:
    """Vectors and y of the LESSONS best and worst documents of which a view is sure by its calibrated chance."""
    ends = [scored.withColumn("sure", c).filter(F.col("sure") >= SURE).orderBy("sure", "key", ascending=[False, True]).select("key", F.lit(y).alias("y")).limit(LESSONS) for y, c in ((1, chance), (0, 1 - chance))]
    return _vectors(docs.join(F.broadcast(checkpoint(ends[0].union(ends[1]).dropDuplicates(["key"]))), "key"), tuple(VIEWS), "y")


@dataclasses.dataclass(frozen=True)
class Trained:
    """content and meta: the models after the last round. lessons: for each round how many documents the text taught, then the metadata."""

    content: Model
    meta: Model
    lessons: tuple[tuple[int, int], ...]


def co_train(docs: DataFrame, labelled: DataFrame, labels: DataFrame, rounds: int) -> Trained:
    """docs: as _prepared() makes them; labelled: as _labelled() does."""
    train = labelled.filter("fold > 0").select("key", "y", "content", "meta")
    fits = {v: _fit(train, v, "y") for v in VIEWS}
    told = []
    for _ in range(rounds):
        # labelled documents are left out once the texts are gone; a join before that would move them
        scored = checkpoint(_odds({v: (v, m) for v, m in fits.items()}, docs).select("doc_id", "key", "odds"))
        scored = scored.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
        taught = {v: _lessons(scored, docs, _chance(_calibrated(labelled, [(v, m)]), F.col(f"odds.{v}"))) for v, m in fits.items()}
        told.append(tuple(taught[v].count() for v in VIEWS))
        other = {"content": "meta", "meta": "content"}
        fits = {v: _fit(train.unionByName(taught[other[v]].select("key", "y", "content", "meta")), v, "y") for v in VIEWS}
    return Trained(fits["content"], fits["meta"], tuple(told))


def _calibrated(labelled: DataFrame, models: list[tuple[str, Model]]) -> tuple[list[float], float]:
    """(weights of the models' odds, bias) of a logistic model on the fold kept from training."""

    def odds_of(model: Model):
        return F.udf(lambda x: model.odds((x.indices, x.values)), "double")

    # at most 2 * FIT_ROWS / FOLDS rows of numbers
    rows = labelled.filter("fold = 0").select("y", *(odds_of(m)(v).alias(f"odds{i}") for i, (v, m) in enumerate(models))).collect()
    odds, y = np.array([r[1:] for r in rows], float), np.array([r["y"] for r in rows], float)
    scale = np.maximum(np.abs(odds).max(0, initial=0.0), 1.0)
    x, w = np.hstack((odds / scale, np.ones((len(y), 1)))), np.zeros(len(models) + 1)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return (w[:-1] / scale).tolist(), float(w[-1])


def _chance(calibration: tuple[list[float], float], *odds: Column) -> Column:
    total = F.lit(calibration[1])
    for w, x in zip(calibration[0], odds, strict=True):
        total = total + F.lit(w) * x
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, content_score, meta_score (calibrated probabilities of each view), quality, toxic, kept, for every document."""
    whole = _prepared(docs)
    nothing = F.lit(None).cast("double")
    models: dict[str, tuple[str, Model]] = {}
    good = _labelled(whole, labels, "quality")
    bad = _labelled(whole, labels, "toxic") if "toxic" in labels.columns else None
    if good is not None:
        trained = co_train(whole, good, labels.filter("quality is not null and doc_id is not null"), rounds)
        models |= {"content": ("content", trained.content), "meta": ("meta", trained.meta)}
    if bad is not None:
        models["toxic"] = ("words", _fit(bad.filter("fold > 0"), "words", "y"))
    rows = _odds(models, whole) if models else whole
    columns = {"content_score": nothing, "meta_score": nothing, "quality": nothing, "toxic": nothing}
    if good is not None:
        both = [models["content"], models["meta"]]
        columns["content_score"] = _chance(_calibrated(good, both[:1]), F.col("odds.content"))
        columns["meta_score"] = _chance(_calibrated(good, both[1:]), F.col("odds.meta"))
        columns["quality"] = _chance(_calibrated(good, both), F.col("odds.content"), F.col("odds.meta"))
    if bad is not None:
        columns["toxic"] = _chance(_calibrated(bad, [models["toxic"]]), F.col("odds.toxic"))
    out = rows.select("doc_id", *(c.alias(n) for n, c in columns.items()))
    return out.withColumn("kept", F.coalesce(F.col("quality") >= KEEP, F.lit(True)) & F.coalesce(F.col("toxic") < TOXIC, F.lit(True)))
