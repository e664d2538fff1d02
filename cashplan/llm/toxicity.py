"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models of the words in a text; each model also reads the
probabilities of the categories before it. While learning, those are out-of-fold: a document's earlier probabilities come
from models that did not see it, so the later models learn how far the earlier ones can be trusted.

The table has one toxicity label, which is the chain's last category. The earlier ones are learnt from the labelled
rows: the toxic documents of the sample, described by the features that tell them from others, fall into ``GROUPS`` kinds
by spherical k-means; the kind with most documents comes first. No word is named anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan.llm.common import Cache, id_crc32, slices, texts
from cashplan.llm.quality import FOLDS, HELD_OUT, learnable, one_text_each
from cashplan.session import written

#: Kinds of toxic documents, the chain's earlier categories.
GROUPS = 2
CATEGORIES = [*(f"kind{i + 1}" for i in range(GROUPS)), "toxic"]
KMEANS_ROUNDS = 30
#: The bound of what is learnt from: labelled documents of each label.
PER_LABEL = 2000
FEATURES = 1024
LEAST_CHI_SQUARE = 12.0
INNER_FOLDS = 3
PENALTY = 1e-4
PREFIXES = (4, 5, 6, 7, 8)
LONGEST_WORD = 24
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[str, ...]:
    """The word (a long one by its digest) and its beginnings."""
    whole = word if len(word) <= LONGEST_WORD else f"{word[:LONGEST_WORD]}:{blake2b(word.encode(), digest_size=16).hexdigest()}"
    return (whole, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n))


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(rows: np.ndarray, target: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights and intercept of a ridge-penalised logistic model, by Newton steps; both labels weigh the same in all."""
    rows = np.hstack([rows, np.ones((len(rows), 1))])
    share = np.clip(target.mean(), 1e-9, 1 - 1e-9)
    of = np.where(target > 0, 0.5 / share, 0.5 / (1 - share))
    ridge = penalty * len(rows) * np.eye(rows.shape[1])
    ridge[-1, -1] = 1e-9
    weight = np.zeros(rows.shape[1])
    for _ in range(12):
        p = _sigmoid(rows @ weight)
        step = np.linalg.solve(
            (rows.T * (of * p * (1 - p) + 1e-6)) @ rows + ridge, rows.T @ (of * (p - target)) + ridge @ weight
        )
        weight -= step
        if np.abs(step).max() < 1e-6:
            break
    return weight


@dataclass
class Chain:
    #: Column of a feature in the models' rows.
    column: dict[str, int] = field(default_factory=dict)
    categories: list[str] = field(default_factory=lambda: list(CATEGORIES))
    weights: list[np.ndarray] = field(default_factory=list)

    def columns(self) -> Cache:
        return Cache(lambda word: [self.column[f] for f in features_of(word) if f in self.column], longest=64)

    def rows(self, documents: list[set[str]], columns: Cache) -> np.ndarray:
        out = np.zeros((len(documents), len(self.column)))
        for row, document in zip(out, documents, strict=True):
            for word in document:
                if at := columns[word]:
                    row[at] = 1
        return out

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Each category's probability, one column after the other."""
        if not self.weights:
            return np.zeros((len(rows), len(self.categories)))
        for weight in self.weights:
            rows = np.hstack([rows, _sigmoid(rows @ weight[:-1] + weight[-1])[:, None]])
        return rows[:, -len(self.weights) :]


def telling_features(sample: DataFrame, limit: int = FEATURES) -> list[list[str]]:
    """Of ``label``, ``fold`` and ``features``, the features that tell label 1 from 0 best, by chi-square with a correction
    for small counts, at most ``limit``: first those of the whole sample, then those of the sample without each fold."""

    def ones(without: int | None, label: int) -> str:
        return f"count_if(label = {label}" + ("" if without is None else f" AND fold <> {without}") + ")"

    parts = [None, *range(INNER_FOLDS)]
    columns = [F.expr(ones(part, label)).alias(f"n{label}_{i}") for i, part in enumerate(parts) for label in (1, 0)]
    sizes = sample.agg(*columns).first()
    counted = sample.select("label", "fold", F.explode("features").alias("feature")).groupBy("feature").agg(*columns)
    scores = {}
    for i in range(len(parts)):
        all_ones, all_zeros = sizes[f"n1_{i}"], sizes[f"n0_{i}"]
        n = float(all_ones + all_zeros)
        a, b = F.col(f"n1_{i}").cast("double"), F.col(f"n0_{i}").cast("double")
        c, d = all_ones - a, all_zeros - b
        off = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
        spread = F.greatest(F.lit(1.0), (a + b) * (c + d) * (a + c) * (b + d))
        scores[f"chi_square_{i}"] = F.when(a + b >= 3, n * off * off / spread).otherwise(0.0)
    telling = written(
        counted.withColumns(scores).select("feature", *scores).where(F.greatest(*scores) >= LEAST_CHI_SQUARE)
    )
    return [
        [row.feature for row in telling.where(F.col(by) >= LEAST_CHI_SQUARE).orderBy(F.desc(by), "feature").limit(limit).collect()]
        for by in scores
    ]


def kinds(rows: np.ndarray, target: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The kind of each row, 0 for the one with most rows, -1 for rows of label 0 and those without a telling feature.

    Features count by how much likelier they are with label 1. Centres start at the row with most weight and at those least
    like the centres so far; equal ones go to the first row.
    """
    of = np.full(len(rows), -1)
    ones, zeros = rows[target > 0], rows[target == 0]
    likelier = np.log((ones.sum(0) + 0.5) / (len(ones) + 1)) - np.log((zeros.sum(0) + 0.5) / (len(zeros) + 1))
    weighted = ones * np.maximum(0.0, likelier)
    length = np.linalg.norm(weighted, axis=1)
    described = length > 0
    points = weighted[described] / length[described, None]
    if not len(points):
        return of
    centres = points[[length[described].argmax()]]
    while len(centres) < min(groups, len(points)):
        centres = np.vstack([centres, points[[np.round(points @ centres.T, 9).max(axis=1).argmin()]]])
    nearest = np.zeros(len(points), int)
    for nth in range(KMEANS_ROUNDS):
        before, nearest = nearest, np.round(points @ centres.T, 9).argmax(axis=1)
        for i in range(len(centres)):
            if (nearest == i).any():
                total = points[nearest == i].sum(0)
                centres[i] = total / np.linalg.norm(total)
        if nth and (before == nearest).all():
            break
    sizes = np.bincount(nearest, minlength=len(centres))
    place = np.empty(len(centres), int)
    place[np.argsort(-sizes, kind="stable")] = np.arange(len(centres))
    of[np.flatnonzero(target > 0)[described]] = place[nearest]
    return of


def _model(rows: np.ndarray, target: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A logistic model of the ``used`` columns, the others having weight 0; never likely where nothing has the label."""
    weight = np.zeros(rows.shape[1] + 1)
    if not target.any():
        weight[-1] = -30.0
        return weight
    weight[np.append(used, True)] = logistic(rows[:, used], target)
    return weight


def learn(rows: np.ndarray, target: np.ndarray, fold: np.ndarray, features: list[str], used: np.ndarray) -> Chain:
    """The chain of labelled documents.

    ``rows`` has the presence of ``features``; ``used`` which of them the models of the whole sample read, and in further rows
    which those read that do not see a fold. Kinds are of the whole sample.
    """
    chain = Chain()
    if not len(target) or target.min() == target.max():
        return chain
    kind = kinds(rows[:, used[0]], target)
    for category in [*((kind == i).astype(float) for i in range(GROUPS)), target]:
        chain.weights.append(_model(rows, category, used[0]))
        apart = np.empty(len(target))
        for i in range(INNER_FOLDS):
            weight = _model(rows[fold != i], category[fold != i], used[1 + i])
            apart[fold == i] = _sigmoid(rows[fold == i] @ weight[:-1] + weight[-1])
        rows = np.hstack([rows, apart[:, None]])
        used = np.hstack([used, np.ones((len(used), 1), bool)])
    # what only the models of a fold read has weight 0
    read = np.flatnonzero(used[0, : len(features)])
    chain.column = {features[at]: i for i, at in enumerate(read)}
    chain.weights = [np.concatenate([weight[read], weight[len(features) :]]) for weight in chain.weights]
    return chain


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        found = [words(text) for text in batch.column("text").to_pylist()]
        features = [sorted({f for word in document for f in features_of(word)}) for document in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(features, pa.list_(pa.string()))],
            ["doc_id", "label", "features"],
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> Chain:
    """Learns from the documents that have one of about ``per_label`` labels of each kind; a third of the ids is held out.

    Features are counted and chosen by Spark, for each inner fold from the others; the driver gets the chosen ones, and which
    of them each document has.
    """
    picked = learnable(labels, label, per_label)
    of_sample = one_text_each(texts(docs).join(F.broadcast(picked), "doc_id"), "label")
    found = of_sample.select("doc_id", "label", "text").mapInArrow(_features, "doc_id long, label int, features array<string>")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(INNER_FOLDS)).cast("int")
    sample = written(found.withColumn("fold", fold))
    chosen = telling_features(sample)
    features = sorted({feature for part in chosen for feature in part})
    column = {feature: i for i, feature in enumerate(features)}
    used = np.zeros((len(chosen), len(features)), bool)
    for row, part in zip(used, chosen, strict=True):
        row[[column[feature] for feature in part]] = True
    mine = F.array_intersect("features", F.lit(features) if features else F.array().cast("array<string>"))
    documents = sample.select("label", "fold", mine.alias("features")).orderBy("doc_id").collect()
    rows = np.zeros((len(documents), len(features)))
    for row, document in zip(rows, documents, strict=True):
        row[[column[feature] for feature in document.features]] = 1
    target = np.array([document.label for document in documents], float)
    return learn(rows, target, np.array([document.fold for document in documents], int), features, used)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, a probability ``p_<category>`` each and ``toxic`` (last one >= 0.5).

    Reads ``doc_id`` and ``text`` only. A null or empty text has the models' base rates; a chain that had one label only
    gives zeros. Texts and words of any length are read whole; texts with the same words tie in all probabilities. Repeated rows
    each come back, ids may be null, an empty table gives an empty one. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{category}" for category in chain.categories]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = shared.value.columns()
        for batch in slices(batches):
            rows = shared.value.rows([words(text) for text in batch.column("text").to_pylist()], columns)
            found = shared.value.predict(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in found.T)], ["doc_id", *names]
            )

    schema = ", ".join(["doc_id long", *(f"{name} double" for name in names)])
    held_out = F.coalesce(id_crc32() % FOLDS == HELD_OUT, F.lit(False))
    toxic = F.when(F.col(names[-1]) >= 0.5, 1).otherwise(0)
    return texts(docs).mapInArrow(score, schema).select(
        "doc_id", held_out.alias("held_out"), *names, toxic.alias("toxic")
    )
