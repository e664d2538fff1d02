"""Language identification by string kernels.

The kernel of two texts is the number of distinct character n-grams (one to three characters) that they share, over the
root of the product of their own numbers. N-grams are hashed to slots; two that share a slot count as one. Nyström
landmarks, some labelled texts of each language, turn the kernel into features; one ridge regression for each
language against the rest is solved in them. A text's scores are linear in its n-grams, so that a batch of texts is scored
by one product of its presence matrix and a matrix of slot weights, which the landmarks and regressions fold into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan.llm.common import hash01, id_crc32, slices, texts

SLOT_BITS = 18
ORDERS = 3
CODES_AT_ONCE = 1 << 20
#: Bounds of what is learnt from: labelled texts per language, and landmarks among them.
PER_LANGUAGE = 250
LANDMARKS = 40
RIDGE = 1e-2
SHARPNESS = 4.0
UNDETERMINED = "und"
FOLDS, HELD_OUT = 5, 0

_U = np.uint64


def slots(text: str) -> np.ndarray:
    """The slots of a text's n-grams, sorted."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(_U)
    present = np.zeros(1 << SLOT_BITS, bool)
    for at in range(0, len(codes), CODES_AT_ONCE):
        part = codes[at : at + CODES_AT_ONCE + ORDERS - 1]
        key = np.zeros(len(part), _U)
        for order in range(min(ORDERS, len(part))):
            key = (key[: len(part) - order] << _U(21)) | part[order:]
            mixed = (key + _U(order + 1)) * _U(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> _U(32))) * _U(0xD6E8FEB86659FD93)
            present[(mixed >> _U(64 - SLOT_BITS)).astype(np.int64)] = True
    return np.flatnonzero(present)


@dataclass
class Model:
    languages: list[str]
    #: For each slot its row of ``weights``, or one row beyond, which is zero.
    row_of: np.ndarray
    weights: np.ndarray

    def predict(self, found: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(found), [0.0] * len(found)
        rows = [i for i, text in enumerate(found) if text and any(map(str.isalpha, text))]
        if not rows or not self.languages:
            return names, scores
        presence = np.zeros((len(rows), len(self.weights)), np.float32)
        sizes = np.empty(len(rows))
        for at, i in enumerate(rows):
            mine = slots(found[i])
            sizes[at] = len(mine)
            presence[at, self.row_of[mine]] = 1
        margins = (presence @ self.weights) / np.sqrt(sizes)[:, None]
        odds = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        for at, i in enumerate(rows):
            best = int(odds[at].argmax())
            names[i], scores[i] = self.languages[best], float(odds[at, best])
        return names, scores


def _matrix(rows: list[np.ndarray], row_of: np.ndarray, width: int) -> np.ndarray:
    """Presence, each row scaled to length one over all its slots."""
    out = np.zeros((len(rows), width), np.float32)
    for at, mine in enumerate(rows):
        out[at, row_of[mine]] = 1 / np.sqrt(max(1, len(mine)))
    return out


def solve(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of labelled texts (language, slots); ``landmarks`` for each language."""
    languages = sorted({language for language, _ in sample})
    marks = [x for language in languages for x in [s for lang, s in sample if lang == language][:landmarks]]
    row_of = np.zeros(1 << SLOT_BITS, np.int64)
    known = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    row_of[:] = len(known)
    row_of[known] = np.arange(len(known))
    width = len(known) + 1
    if len(languages) == 0:
        return Model([], row_of, np.zeros((width, 0), np.float32))
    grams = _matrix(marks, row_of, width)
    grams[:, -1] = 0
    texts_ = _matrix([s for _, s in sample], row_of, width)
    texts_[:, -1] = 0
    value, vector = np.linalg.eigh((grams @ grams.T).astype(float))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    features = (texts_ @ grams.T).astype(float) @ whiten
    targets = np.array([[1.0 if lang == language else -1.0 for language in languages] for lang, _ in sample])
    gram = features.T @ features + ridge * len(sample) * np.eye(features.shape[1])
    coefficients = whiten @ np.linalg.solve(gram, features.T @ targets)
    return Model(languages, row_of, (grams.T @ coefficients.astype(np.float32)).astype(np.float32))


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [slots(text).astype("<i4").tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("pick"), pa.array(found, pa.binary())], ["lang", "pick", "slots"]
        )


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Learns from ``text`` and ``lang`` of the documents that are not held out, at most ``per_language`` of each language."""
    labelled = docs.where(id_crc32() % FOLDS != HELD_OUT).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {row.lang: row["count"] for row in labelled.groupBy("lang").count().collect()}
    if not counts:
        return solve([])
    share = F.coalesce(
        *(F.when(F.col("lang") == lang, min(1.0, 1.5 * per_language / n)) for lang, n in counts.items())
    )
    picked = (
        labelled.where(hash01("doc_id") < share)
        .select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("pick"), F.col("text").cast("string"))
        .mapInArrow(_slots_of, "lang string, pick long, slots binary")
        .orderBy("pick", "lang", "slots")
        .limit(2 * per_language * len(counts))
    )
    sample: dict[str, list] = {}
    for row in picked.collect():
        some = sample.setdefault(row.lang, [])
        if len(some) < per_language:
            some.append((row.lang, np.frombuffer(row.slots, "<i4").astype(np.int64)))
    return solve([x for lang in sorted(sample) for x in sample[lang]], landmarks)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1).

    Predictions read the text alone. ``und`` with score 0 stands for a null text, one without a letter, and for a model
    that had nothing to learn from. Equal scores go to the first language by name. Repeated rows each come back, ids may
    be null (not held out), an empty table gives an empty one. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    found = texts(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(id_crc32() % FOLDS == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
