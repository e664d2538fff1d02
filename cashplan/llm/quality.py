"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text is the counts of hashed features: each token's shape, short tokens and the ends of long ones, and coarse figures on
repetition and length. Document frequencies are counted over all documents. The weighted counts of a bounded number of
labelled documents are decomposed; the leading directions make the vectors. The labelled vectors are broadcast, every
document's cosines with all of them are computed in blocks, and the nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan.llm.common import Cache, hash01, id_crc32, slices, texts

FEATURES = 1 << 13
DIRECTIONS = 48
NEIGHBOURS = 15
TOKENS_KEPT = 400_000
#: The bound of what is learnt from: labelled documents of each label.
PER_LABEL = 600
FOLDS, HELD_OUT = 3, 1
LONGEST_TOKEN_KEPT = 64
#: Cosines that agree to this many digits are equal, however many documents are multiplied at once.
COSINE_DIGITS = 5
_SIGNS = ".,;:!?|*&%$#@+-=_/\\<>[]{}\"'()"
_RUNS = (
    (re.compile(r"[^\W\d_]+"), lambda run: "A" if run[0].isupper() else "a"),
    (re.compile(r"\d+"), lambda _: "9"),
    (re.compile(r"(.)\1+", re.DOTALL), lambda run: run[1]),
)


def _slot(feature: str) -> int:
    return crc32(feature.encode()) % FEATURES


def _shape(token: str) -> str:
    """A token with each run of letters, capitals, digits or of one sign as one sign."""
    for pattern, sign in _RUNS:
        token = pattern.sub(sign, token)
    return token


def _of_token(token: str) -> int:
    """Slots of a token's shape, and of its bare word or that word's end, in one number."""
    bare = token.strip(_SIGNS)
    if bare.isalpha():  # the usual case, without a pattern
        start, _, stop = token.partition(bare)
        shape = f"{start[:2]}{'A' if bare.isupper() else 'a'}{stop[:2]}"
    else:
        shape = _shape(token)
    bare = bare.lower()
    word = f"word {bare}" if len(bare) <= 4 else f"end {bare[-3:]}"
    return _slot(f"shape {shape}") * FEATURES + _slot(word)


class Reader:
    """Texts to features; what tokens come to is kept."""

    def __init__(self):
        self.slots = Cache(_of_token, TOKENS_KEPT, LONGEST_TOKEN_KEPT)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and how often each occurs."""
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        found = np.fromiter(map(self.slots.__getitem__, tokens), np.int64, len(tokens))
        figures = [_slot(f"{name} {value}") for name, value in _figures(text, tokens)]
        counts = np.bincount(found // FEATURES, minlength=FEATURES) + np.bincount(found % FEATURES, minlength=FEATURES)
        counts = counts.astype(float)
        counts[figures] += max(1, len(tokens) // 8)
        slots = np.flatnonzero(counts)
        return slots, counts[slots]


def _figures(text: str, tokens: list[str]) -> list[tuple[str, int]]:
    lines = text.split("\n")
    most = Counter(lines).most_common(1)[0][1]
    return [
        ("distinct", int(10 * len(set(tokens)) / len(tokens))),
        ("repeated line", min(4, most)),
        ("lines", int(4 * len(set(lines)) / len(lines))),
        ("tokens", len(tokens).bit_length()),
    ]


@dataclass
class Model:
    weight: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def vector(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The latent vector, of length one; zero for a text without features."""
        if not len(slots):
            return np.zeros(self.directions.shape[1], np.float32)
        found = (np.log1p(counts) * self.weight[slots]) @ self.directions[slots]
        return (found / (np.linalg.norm(found) or 1.0)).astype(np.float32)

    def scores(self, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The labels of the nearest labelled vectors, weighted by cosine; those that tie for the last places share them."""
        if not len(self.labels) or not features:
            return np.full(len(features), self.prior)
        cosine = np.round(np.array([self.vector(*x) for x in features]) @ self.vectors.T, COSINE_DIGITS)
        n = min(NEIGHBOURS, len(self.labels))
        last = np.partition(cosine, len(self.labels) - n, axis=1)[:, [len(self.labels) - n]]
        row, near = np.nonzero(cosine >= last)
        weight = np.maximum(cosine[row, near], 0).astype(float) ** 4
        ties = cosine[row, near] == last[row, 0]
        tied = np.bincount(row[ties], minlength=len(cosine))
        weight[ties] *= ((n - np.bincount(row[~ties], minlength=len(cosine))) / tied)[row[ties]]
        total = np.bincount(row, weight, len(cosine))
        voted = np.bincount(row, weight * self.labels[near], len(cosine)) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, voted, self.prior), 0.0, 1.0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents: how many there are (slot -1), and how many have each slot."""
    reader, seen, n = Reader(), np.zeros(FEATURES, np.int64), 0
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            seen[reader.counts(text)[0]] += 1
            n += 1
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], ["slot", "n"]
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in slices(batches):
        found = [reader.counts(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()),
                pa.array([x.astype("<f8").tobytes() for _, x in found], pa.binary()),
            ],
            ["doc_id", "slots", "counts"],
        )


def learnable(labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """``doc_id`` and ``label`` (0 or 1) of a bounded sample of the labels that are not held out.

    Labels that are null or no 0 or 1 and documents with several labels that differ are left out.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(id_crc32() % FOLDS != HELD_OUT)
        .where("label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
    )
    counts = {row.label: row["count"] for row in one.groupBy("label").count().collect()}
    if not counts:
        return one.limit(0)
    share = F.coalesce(*(F.when(F.col("label") == x, min(1.0, 1.5 * per_label / n)) for x, n in counts.items()))
    return one.where(hash01("doc_id") < share).orderBy(hash01("doc_id"), "doc_id").limit(4 * per_label)


def one_text_each(docs: DataFrame, *others: str) -> DataFrame:
    """Of rows that share a ``doc_id`` one text, the same one in every run; ``others`` must be alike in these rows."""
    return docs.groupBy("doc_id", *others).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def decompose(
    sample: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, directions: int = DIRECTIONS
) -> Model:
    """The model of labelled documents (label, slots, counts)."""
    labels = np.array([label for label, _, _ in sample], float)
    rows = np.zeros((len(sample), FEATURES), np.float32)
    for row, (_, slots, counts) in zip(rows, sample, strict=True):
        found = np.log1p(counts) * weight[slots]
        row[slots] = found / (np.linalg.norm(found) or 1.0)
    if not len(sample):
        return Model(weight, np.zeros((FEATURES, 0), np.float32), rows[:, :0], labels, 0.5)
    value, vector = np.linalg.eigh((rows @ rows.T).astype(float))
    kept = np.argsort(-value)[:directions]
    kept = kept[value[kept] > 1e-9 * max(value.max(), 1e-30)]
    model = Model(weight, rows.T @ (vector[:, kept] / np.sqrt(value[kept])).astype(np.float32), rows, labels, labels.mean())
    model.vectors = np.array([model.vector(slots, counts) for _, slots, counts in sample], np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Learns from the documents that have one of at most ``per_label`` labels of each kind, none of them held out."""
    docs = texts(docs)
    counts = docs.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    seen = {row.slot: row.n for row in counts.collect()}  # a row for each slot at most
    n = seen.pop(-1, 0)
    weight = np.full(FEATURES, np.log(n + 1.0) + 1)
    for slot, many in seen.items():
        weight[slot] = np.log((n + 1.0) / (many + 1.0)) + 1
    picked = learnable(labels, label, per_label)
    sample = one_text_each(docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi"))
    of = {row.doc_id: row.label for row in picked.collect()}
    rows = {0: [], 1: []}
    found = sample.mapInArrow(_counted, "doc_id long, slots binary, counts binary").collect()
    for row in sorted(found, key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id)):
        some = rows[of[row.doc_id]]
        if len(some) < per_label:
            some.append(
                (of[row.doc_id], np.frombuffer(row.slots, "<i4").astype(np.int64), np.frombuffer(row.counts, "<f8"))
            )
    return decompose(rows[0] + rows[1], weight)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Scores read the text alone. A null or empty text, one unlike any labelled document, and a model without labels give
    the share of label 1 in what was learnt from (0.5 without labels). Labelled texts at one cosine (to five digits) that tie
    for the last places among the nearest share these, whatever their order. Repeated rows each come back, ids may be null
    (not held out), an empty table gives an empty one. Texts and tokens of any length are read whole. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in slices(batches):
            found = shared.value.scores([reader.counts(text) for text in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    held_out = F.coalesce(id_crc32() % FOLDS == HELD_OUT, F.lit(False))
    return texts(docs).mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is 0.5 or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in slices(batches):
            found = shared.value.scores([reader.counts(text) for text in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(found >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
