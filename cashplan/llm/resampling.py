"""Importance resampling towards a target distribution of hashed word runs.

* Weights: two passes count the runs of all documents and of the target by bucket. The buckets' log ratios are one array of
  fixed size, which every task holds; a document's weight is the sum of the array at its runs' buckets.
* Draw: a document's score is its weight plus noise that follows from its id (the Gumbel trick: the highest scores are a
  sample without replacement). The cutoff is found by bisection: jobs count, exactly, how many of the written scores lie at or
  above a few thresholds, and the bounds close in until one score is left; the same among that score's ids, then among
  that id's rows. Nothing is sorted for it, and no task gathers more than counts.
* Ranks: what was drawn is range-partitioned by (score, id, place) and numbered partition by partition.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashplan.llm.common import slices, texts
from cashplan.session import written

BUCKETS = 10_000
RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Thresholds that one job counts at: four steps of bisection at once.
THRESHOLDS = 15
#: Bytes of a text that are cut into words at a time.
BYTES_AT_ONCE = 1 << 20
#: Drawn rows that a task numbers, on average.
ROWS_PER_RANGE = 1 << 20

# Fixed rule: A-Z become a-z; what is neither a digit, a letter nor beyond ASCII parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PARTING = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch of it (and the word that it ends in) at a time."""
    start = 0
    while start < len(text):
        end = _PARTING.search(text, start + BYTES_AT_ONCE)
        stop = end.end() if end else len(text)
        yield text[start:stop].translate(_WORD_BYTES).split()
        start = stop


def run_buckets(text: bytes | None, run: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For stretches of a text, the number of their words and the buckets of the runs of 1 to ``run`` words."""
    tail: list[bytes] = []
    for words in word_lists(text or b""):
        crcs = list(map(zlib.crc32, words))
        joined = tail + words
        for length in range(2, run + 1):
            first = max(0, len(tail) - length + 1)
            ends = range(first + length, len(joined) + 1)
            crcs.extend(zlib.crc32(b" ".join(joined[end - length : end])) for end in ends)
        tail = joined[len(joined) - run + 1 :] if run > 1 else []
        yield len(words), np.array(crcs, np.int64) % buckets


def _texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _counter(run: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in _texts_of(batch):
                for _, found in run_buckets(text, run, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return count


def bucket_counts(rows: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all ``text`` each bucket gets; ``buckets`` numbers at most leave each task and reach the driver."""
    text = rows.select(F.col("text").cast("string").alias("text"))
    counted = text.mapInArrow(_counter(run, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counted.collect():
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of target to source, smoothed by one run a bucket, in whole thousandths."""
    buckets = len(source)
    all_source, all_target = float(source.sum()) + buckets, float(target.sum()) + buckets
    ratios = ((float(t) + 1) * all_source / ((float(s) + 1) * all_target) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in whole thousandths that follows from the id; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigher(gain: np.ndarray, run: int, seed: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts_of(batch), strict=True):
                words = features = weight = 0
                for n, found in run_buckets(text, run, len(gain)):
                    words += n
                    features += len(found)
                    weight += int(gain[found].sum())
                rows.append((words, features, weight, weight + noise(doc_id, seed)))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight", "score"]
            )

    return weigh


def weighed(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of each document, written to the shared folder, with the
    row's ``place`` in it."""
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    scored = texts(docs).mapInArrow(_weigher(gain, run, seed), schema)
    return written(scored.withColumn("place", F.monotonically_increasing_id()))


def highest_reaching(rows: DataFrame, value: str, wanted: int) -> tuple[int, int]:
    """The greatest number that at least ``wanted`` rows' values reach, and how many values are above it.

    Jobs that count at a few thresholds halve the range between them again and again; ``wanted`` is 1 or more, and no
    more than there are rows.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()  # all reach the low end
    above = 0
    while low < high:
        width = high - low
        steps = sorted({low + width * i // (THRESHOLDS + 1) + 1 for i in range(THRESHOLDS + 1)})
        reach = [F.coalesce(F.sum((F.col(value) >= step).cast("long")), F.lit(0)).alias(f"t{i}") for i, step in enumerate(steps)]
        counts = list(rows.where(F.col(value) >= steps[0]).agg(*reach).first())
        passed = sum(count >= wanted for count in counts)  # counts fall
        if passed < len(steps):
            high, above = steps[passed] - 1, counts[passed]
        if passed:
            low = steps[passed - 1]
    return low, above


def _cutoff(eligible: DataFrame, wanted: int) -> Column:
    """Which rows are the ``wanted`` first by falling score, then rising id (nulls last), then rising place."""
    score, above = highest_reaching(eligible, "score", wanted)
    tied = eligible.where(F.col("score") == score)
    drawn = F.col("score") > score
    wanted -= above
    named = tied.where("doc_id IS NOT NULL").select((-F.col("doc_id")).alias("back"), (-F.col("place")).alias("place"))
    of_named = named.count()
    ties = F.col("score") == score
    if wanted <= of_named:
        back, above = highest_reaching(named, "back", wanted)
        wanted -= above
        drawn = drawn | (ties & (F.col("doc_id") < -back))
        place, _ = highest_reaching(named.where(F.col("back") == back), "place", wanted)
        last = F.col("doc_id") == -back
    else:
        nameless = tied.where("doc_id IS NULL").select((-F.col("place")).alias("place"))
        drawn = drawn | (ties & F.col("doc_id").isNotNull())
        place, _ = highest_reaching(nameless, "place", wanted - of_named)
        last = F.col("doc_id").isNull()
    return F.coalesce(drawn, F.lit(False)) | F.coalesce(ties & last & (F.col("place") <= -place), F.lit(False))


def _ranked(drawn: DataFrame, n: int) -> DataFrame:
    """Rows with their ``rank``, by ranges that are numbered each and start where those before end."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place"))
    ranges = drawn.repartitionByRange(max(1, -(-n // ROWS_PER_RANGE)), *order).sortWithinPartitions(*order)
    laid = written(ranges.withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}))
    sizes = laid.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.min("nth").alias("first"))  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("nth") - F.col("first") + 1
    return laid.join(F.broadcast(starts), "range").withColumn("rank", rank).drop("range", "nth", "first", "before")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    run: int = RUN,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn), all long.

    Reads ``doc_id`` and ``text`` of ``docs`` and ``text`` of ``target`` only. Null and empty texts have no words, a weight of
    zero and their noise as score. Texts of any length are cut into words a stretch at a time. Repeated rows count
    and may be drawn each. Of equal scores the smaller doc_id comes first, null ids last, and among rows of one id the one that
    lies first in the written scores. An empty table gives an empty one; an empty target has all buckets at its smoothing.
    """
    scored = weighed(docs, target, run, buckets, seed)
    eligible = scored.where(F.col("n_words") >= least_words)
    wanted = percent * eligible.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*columns, no_rank)
    is_drawn = (F.col("n_words") >= least_words) & _cutoff(eligible, wanted)
    ranked = _ranked(scored.where(is_drawn), wanted)
    return ranked.select(*columns, F.col("rank").cast("long").alias("rank")).unionByName(
        scored.where(~is_drawn).select(*columns, no_rank)
    )


def drawn(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The documents that were drawn, in all their columns; rows of a drawn id come all, null ids never."""
    ids = ranked.where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(docs.columns)
