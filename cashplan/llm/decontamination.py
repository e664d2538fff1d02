"""Benchmark decontamination: benchmark windows as a broadcast hash set, looked up from every window of every text.

Words are numbered by the benchmark's vocabulary. A text's words outside it break windows; the windows that remain get a
hash of their numbers, are looked up in the sorted hashes and, where found, compared word by word.

The set is broadcast in blocks of a fixed number of windows. A benchmark of the usual size is one block; a larger one
makes more blocks, which the rows pass through one after the other. Between two blocks the rows are written to the shared
folder and the first block is destroyed, so that a Python worker holds one block whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashplan.llm.common import new_name, slices
from cashplan.session import written

WINDOW = 13
WINDOWS_PER_BLOCK = 200_000

#: Upper case to lower case; what is no digit, letter or part of a character beyond ASCII, to a space.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _windows(size: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words(text)
                width = min(size, len(found))
                rows += {(item, b" ".join(found[i : i + width])) for i in range(len(found) - width + 1) if width}
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary())],
                ["item", "window"],
            )

    return windows


class Index:
    """A block of benchmark windows, for one look-up after the other."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], list[str]] = {}
        for item, window in rows:
            key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.split())
            self.items.setdefault(key, []).append(item)
        self.hashes: dict[int, np.ndarray] = {}
        for width in {len(key) for key in self.items}:
            keys = np.array([key for key in self.items if len(key) == width], np.uint64)
            self.hashes[width] = np.unique((keys * _factors(width)).sum(axis=1, dtype=np.uint64))

    def find(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Marks the words inside a window, and the items whose windows occur."""
        n = len(found)
        hit, items = np.zeros(n, bool), set()
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.uint64, n)
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        for width, hashes in self.hashes.items():
            at = np.flatnonzero(known[width:] - known[:-width] == width) if n >= width else ()
            if not len(at):
                continue
            key = np.zeros(len(at), np.uint64)
            for i, factor in enumerate(_factors(width)):
                key += ids[at + i] * factor
            place = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            for start in at[hashes[place] == key].tolist():
                of = self.items.get(tuple(ids[start : start + width].tolist()))
                if of:
                    hit[start : start + width] = True
                    items.update(of)
        return hit, items


def _factors(width: int) -> np.ndarray:
    return np.resize(_FACTORS, width)


def benchmark_blocks(benchmark: DataFrame, window: int, per_block: int) -> Iterator[tuple[Index, bool]]:
    """The benchmark's windows, a block at a time, and whether it is the last. Items without an id or without words take no
    part."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")
    ).where("item IS NOT NULL AND text IS NOT NULL")
    found = written(items.mapInArrow(_windows(window), "item string, window binary").distinct())
    blocks = max(1, -(-found.count() // per_block))
    for block in range(blocks):
        mine = found.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == block)
        yield Index([(row.item, bytes(row.window)) for row in mine.collect()]), block == blocks - 1


_HITS = (
    T.StructType()
    .add("n_words", T.LongType())
    .add("spans", T.ArrayType(T.IntegerType()))
    .add("items", T.ArrayType(T.StringType()))
)
_ARROW_HITS = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)


def _runs(hit: np.ndarray) -> np.ndarray:
    """Starts and stops of the runs of marks, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))


def _look_up(index, text: str, name: str, keep: list[str]):
    """Adds a block's hits to those of the blocks before it."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            before = batch.column(name).to_pylist() if name in batch.schema.names else repeat(None)
            for value, old in zip(batch.column(text).to_pylist(), before, strict=False):
                found = words(value)
                hit, items = index.value.find(found)
                if old:
                    for start, stop in zip(old["spans"][::2], old["spans"][1::2], strict=True):
                        hit[start:stop] = True
                    items |= set(old["items"])
                rows.append({"n_words": len(found), "spans": _runs(hit).tolist(), "items": sorted(items)})
            hits = pa.array(rows, _ARROW_HITS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), hits], [*keep, name])

    return look


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str,
    keep: list[str] | None = None,
    window: int = WINDOW,
    per_block: int = WINDOWS_PER_BLOCK,
) -> DataFrame:
    """Documents (the columns ``keep``, by default all) with their hits in one column ``name``.

    It holds ``n_words``, ``spans`` (starts and stops of the runs of hit words, in turn) and ``items`` (ids, sorted).
    """
    keep = docs.columns if keep is None else keep
    out = docs.select(*dict.fromkeys([*keep, "text"]))
    for block, last in benchmark_blocks(benchmark, window, per_block):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        kept = keep if last else [c for c in out.columns if c != name]
        schema = T.StructType([*(out.schema[c] for c in kept), T.StructField(name, _HITS)])
        out = out.mapInArrow(_look_up(shared, "text", name, kept), schema)
        if not last:
            out = written(out)
            shared.destroy()
    return out


def _measures(hits: str) -> dict[str, F.Column]:
    n_hit = F.aggregate(
        F.transform(F.col(f"{hits}.spans"), lambda at, i: F.when(i % 2 == 1, at).otherwise(-at)),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return {"n_words": F.col(f"{hits}.n_words"), "n_hit": n_hit}


def contaminated(n_words, n_hit):
    """The rule: a twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    Reads ``doc_id`` and ``text`` (``item_id`` and ``text`` of the benchmark) only. A null or empty text has no words and
    is clean. Repeated rows each come back, repeated items count once, ids may be null. An empty benchmark contaminates
    nothing, an empty table gives an empty one.
    """
    found = with_hits(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        benchmark,
        "hits",
        ["doc_id"],
        **options,
    )
    measured = found.withColumns(_measures("hits"))
    return measured.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they are."""
    name = new_name(docs, "hits")
    measures = _measures(name)
    found = with_hits(docs, benchmark, name, **options)
    return found.where(~contaminated(measures["n_words"], measures["n_hit"])).select(docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, with the words that are hit, and what lies between them, cut out of the text."""
    name, names, schema = new_name(docs, "hits"), docs.columns, docs.schema
    found = with_hits(docs, benchmark, name, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [
                cut_words(text, hits["spans"])
                for text, hits in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(cut, schema)


def cut_words(text: str | None, spans: list[int]) -> str | None:
    """A text without the words in the spans."""
    if not spans:
        return text
    data = text.encode()
    bounds = _runs(np.frombuffer(data.translate(_WORDS), np.uint8) != 32).tolist()
    out, at = [], 0
    for start, stop in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at : bounds[2 * start]])
        at = bounds[2 * stop - 1]
    return b"".join([*out, data[at:]]).decode()


