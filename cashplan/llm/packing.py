"""Best-fit packing of documents into training sequences, online and in bounded space.

A packer holds a fixed number of open sequences, listed by their free space in a bitset: the least free space that takes a
piece is the lowest set bit at or above its length. A piece that fits nowhere opens a sequence; with all places taken, the
fullest open one closes first. Pieces are dealt to packers by a hash and arrive in the order of a hash, so a long run of
equal lengths does not meet one packer, and a task that is run again gives every piece the same place.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan.llm.common import Cache, slices, texts
from cashplan.llm.tokens import LONGEST_PIECE_KEPT, PIECES_KEPT, compiled, piece_of
from cashplan.session import written

CAPACITY = 1024
END_ID = 2
OPEN = 1024
PIECES_PER_PACKER = 1 << 17

#: Texts whose pieces are looked up together, as one piece is then looked up once for all of them.
TEXTS_AT_ONCE = 512

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Packer:
    """Places piece lengths of 1 to ``capacity``, one after the other."""

    def __init__(self, capacity: int = CAPACITY, places: int = OPEN):
        self.capacity, self.places = capacity, places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.sequences = 0

    def _take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.sequences
            self.sequences += 1
            if self.open == self.places and length < free:
                self._take((self.bits & -self.bits).bit_length() - 1)
        if rest := free - length:
            self.by_free[rest].append(sequence)
            self.bits |= 1 << rest
            self.open += 1
        return sequence, self.capacity - free


class _Ids:
    """Ids of text pieces as bytes, by the tokenizer's library; worked out once for each piece, named by its key.

    Pieces not known yet are put in the library's characters all at once.
    """

    def __init__(self, path: str):
        tokenizer = compiled(path)
        self.shown = {byte: char for char, byte in tokenizer.byte_of.items()}
        self.tokenize = tokenizer.library.model.tokenize
        self.kept = Cache(lambda key: self._worked_out([key])[0], PIECES_KEPT, LONGEST_PIECE_KEPT)

    def _worked_out(self, keys: list[int | str]) -> list[bytes]:
        apart = b"\xff"  # a byte that no text in UTF-8 has
        shown = apart.join(map(str.encode, map(piece_of, keys))).decode("latin-1").translate(self.shown)
        tokenize = self.tokenize
        return [
            array("I", [token.id for token in tokenize(piece)]).tobytes()
            for piece in shown.split(self.shown[apart[0]])
        ]

    def __call__(self, keys: list[int | str]) -> list[bytes]:
        found = list(map(self.kept.get, keys))
        if lacking := [i for i, ids in enumerate(found) if ids is None]:
            new = [keys[i] for i in lacking]
            for i, key, ids in zip(lacking, new, self._worked_out(new), strict=True):
                found[i] = ids
                self.kept.keep(key, ids)
        return found


@lru_cache(maxsize=1)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def _plain_ids(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of texts without special tokens: those of the distinct pieces, gathered in the order of all pieces."""
    of = _ids(path)
    for distinct, pieces, stops in compiled(path).distinct_pieces(texts):
        found = of(distinct)
        table = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(lengths) - lengths
        of_piece = lengths[pieces]
        after = np.cumsum(of_piece)
        at = np.repeat(starts[pieces] - after + of_piece, of_piece)
        at += np.arange(len(at))
        flat = table[at]
        after = np.concatenate([[0], after])[stops]
        for start, stop in zip([0, *after.tolist()], after.tolist(), strict=False):
            yield flat[start:stop]


def token_ids(docs: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text, as unsigned little-endian 32-bit numbers."""
    parts = [compiled(path).parts(text) for text in docs]
    plain = _plain_ids([x for some in parts for x in some if isinstance(x, str)], path)
    return [
        next(plain)
        if len(some) == 1
        else np.concatenate([np.array([x], "<u4") if isinstance(x, int) else next(plain) for x in some])
        for some in parts
    ]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and stops of the pieces of ``n`` tokens: whole ones, but for the first."""
    first = n % capacity or min(n, capacity)
    stops = range(first, n + 1, capacity)
    return [(max(0, stop - capacity) if stop > first else 0, stop) for stop in stops]


def _cutter(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS_AT_ONCE):
            rows = []
            found = token_ids([text or "" for text in batch.column("text").to_pylist()], path)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                for piece, (start, stop) in enumerate(cut(len(ids) + 1, capacity)):
                    crc = zlib.crc32(ids[start:stop])
                    if stop > len(ids):
                        crc = zlib.crc32(end, crc)
                    rows.append((doc_id, piece, start, stop - start, crc))
            doc, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


def _packer(capacity: int, places: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, places)
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [packer.place(length) for length in batch.column("length").to_pylist()]
            sequence = np.array([x[0] for x in placed], np.int64) + first
            offset = np.array([x[1] for x in placed], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(offset)],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return pack


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    places: int = OPEN,
    pieces_per_packer: int = PIECES_PER_PACKER,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    Reads ``doc_id`` and ``text`` only. A document is its ids and the end id; a null or empty text is the end id alone. Only
    longer ones are cut, the first piece being the shorter one. Repeated rows are packed each. A null doc_id stays null.
    An empty table gives an empty one. Sequence ids are any numbers; offsets in a sequence leave no gap.

    Texts are turned to pieces where they are read; only the pieces' lengths are shuffled. A packer gets a fixed
    number of pieces on average, so there are more packers with more data, and what their last sequences leave free
    stays a fixed small share.
    """
    pieces = written(texts(docs).mapInArrow(_cutter(tokenizer_path, capacity, end_id), _PIECES))
    packers = max(1, -(-pieces.count() // pieces_per_packer))
    # dealt by place in the written table, as one id, a null one too, may hold many rows; the place stays when a task runs again
    placed = pieces.withColumn("row", F.monotonically_increasing_id())
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = placed.repartition(packers, "row").sortWithinPartitions(order, "row").drop("row")
    return dealt.mapInArrow(_packer(capacity, places), f"{_PIECES}, sequence_id long, offset long")
