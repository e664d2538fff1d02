"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits have a 64-bit string between them that is one bit from the one and
at most two from the other. Every fingerprint emits the strings within half the radius, the strings are shuffled,
and fingerprints that meet in one are linked. Which half a fingerprint gets follows from its parity, so that all
meeting points have an odd number of set bits:

* an even fingerprint emits the 64 strings one bit away;
* an odd one emits itself and the 2,016 strings two bits away.

Two even or two odd fingerprints two bits apart, and an even and an odd one, one or three bits apart, all meet in a
string that an even fingerprint emitted or that is itself a fingerprint. In such a string all that meet are within three
bits of the even (or own) one, so each is linked to that one, and no pairs are listed. Strings in which only odd
fingerprints meet, two bits from each, are dropped: the pairs among them that are close meet elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashplan.llm.common import new_name, slices, texts
from cashplan.llm.components import components
from cashplan.session import written

RADIUS = 3
BITS = 64
SHINGLE = 3
SEED = 42
HASHES_AT_ONCE = 1 << 16
#: A bucket of strings gets this many on average; one with more than the limit is split by further bits.
BUCKET = 1 << 20
BUCKET_LIMIT = 1 << 22
SPLIT_BITS = 6
LEAST_BITS, MOST_BITS = 6, 56

_U = np.uint64


def fingerprint(text: str | None) -> int:
    """Of the words' shingles, repeats included: a bit is set where it is set in over half of their hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(SHINGLE, len(words))
    starts, stops = (ends - lengths)[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        cut = map(slice, starts[at : at + HASHES_AT_ONCE].tolist(), stops[at : at + HASHES_AT_ONCE].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(SEED)), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(text.as_py()) for text in batch.column("text")], _U)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))],
            ["doc_id", "text_hash", "fp"],
        )


# Emitted strings travel together where they share their first bits: a row (bits, prefix, fp, left) stands for the
# strings that start with the prefix and have the fingerprint's other bits but for ``left`` of them.


def _spheres(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    odd = (np.bitwise_count(fp) & 1).astype(bool)
    all_fp = np.concatenate([fp[~odd], fp[odd], fp[odd]])
    left = np.repeat(np.array([1, 2, 0], np.int8), [(~odd).sum(), odd.sum(), odd.sum()])
    return np.zeros(len(all_fp), _U), all_fp, left


def _flips(width: int) -> tuple[list[int], list[int]]:
    one = [1 << i for i in range(width)]
    return one, [a | b for i, a in enumerate(one) for b in one[:i]]


def _refine(prefix, fp, left, start: int, stop: int):
    """Rows with prefixes of ``start`` bits to rows with prefixes of ``stop`` bits, for the same strings."""
    width = stop - start
    base = (prefix << _U(width)) | ((fp >> _U(BITS - stop)) & _U((1 << width) - 1))
    one, two = _flips(width)
    out = [(base, fp, left)]
    for masks, spent in ((one, 1), (two, 2)):
        may = left >= spent
        masks = np.array(masks, _U)
        out.append(
            (
                (base[may][:, None] ^ masks[None, :]).ravel(),
                np.repeat(fp[may], len(masks)),
                np.repeat(left[may] - np.int8(spent), len(masks)),
            )
        )
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _emit(first_bits: int, hot: list[np.ndarray]):
    def rows(prefix, fp, left, bits):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(fp), bits, np.int32)),
                pa.array(prefix.view(np.int64)),
                pa.array(fp.view(np.int64)),
                pa.array(left),
            ],
            ["bits", "prefix", "fp", "left"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            bits = first_bits
            found = _refine(*_spheres(batch.column("fp").to_numpy().view(_U)), 0, bits)
            for keys in hot:
                split = np.isin(found[0], keys)
                yield rows(*(x[~split] for x in found), bits)
                found = _refine(*(x[split] for x in found), bits, bits + SPLIT_BITS)
                bits += SPLIT_BITS
            yield rows(*found, bits)

    return emit


def _strings(base: np.ndarray, fp: np.ndarray, flips: list[int], among: np.ndarray | None = None):
    """Each base with each of the flips, and whose it is; with ``among``, only those that are in that sorted array."""
    masks = np.array(flips, _U)
    if among is not None:
        seen = np.zeros(1 << 22, bool)
        seen[_slot(among)] = True
    step = max(1, (1 << 20) // max(1, len(masks)))
    found, whose = [base[:0]], [fp[:0]]
    for at in range(0, len(base), step):
        strings = (base[at : at + step, None] ^ masks[None, :]).ravel()
        owners = np.repeat(fp[at : at + step], len(masks))
        if among is not None:
            may = np.flatnonzero(seen[_slot(strings)])
            strings, owners = strings[may], owners[may]
            at_most = np.minimum(np.searchsorted(among, strings), len(among) - 1)
            strings, owners = strings[is_in := among[at_most] == strings], owners[is_in]
        found.append(strings)
        whose.append(owners)
    return np.concatenate(found), np.concatenate(whose)


def _slot(strings: np.ndarray) -> np.ndarray:
    return ((strings * _U(0x9E3779B97F4A7C15)) >> _U(BITS - 22)).astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, each with the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _meet(bucket: pa.Table) -> pa.Table:
    """Links of the fingerprints that meet in a bucket's strings, as few as keep its components."""
    fp, left = bucket["fp"].to_numpy().view(_U), bucket["left"].to_numpy()
    free = BITS - bucket["bits"][0].as_py()
    head = bucket["prefix"].to_numpy().view(_U) << _U(free)
    base = head | (fp & _U((1 << free) - 1))
    odd = (np.bitwise_count(fp) & 1).astype(bool)
    own = odd & (left == 0) & (base == fp)
    one, two = _flips(free)
    centres = [
        (base[own], fp[own]),
        (base[~odd & (left == 0)], fp[~odd & (left == 0)]),
        _strings(base[~odd & (left == 1)], fp[~odd & (left == 1)], one),
    ]
    strings, whose = map(np.concatenate, zip(*centres, strict=True))
    order = np.lexsort((whose, strings))
    strings, whose = strings[order], whose[order]
    known, first = np.unique(strings, return_index=True)
    centre = whose[first]
    a, b = [whose], [centre[np.searchsorted(known, strings)]]
    if len(known):
        for steps, flips in ((0, [0]), (1, one), (2, two)):
            rows = odd & (left == steps) & ~own
            met, of = _strings(base[rows], fp[rows], flips, known)
            a.append(of)
            b.append(centre[np.searchsorted(known, met)])
    a, b = np.concatenate(a), np.concatenate(b)
    near = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)  # the check of each collision
    nodes, roots = forest(a[near], b[near])
    nodes, roots = nodes[nodes != roots], roots[nodes != roots]
    return pa.table({"a": nodes.view(np.int64), "b": roots.view(np.int64)})


def near_links(prints: DataFrame) -> DataFrame:
    """Distinct ``fp`` to links (``a``, ``b``) that hold every two fingerprints within the radius in one component.

    The first bits that strings are shuffled by grow with the number of fingerprints. A bucket that one dense group
    fills is split by further bits, down to single strings if need be, of which no fingerprint emits more than 2,017.
    """
    n = prints.count()
    bits = LEAST_BITS
    while n * 1040 >> bits > BUCKET and bits < MOST_BITS:
        bits += 1
    hot: list[np.ndarray] = []
    schema = "bits int, prefix long, fp long, left byte"
    while True:
        emitted = prints.select("fp").mapInArrow(_emit(bits, hot), schema)
        last = bits + SPLIT_BITS * len(hot)
        if last + SPLIT_BITS > MOST_BITS:
            break
        free = BITS - last
        strings = F.expr(f"CASE left WHEN 2 THEN {free * (free - 1) // 2} WHEN 1 THEN {free} ELSE 1 END")
        full = (
            emitted.where(F.col("bits") == last)
            .groupBy("prefix")
            .agg(F.sum(strings).alias("strings"))
            .where(F.col("strings") > BUCKET_LIMIT)
        )
        # at most one in four of the average buckets can be over the limit
        keys = np.array([row.prefix for row in full.select("prefix").collect()], np.int64).view(_U)
        if not len(keys):
            break
        hot.append(keys)
    return emitted.groupBy("bits", "prefix").applyInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id reachable.

    Reads ``doc_id`` and ``text`` only. A null or blank text has fingerprint zero and is linked like any other.
    Repeated rows each come back. A null doc_id comes back null, with the component of its fingerprint; it never names a
    component (which is null if no member has an id). An empty table gives an empty one.

    Copies share a fingerprint and count once in the search, so a group of copies of any size costs one row per task.
    """
    return _classed(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _classed(docs: DataFrame) -> DataFrame:
    """Each document's ``doc_id``, ``text_hash``, ``fp``, the ``root`` of its component and ``component_id``."""
    hashed = texts(docs).withColumn("text_hash", _text_hash())
    prints = written(hashed.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long"))
    members = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(members)).withColumnRenamed("node", "fp")
    rooted = written(
        members.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without their near-duplicates: of each class one of the smallest doc_id stays, once.

    All columns stay as they are. Where rows of one doc_id have different texts, each row goes by its own text, so no class
    vanishes. Rows without a doc_id are left in, as no decision can name them.
    """
    text_hash = new_name(docs, "text_hash")
    kept = (
        _classed(docs)
        .where("doc_id = component_id")
        .groupBy("doc_id", "root")
        .agg(F.min("text_hash").alias(text_hash))
        .drop("root")
    )
    named = docs.where("doc_id IS NOT NULL").withColumn(text_hash, _text_hash())
    once = named.join(kept, ["doc_id", text_hash], "left_semi").dropDuplicates(["doc_id", text_hash])
    return once.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
