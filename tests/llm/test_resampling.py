"""Resampling against a plain version of it."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cashplan.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, run=1, least=20, percent=10):
    def runs(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    source, goal = Counter(b for _, t in docs for b in runs(t)), Counter(b for t in target for b in runs(t))
    all_source, all_goal = sum(source.values()), sum(goal.values())

    def gain(b):
        return math.floor(1000 * math.log((goal[b] + 1) * (all_source + 10_000) / ((source[b] + 1) * (all_goal + 10_000))))

    rows = []
    for doc_id, text in docs:
        found = runs(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, len(found), weight, score, None, len(words(text))])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(may[: percent * len(may) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Äpfel", "naïve", "X9", "don't", "a-b", "字", "ZZ"] + [f"w{i}" for i in range(300)]
    return [(i, ", ".join(rng.choices(vocabulary, k=rng.randint(0, 90)))) for i in range(n)]


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("run", [1, 3])
def test_weights_draw_and_ranks_are_the_plain_ones(spark, make_docs, monkeypatch, run):
    monkeypatch.setattr(resampling, "ROWS_PER_RANGE", 7)
    docs, target = corpus(1, 600), [t for _, t in corpus(2, 20)]
    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    frame = resampling.resampled(make_docs(docs).repartition(5), items, run=run)
    assert got(frame) == plain(docs, target, run)


def test_ties_and_repeated_rows(spark, make_docs):
    """Rows of one id and text tie in everything; each is drawn by itself, and exactly the wanted number is."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(7, text)] * 40 + [(None, text)] * 10 + [(-3, text)] * 2
    items = spark.createDataFrame([], "item_id string, text string")
    for percent in (10, 50, 90, 100):
        rows = resampling.resampled(make_docs(docs).repartition(4), items, percent=percent).collect()
        ranks = sorted(r["rank"] for r in rows if r["rank"])
        assert len(rows) == 52 and ranks == list(range(1, 52 * percent // 100 + 1))
        assert got(resampling.resampled(make_docs(docs), items, percent=percent)) == plain(docs, [], percent=percent)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([("a", None), (None, "a b c"), ("b", "")], "item_id string, text string")
    clash = odd_docs.withColumns({name: F.lit("clash") for name in ("weight", "rank", "place", "n_features", "bucket", "range", "nth")})
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(resampling.resampled(clash, items, least_words=1, percent=60)) == plain(docs, ["a b c"], least=1, percent=60)
    assert got(resampling.resampled(no_docs, items)) == []


def test_long_texts_are_cut_between_words(monkeypatch):
    text = (" ".join(f"wörd{i % 7}" for i in range(3000)) + "x" * 900 + "--" + "y" * 5000).encode()
    whole = [w.encode() for w in words(text.decode())]
    for size in (1, 2, 10, 997):
        monkeypatch.setattr(resampling, "BYTES_AT_ONCE", size)
        assert [w for part in resampling.word_lists(text) for w in part] == whole
        runs = sorted(b for _, found in resampling.run_buckets(text, 3) for b in found.tolist())
        assert runs == sorted(zlib.crc32(b" ".join(whole[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(whole) - n + 1))


def test_bisection_finds_the_cutoff(spark):
    rng = random.Random(3)
    values = [rng.choice([-(10**15), -5, 0, 0, 1, 7, 10**12]) + rng.randint(0, 3) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    for wanted in (1, 2, 50, 299, 300):
        cutoff, above = resampling.highest_reaching(rows, "v", wanted)
        assert cutoff == sorted(values, reverse=True)[wanted - 1] and above == sum(v > cutoff for v in values)


def test_drawn_documents_keep_their_columns(spark, make_docs):
    docs = make_docs(corpus(4, 200))
    items = spark.createDataFrame([("a", "w1 w2 w3")], "item_id string, text string")
    ranked = resampling.resampled(docs, items)
    kept = resampling.drawn(docs, ranked)
    assert kept.columns == docs.columns and kept.count() == ranked.where("rank IS NOT NULL").count() > 0
