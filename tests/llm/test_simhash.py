import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cashplan.llm import simhash
from cashplan.llm.components import components
from cashplan.session import written


def plain_fingerprint(text):
    words = [w for w in re_split(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def re_split(text):
    import re

    return re.split(r"[\x20\x09-\x0D]+", text)


def roots(prints):
    """Components of fingerprints by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def groups(of):
    out = {}
    for node, root in of.items():
        out.setdefault(root, set()).add(node)
    return sorted(map(sorted, out.values()))


def test_fingerprints():
    for text in ["", " \t", "One", "one TWO", "a b c", "ÀB c\x0bd\x1ce é", "x y z " * 50, "ÉCOLE école"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0
    assert simhash.fingerprint("A b\nC d") == simhash.fingerprint("a B  c D")


def dense(rng, n):
    """Fingerprints, many of them close: chains of small steps, a crowded ball and far ones."""
    found = {rng.getrandbits(64) for _ in range(n // 4)}
    centre = rng.getrandbits(64)
    while len(found) < 3 * n // 4:
        found.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6]))))
    at = rng.getrandbits(64)
    while len(found) < n:
        at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
        found.add(at)
    return sorted(found)


def test_links_join_what_is_within_three_bits(spark, make_docs, monkeypatch):
    prints = dense(random.Random(5), 400)
    frame = written(spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long"))
    want = groups(roots(prints))
    for limit in (simhash.BUCKET_LIMIT, 2000):  # the second splits crowded buckets, more than once
        monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(frame).collect()]
        assert all((a ^ b) and a in set(prints) and b in set(prints) for a, b in links)
        rows = components(spark.createDataFrame([(a - (a >> 63 << 64), b - (b >> 63 << 64)) for a, b in links], "a long, b long"))
        of = {p: p for p in prints} | {r.node % 2**64: r.root % 2**64 for r in rows.collect()}
        assert groups(of) == want


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300) if i % 100 != 99] + [(1000, j) for j in range(1001, 1040)]
    rng.shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: i // 100 * 100 for i in range(301) if i % 100} | {j: 1000 for j in range(1001, 1040)}
    want[300] = 200 if (299, 300) in links else 300
    assert {k: found.get(k, k) for k in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_against_brute_force(make_docs):
    rng = random.Random(11)
    base = [" ".join(rng.choices("abcdefghij", k=300)) for _ in range(6)]
    texts = base + base[:3] + [t.replace("a b", "a x b", 1) for t in base] + [t + " end" for t in base] + ["", None, "  "]
    docs = [(100 - i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(docs)).collect()}
    prints = {i: plain_fingerprint(t or "") for i, t in docs}
    root = roots(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(least.get(root[p], i), i)
    assert got == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


def test_odd_rows(odd_docs, no_docs):
    got = sorted(
        ((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()), key=str
    )
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (3, 2), (5, 2), (None, 2), (4, 4)], key=str)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(kept.select(F.coalesce("doc_id", F.lit(-1)).alias("i")).toPandas().i) == [-1, -1, 1, 2, 4]


def test_rows_of_one_id_go_by_their_own_texts(make_docs):
    """No class vanishes: id 5 stands for two of them, and its third row belongs to that of id 3."""
    one, two, three = (" ".join(f"{w}{i * i}" for i in range(60)) for w in "pqr")
    docs = make_docs([(3, one), (5, one), (5, two), (5, three), (5, three), (6, two)])
    kept = sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect())
    assert kept == sorted([(3, one), (5, two), (5, three)])
