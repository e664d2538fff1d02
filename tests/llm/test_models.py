"""Language, quality, toxicity and search."""

import math
import operator
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashplan.llm import language, quality, top_k, toxicity

WORDS = {"en": "the and of with ing tion that".split(), "fr": "le la une dans eau ment quel".split(), "de": "der die und sch ung keit eine".split()}


def sentences(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(WORDS[lang], k=2)) for _ in range(20)), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_kernels_are_those_of_shared_grams():
    a, b = "abcab", "bcd é"
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in (a, b)]
    slots = [set(language.slots(t).tolist()) for t in (a, b)]
    assert [len(s) for s in slots] == [len(g) for g in grams]
    assert len(slots[0] & slots[1]) == len(grams[0] & grams[1])


def test_folded_weights_score_as_the_kernel_does():
    sample = [(lang, language.slots(text)) for _, text, lang in sentences(1, 60)]
    model = language.solve(sample, landmarks=5, ridge=1e-3)
    marks = [s for lang in model.languages for s in [s for x, s in sample if x == lang][:5]]

    def kernel(x, y):
        return len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y))

    value, vector = np.linalg.eigh(np.array([[kernel(x, y) for y in marks] for x in marks]))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    rows = np.array([[kernel(x, y) for y in marks] for _, x in sample]) @ whiten
    targets = np.array([[1.0 if x == lang else -1.0 for lang in model.languages] for x, _ in sample])
    solved = np.linalg.solve(rows.T @ rows + 1e-3 * len(sample) * np.eye(rows.shape[1]), rows.T @ targets)
    for _, text, _ in sentences(2, 10):
        x = language.slots(text)
        margins = np.array([kernel(x, y) for y in marks]) @ whiten @ solved
        names, _ = model.predict([text])
        assert names[0] == model.languages[int(margins.argmax())]


def test_language_is_learnt_from_what_is_not_held_out(spark, make_docs, odd_docs, no_docs):
    rows = sentences(3, 400)
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], make_docs([]).schema)
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    model = language.fit(wrong)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.predicted(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].lang_pred, x) for i, _, x in rows if got[i].held_out]
    assert sum(a == b for a, b in held) > 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    odd = language.predicted(odd_docs, model).collect()
    assert len(odd) == 8 and {r.lang_pred for r in odd if r.doc_id in (2, 3, 5)} == {"und"}
    assert language.predicted(no_docs, model).count() == 0
    assert {r.lang_pred for r in language.predicted(odd_docs, language.fit(odd_docs)).collect()} == {"und"}


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choices(["th", "er", "on", "an", "re", "ou"], k=rng.randint(1, 4))) for _ in range(40)]
        junk, rude = i % 5 == 0, i % 4 == 0
        if junk:
            words = [f"{w.upper()}!!" if i % 2 else f"{w}***" for w in words]
        if rude:
            words[rng.randrange(40)] = rng.choice([["glonk", "vrimmel"], ["zapfod", "quorbis"]][i % 8 > 0])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(rude)))
    labels += [(0, 1, 1), (None, 1, 0), (7, None, None), (1, 1, 0)]  # a conflict, nulls and a repeated row
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, column, label):
    of = {r.doc_id: r[label] for r in labels.collect() if r.doc_id and r[label] is not None}
    held = [(r[column], of[r.doc_id]) for r in rows if r.held_out and r.doc_id in of]
    return sum(a == b for a, b in held) / len(held)


def test_quality_on_what_is_held_out(labelled, odd_docs, no_docs):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 600 and accuracy(rows, labels, "predicted", "quality") > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    assert quality.scored(odd_docs, model).count() == 8 and quality.scored(no_docs, model).count() == 0
    assert quality.accepted(odd_docs, model).columns == odd_docs.columns
    none = quality.fit(no_docs, labels.limit(0))
    assert {r.score for r in quality.scored(odd_docs, none).collect()} == {0.5}


def test_quality_votes_are_those_of_the_nearest(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    reader = quality.Reader()
    text = docs.where("doc_id = 3").first().text
    vector = model.vector(*reader.counts(text)).astype(float)
    cosine = model.vectors.astype(float) @ vector
    nearest = np.argsort(-cosine)[: quality.NEIGHBOURS]
    weight = np.maximum(cosine[nearest], 0) ** 4
    assert model.scores([reader.counts(text)])[0] == pytest.approx((weight * model.labels[nearest]).sum() / weight.sum(), abs=1e-4)


def test_votes_of_ties_do_not_depend_on_the_order():
    """Forty labelled vectors at one cosine, half of them with label 1."""
    vectors = np.tile(np.array([[0.6, 0.8]], np.float32), (40, 1))
    labels = np.repeat([1.0, 0.0], 20)
    for order in (slice(None), slice(None, None, -1)):
        model = quality.Model(np.ones(quality.FEATURES), np.eye(quality.FEATURES, 2, dtype=np.float32), vectors[order], labels[order], 0.5)
        assert model.scores([(np.array([0, 1]), np.array([3.0, 1.0]))])[0] == pytest.approx(0.5)
    # one nearer vector, and the places that it leaves are shared by the others
    vectors[7] = [1.0, 0.0]
    model = quality.Model(np.ones(quality.FEATURES), np.eye(quality.FEATURES, 2, dtype=np.float32), vectors, labels, 0.5)
    others = (quality.NEIGHBOURS - 1) * 0.6**4
    want = (1 + others * 19 / 39) / (1 + others)
    assert model.scores([(np.array([0]), np.array([1.0]))])[0] == pytest.approx(want, abs=1e-4)


def test_long_tokens_and_words_are_read_to_their_end():
    assert quality._of_token("a1" * 40 + "b") != quality._of_token("a1" * 40 + "!b")
    one, two = "x" * 24 + "yes", "x" * 24 + "no"
    assert toxicity.features_of(one)[0] != toxicity.features_of(two)[0] and toxicity.features_of(one[:24])[0] == one[:24]


def test_a_rerun_learns_the_same_of_rows_that_share_an_id(spark, make_docs):
    docs = make_docs([(1, "b"), (1, "a"), (1, None), (2, "c")])
    first = sorted(map(tuple, quality.one_text_each(docs.repartition(3)).collect()))
    assert first == sorted(map(tuple, quality.one_text_each(docs.orderBy("text").coalesce(1)).collect())) and len(first) == 2


def test_toxicity_on_what_is_held_out(labelled, odd_docs, no_docs):
    docs, labels = labelled
    chain = toxicity.fit(docs, labels)
    assert len(chain.weights) == len(toxicity.CATEGORIES)
    assert [len(w) for w in chain.weights] == [len(chain.column) + 1 + i for i in range(len(chain.weights))]
    rows, text = toxicity.scored(docs, chain).collect(), {r.doc_id: r.text for r in docs.collect()}
    assert accuracy(rows, labels, "toxic", "toxic") > 0.97
    kind = {w: {(r.p_kind1 > 0.5) for r in rows if r.toxic and w in text[r.doc_id]} for w in ("glonk", "vrimmel", "zapfod", "quorbis")}
    # rude words of two sorts that never share a document with each other: each word's documents are of one kind
    assert all(len(found) == 1 for found in kind.values()) and len(set(map(frozenset, kind.values()))) == 2
    assert toxicity.scored(odd_docs, chain).count() == 8 and toxicity.scored(no_docs, chain).count() == 0
    assert {r.toxic for r in toxicity.scored(odd_docs, toxicity.fit(no_docs, labels)).collect()} == {0}


def plain_logistic(rows, target, penalty=1e-4):
    """Newton steps in plain Python, the equations solved by elimination."""
    rows = [[*row, 1.0] for row in rows]
    n, width, share = len(rows), len(rows[0]), sum(target) / len(target)
    of = [0.5 / share if t else 0.5 / (1 - share) for t in target]
    ridge = [penalty * n] * (width - 1) + [1e-9]
    weight = [0.0] * width
    for _ in range(12):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(map(operator.mul, row, weight)))))) for row in rows]
        left = [[sum((of[r] * p[r] * (1 - p[r]) + 1e-6) * rows[r][i] * rows[r][j] for r in range(n)) + (ridge[i] if i == j else 0) for j in range(width)] for i in range(width)]
        right = [sum(rows[r][i] * of[r] * (p[r] - target[r]) for r in range(n)) + ridge[i] * weight[i] for i in range(width)]
        for i in range(width):
            top = max(range(i, width), key=lambda r: abs(left[r][i]))
            left[i], left[top], right[i], right[top] = left[top], left[i], right[top], right[i]
            for r in range(i + 1, width):
                by = left[r][i] / left[i][i]
                left[r] = [x - by * y for x, y in zip(left[r], left[i])]
                right[r] -= by * right[i]
        step = [0.0] * width
        for i in reversed(range(width)):
            step[i] = (right[i] - sum(left[i][j] * step[j] for j in range(i + 1, width))) / left[i][i]
        weight = [w - x for w, x in zip(weight, step)]
        if max(map(abs, step)) < 1e-6:
            break
    return weight


def test_the_chain_is_that_of_plain_python():
    """Models, out-of-fold probabilities and the columns that each fold may read."""
    rng = random.Random(4)
    rows = [[float(rng.random() < 0.4) for _ in range(4)] for _ in range(90)]
    target = [float(rng.random() < (0.8 if r[0] or r[1] else 0.1)) for r in rows]
    fold = [rng.randrange(3) for _ in rows]
    used = np.array([[1, 1, 1, 0], [1, 1, 0, 0], [1, 0, 1, 1], [0, 1, 1, 1]], bool)
    chain = toxicity.learn(np.array(rows), np.array(target), np.array(fold), list("abcd"), used)
    kind = toxicity.kinds(np.array(rows)[:, used[0]], np.array(target)).tolist()
    assert {k for k, t in zip(kind, target) if not t} == {-1} and kind.count(0) >= kind.count(1) > 0
    assert chain.column == {"a": 0, "b": 1, "c": 2}
    rows, masks = [list(r) for r in rows], [list(u) for u in used.tolist()]
    for weight, category in zip(chain.weights, [[float(k == 0) for k in kind], [float(k == 1) for k in kind], target]):
        def fitted(mask, keep):
            if not any(category[r] for r in keep):  # never likely
                return [0.0] * len(mask) + [-30.0]
            found = iter(plain_logistic([[x for x, m in zip(rows[r], mask) if m] for r in keep], [category[r] for r in keep]))
            return [next(found) if m else 0.0 for m in [*mask, True]]

        want = fitted(masks[0], range(90))
        assert want.pop(3) == 0 and weight == pytest.approx(want, abs=1e-9)  # the fourth feature is the folds' only
        by_fold = [fitted(masks[1 + i], [r for r in range(90) if fold[r] != i]) for i in range(3)]
        for r in range(90):
            rows[r].append(1 / (1 + math.exp(-(sum(map(operator.mul, rows[r], by_fold[fold[r]])) + by_fold[fold[r]][-1]))))
        masks = [[*m, True] for m in masks]


def test_features_are_chosen_without_the_fold(spark, make_docs):
    """A word that tells the labels apart in one fold only is none of the features that its models read."""
    make_docs([])
    rows = [(i % 2, f, ["rude"] * (i % 2) + ["only"] * (i % 2 and f == 1)) for f in range(3) for i in range(60)]
    chosen = toxicity.telling_features(spark.createDataFrame(rows, "label int, fold int, features array<string>"))
    assert [sorted(part) for part in chosen] == [["only", "rude"], ["only", "rude"], ["rude"], ["only", "rude"]]


def test_kinds_of_no_telling_row():
    assert toxicity.kinds(np.zeros((3, 2)), np.array([1.0, 0.0, 1.0])).tolist() == [-1, -1, -1]
    assert sorted(toxicity.kinds(np.array([[1.0], [0.0]]), np.array([1.0, 0.0])).tolist()) == [-1, 0]


def plain_top_k(rows, asked, k=5):
    def score(a, b):
        return sum(int(np.floor(256.0 * x)) * int(np.floor(256.0 * y)) for x, y in zip(a, b, strict=False))

    out = set()
    for query, vector in asked:
        found = sorted((-score(vector, v), i) for i, v in rows if i != query)[:k]
        out |= {(query, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("seed, per_block, lists", [(1, 2048, 2), (2, 3, 3), (3, 2048, 1)])
def test_top_k_against_brute_force(spark, make_docs, seed, per_block, lists):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, []), (2001, [1e6] * 8), (2002, rows[1][1][:3])]
    bad = [(3000, None), (None, [1.0] * 8), (3001, [float("nan")] * 8), (3002, [float("inf"), 1.0]), (3003, [None, 1.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    vectors = top_k.whole(table)
    assert vectors.count() == len(rows)
    found = top_k.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), lists=lists, per_block=per_block)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()}
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain_top_k(exact, [x for x in exact if x[0] % 50 == 0])


def test_top_k_of_few_rows(spark, make_docs):
    make_docs([])
    table = spark.createDataFrame([(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    vectors = top_k.whole(table)
    got = [tuple(r) for r in top_k.top_k(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0)]
    empty = top_k.whole(table.limit(0))
    assert top_k.top_k(empty, empty).count() == 0 and top_k.top_k(vectors, empty).count() == 0
