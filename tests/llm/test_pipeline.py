"""The whole pipeline against plain Python, stage by stage, on a small corpus."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from cashplan.llm import pii, quality
from cashplan.llm.queries import TEST_KEY
from test_scans import plain_hits
from test_simhash import plain_fingerprint, roots
from test_tokens_and_packing import packed_rows

REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def corpus(spark, make_docs, tmp_path_factory):
    rng = random.Random(12)
    benchmark = [(i, " ".join(f"b{i}x{j}" for j in range(20))) for i in range(3)]
    rows, labels = [], []
    for i in range(240):
        words = ["".join(rng.choices(["th", "er", "on", "an", "re"], k=rng.randint(1, 3))) for _ in range(60)]
        if i % 6 == 0:
            words = [f"{w}***" for w in words]
        if i % 10 == 1:
            words[5:5] = benchmark[i % 3][1].split()
        if i % 7 == 2:
            words[9] = "und.34@mail7.example.com 4111111111111111 97.51.17.173"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 != 0), 0))
    rows += [(500 + i, rows[i][1]) for i in range(20)] + [(7, rows[7][1]), (600, None), (601, ""), (602, rows[3][1] * 40)]
    folder = tmp_path_factory.mktemp("corpus")
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, benchmark


def test_stages_against_plain_python(spark, corpus):
    folder, rows, benchmark = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    reader = quality.Reader()

    def vote(text):
        vector = model.vector(*reader.counts(text)).astype(float)
        cosine = model.vectors.astype(float) @ vector
        nearest = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[nearest], 0) ** 4
        return (weight * model.labels[nearest]).sum() / weight.sum() if weight.sum() > 0 else model.prior

    good = [(i, text) for i, text in rows if vote(text) >= 0.5]
    prints = {text: plain_fingerprint(text or "") for _, text in good}
    root = roots(sorted(set(prints.values())))
    least = {}
    for i, text in good:
        key = root[prints[text]]
        least[key] = min(least.get(key, i), i)
    single = {i: text for i, text in good if least[root[prints[text]]] == i}
    hits = {i: plain_hits(text, benchmark) for i, text in single.items()}
    clean = {i: text for i, text in single.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    fresh = {i: pii.Pseudonyms(TEST_KEY).replace(text)[0] for i, text in clean.items()}
    wants = [good, list(single.items()), list(clean.items()), list(fresh.items())]

    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], wants, strict=True):
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < len(fresh) < len(single) < len(good) < len(rows) and any(fresh[i] != clean[i] for i in fresh)
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)

    from cashplan.llm import tokens
    from cashplan.llm.queries import tokenizer_path

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(fresh)
    packed_rows(tokens.compiled(tokenizer_path()), list(fresh.items()), packed)


def test_empty_tables_pass_through(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_works_without_this_subpackage(tmp_path):
    shutil.copytree(REPO / "cashplan", tmp_path / "cashplan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and not [q for q in e.queries() if q[:2] == 'op' or q == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
