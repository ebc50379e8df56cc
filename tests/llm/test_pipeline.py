"""The pipeline's stages against plain rules, on small tables with odd rows."""

import hashlib
import re

import pytest
from test_exact_and_mixing import plain_schedule
from test_near import plain_components

import __spark_entry__ as entry
import corpus_pipeline
from rxcover.llm import mixing

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, place int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def odd(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, words), (2, words + " more"), (3, words.replace("w7", "w 7")), (4, None), (5, ""), (6, " "), (None, words),
        (8, "z" * 50_000), (9, "short text"), (9, "short text"), (10, "Short  text"),
    ]
    return spark.createDataFrame([(*r, "en", None if r[0] == 9 else "s", 1, "r", "k", 3) for r in rows], COLUMNS)


def test_stages_keep_columns_and_rows_follow_the_rules(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "tokens"]
    stage = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    exact = stage["exact"](spark, docs, FOLDER)
    best = {}
    for i, t in texts.items():
        key = SPACE.sub("", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    assert exact.columns == docs.columns
    assert sorted(r.doc_id for r in exact.collect()) == sorted(i for _, i in best.values())

    near = stage["near"](spark, docs, FOLDER)
    groups = plain_components(list(texts.items()), 5, 8, 10)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)

    mixing = stage["mixing"](spark, docs, FOLDER)
    assert mixing.columns == docs.columns
    assert sorted(mixing.collect()) == sorted(docs.collect())


def test_quality_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, folder).collect()}
    good = [i for i, q in labels.items() if q == 1]
    poor = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in poor) <= 0.05 * len(poor)


def test_odd_rows(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
    exact = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.exact_stage(spark, docs, FOLDER).collect())
    assert [i for i, _ in exact] == [2, 3, 4, 8, 9, 10] or [i for i, _ in exact] == [2, 3, 6, 8, 9, 10]
    tokens = corpus_pipeline.tokens_stage(spark, docs, FOLDER)
    assert tokens.count() == docs.count()
    assert corpus_pipeline.tokens_stage(spark, docs.limit(0), FOLDER).count() == 0


def test_run(spark, docs):
    rows = entry.queries()["pipeline"](spark, FOLDER).collect()
    assert 0 < len(rows) < docs.count() and all(r.n_tokens * 4 == len(r.ids) for r in rows)


def test_run_follows_the_schedule(spark, docs):
    rows = entry.queries()["pipeline"](spark, FOLDER).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    waiting = {}
    for r in sorted(rows, key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()):
        waiting.setdefault(source[r.doc_id], []).append(r.doc_id)
    size = mixing.BLOCK_DOCS
    weights = {s: int(1000 * len(ids) ** 0.5 + 0.5) for s, ids in waiting.items()}
    plan = plain_schedule(weights, {s: -(-len(ids) // size) for s, ids in waiting.items()})
    expected = []
    for _, (s, block) in sorted(plan.items()):
        expected += waiting[s][block * size : (block + 1) * size]
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.mix_position)] == expected
    assert sorted(r.mix_position for r in rows) == list(range(len(rows)))
