"""Classifiers and scanners: held-out accuracy, odd tables, and their parts against plain rules."""

import time

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rxcover.llm import language, quality, secret_scan, toxicity
from rxcover.llm.shared import remainder
from rxcover.llm.terms import labelled_sample, letter_runs, lowered, sampled_terms, word_terms
from rxcover.llm.textvec import shingle_sets, text_chunks, words

FOLDER = "/root/testdata/sf0.1"
ODD = [(None, None), (1, ""), (2, " \n"), (3, "12 34"), (3, "12 34"), (4, "a" * 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 7) for r in ODD], "doc_id long, text string, score string, kept int")


def test_chunks_and_words_equal_python():
    texts = ["Ab c", None, "", "x\x0by", " é É ", "tail", "日本 語", "end "]
    for limit in (1, 6, 1000):
        found = []
        for _, data, offsets in text_chunks(pa.array(texts), limit):
            starts, ends, rows = words(data, offsets)
            line = data.tobytes()
            per_text = [[] for _ in range(len(offsets) - 1)]
            for a, b, r in zip(starts, ends, rows):
                per_text[r].append(line[a:b].decode())
            found += per_text
        assert found == [(t or "").split() for t in texts]
    sliced = pa.array(texts).slice(3, 3)
    assert [data.tobytes().decode() for _, data, _ in text_chunks(sliced, 1)] == ["x\x0by", " é É ", "tail"]


def test_lowered_and_letter_runs():
    data = np.frombuffer("ÉÀ× Ab,9c".encode(), np.uint8)
    low = lowered(data)
    assert low.tobytes().decode() == "éà× ab,9c"
    starts, ends, _ = letter_runs(low, np.array([0, len(low)]))
    assert [low[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["éà×", "ab", "c"]


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c d", "a b", "", "b c d", "x a b c"]
    together = [s for _, d, o in text_chunks(pa.array(texts)) for s in shingle_sets(d, o, 3)]
    alone = [s for t in texts for _, d, o in text_chunks(pa.array([t])) for s in shingle_sets(d, o, 3)]
    assert all((a == b).all() for a, b in zip(together, alone))
    assert [len(s) for s in together] == [2, 1, 0, 1, 2]
    assert set(together[0]) & set(together[3]) and set(together[0]) & set(together[4])


def test_sample_is_bounded_and_weighted(spark):
    labels = spark.createDataFrame(
        [(i, i % 10 == 0) for i in range(100)] + [(1, True), (None, True), (5, None)], "doc_id long, toxic boolean"
    ).select("doc_id", F.col("toxic").cast("int").alias("target"))
    rows = labelled_sample(labels, 4, [0, 1]).collect()
    assert sorted({(r.target, r.weight) for r in rows}) == [(0, 89 / 4), (1, 11 / 4)] and len(rows) == 8


def test_sample_holds_an_id_once(spark):
    """One labelled id on very many rows brings one row to training."""
    docs = spark.range(20_000).selectExpr("1L AS doc_id", "concat('word', 20000 + id) AS text")
    docs = docs.unionByName(spark.createDataFrame([(i, f"other {i}") for i in range(2, 12)], "doc_id long, text string"))
    docs = docs.unionByName(spark.createDataFrame([(1, None), (12, None)], "doc_id long, text string"))
    sample = labelled_sample(spark.range(1, 13).selectExpr("id AS doc_id", "int(id = 1) AS target"), 100, [0, 1])
    rows = sampled_terms(docs, sample, word_terms, 1 << 20).collect()
    assert len(rows) == 12 and [len(r.terms) for r in rows if r.target == 1] == [len(word_terms_of("word20000"))]
    assert sorted(r.total for r in rows)[0] == 0


def word_terms_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return word_terms(data, np.array([0, len(data)]))[1]


def test_language_held_out(spark, docs):
    rows = entry.queries()["op7_language_filters"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    right = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99


def test_language_filters_report_all_languages(spark):
    rows = [("aaaa bbbb", "x"), ("aaaa cccc", "y"), ("dddd", None), (None, "x")] + [(f"l{i:03d}q" * 3, f"z{i:03d}") for i in range(70)]
    filters = language.learn(spark.createDataFrame(rows, "text string, lang string"), slots=1 << 12)
    assert len(filters.languages) == 72 and filters.table.shape == (2, 1 << 12)
    data = np.frombuffer(b"aaaa", np.uint8)
    row, gram = language.grams(data, np.array([0, 4]))
    assert [int(g).to_bytes(4, "big") for g in gram] == [b" aaa", b"aaaa", b"aaa "]
    n, found = filters.counts(row, gram, 1)
    reported = dict(zip(filters.languages, found[0]))
    assert n[0] == 3 and reported["x"] == 3 and reported["y"] == 3


def test_language_odd_tables(spark, odd):
    nothing = language.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.identified(odd, nothing).collect()} == {"und"}
    two = language.learn(spark.createDataFrame([("aaaa", "x"), ("bbbb", "y")], "text string, lang string"))
    rows = language.identified(odd, two, carry=["doc_id", "score", "kept"]).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in rows) == [
        (0, "und"), (1, "und"), (2, "und"), (3, "und"), (3, "und"), (4, "x")
    ]
    assert all(0 <= r.score <= 1 and r.kept == 7 for r in rows)
    assert language.identified(odd.limit(0), two).count() == 0


def test_toxicity_held_out(spark, labels):
    rows = entry.queries()["op5_factorization_machine"](spark, FOLDER).join(labels, "doc_id").filter("held_out")
    found, wrong, missed = rows.agg(
        F.count_if(F.expr("predicted = 1 AND toxic = 1")),
        F.count_if(F.expr("predicted = 1 AND toxic = 0")),
        F.count_if(F.expr("predicted = 0 AND toxic = 1")),
    ).first()
    assert found / (found + wrong) > 0.95 and found / (found + missed) > 0.7


def test_factorization_machine_learns_pairs(spark):
    """Only both terms together are toxic, which no sum of weights can tell."""
    texts = {0: ["insult here", "group here", "group nice", "nothing here"], 1: ["insult group"]}
    rows = [(10 * i + c, t, c) for i in range(60) for c in (0, 1) for t in [texts[c][i % len(texts[c])]]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    target = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, target int")
    model = toxicity.train(docs, target, epochs=400)
    scores = {r.text: r.score for r in toxicity.scored(docs, model, carry=["text"]).collect()}
    assert scores["insult group"] > 0.8 and max(v for t, v in scores.items() if t != "insult group") < 0.3


def test_toxicity_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None)], "doc_id long, target int")
    for given in (labels, labels.limit(0), labels.filter("target = 1")):
        rows = toxicity.scored(odd, toxicity.train(odd, given)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(odd.limit(0), toxicity.train(odd.limit(0), labels)).count() == 0


def test_quality_held_out(spark, docs, labels):
    ratings = quality.grades(labels)
    model = quality.train(docs, ratings.filter(remainder("doc_id", 4) != 2))
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.graded(docs, model).join(labels, "doc_id").filter(remainder("doc_id", 4) == 2)
    by = {r.quality: r for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("grade")).collect()}
    assert by[1].kept > 0.99 and by[0].kept < 0.05 and by[0].grade < by[1].grade


def test_quality_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (3, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = quality.graded(odd, quality.train(odd, quality.grades(given)), carry=["doc_id", "score"]).collect()
        assert len(rows) == len(ODD)
        assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows)


KEY = "AKIA" + "Q7RT" * 4
SCAN = [
    (1, f"see {KEY} there"),
    (2, 'token = "0123456789abcdef0123" end'),
    (3, "a verylongordinaryword here"),
    (4, None),
    (5, ""),
    (6, f"{KEY}"),
    (6, f"é\U0001f600 {KEY} verylongordinaryword"),
    (None, "4111111111111111"),
]


def test_candidates_have_their_place(spark):
    docs = spark.createDataFrame([(*r, "x") for r in SCAN], "doc_id long, text string, candidate string")
    rows = secret_scan.candidates(docs).collect()
    texts = {i: [t for j, t in SCAN if j == i] for i, _ in SCAN}
    for r in rows:
        assert any((t or "")[r.start : r.start + len(r.candidate)] == r.candidate for t in texts[r.doc_id])
    assert sorted((r.doc_id or 0, r.start, r.candidate[:4]) for r in rows) == [
        (0, 0, "4111"), (1, 4, "AKIA"), (2, 9, "0123"), (3, 2, "very"), (6, 0, "AKIA"), (6, 3, "AKIA"), (6, 24, "very")
    ]


def test_secrets(spark):
    found = {
        (r.doc_id or 0, r.candidate[:4]): r.kept
        for r in secret_scan.scanned(spark.createDataFrame(SCAN * 5, "doc_id long, text string")).collect()
    }
    assert found == {
        (0, "4111"): False, (1, "AKIA"): True, (2, "0123"): True, (3, "very"): False, (6, "AKIA"): True, (6, "very"): False
    }
    assert secret_scan.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one_class = spark.createDataFrame([(1, "averylongordinaryword")], "doc_id long, text string")
    assert [r.probability for r in secret_scan.scanned(one_class).collect()] == [0.5]


SECRETS = [
    ('password = "hunter2!x"', "hunter2!x"),
    ("postgres://bob:s3cr3t@host/db", "s3cr3t"),
    ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYzR9pLq2sT8vW", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzR9pLq2sT8vW"),
    ("DB_PASSWORD='p@ss:w0rd,1'", "p@ss:w0rd,1"),
    ('{"client_secret": "9f86d081884c7d659a2feaa0c55ad015"}', "9f86d081884c7d659a2feaa0c55ad015"),
    ("export GH_TOKEN=ghp_" + "a1B2c3" * 6, "ghp_" + "a1B2c3" * 6),
    ("pwd: Tr0ub4dor&3", "Tr0ub4dor&3"),
    ("apiKey := 4f2d8e61b0c97a35d1e8", "4f2d8e61b0c97a35d1e8"),
    ("https://ci:x9!kQ2z@git.example.org/r.git", "x9!kQ2z"),
    ("token: 7c4a8d09ca3762af61e59520943dc26494f8941b", "7c4a8d09ca3762af61e59520943dc26494f8941b"),
    (f"key {KEY[:-1]}Z here", f"{KEY[:-1]}Z"),
    ("secret=0a1b2c3d4e5f60718293", "0a1b2c3d4e5f60718293"),
]
HARMLESS = [
    ("key: value", "value"),
    ("the secret: patience", "patience"),
    ("sha256: 9f86d081884c7d659a2feaa0c55ad0153d3e", "9f86d081884c7d659a2feaa0c55ad0153d3e"),
    ("commit 7c4a8d09ca3762af61e59520943dc264", "7c4a8d09ca3762af61e59520943dc264"),
    ("see docs/guides/getting-started/install", "docs/guides/getting-started/install"),
    ("password: required", "required"),
    ("internationalization matters", "internationalization"),
    ("card 4111111111111111", "4111111111111111"),
    ("token = None", "None"),
    ("usr/local/share/applications", "usr/local/share/applications"),
    ("key = primary", "primary"),
    ("md5: d41d8cd98f00b204e9800998ecf8427e", "d41d8cd98f00b204e9800998ecf8427e"),
]


def test_candidates_equal_a_plain_walk(spark):
    """Places, values and context of every match, found one after the other in Python."""
    texts = [t for t, _ in SECRETS + HARMLESS] + [
        "apiKey: abc, turkey: x, 'token': 'a b'", "password=\n pwd=''", "x\U0001f600token=é1; key=" + KEY, "aws_secret_access_key", "key==" * 9
    ] + [" ".join(t for t, _ in SECRETS + HARMLESS) * 30]
    expected = []
    for i, text in enumerate(texts):
        ends = list(regex.finditer(secret_scan.CANDIDATE, text))
        for m, low, high in zip(ends, [0] + [m.end() for m in ends], [m.start() for m in ends[1:]] + [len(text)]):
            head = regex.match(secret_scan._WITHIN, m.group())
            head = head.group() if head else ""
            body = m.group()[len(head) :]
            if head.endswith(('"', "'")) or head.startswith("://"):
                body = body[:-1]
            at = m.start() + len(head)
            before = (text[max(low, m.start() - 64) : m.start()] + head)[-64:]
            after = (text[at + len(body) : m.end()] + text[m.end() : min(high, m.end() + 64)])[:64]
            expected.append((i, at, body, before, after))
    rows = secret_scan.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in rows) == sorted(expected) and len(expected) > secret_scan.BLOCK
    for text, value in SECRETS + HARMLESS:
        assert value in [c for i, _, c, _, _ in expected if texts[i] == text]


def generated_findings(count):
    """Labelled texts with random values under names that `SECRETS` and `HARMLESS` mostly do not use."""
    random = np.random.Generator(np.random.PCG64(5))
    pick = lambda letters, n: "".join(random.choice(list(letters), n))
    base, hexa, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for _ in range(count):
        short = pick(base, int(random.integers(4, 9))) + pick("!@#$%&*.", 1) + pick("0123456789", 2)
        rows += [
            (f"{random.choice(['root_password', 'passphrase', 'login password'])} = \"{short}\"", 1),
            (f"mysql://app:{short.replace('@', '!').replace('/', 'x')}@db.example.net:3306", 1),
            (f"{random.choice(['session_token', 'signing secret', 'auth key'])}: {pick(base, 40)}", 1),
            (f"{random.choice(['refresh_token', 'private_key'])} = {pick(hexa, int(random.integers(16, 41)))}", 1),
            (f"the {random.choice(['key', 'secret', 'token', 'password'])} {random.choice([':', '='])} {random.choice(['empty', 'unknown', 'optional', 'secondary', 'kindness', 'Null', 'string'])}", 0),
            (f"{random.choice(['sha1', 'digest', 'revision', 'blob', 'commit'])} {random.choice([':', ''])} {pick(hexa, int(random.integers(20, 41)))}", 0),
            (f"in src/{pick(lower, 6)}/{pick(lower, 9)}/{pick(lower, 5)}", 0),
            (f"number {pick('0123456789', 16)}", 0),
        ]
    return rows


def test_secrets_of_hand_labelled_rows(spark, docs):
    """Precision and recall on rows labelled by hand: what the corpus's own findings teach, and given ones with them."""
    rows = [(-1 - i, t) for i, (t, _) in enumerate(SECRETS + HARMLESS)]
    corpus = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    findings = spark.createDataFrame(generated_findings(60), "text string, target int")
    # The rows themselves stay out of training.
    measures = secret_scan.dictionary(docs)
    described = secret_scan.known_findings(secret_scan.described(secret_scan.candidates(corpus), *measures)).cache()
    own = described.filter("doc_id >= 0").drop("doc_id")
    given = secret_scan.candidates(findings.selectExpr("target AS doc_id", "text"))
    given = secret_scan.described(given, *measures).withColumnRenamed("doc_id", "target")
    for name, labelled in (("corpus", own), ("corpus and findings", own.unionByName(given))):
        forest = secret_scan.SecretForest.fit(labelled)
        found = {(r.doc_id, r.candidate): r.kept for r in forest.judged(described.filter("doc_id < 0")).collect()}
        kept = [found[-1 - i, c] for i, (_, c) in enumerate(SECRETS + HARMLESS)]
        right, wrong = sum(kept[: len(SECRETS)]), sum(kept[len(SECRETS) :])
        print(name, right, wrong, [c for k, (_, c) in zip(kept, SECRETS + HARMLESS) if k != ((_, c) in SECRETS)])
    described.unpersist()
    assert right / (right + wrong) >= 0.8 and right / len(SECRETS) >= 0.8


def test_given_findings_teach_what_the_texts_do_not(spark):
    made = spark.createDataFrame([(1, 'password = "hunter2!x"'), (2, "the key: value")], "doc_id long, text string")
    findings = spark.createDataFrame(generated_findings(20), "text string, target int")
    rows = secret_scan.scanned(made, findings).collect()
    assert {r.candidate: r.kept for r in rows} == {"hunter2!x": True, "value": False}


def test_long_texts_take_time_in_proportion(spark):
    many = " ".join(f"0123456789abcdef{i:05d}" for i in range(60_000))
    rows = [(1, many), (2, "tokentoken" * 50_000), (3, 'key="' * 100_001), (4, "z" * 500_000), (5, "password=" + "x," * 200_000)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    started = time.monotonic()
    counts = {r.doc_id: (r["count"], r.last) for r in secret_scan.candidates(made).groupBy("doc_id").agg(F.count("*").alias("count"), F.max("start").alias("last")).collect()}
    assert counts == {1: (60_000, 59_999 * 22), 2: (1, 0), 3: (50_000, 99_998 * 5 + 5), 4: (1, 0), 5: (1, 9)}
    assert secret_scan.scanned(made.filter("doc_id > 3")).count() == 2
    assert time.monotonic() - started < 60
