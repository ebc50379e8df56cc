"""Collocations, ranked search and decontamination against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rxcover.llm import collocations, decontaminate, search
from rxcover.llm.textvec import span_hashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def texts(seed, n=60):
    pick = random.Random(seed)
    words = [*"the of and to a in IS it".split(), "Été", "ÉTÉ", "straße", *[f"w{i}" for i in range(25)]]
    glue = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "-", "\x0b"]
    rows = ["", None, "...", " \t ", "x", "İK k", "word", "The of the OF, the of", "longwordlongword" * 40 + " the of"]
    for _ in range(n):
        rows.append("".join(pick.choice(words) + pick.choice(glue) for _ in range(pick.choice([3, 12, 40, 150]))))
    return rows + [rows[-1]] * 3 + [" ".join(pick.choices(words, k=40_000))]


# collocations


def plain_phrases(rows, most):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def plain_collocations(rows, least, most, top):
    counts, totals = plain_phrases(rows, most)
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            if any(
                100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
                if len(q) > len(p)
            ):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, i, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def collocated(spark, rows, **options):
    df = spark.createDataFrame([(l, t, 1, 2) for l, t in rows], "lang string, text string, n long, block long")
    return [tuple(r) for r in collocations.collocations(df, **options).collect()]


@pytest.mark.parametrize("seed,least,most,top", [(1, 5, 3, 2000), (2, 3, 4, 15)])
def test_collocations(spark, monkeypatch, seed, least, most, top):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 3000)  # texts of several blocks
    rows = [(random.Random(i).choice(["en", "de", None, "und"]), t) for i, t in enumerate(texts(seed))]
    found = collocated(spark, rows, least=least, most_words=most, top=top, buckets=7)
    assert len(found) == len(set(found))
    assert set(found) == plain_collocations(rows, least, most, top)


def test_collocations_without_candidates(spark):
    assert collocated(spark, []) == []
    assert collocated(spark, [("en", None), ("en", ""), (None, "a b c"), ("de", ".,;")]) == []


def test_colliding_fingerprints_are_told_apart_by_text(monkeypatch):
    monkeypatch.setattr(collocations, "_fingerprints", lambda part, s, e, seed: (e - s).astype(np.uint64))
    data, _ = collocations.normalised(np.frombuffer(b"ab cd ab. ab cd", np.uint8), np.array([0, 15]))
    found = collocations._by_text("en", data, np.array([1], np.uint32), 3)  # word 0, one word: "ab"
    assert dict(zip(found.column("phrase").to_pylist(), found.column("times").to_pylist())) == {"ab": 3, "cd": 2}


def test_long_phrases_are_compared_to_their_end():
    long = b"x" * 70
    data = np.frombuffer(long + b"a " + long + b"b " + long + b"a\n", np.uint8)
    starts, ends = np.array([0, 72, 144]), np.array([71, 143, 215])
    same = collocations._same_bytes(data, starts, ends, np.zeros(3, np.int64), np.full(3, 71))
    assert same.tolist() == [True, False, True]


def test_fingerprints_depend_on_the_phrase_alone():
    data = np.frombuffer(b"of the of the", np.uint8)
    hashes = span_hashes(data, np.array([0, 7]), np.array([6, 13]))
    assert hashes[0] == hashes[1]


# search


def plain_ranks(docs, items, best):
    terms = [(i, TERM.findall(lower(t))) for i, t in docs]
    counts = [(i, Counter(w), len(w)) for i, w in terms if w]
    n, total = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(lower(text)))
        scored = []
        for doc, c, size in counts:
            m = 75 + 25 * size * n // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items()
                if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:best], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, 5, 6.0) for i, t in docs], "doc_id long, text string, n long, norm double")
    items = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, item long")
    return sorted((tuple(r) for r in search.ranked(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("bucket,block", [(4, 1000), (2048, 3)])
def test_ranked(spark, bucket, block):
    docs = list(enumerate(texts(3))) + [(None, "the w1 w2"), (None, "the w1 w2"), (2, "w3 Été"), (2, "w3 Été")]
    items = [(1, "the W1 été w1"), (2, "ÉTÉ straße w20 w21"), (3, "nowhere"), (4, ""), (5, None), (None, "w5 w6"), (1, "w7"), (1, "w7")]
    assert searched(spark, docs, items, bucket=bucket, block_items=block) == plain_ranks(docs, items, 20)


def test_ranked_without_rows(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None), (2, "...")], [(1, "a")]) == []


def test_bounds_leave_out_work_but_no_result(spark):
    pick = random.Random(5)
    docs = [(i, " ".join(pick.choices([f"t{k}" for k in range(40)], k=pick.choice([2, 5, 30])))) for i in range(600)]
    items = [(i, " ".join(pick.choices([f"t{k}" for k in range(40)], k=6))) for i in range(10)]
    assert searched(spark, docs, items, best=3, bucket=32) == plain_ranks(docs, items, 3)
    root, item = np.ones(2), search.Item(np.array([0, 1]), np.array([9, 1]), np.array([9, 1]) / 82**0.5, 82**0.5)
    bucket = search.Bucket(pa.array([1, 2]), np.array([5.0, 4.0]), np.array([1, 0]), np.array([5, 4]), np.array([0, 1, 2]), 2)
    assert bucket.candidates(item, root, 30).tolist() == [False, True]  # 9 * 4 reaches 30, 1 * 5 does not


# decontamination


def plain_leaks(docs, items, window=10):
    cut = {}
    for item, text in items:
        words = TERM.findall(lower(text))
        for s in range(max(1, len(words) - window + 1)) if words else ():
            cut.setdefault(tuple(words[s : s + window]), set()).add(item)
    out = []
    for doc, text in docs:
        words = TERM.findall(lower(text))
        hit, named = set(), set()
        for k in {len(w) for w in cut}:
            for s in range(len(words) - k + 1):
                if tuple(words[s : s + k]) in cut:
                    hit.update(range(s, s + k))
                    named |= cut[tuple(words[s : s + k])]
        names = sorted(str(i) for i in named if i is not None)
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return sorted(out, key=str)


def leaks(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row long, words string")
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, wid long")
    rows = decontaminate.contamination(docs, items, **options).collect()
    digest = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, digest(r.item_ids)) for r in rows), key=str)


@pytest.mark.parametrize("broadcast", [200_000, 1])
def test_contamination(spark, broadcast):
    base = texts(7, 25)
    words = TERM.findall(lower(base[-1]))
    items = [(i, " ".join(words[100 * i : 100 * i + n])) for i, n in enumerate((3, 9, 10, 11, 30, 60, 2, 1))]
    items += [(10, items[4][1]), (None, items[5][1]), (2, items[2][1]), (11, ""), (12, None), (13, "İK K"), (14, "never seen at all")]
    docs = list(enumerate(base)) + [(None, items[4][1].upper()), (3, items[5][1] + " x " + items[5][1]), (3, None)]
    docs += [(900, "\n".join(items[4][1].split())), (901, " ".join(items[4][1].split()[:-21]))]
    assert leaks(spark, docs, items, broadcast_windows=broadcast) == plain_leaks(docs, items)


def test_contamination_without_rows(spark):
    assert leaks(spark, [], [(1, "a b c")]) == []
    assert leaks(spark, [(1, "a b"), (2, None)], []) == plain_leaks([(1, "a b"), (2, None)], [])


def test_screen_that_lets_everything_pass(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    docs, items = list(enumerate(texts(8, 10)[:-1])), [(1, texts(8, 10)[-2]), (2, "the of")]
    assert leaks(spark, docs, items) == plain_leaks(docs, items)
