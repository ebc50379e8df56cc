"""Similarity joins against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from rxcover.llm.components import components
from rxcover.llm.ngram_join import Cut, NgramJoin, _folded, ngram_components, sketch
from rxcover.llm.vector_dedup import linked_vectors, passes_for

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def connected(ids, edges):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def plain_components(rows, size, numerator, denominator):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    edges = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[:k]
        if sets[a]
        and sets[b]
        and denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in connected(ids, edges).items()}


def corpus(seed):
    """Copies with few and with many edits, shared passages, short, empty and repeated texts."""
    pick = random.Random(seed)
    words = [f"W{n}" for n in range(400)]
    base = [pick.choices(words, k=n) for n in (12, 30, 60, 200, 900)]
    passage = pick.choices(words, k=60)
    rows = []
    for text in base:
        for edits in (0, 0, 1, 1, 2, 3, 5, 9, 30):
            copy = list(text)
            for _ in range(edits):
                at = pick.randrange(len(copy))
                copy[at : at + pick.choice((0, 1))] = [pick.choice(words)] * pick.choice((0, 1))
            rows.append(" ".join(copy))
        rows.append(" ".join(text[: len(text) // 2] + passage))
    rows += [None, "", " \t", "one", "ONE", "one two", "two one", "a b c", "a b c", "a b c d", "x " * 5000, "x " * 4000]
    pick.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "numerator", "denominator", "tile"), [(3, 9, 10, 512), (5, 8, 10, 2)])
def test_ngram_join_equals_brute_force(spark, size, numerator, denominator, tile):
    rows = corpus(size)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    found = NgramJoin(docs, size, numerator, denominator, buckets=5, tile=tile).result().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(rows, size, numerator, denominator)


def test_cut_bounds_differences():
    cut = Cut(8, 10)
    for a in range(1, 300):
        for b in range(a, a * 10 // 8 + 1):
            low, high = cut.size_class(a), cut.size_class(b)
            assert high - low in (0, 1)
            common = next((c for c in range(1, a + 1) if 10 * c >= 8 * (a + b - c)), None)
            if common:
                assert a + b - 2 * common <= cut.differences(low)


def test_sketches_never_reject():
    pick = np.random.default_rng(3)
    for n in (1, 5, 40, 700):
        for _ in range(30):
            a = np.unique(pick.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[pick.random(len(a)) > 0.1], pick.integers(0, 2**64, n // 5, dtype=np.uint64)]))
            if len(b):
                rows = _folded([sketch(a), sketch(b)])
                assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_ngram_join_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(empty).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == [
        (0, 2, 0),
        (0, 2, 0),
        (3, 2, 3),
        (3, 2, 3),
        (4, 0, 4),
    ]


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (3, 2)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r.node: r.component for r in rows}
    assert len({label[i] for i in range(41)}) == 1 and len({label[i] for i in (100, *range(200, 250))}) == 1
    assert label[0] != label[100]


def test_vectors_equal_brute_force(spark):
    pick = np.random.default_rng(5)
    base = pick.standard_normal((40, 16))
    near = np.concatenate([base + pick.standard_normal(base.shape) * s for s in (0.02, 0.1, 0.25)])
    far = pick.standard_normal((60, 16))
    vectors = np.concatenate([base, near, far, base[:5], base[:1] * 3]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(n + i, v) for i, v in enumerate(odd)] + [(None, vectors[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    label = connected(range(n), zip(*(x.tolist() for x in np.nonzero(linked))))
    for tile in (2048, 3):
        found = {r.vec_id: r for r in linked_vectors(table, tile=tile, window=16).collect()}
        for i in range(n):
            assert (found[i].n_links, found[i].component_id, found[i].kept) == (linked[i].sum(), label[i], label[i] == i)
        assert all(found[n + i].n_links == 0 and found[n + i].kept for i in range(len(odd)))
        assert found[None].component_id is None and not found[None].kept


def test_no_vectors(spark):
    assert linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def cone(rows, pairs, cosine, mean, seed):
    """Unit vectors of 64 dimensions around one direction with mean cosine `mean`, the first ones in pairs of `cosine`."""
    random = np.random.Generator(np.random.PCG64(seed))
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(random.standard_normal(64))
    around = random.standard_normal((rows, 64))
    around = unit(around - (around @ axis)[:, None] * axis)
    vectors = mean * axis + np.sqrt(1 - mean**2) * around
    base = vectors[:pairs]
    off = random.standard_normal((pairs, 64))
    off = unit(off - (off * base).sum(1, keepdims=True) * base)
    vectors[pairs : 2 * pairs] = cosine * base + np.sqrt(1 - cosine**2) * off
    return vectors


@pytest.mark.parametrize("mean", [0.0, 0.8])
def test_recall_does_not_fall_with_size(spark, mean):
    """All links among the vectors against brute force, at two sizes; windows of 32 stand for larger tables."""
    for rows, pairs in ((2_000, 200), (24_000, 600)):
        vectors = cone(rows, pairs, 0.955, mean, 9)
        table = spark.createDataFrame(pd.DataFrame({"vec_id": range(rows), "embedding": vectors.tolist()}))
        found = linked_vectors(table, window=32).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"]
        links = sum(((vectors[i : i + 2000] @ vectors.T) >= 0.95).sum() for i in range(0, rows, 2000)) - rows
        assert links >= 2 * pairs
        print(f"mean cosine {mean}, {rows} rows, {passes_for(rows, 32)} passes: recall {found.sum() / links:.4f}")
        assert 0.95 < found.sum() / links <= 1


def test_rows_at_the_ends_of_partitions_meet(spark):
    """One pass in which every partition holds few rows finds what one partition finds."""
    vectors = cone(600, 200, 0.99, 0.5, 4)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(600), "embedding": vectors.tolist()}))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    results = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for partitions in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            results.append(sorted(tuple(r) for r in linked_vectors(table, window=25, passes=1).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert results[0] == results[1] and sum(r[1] for r in results[0]) > 100
