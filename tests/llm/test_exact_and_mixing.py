"""Exact duplicates and mixing, against plain Python and known cases."""

import re
from collections import defaultdict

import pytest

from rxcover.llm import exact_dedup, mixing, pfair

SPACE = re.compile(r"[\x20\x09-\x0D]")


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((doc_id, len(text or "")))
    found = {}
    for members in groups.values():
        keep = min(members, key=lambda m: (-m[1], m[0]))[0]
        for doc_id, _ in members:
            found[doc_id] = (keep, len(members), doc_id == keep)
    return found


TEXTS = [
    (1, "a b c"),
    (2, "abc"),
    (3, "a\tb\nc "),
    (4, None),
    (5, ""),
    (6, " \r\n"),
    (7, "x" * 64 + "1"),
    (8, "x" * 64 + "2"),
    (9, "x" * 64 + " 1"),
    (10, "a bc"),
    (11, "\U0001f600 a"),
    (12, "\U0001f600a "),
    (13, "z" * 200_000),
    (14, "z" * 200_000),
]


def test_groups_equal_plain_rule(spark):
    docs = spark.createDataFrame([(i, t, i * 10) for i, t in TEXTS], "doc_id long, text string, kept_size long")
    for broadcast in (1_000, 0):
        rows = exact_dedup.exact_groups(docs, carry=["kept_size"], broadcast_keys=broadcast).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == plain_groups(TEXTS)
        assert all(r.kept_size == r.doc_id * 10 for r in rows)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in rows if r.keep_id) == [
        (False, 1, 3, False),
        (False, 1, 3, True),
        (True, 1, 3, False),
    ]
    assert [(r.group_size, r.kept) for r in rows if r.keep_id is None] == [(1, True)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert exact_dedup.exact_groups(docs).count() == 0
    assert mixing.mixed(docs).columns[-1] == "mix_position" and mixing.mixed(docs).count() == 0


def plain_schedule(weights, blocks):
    """Earliest deadline first, one slot at a time."""
    names, total = sorted(weights, key=lambda s: (s is not None, s)), sum(weights.values())
    done, plan, slot = dict.fromkeys(names, 0), {}, 0
    while len(plan) < sum(blocks.values()):
        open_to = [s for s in names if done[s] < blocks[s] and done[s] * total // weights[s] <= slot]
        if open_to:
            pick = min(open_to, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), names.index(s)))
            plan[slot] = (pick, done[pick])
            done[pick] += 1
        slot += 1
    return plan


def scheduled(spark, monkeypatch, weights, sizes, leaf, fan, run=4096):
    """What `mixed` puts into each slot, in blocks of one row."""
    for name, value in (("LEAF", leaf), ("FAN", fan), ("RUN", run)):
        monkeypatch.setattr(pfair, name, value)
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mixed(docs, weights, block_docs=1).collect()
    ordered = sorted(out, key=lambda r: r.mix_slot)
    assert [r.mix_position for r in ordered] == list(range(len(rows)))
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)
    return {r.mix_slot: (r.source, r.mix_block) for r in ordered}


@pytest.mark.parametrize(
    "weights, sizes",
    [
        ({"a": 5, "b": 3, None: 2}, {"a": 50, "b": 30, None: 20}),
        ({"only": 4}, {"only": 9}),
        ({"a": 50, **{f"s{i}": 1 for i in range(50)}}, {"a": 60, **{f"s{i}": 2 for i in range(50)}}),
        ({"a": 397, "b": 211, "c": 89, "d": 3}, {"a": 5, "b": 120, "c": 40, "d": 3}),
        ({"a": 10**9, "b": 1}, {"a": 30, "b": 1}),
    ],
)
def test_schedule(spark, monkeypatch, weights, sizes):
    assert scheduled(spark, monkeypatch, weights, sizes, 8, 3, 4) == plain_schedule(weights, sizes)


def test_idle_slots_between_spans(spark, monkeypatch):
    """Long after the others have run out, a source of little weight still gets its own slots."""
    weights, sizes = {"a": 997, "b": 2, "c": 1}, {"a": 3, "b": 4, "c": 2}
    assert scheduled(spark, monkeypatch, weights, sizes, 4, 2) == plain_schedule(weights, sizes)


def test_many_sources_keep_to_their_weights(spark, monkeypatch):
    """2000 sources, one of them with 40 %: every prefix is within a block of the weights."""
    weights = {f"s{i}": 1 + i % 7 for i in range(2000)}
    weights["hot"] = 2 * sum(weights.values()) // 3
    total = sum(weights.values())
    sizes = {s: max(1, 3000 * w // total) for s, w in weights.items()}
    plan = scheduled(spark, monkeypatch, weights, sizes, 64, 64)
    last = {s: -(-n * total // weights[s]) for s, n in sizes.items()}
    done = dict.fromkeys(weights, 0)
    for slot in range(max(plan) + 1):
        if slot in plan:
            done[plan[slot][0]] += 1
        assert abs(done["hot"] * total - weights["hot"] * (slot + 1)) < total or slot + 1 >= last["hot"]
    for source, n in sizes.items():
        slots = sorted(t for t, (s, _) in plan.items() if s == source)
        for nth, t in enumerate(slots):
            # Before and after each of its blocks.
            assert abs(nth * total - weights[source] * t) < total and abs((nth + 1) * total - weights[source] * (t + 1)) < total
        assert len(slots) == n


def test_mixed_positions(spark):
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else None), i, i) for i in range(300)]
    rows += [(None, "hot", 0, 0), (5, "hot", 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot long, block long").repartition(7)
    out = mixing.mixed(docs, block_docs=4).orderBy("mix_position").collect()
    assert [r.mix_position for r in out] == list(range(302))
    assert all(r.block == (r.doc_id or 0) for r in out)
    slots = defaultdict(set)
    for r in out:
        slots[r.mix_slot].add((r.source, r.mix_block))
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert all(len(found) == 1 for found in slots.values())
    with pytest.raises(ValueError):
        mixing.mixed(docs, weights={"hot": 1})
    with pytest.raises(ValueError):
        mixing.mixed(docs, weights={"hot": 10**18, "b": 1, None: 1})
