"""Tokens against the two libraries, and the token files."""

import hashlib
import os
import random
import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from rxcover.llm import bpe, pretokens, queries, token_files
from rxcover.llm.elias_fano import EliasFano
from rxcover.llm.pretokens import distinct, pieces
from rxcover.llm.textvec import span_hashes, text_chunks

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "It's we've I'll 'rest ''s  don't",
    None,
    "",
    "   ",
    "a\n\n b\t c  　d ",
    "<|endoftext|> x",
    "Größe 日本語 \U0001f600\U0001f600 ́e",
    "1234567 89,,!! --x",
    "the " * 3000,
    "z" * 20_000,
    "the the",
    "the the",
]


def cut(texts):
    found = []
    for _, data, offsets in text_chunks(pa.array(texts, pa.string()), 50):
        starts = pieces(data, offsets)
        ends, line = np.append(starts[1:], len(data)), data.tobytes()
        per_text = [[] for _ in range(len(offsets) - 1)]
        for a, b, r in zip(starts, ends, np.searchsorted(offsets, starts, side="right") - 1):
            per_text[r].append(line[a:b].decode())
        found += per_text
    return found


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab' 's'tredvlm12\n\t\r é,!　\xa0\x1c\x85\U0001f600²Ⅷ")), max_size=12), max_size=5))
def test_pieces_equal_the_pattern(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert cut(texts) == [pattern.findall(t) for t in texts]


def test_distinct_pieces():
    data = np.frombuffer(b" the the cat the", np.uint8)
    starts = pieces(data, np.array([0, len(data)]))
    _, index, number = distinct(data, starts)
    assert len(index) == 2 and len(number) == 4 and number[0] == number[1] == number[3]


def test_pieces_of_equal_hashes_are_kept_apart(monkeypatch):
    second = lambda d, s, e, kind=0: span_hashes(d, s, e, 1) if kind else np.zeros(len(s), np.uint64)
    monkeypatch.setattr(pretokens, "span_hashes", second)
    data = np.frombuffer(b" the the cat the", np.uint8)
    found, index, number = distinct(data, pieces(data, np.array([0, len(data)])))
    assert len(set(found.tolist())) == len(index) == 2 and number[0] == number[1] == number[3] != number[2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (0, "again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_ids_and_round_trip(spark, docs):
    import tiktoken

    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    prepare = bpe.tiktoken_encoder(RANKS, public_tokenizers.PATTERN)
    found = bpe.decoded(bpe.encoded(docs, prepare, buckets=5, remembered=2), RANKS).collect()
    expected = [(i, own.encode_ordinary(t), t.encode()) for i, t in rows_of(docs)]
    key = lambda r: (r[0] or -1, r[1])
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)
    none = bpe.encoded(docs.limit(0), prepare)
    assert none.count() == 0


def test_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(MODEL)
    own.encode_special_tokens = True
    tokens = bpe.encoded(docs, bpe.tokenizers_encoder(MODEL), end=2)
    for shard_ids in (10, 1 << 20):
        folder = str(tmp_path / str(shard_ids))
        token_files.write_tokens(tokens, docs.select("doc_id"), folder, shard_ids=shard_ids)
        found = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in found] == sorted((i for i, _ in rows_of(docs)), key=lambda i: -1 if i is None else i)
        texts = {(i, tuple(own.encode(t, add_special_tokens=False).ids + [2])) for i, t in rows_of(docs)}
        at = 0
        for r in found:
            ids = np.frombuffer(r.ids, "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids))
            assert (r.doc_id, tuple(ids.tolist())) in texts
            at += len(ids)
    empty = str(tmp_path / "empty")
    token_files.write_tokens(tokens.limit(0), docs.limit(0).select("doc_id"), empty)
    assert token_files.read_tokens(spark, empty).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=700))
def test_elias_fano(numbers):
    numbers = np.sort(np.array(numbers, dtype=np.int64))
    coded = EliasFano.of(numbers)
    assert coded.all().tolist() == numbers.tolist()
    for i in random.Random(1).sample(range(len(numbers)), min(20, len(numbers))):
        assert coded.select(i) == numbers[i]
    if len(numbers) > 100:
        bits = 8 * (len(coded.lower) + len(coded.upper))
        assert bits <= len(numbers) * (3 + np.log2(1 + numbers[-1] / len(numbers))) + 16


def test_elias_fano_rejects():
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([2])).select(1)


def test_sha_of_empty_text_is_that_of_nothing(spark):
    prepare = bpe.tiktoken_encoder(RANKS, public_tokenizers.PATTERN)
    row = bpe.encoded(spark.createDataFrame([(1, None)], "doc_id long, text string"), prepare).first()
    assert row.n_tokens == 0 and hashlib.sha256(row.ids).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_op10_equals_the_unchanged_library(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(MODEL)
    mark = "<|endoftext|>"
    texts = [t or "" for t in TEXTS] + [
        f"a {mark} b", mark, mark * 3, f"  {mark}  x", f"it's{mark}'s", "<|endof", "text|> y", f"é\n{mark}\n\n 日", f"<{mark[:-1]}{mark}>",
    ]
    assert own.encode(texts[len(TEXTS)], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    at = 0
    for r in sorted(queries.op10_elias_fano_files(spark, str(tmp_path)).collect()):
        ids = own.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_ids_that_do_not_fit_are_refused():
    fits, beyond = (pa.array([b"", np.array([1, top], "<u4").tobytes()], pa.binary()) for top in (65535, 65536))
    token_files.refuse_wider(fits, 2)
    token_files.refuse_wider(fits.slice(0, 0), 2)
    with pytest.raises(ValueError, match="65536 does not fit 2 bytes"):
        token_files.refuse_wider(beyond, 2)


def test_ids_are_narrowed_where_they_are_made(spark, docs, tmp_path):
    tokens = partial(bpe.encoded, docs, bpe.tokenizers_encoder(MODEL), end=2)
    plan = token_files.shards_of(tokens, docs.select("doc_id"))._jdf.queryExecution().sparkPlan().toString()
    steps = [word for word in plan.replace("(", " ").split() if word in ("MapInArrow", "Exchange")]
    # Words, texts, encoding, assembling with narrowing, shards: no task has two Python workers.
    assert steps.count("MapInArrow") == 5 and steps[:4] == ["MapInArrow", "Exchange"] * 2
    found = []
    for at, given_tokens in (("made", tokens), ("given", tokens())):
        token_files.write_tokens(given_tokens, docs.select("doc_id"), str(tmp_path / at))
        found.append(token_files.read_tokens(spark, str(tmp_path / at)))
    assert sorted(found[0].collect(), key=str) == sorted(found[1].collect(), key=str)
    bare = token_files.read_tokens(spark, str(tmp_path / "made"), with_ids=False)
    assert bare.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(bare.collect(), key=str) == sorted(found[0].drop("ids").collect(), key=str)


@pytest.mark.parametrize("special", [False, True])
def test_words_in_one_line_have_the_ids_of_single_words(special):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(MODEL)
    own.encode_special_tokens = not special
    words = [" the", "\n", " \n\t", "\r\x85", "\xa0", "é", " 日本", "\U0001f600", "ÿ", "'s", "!!", "Ċ", "z" * 500, "<|endoftext|>", " "]
    found = bpe.tokenizers_encoder(MODEL, special=special)()
    assert found([w.encode() for w in words]) == [own.encode(w, add_special_tokens=False).ids for w in words]
    assert found([]) == [] and found([b"a"]) == [own.encode("a").ids]
