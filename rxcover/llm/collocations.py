"""Phrase collocations by Rabin-Karp fingerprints.

Texts are packed into blocks of one language, words apart by one space and pieces by
a line feed, so that a phrase is a span of bytes. Prefix polynomials give the
fingerprint of every span of one to a few words. A shuffle adds up the counts of
equal fingerprints, each with a pointer to an occurrence in its block. Fingerprints
that reach the least count go back to their blocks, where every occurrence is
compared with the text at the pointer; only these phrases become text, and their
counts are added up by text. So a collision costs time but changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxcover.llm.runs import binaries, byte_table, joined, word_runs
from rxcover.llm.shared import stored
from rxcover.llm.textvec import CHUNK_BYTES, LOWER, mix, span_hashes, text_chunks

# Fixed values of the contract: what ends a piece, and what separates its words.
ENDS_PIECE = byte_table([*b".,;:!?", *range(0x0A, 0x0E)])
BETWEEN_WORDS = byte_table([*b" \t", *np.flatnonzero(ENDS_PIECE)])
LEAST, WORDS, TOP = 10, 3, 2000
UNIT = 1_000_000

# Text of one block, cut at the end of a piece; a single longer piece is a block of its own.
BLOCK_BYTES = 16 << 20
# Text that a task holds before it writes the largest block.
HELD_BYTES = 64 << 20
# Text for each bucket of fingerprints; at least one bucket a shuffle partition.
BUCKET_BYTES = 8 << 20
SPACE, BREAK = 32, 10

_BLOCK = "lang string, words long, size long, data binary"
# Fingerprints as differences and pointers cut by bytes, so that the shuffle can compress them.
_PLANES = {"low": np.uint32, "high": np.uint16, "near": np.uint16, "far": np.uint8, "top": np.uint8, "counts": np.uint32}
_COUNTED = "bucket long, block long, " + ", ".join(f"{name} binary" for name in _PLANES)
_PHRASES = "lang string, words int, phrase string, times long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as blocks of bytes of one language: lower case, each word followed by SPACE or BREAK."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        languages = batch.column("lang").dictionary_encode()
        codes, names = languages.indices.to_numpy(), languages.dictionary.to_pylist()
        for first, data, offsets in text_chunks(batch.column("text")):
            out, bounds = normalised(data, offsets)
            code = codes[first : first + len(offsets) - 1]
            owner = np.repeat(code, np.diff(bounds))
            for c in np.unique(code):
                name = names[c]
                part = out[owner == c]
                held.setdefault(name, []).append(part)
                sizes[name] = sizes.get(name, 0) + len(part)
                if sizes[name] >= BLOCK_BYTES:
                    yield from _blocks(name, held.pop(name), sizes.pop(name))
            while sum(sizes.values()) >= HELD_BYTES:
                name = max(sizes, key=sizes.__getitem__)
                yield from _blocks(name, held.pop(name), sizes.pop(name))
    for name in list(held):
        yield from _blocks(name, held.pop(name), sizes.pop(name))


def _blocks(lang: str, parts: list[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    data = np.concatenate(parts)
    for low, high in _cuts(data, BLOCK_BYTES):
        block = data[low:high]
        words = int(np.count_nonzero((block == SPACE) | (block == BREAK)))
        body = pa.compress(block.tobytes(), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([words]), pa.array([len(block)]), pa.array([body], pa.binary())],
            ["lang", "words", "size", "data"],
        )


def _opened(body: pa.Scalar, size: pa.Scalar) -> np.ndarray:
    return np.frombuffer(pa.decompress(body.as_buffer(), size.as_py(), codec="zstd"), dtype=np.uint8)


def _cuts(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about `size` bytes, each the end of a piece."""
    breaks = np.flatnonzero(data == BREAK) + 1
    low = 0
    while low < len(data):
        # The last end within reach, or else the first one beyond.
        at = max(np.searchsorted(breaks, low + size, side="right") - 1, np.searchsorted(breaks, low, side="right"))
        high = int(breaks[at])
        yield low, high
        low = high


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows, each followed by SPACE, the last of a piece by BREAK; and the bounds of each row."""
    low = LOWER[data]
    starts, ends, rows = word_runs(low, offsets, BETWEEN_WORDS)
    pieces = np.cumsum(ENDS_PIECE[low])[starts] if len(starts) else starts
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = (rows[1:] != rows[:-1]) | (pieces[1:] != pieces[:-1])
    after = np.cumsum(ends - starts + 1)
    out = np.empty(int(after[-1]) if len(after) else 0, dtype=np.uint8)
    is_word = np.ones(len(out), dtype=bool)
    is_word[after - 1] = False
    out[is_word] = low[~BETWEEN_WORDS[low]]
    out[after - 1] = np.where(last, BREAK, SPACE)
    bounds = np.concatenate([[0], after])[np.searchsorted(rows, np.arange(len(offsets)))]
    return out, bounds


def _spans(data: np.ndarray, most: int) -> Iterator[tuple]:
    """(offset, bytes, words before, words, number, start, end) of all phrases of 1 to `most` words, part by part."""
    seen = 0
    for low, high in _cuts(data, CHUNK_BYTES):
        part = data[low:high]
        ends = np.flatnonzero((part == SPACE) | (part == BREAK))
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = part[ends] == BREAK
        number = np.arange(len(ends))
        for words in range(1, most + 1):
            if words > 1:  # goes on to the next word only within a piece
                number = number[~last[number + words - 2]]
            yield low, part, seen, words, number, starts[number], ends[number + words - 1]
        seen += len(ends)


def _seed(lang: str) -> np.uint64:
    name = np.frombuffer(lang.encode(), dtype=np.uint8)
    return span_hashes(name, np.zeros(1, np.int64), np.array([len(name)]), kind=1)[0]


def _fingerprints(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64) -> np.ndarray:
    """48 bits of the polynomial of each span, told apart by language."""
    return mix(span_hashes(part, starts, ends) ^ seed) >> np.uint64(16)


def _counted(buckets: int, most: int):
    """Distinct fingerprints of each block with their number and first occurrence, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, size, body in zip(*(batch.column(c) for c in ("block", "lang", "size", "data"))):
                data, seed = _opened(body, size), _seed(lang.as_py())
                prints, places = [], []
                for _, part, seen, words, number, starts, ends in _spans(data, most):
                    prints.append(_fingerprints(part, starts, ends, seed))
                    places.append(((number + seen) * (most + 1) + words).astype(np.uint32))
                if not prints:
                    continue
                prints, places = np.concatenate(prints), np.concatenate(places)
                order = np.argsort(prints, kind="stable")
                prints, places = prints[order], places[order]
                first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
                counts = np.diff(np.concatenate([first, [len(prints)]])).astype(np.uint32)
                prints, places = prints[first], places[first]
                bucket = ((prints >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
                heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                bounds = np.concatenate([heads, [len(prints)]])
                steps = np.concatenate([prints[:1], prints[1:] - prints[:-1]])
                steps[heads] = prints[heads]
                columns = [steps, steps >> np.uint64(32), places, places >> np.uint32(16), places >> np.uint32(24), counts]
                columns = [c.astype(kind) for c, kind in zip(columns, _PLANES.values())]
                step = 4096  # rows of one batch
                for i in range(0, len(heads), step):
                    own = bounds[i : i + step + 1]
                    cut = slice(own[0], own[-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket[own[:-1]].astype(np.int64)),
                            pa.array(np.full(len(own) - 1, block.as_py(), dtype=np.int64)),
                            *[binaries(c[cut], own - own[0]) for c in columns],
                        ],
                        ["bucket", "block", *_PLANES],
                    )

    return run


def _frequent(least: int):
    """Pointers of the fingerprints that reach the least count, back to their blocks; rows come by bucket."""

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        plane = lambda name, kind: joined(table.column(name), _PLANES[name])[0].astype(kind)
        prints = plane("high", np.uint64)
        prints <<= np.uint64(32)
        prints |= plane("low", np.uint64)
        bounds = joined(table.column("low"), np.uint32)[1]
        np.cumsum(prints, out=prints)
        prints -= np.repeat(np.concatenate([[np.uint64(0)], prints])[bounds[:-1]], np.diff(bounds))
        order = np.argsort(prints)
        prints = prints[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        totals = np.add.reduceat(plane("counts", np.int64)[order], first)
        kept = np.zeros(len(prints), dtype=bool)
        kept[order] = np.repeat(totals >= least, np.diff(np.concatenate([first, [len(prints)]])))
        del prints, order
        places = plane("near", np.uint32) | (plane("far", np.uint32) << 16) | (plane("top", np.uint32) << 24)
        sizes = np.add.reduceat(kept.astype(np.int64), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        out = pa.RecordBatch.from_arrays(
            [table.column("block"), binaries(places[kept], np.concatenate([[0], np.cumsum(sizes)]))], ["block", "places"]
        )
        return out.filter(pa.array(sizes > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            of = batch.column("bucket").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
            for low, high in zip(edges, [*edges[1:], len(of)]):
                if held and of[low] != bucket:
                    yield finish(held)
                    held = []
                bucket = of[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield finish(held)

    return run


def _verified(most: int):
    """Every occurrence of the fingerprints pointed at, compared with the text there, counted by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, size, body, places in zip(*(batch.column(c) for c in ("lang", "size", "data", "places"))):
                data = _opened(body, size)
                places = np.concatenate([np.frombuffer(p.as_buffer(), dtype=np.uint32) for p in places.values])
                yield _by_text(lang.as_py(), data, places, most)

    return run


def _by_text(lang: str, data: np.ndarray, places: np.ndarray, most: int) -> pa.RecordBatch:
    seed = _seed(lang)
    ends = np.flatnonzero((data == SPACE) | (data == BREAK))
    word, words = places.astype(np.int64) // (most + 1), places.astype(np.int64) % (most + 1)
    from_ = np.where(word > 0, ends[word - 1] + 1, 0)
    to = ends[word + words - 1]
    known = np.empty(len(places), dtype=np.uint64)
    for low, high in _cuts(data, CHUNK_BYTES):
        here = np.flatnonzero((from_ >= low) & (from_ < high))
        known[here] = _fingerprints(data[low:high], from_[here] - low, to[here] - low, seed)
    order = np.argsort(known)
    known, from_, to, words = known[order], from_[order], to[order], words[order]
    times = np.zeros(len(known), dtype=np.int64)
    others: dict[tuple[int, bytes], int] = {}
    for low, part, _, count, _, starts, stops in _spans(data, most):
        prints = _fingerprints(part, starts, stops, seed)
        at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
        found = np.flatnonzero(known[at] == prints)
        at, starts, stops = at[found], starts[found] + low, stops[found] + low
        same = _same_bytes(data, starts, stops, from_[at], to[at])
        times += np.bincount(at[same], minlength=len(known))
        for i in np.flatnonzero(~same):
            key = (count, data[starts[i] : stops[i]].tobytes())
            others[key] = others.get(key, 0) + 1
    phrases = [data[a:b].tobytes() for a, b in zip(from_.tolist(), to.tolist())] + [text for _, text in others]
    numbers = np.concatenate([words, np.array([count for count, _ in others], dtype=np.int64)])
    total = np.concatenate([times, np.array(list(others.values()), dtype=np.int64)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(phrases), pa.string()),
            pa.array(numbers.astype(np.int32)),
            pa.array(phrases, pa.binary()).cast(pa.string()),
            pa.array(total),
        ],
        ["lang", "words", "phrase", "times"],
    )


def _same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether data[start:end] equals data[from:to], pair by pair."""
    size = ends - starts
    same = size == to - from_
    open_ = np.flatnonzero(same & (starts != from_))
    byte = 0
    while len(open_):
        equal = data[starts[open_] + byte] == data[from_[open_] + byte]
        same[open_[~equal]] = False
        byte += 1
        open_ = open_[equal]
        open_ = open_[size[open_] > byte]
        if byte == 64:  # the few long ones one by one
            for i in open_:
                same[i] = np.array_equal(data[starts[i] : ends[i]], data[from_[i] : to[i]])
            break
    return same


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, most_words: int = WORDS, buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `most_words` words that occur at least `least` times in their language, and the words of each.

    `lang`, `words`, `phrase`, `times`; and `lang`, `n`, all word occurrences.
    Occurrences lie within pieces and may overlap. A null language is `und`; null
    and empty texts hold no words. Other columns are ignored.

    A block's fingerprints are counted before the shuffle, so a phrase costs one
    entry a block however often it occurs. The number of buckets follows the bytes
    of all texts.
    """
    spark = docs.sparkSession
    packed = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(_packed, _BLOCK)
    blocks = stored(packed.withColumn("block", F.monotonically_increasing_id()), "blocks", "none")
    if buckets is None:
        size = blocks.agg(F.sum("size")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    counted = blocks.select("block", "lang", "size", "data").mapInArrow(_counted(buckets, most_words), _COUNTED)
    dealt = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    pointers = dealt.mapInArrow(_frequent(least), "block long, places binary")
    pointers = pointers.groupBy("block").agg(F.collect_list("places").alias("places"))
    texts = blocks.select("block", "lang", "size", "data").join(pointers, "block").select("lang", "size", "data", "places")
    phrases = (
        texts.mapInArrow(_verified(most_words), _PHRASES)
        .groupBy("lang", "words", "phrase")
        .agg(F.sum("times").alias("times"))
        .filter(F.col("times") >= least)
    )
    return stored(phrases, "phrases"), blocks.groupBy("lang").agg(F.sum("words").alias("n"))


def _run(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("parts", first, length), " ")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    most_words: int = WORDS,
    top: int = TOP,
    absorbed: int = 50,
    buckets: int | None = None,
) -> DataFrame:
    """The `top` phrases of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    Candidates are phrases of 2 to `most_words` words with `a` >= `least`
    occurrences. Cut after k words, the first part occurs `l` and the rest `r`
    times; the score is floor(10^6 a a / (l r)), of all cuts the lowest, then the
    smallest k. Products are decimals of 38 digits, enough for 10^13 occurrences.
    A candidate that lies within a longer one with at least `absorbed` percent of
    its occurrences is left out. Ranks go by score and `a` descending, then by
    phrase in byte order, so there are no ties. Repeated rows count as often as
    they occur. No documents, or none with a candidate, give no rows.
    """
    phrases, totals = frequent_phrases(docs, least, most_words, buckets)
    wide, plain = "decimal(38,0)", "decimal(19,0)"
    candidates = phrases.filter("words > 1").select("lang", "words", "phrase", F.col("times").alias("a"))
    parts = candidates.withColumn("parts", F.split("phrase", " "))
    cuts = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "words", "phrase", "a", "k", _run(F.lit(1), F.col("k")).alias("first"), _run(F.col("k") + 1, F.col("words")).alias("rest")
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("times").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("times").alias("r"))
    a, l, r = (F.col(c).cast(plain) for c in "alr")
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    both = both.withColumn("above", (F.lit(UNIT).cast(plain) * (a * a).cast(wide)).cast(wide)).withColumn("below", (l * r).cast(wide))
    scored = (
        both.withColumn("score", F.expr("above div below"))
        .groupBy("lang", "words", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # Shorter phrases within a candidate, by the most frequent candidate that holds them.
    lengths = F.sequence(F.lit(2), F.col("words") - 1)
    inner = parts.filter("words > 2").withColumn("length", F.explode(lengths))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)))
    inner = inner.groupBy("lang", _run(F.col("at"), F.col("length")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (
        kept.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
    )
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
