"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into blocks of about 8 MB. Each block lists its distinct
pre-tokens once, by bucket of their hash, and its texts as positions in that
list. A bucket meets the words of all blocks, encodes each distinct word once,
and sends the ids back to the blocks, which put their texts together by
position. A word shared by all texts is one entry per block, so frequent words
weigh no more than others. The texts are cut twice, once for the words and once
for the positions, so that positions are shuffled once and no block is stored.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcover.llm.pretokens import distinct, pieces
from rxcover.llm.runs import binaries
from rxcover.llm.textvec import CHUNK_BYTES, text_chunks

BLOCK_BYTES = 8 << 20
# Words that one task remembers at a time; beyond that it starts over, which costs time only.
REMEMBERED = 1_000_000
# Words given to the encoder in one go.
AT_ONCE = 4096

Encoder = Callable[[Sequence[bytes]], Sequence[Sequence[int]]]
# What a task does with its batches, and the schema of the result.
Step = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]

_PACKED = "block long, bucket int, docs array<long>, payload binary"


def tiktoken_encoder(ranks: str, pattern: str) -> Callable[[], Encoder]:
    """Encoder by the rank file `ranks`, read on the driver (its size is that of the vocabulary)."""
    table = read_ranks(ranks)

    def prepare() -> Encoder:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return lambda words: [own.encode_ordinary(w.decode("utf-8")) for w in words]

    return prepare


def tokenizers_encoder(path: str, special: bool = False) -> Callable[[], Encoder]:
    """Encoder by the tokenizers library with the file `path`, read on the driver.

    Strings of special tokens are ordinary text, or with `special` have the ids of the file; then
    give `encoded` the `added_tokens` of the file too.
    """
    with open(path, encoding="utf-8") as file:
        model = file.read()
    file = json.loads(model)
    cutter = file["pre_tokenizer"] or {}
    by_bytes = (
        cutter.get("type") == "ByteLevel"
        and not cutter["add_prefix_space"]
        and not any(file[k] for k in ("normalizer", "truncation", "padding"))
        and all(33 <= ord(c) < 127 for t in file["added_tokens"] for c in t["content"])
    )

    def prepare() -> Encoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer
        from tokenizers.pre_tokenizers import Sequence as Steps

        own = Tokenizer.from_str(model)
        own.encode_special_tokens = not special
        if not by_bytes:
            return lambda words: [
                e.ids for e in own.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
            ]
        # The words are cut already, so they go in as one line, in the letters that the vocabulary has for
        # bytes; a line feed, which is none of these, stands between them.
        own.pre_tokenizer = Steps([])
        own.add_tokens([AddedToken("\n", normalized=False)])
        between, letters = own.token_to_id("\n"), _byte_letters()

        def encode(words: Sequence[bytes]) -> Sequence[Sequence[int]]:
            if not words:
                return []
            line = b"\xff".join(words).decode("latin-1").translate(letters)  # no UTF-8 has the byte FF
            ids = own.encode_batch_fast([line], add_special_tokens=False)[0].ids
            ends = [*np.flatnonzero(np.array(ids) == between).tolist(), len(ids)]
            return [ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]

        return encode

    return prepare


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies, and a line feed for FF."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)} | {0xFF: "\n"}


def added_tokens(path: str) -> list[str]:
    """The strings to which the file `path` of the tokenizers library gives ids beside its vocabulary."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens that look at their neighbours are not supported")
    return [t["content"] for t in found]


def _pieces(data: np.ndarray, offsets: np.ndarray, added: re.Pattern | None) -> np.ndarray:
    """Starts of the pieces; what `added` matches in a text is one piece, and texts are cut there first."""
    line = data.tobytes() if added else b""
    if not added or not added.search(line):
        return pieces(data, offsets)
    ends = offsets.tolist()
    spans = [m.span() for low, high in zip(ends, ends[1:]) for m in added.finditer(line, low, high)]
    if not spans:
        return pieces(data, offsets)
    spans = np.array(spans, dtype=np.int64)
    starts = pieces(data, np.unique(np.concatenate([offsets, spans.ravel()])))
    own = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return starts[(own < 0) | (starts == spans[own, 0]) | (starts >= spans[own, 1])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, byte by byte plane, compressed."""
    out = []
    packer = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        body = packer.compress(planes)
        out += [np.array([len(a), len(body)], "<u8").tobytes(), body]
    return b"".join(out)


def _unzip(raw: bytes) -> Iterator[np.ndarray]:
    at, unpacker = 0, zstandard.ZstdDecompressor()
    while at < len(raw):
        n, size = (int(x) for x in np.frombuffer(raw, "<u8", 2, at))
        planes = unpacker.decompress(raw[at + 16 : at + 16 + size], max_output_size=max(1, 4 * n))
        yield np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()
        at += 16 + size


# Numbers below ONE take one byte, those below TWO two bytes, others five.
ONE = 200
TWO = ONE + 55 * 256


def _zip_ranks(ranks: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent."""
    packer = zstandard.ZstdCompressor(level=1)
    ranks = ranks.astype("<u4")
    two, more = (ranks >= ONE) & (ranks < TWO), ranks[ranks >= TWO]
    first = np.where(two, ONE + ((ranks - ONE) >> 8), np.minimum(ranks, 255)).astype(np.uint8)
    first[ranks >= TWO] = 255
    second = ((ranks[two] - ONE) & 255).astype(np.uint8)
    rest = np.ascontiguousarray(more.view(np.uint8).reshape(-1, 4).T)
    bodies = [packer.compress(part.tobytes()) for part in (first, second, rest)]
    sizes = [len(first), len(second), len(more), *map(len, bodies)]
    return np.array(sizes, "<u8").tobytes() + b"".join(bodies)


def _unzip_ranks(raw: bytes) -> np.ndarray:
    sizes = np.frombuffer(raw, "<u8", 6).astype(int)
    ends = 48 + np.cumsum(sizes[3:])
    unpacker = zstandard.ZstdDecompressor()
    first, second, rest = (
        np.frombuffer(unpacker.decompress(raw[e - n : e], max_output_size=max(1, most)), np.uint8)
        for e, n, most in zip(ends, sizes[3:], (sizes[0], sizes[1], 4 * sizes[2]))
    )
    ranks = first.astype("<u4")
    two = (first >= ONE) & (first < 255)
    ranks[two] = ONE + ((ranks[two] - ONE) << 8 | second)
    ranks[first == 255] = np.ascontiguousarray(rest.reshape(4, -1).T).view("<u4").ravel()
    return ranks


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "bucket", "docs", "payload"]
    )


def gather(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts body[start : start + length] one after the other."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return body[shift + np.arange(len(shift))]


def _cut(buckets: int, words: bool, added: Sequence[str] = ()):
    """Blocks: either the distinct `words` by bucket, or the texts as positions in the list of words."""
    # The longest first, as the library does.
    cuts = [re.escape(a.encode()) for a in sorted(added, key=len, reverse=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        pattern = re.compile(b"|".join(cuts)) if cuts else None
        # Per chunk: hashes and words of its distinct pieces, numbers of its pieces, pieces per text.
        ids, at, chunks, held = [], [], [], 0

        def flush():
            hashes = np.concatenate([c[0] for c in chunks])
            sizes = np.concatenate([c[2] for c in chunks])
            known, first, number = np.unique(hashes, return_index=True, return_inverse=True)
            bases = np.cumsum([0] + [len(c[0]) for c in chunks[:-1]])
            uses = np.zeros(len(known), dtype=np.int64)
            for base, c in zip(bases, chunks):
                times = np.bincount(c[3], minlength=len(c[0]))
                own = np.bincount(number[base : base + len(c[0])], weights=times, minlength=len(known))
                uses += own.astype(np.int64)
            order = np.argsort(-uses, kind="stable")  # frequent words get small numbers
            bucket = (known[order] % np.uint64(buckets)).astype(np.int64)
            if not words:
                rank = np.empty(len(known), dtype=np.int64)
                rank[order] = np.arange(len(known))
                line = np.concatenate([rank[number[base : base + len(c[0])]][c[3]] for base, c in zip(bases, chunks)])
                per_text = np.concatenate([c[4] for c in chunks])
                head = _zip(per_text, bucket)
                texts = np.array([len(head)], "<u8").tobytes() + head + _zip_ranks(line)
                return _rows([(block, -1, ids + at, texts)])
            out = []
            body = np.concatenate([c[1] for c in chunks])
            offsets = np.cumsum(sizes) - sizes
            first = first[order]
            dealt = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[dealt], np.arange(buckets + 1))
            for b in range(buckets):
                mine = first[dealt[edges[b] : edges[b + 1]]]
                if len(mine):
                    letters = gather(body, offsets[mine], sizes[mine])
                    out.append((block, b, None, _zip(sizes[mine], letters)))
            # A block without words still has a row.
            out = out or [(block, 0, None, _zip(np.zeros(0), np.zeros(0)))]
            return _rows(out)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            places = batch.column("position").to_pylist() if "position" in batch.schema.names else []
            for low, data, offsets in text_chunks(batch.column("text")):
                n = len(offsets) - 1
                if ids and held + len(data) > BLOCK_BYTES:
                    yield flush()
                    block, ids, at, chunks, held = block + 1, [], [], [], 0
                starts = _pieces(data, offsets, pattern)
                known, index, number = distinct(data, starts)
                lengths = np.diff(np.append(starts, len(data)))
                per_text = np.diff(np.searchsorted(starts, offsets)) if len(starts) else np.zeros(n, np.int64)
                letters = gather(data, starts[index], lengths[index]) if words else None
                chunks.append((known, letters, lengths[index], number, per_text))
                ids.extend(doc_ids[low : low + n])
                at.extend(places[low : low + n])
                held += len(data)
        if ids:
            yield flush()

    return run


def _encode(prepare: Callable[[], Encoder], remembered: int):
    """For each block and bucket, the ids of its words in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, bucket = prepare(), {}, None
        # Rows of one bucket: block, sizes and letters of its words. A word of many blocks is looked up once.
        rows, held = [], 0

        def flush():
            sizes = np.concatenate([r[1] for r in rows])
            data = np.concatenate([r[2] for r in rows])
            starts = np.cumsum(sizes) - sizes
            _, index, number = distinct(data, starts)
            body = data.tobytes()
            words = [body[a : a + n] for a, n in zip(starts[index].tolist(), sizes[index].tolist())]
            new = [w for w in words if w not in known]
            for low in range(0, len(new), AT_ONCE):
                part = new[low : low + AT_ONCE]
                known.update(zip(part, encode(part)))
            ids = [known[w] for w in words]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
            firsts = np.cumsum(lengths) - lengths
            out, at = [], 0
            for block, own, _ in rows:
                mine = number[at : at + len(own)]
                at += len(own)
                out.append((block, bucket, None, _zip(lengths[mine], gather(flat, firsts[mine], lengths[mine]))))
            return _rows(out)

        for batch in batches:
            blocks, buckets, payloads = (batch.column(c).to_pylist() for c in ("block", "bucket", "payload"))
            for block, own, payload in zip(blocks, buckets, payloads):
                sizes, letters = _unzip(payload)
                if rows and (own != bucket or held + len(letters) > CHUNK_BYTES):
                    yield flush()
                    rows, held = [], 0
                if own != bucket or len(known) > remembered:
                    bucket, known = own, {}
                rows.append((block, sizes.astype(np.int64), letters.astype(np.uint8)))
                held += len(letters)
        if rows:
            yield flush()

    return run


def _assemble(end: int | None):
    """From rows sorted by block and bucket, the one with `docs` first: the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts, ids = None, [], []

        def flush():
            docs, per_text, bucket, line = texts
            docs, places = docs[: len(per_text)], docs[len(per_text) :]
            found = [len(n) for n in counts if len(n)]
            if found != [n for n in np.bincount(bucket.astype(np.int64)).tolist() if n]:
                raise ValueError("the texts were read in another order the second time: give a stored table")
            order = np.argsort(bucket, kind="stable")
            sizes = np.zeros(len(bucket), dtype=np.int64)
            starts = np.zeros(len(bucket), dtype=np.int64)
            if counts:
                length = np.concatenate(counts).astype(np.int64)
                sizes[order] = length
                starts[order] = np.cumsum(length) - length
            body = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            bounds = np.concatenate([[0], np.cumsum(per_text.astype(np.int64))])
            step = 64
            for low in range(0, len(docs), step):
                high = min(len(docs), low + step)
                words = line[bounds[low] : bounds[high]].astype(np.int64)
                flat = gather(body, starts[words], sizes[words]).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(sizes[words])])[bounds[low : high + 1] - bounds[low]]
                if end is not None:
                    flat = np.insert(flat, ends[1:], end)
                    ends = ends + np.arange(len(ends))
                columns = [
                    pa.array(docs[low:high], pa.int64()),
                    pa.array(np.diff(ends), pa.int64()),
                    binaries(flat, ends),
                ]
                names = ["doc_id", "n_tokens", "ids"]
                if places:
                    columns, names = [*columns, pa.array(places[low:high], pa.int64())], [*names, "position"]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for docs, payload in zip(batch.column("docs"), batch.column("payload")):
                raw = payload.as_py()
                if docs.is_valid:
                    if texts is not None:
                        yield from flush()
                    size = int(np.frombuffer(raw, "<u8", 1)[0])
                    head, ranks = _unzip(raw[8 : 8 + size]), _unzip_ranks(raw[8 + size :])
                    texts, counts, ids = (docs.as_py(), *head, ranks), [], []
                else:
                    n, body = _unzip(raw)
                    counts.append(n)
                    ids.append(body)
        if texts is not None:
            yield from flush()

    return run


def encoded(
    docs: DataFrame,
    prepare: Callable[[], Encoder],
    buckets: int = 0,
    remembered: int = REMEMBERED,
    end: int | None = None,
    position: str | None = None,
    added: Sequence[str] = (),
    then: Step | None = None,
) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids` (little-endian unsigned 32-bit numbers) for every row of `docs`.

    `added` are strings that are words of their own wherever a text holds them.
    `position` names a column of whole numbers that goes with each row into a column `position`.
    `then` gets the batches of the result inside the tasks that make them, and its own result is returned
    instead: a `mapInArrow` behind would run a second Python worker beside each of these, and send it all ids.

    `prepare()` gives, in a task, a function from words to their ids; a word is
    never cut differently inside a text. `end` is an id put behind every text.
    Null and empty texts have no ids but `end`. Rows are independent of one another, so repeated
    and null `doc_id`s are kept as they are. No rows give no rows. Other columns
    are ignored.

    A task holds one block, or the words of one bucket up to `remembered`; give
    more `buckets` for more data. A block is what a task reads in a row, so `docs`
    must be files or a stored table, whose tasks read the same again; if they do
    not, the word counts of a block differ and the query fails.
    """
    buckets = buckets or min(4096, max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        *([F.col(position).cast("long").alias("position")] if position else []),
    )
    words = rows.mapInArrow(_cut(buckets, words=True, added=added), _PACKED)
    words = words.repartition("bucket").sortWithinPartitions("bucket", "block")
    texts = rows.mapInArrow(_cut(buckets, words=False, added=added), _PACKED)
    # The texts come first: the numbers of their tasks, and so of their blocks, are those of the first reading.
    both = texts.unionByName(words.mapInArrow(_encode(prepare, remembered), _PACKED))
    blocks = both.repartition("block").sortWithinPartitions("block", "bucket")
    assemble = _assemble(end)
    if then:
        run, schema = then
        return blocks.mapInArrow(lambda batches: run(assemble(batches)), schema)
    return blocks.mapInArrow(assemble, "doc_id long, n_tokens long, ids binary" + ", position long" * bool(position))


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """The columns of `encoded` and `decoded`: the bytes of the ids, joined from the token table.

    The table is that of the rank file. An id that it lacks raises an error.
    """
    table = read_ranks(ranks)
    size = max(table.values()) + 1
    words = [b""] * size
    for word, rank in table.items():
        words[rank] = word
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    body = np.frombuffer(b"".join(words), dtype=np.uint8)
    shared = tokens.sparkSession.sparkContext.broadcast((body, np.cumsum(lengths) - lengths, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, starts, lengths = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                out = []
                for raw in part.column("ids"):
                    ids = np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
                    if len(ids) and (lengths[ids] == 0).any():
                        raise ValueError("an id without a token")
                    out.append(gather(body, starts[ids], lengths[ids]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(out, pa.binary())],
                    [*part.schema.names, "decoded"],
                )

    position = ["position"] if "position" in tokens.columns else []
    return tokens.select("doc_id", "n_tokens", "ids", *position).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary" + ", position long" * bool(position) + ", decoded binary"
    )
