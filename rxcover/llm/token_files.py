"""Token ids of a corpus as one long array in shards, with Elias-Fano coded document boundaries.

A shard is a row of a Parquet folder, so any store that Spark writes to will do
and a lost task leaves nothing behind: `part` and `shard` (order), `first` (ids of
the part before it), `docs` (ids of its documents), `n_ids`, `bytes_per_id`, `ids` (the concatenated ids, little-endian), and
the n + 1 boundaries in `ids` as `width`, `lower`, `upper`, `samples`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxcover.llm.bpe import Step
from rxcover.llm.elias_fano import EliasFano
from rxcover.llm.runs import joined

# Ids after which a shard is closed (a document is never split).
SHARD_IDS = 1 << 20

SHARDS = (
    "part int, shard int, first long, docs array<long>, n_ids long, bytes_per_id int, width int, lower binary, upper binary, "
    "samples binary, ids binary"
)
_KINDS = [
    pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.binary(),
    pa.binary(), pa.binary(), pa.binary(),
]
_NAMES = [field.split()[0] for field in SHARDS.split(", ")]


def _narrow(bytes_per_id: int, cuts: list[int]):
    """Ids in few bytes, and the part that each document belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            known = doc_ids.fill_null(0).to_numpy()
            part = np.where(doc_ids.is_null().to_numpy(False), 0, 1 + np.searchsorted(cuts, known, side="left"))
            if batch.column("ids").null_count:
                raise ValueError("null ids")
            refuse_wider(batch.column("ids"), bytes_per_id)
            values, bounds = joined(batch.column("ids"), np.uint32)
            body, edges = values.astype(f"<u{bytes_per_id}").tobytes(), (bounds * bytes_per_id).tolist()
            ids = [packer.compress(body[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), doc_ids, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"]
            )

    return run


def refuse_wider(ids: pa.Array, bytes_per_id: int) -> None:
    """Raise if any id of the column (little-endian unsigned 32-bit) needs more bytes."""
    largest = joined(ids, np.uint32)[0].max(initial=0)
    if int(largest) >> (8 * bytes_per_id):
        raise ValueError(f"id {largest} does not fit {bytes_per_id} bytes")


def _shards(bytes_per_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, first, docs, bodies, held = None, 0, 0, [], [], 0

        def flush():
            lengths = [len(b) // bytes_per_id for b in bodies]
            bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)]))
            row = (part, shard, first, docs, held, bytes_per_id, bounds.width, bounds.lower, bounds.upper, bounds.samples,
                   b"".join(bodies))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], _NAMES)

        for batch in batches:
            for own, doc_id, raw in zip(
                batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")
            ):
                if docs and (own != part or held >= shard_ids):
                    yield flush()
                    shard, first = (shard + 1, first + held) if own == part else (0, 0)
                    docs, bodies, held = [], [], 0
                part = own
                body = zstandard.decompress(raw.as_py())
                docs.append(doc_id)
                bodies.append(body)
                held += len(body) // bytes_per_id
        if docs:
            yield flush()

    return run


def shards_of(
    tokens: DataFrame | Callable[..., DataFrame], doc_ids: DataFrame, bytes_per_id: int = 2, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """The shards that `write_tokens` writes."""
    parts = int(doc_ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = doc_ids.select(F.percentile_approx("doc_id", shares, 100 * parts).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    narrow: Step = (_narrow(bytes_per_id, cuts), "part int, doc_id long, ids binary")
    dealt = tokens(then=narrow) if callable(tokens) else tokens.select("doc_id", "ids").mapInArrow(*narrow)
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    return dealt.mapInArrow(_shards(bytes_per_id, shard_ids), SHARDS)


def write_tokens(
    tokens: DataFrame | Callable[..., DataFrame],
    doc_ids: DataFrame,
    folder: str,
    bytes_per_id: int = 2,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Write `doc_id`, `ids` (little-endian unsigned 32-bit) to `folder` in ascending order of `doc_id`.

    Null ids come first; rows with the same id are neighbours. `tokens` is a table,
    or `bpe.encoded` with all but `then` given: the tasks that make the ids then
    narrow them as well, and no second Python worker stands beside each of them.
    `doc_ids` has the ids alone: their quantiles, read beforehand, cut the order
    into as many parts as there are shuffle partitions, so the ids are shuffled once
    and no pass is spent on samples of them. All ids must fit `bytes_per_id` bytes.
    """
    shards = shards_of(tokens, doc_ids, bytes_per_id, shard_ids)
    shards.write.option("compression", "zstd").mode("overwrite").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """`doc_id`, `start` (ids of all documents before), `n_tokens`, `ids` and `ids_crc32` from the files.

    `ids` has 4 bytes each, as does what the checksum is taken of. Without `with_ids`
    that column is left out and the ids stay in the tasks that read them.
    """
    shards = spark.read.schema(SHARDS).parquet(folder)
    # One row for each part: as many as the writer had shuffle partitions, and one for null ids.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: B023, E731
                docs = get("docs").as_py()
                bounds = EliasFano(
                    len(docs) + 1, *(get(c).as_py() for c in ("width", "lower", "upper", "samples"))
                ).all()
                ids = np.frombuffer(get("ids").as_buffer(), f"<u{get('bytes_per_id').as_py()}")
                for low in range(0, len(docs), 64):
                    spans = list(zip(bounds[low : low + 64], bounds[low + 1 : low + 65]))
                    found = [ids[a:b].astype("<u4").tobytes() for a, b in spans]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([get("part").as_py()] * len(found), pa.int32()),
                            pa.array(docs[low : low + 64], pa.int64()),
                            pa.array([get("first").as_py() + int(a) for a, _ in spans], pa.int64()),
                            pa.array([int(b - a) for a, b in spans], pa.int64()),
                            *([pa.array(found, pa.binary())] if with_ids else []),
                            pa.array([zlib.crc32(f) for f in found], pa.int64()),
                        ],
                        ["part", "doc_id", "at", "n_tokens", *body, "ids_crc32"],
                    )

    body = ["ids"] if with_ids else []
    schema = "part int, doc_id long, at long, n_tokens long" + ", ids binary" * with_ids + ", ids_crc32 long"
    return shards.mapInArrow(run, schema).join(F.broadcast(ahead), "part").select(
        "doc_id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", *body, "ids_crc32"
    )
