"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcover.llm.components import components
from rxcover.llm.shared import stored

# Passes over as many vectors as 40 windows hold; beyond that they grow with the cube root of the rows.
PASSES = 16
# Rows before each row with which a pass compares it.
WINDOW = 512
# Rows of a component that one task compares with as many others.
TILE = 2048
SEED = 7


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Parts of sorted batches within which `keys` are equal, as (key, part)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for low, high in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield tuple(c[low] for c in columns), batch.slice(low, high - low)


def _hashes(passes: int, seed: int):
    """For every vector and pass, the signs of 63 random projections as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(62, -1, -1, dtype=np.int64)
        for (size,), part in _runs(batches, ["size"]):
            vectors = _unit(_matrix(part.column("vec")))
            if size not in planes:
                planes[size] = np.random.Generator(np.random.PCG64([seed, size])).standard_normal((size, passes * 63))
            for low in range(0, len(vectors), 1024):
                rows = slice(low, low + 1024)
                signs = (vectors[rows] @ planes[size]) > 0
                codes = signs.reshape(-1, passes, 63) @ weights
                count = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(passes, dtype=np.int32), count)),
                        pa.array(np.full(count * passes, size, dtype=np.int32)),
                        pa.array(codes.ravel()),
                        part.column("rep").slice(low, 1024).take(pa.array(np.repeat(np.arange(count), passes))),
                        part.column("vec").slice(low, 1024).take(pa.array(np.repeat(np.arange(count), passes))),
                    ],
                    ["pass", "size", "code", "rep", "vec"],
                )

    return run


def passes_for(rows: int, window: int = WINDOW) -> int:
    """Passes over `rows` vectors.

    A pass misses ever more pairs as rows come between them. Of two vectors with
    cosine 0.95 the signs of a projection agree with a chance of 0.90, of others
    with 1/2, or 0.72 if all lie in a cone around one direction (mean cosine 0.8).
    Codes agree where windows are cut with chances that fall with the power 0.15
    or 0.33 of the rows, so this many passes hold the recall of both.
    """
    return max(PASSES, math.ceil(PASSES * (rows / (40 * window)) ** (1 / 3)))


KEYS = ["pass", "size", "code", "rep"]


def _neighbours(threshold: float, window: int):
    """In rows sorted by `KEYS`: edges `a`, `b` that connect what is linked within the window.

    The first and last `window` rows of a partition follow as rows without edge,
    as their neighbours may be in other partitions.
    """

    def ends(part: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(part.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *[part.column(c) for c in [*KEYS, "vec"]]], ["a", "b", *KEYS, "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tail, tail_ids = None, None, None
        # Rows of the first pass and size still to hand on, and the last rows of the present one.
        missing, last = window, None
        for new, part in _runs(batches, ["pass", "size"]):
            if new != key:
                missing, last = window if key is None else 0, None
                key, tail, tail_ids = new, np.zeros((0, int(new[1]))), np.zeros(0, dtype=np.int64)
            front = min(missing, part.num_rows)
            if front:
                missing -= front
                yield ends(part.slice(0, front))
            held = [last, part.slice(front)] if last is not None else [part.slice(front)]
            last = pa.concat_batches(held) if len(held) > 1 else held[0]
            last = last.slice(max(0, last.num_rows - window))
            vectors, ids = _unit(_matrix(part.column("vec"))), part.column("rep").to_numpy()
            for low in range(0, len(ids), window):
                block = np.concatenate([tail, vectors[low : low + window]])
                block_ids = np.concatenate([tail_ids, ids[low : low + window]])
                linked = block @ block.T >= threshold
                label = np.arange(len(block))
                while True:  # the least row that each row reaches
                    least = np.where(linked, label, len(block)).min(axis=1)
                    least = np.minimum(least, label)
                    least = least[least]
                    if (least == label).all():
                        break
                    label = least
                joined = label != np.arange(len(block))
                if joined.any():
                    found = [pa.array(block_ids[label[joined]]), pa.array(block_ids[joined])]
                    none = [pa.nulls(len(found[0]), part.schema.field(c).type) for c in [*KEYS, "vec"]]
                    yield pa.RecordBatch.from_arrays([*found, *none], ["a", "b", *KEYS, "vec"])
                tail, tail_ids = block[-window:], block_ids[-window:]
        if last is not None and last.num_rows:
            yield ends(last)

    return run


def _tile_counts(threshold: float):
    """For the rows of one pair of tiles, the number of vectors linked in the other tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            side = np.concatenate([p.column("side").to_numpy() for p in held])
            ids = np.concatenate([p.column("rep").to_numpy() for p in held])
            copies = np.concatenate([p.column("copies").to_numpy() for p in held])
            vectors = _unit(np.concatenate([_matrix(p.column("vec")) for p in held]))
            left, right = side == 0, side == 1
            if key[1] == key[2]:  # a tile with itself
                right = left
            linked = vectors[left] @ vectors[right].T >= threshold
            if right is left:
                np.fill_diagonal(linked, False)
            out = [(ids[left], linked @ copies[right])]
            if right is not left:
                out.append((ids[right], copies[left] @ linked))
            for found, counts in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(counts.astype(np.int64))], ["rep", "linked"]
                )

        for new, part in _runs(batches, ["component", "i", "j"]):
            if new != key and held:
                yield from flush()
                held = []
            key = new
            held.append(part)
        if held:
            yield from flush()

    return run


def linked_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    passes: int | None = None,
    window: int = WINDOW,
    tile: int = TILE,
    seed: int = SEED,
) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` for every row of `vec_id`, `embedding`.

    Each pass orders all vectors by the signs of 63 random projections, put one
    after the other, and compares each vector with the `window` before it, those at
    the end of another partition included; pairs with cosine >= `threshold` (double
    precision) are united across passes. By default `passes_for` gives their number. Then
    every pair within a component is compared, in tiles, so `n_links` is exact
    for the components found and nothing needs to hold all pairs: a tile returns
    counts. A pass may miss a pair, all passes seldom do; the chance falls
    geometrically with their number.

    Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing; so do vectors of different lengths. Equal vectors are one
    class that is compared once and counts as often as it occurs, so copies that
    make up a third of all rows cost one row. Rows that repeat a `vec_id` with
    another vector are vectors of their own; a null `vec_id` has null
    `component_id` and links with nothing. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    finite = "x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')"
    usable = F.expr(
        f"vec_id IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> {finite}) AND exists(vec, x -> x <> 0)"
    )
    # Adding 0 makes -0.0 and 0.0 one value.
    shown = rows.withColumn("vec", F.when(usable, F.expr("transform(vec, x -> x + 0)")))
    classes = (
        shown.filter("vec IS NOT NULL")
        .groupBy("vec")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .select(F.xxhash64("least", "vec").alias("rep"), "least", "copies", F.size("vec").alias("size"), "vec")
    )
    classes = stored(classes, "classes")
    kind = dict(classes.dtypes)["vec"]
    passes = passes_for(classes.count(), window) if passes is None else passes
    hashed = classes.select("size", "rep", "vec").mapInArrow(
        _hashes(passes, seed), f"pass int, size int, code long, rep long, vec {kind}"
    )
    ordered = stored(hashed, "passes", "lz4")
    ordered = ordered.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    met = ordered.mapInArrow(_neighbours(threshold, window), f"a long, b long, pass int, size int, code long, rep long, vec {kind}")
    met = stored(met, "met")
    # The ends of all partitions in order, by pass: 2 * `window` rows a partition.
    across = met.filter("a IS NULL").select(*KEYS, "vec").repartition("pass", "size").sortWithinPartitions(*KEYS)
    across = across.mapInArrow(_neighbours(threshold, window), met.schema)
    edges = met.unionByName(across).filter("a IS NOT NULL").select("a", "b")
    found = components(edges)

    joined = found.join(classes, found["node"] == classes["rep"]).select("component", "rep", "least", "copies", "vec")
    joined = stored(joined, "linked")
    totals = joined.groupBy("component").agg(F.count("*").alias("rows"), F.min("least").alias("component_id"))
    tiles = (
        joined.join(totals, "component")
        .withColumn("n", F.expr(f"cast((rows + {tile - 1}) div {tile} as int)"))
        .withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    )
    tiles = tiles.select(
        "component",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "rep",
        "copies",
        "vec",
    )
    tiles = tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counts = tiles.mapInArrow(_tile_counts(threshold), "rep long, linked long")
    counts = counts.groupBy("rep").agg(F.sum("linked").alias("linked"))
    per_class = (
        classes.select("rep", "least", "copies")
        .join(counts, "rep", "left")
        .join(joined.join(totals, "component").select("rep", "component_id"), "rep", "left")
        .select(
            "rep",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    # Of equal vectors each row finds its class by the hash of the vector; the class's least id is part of it.
    keyed = classes.select("vec", "rep").withColumn("hash", F.xxhash64("vec"))
    per_vector = keyed.join(per_class, "rep").select("hash", "vec", "n_links", "component_id")
    out = shown.withColumn("hash", F.xxhash64("vec")).join(per_vector, ["hash", "vec"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
