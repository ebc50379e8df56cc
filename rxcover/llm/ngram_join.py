"""Jaccard join on word n-grams by vertical partitioning.

The n-grams are put into one global order, that of their 64-bit hashes, and the
order is cut into fragments. If two sets differ in at most D n-grams and the
order is cut into more than D fragments, some fragment must be equal in both.
So documents meet on equal fragments. Those that meet are screened by bit sketches
that never reject a similar pair. Of documents connected that way, the overlaps are
counted in each fragment of the order separately and summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcover.llm.components import components
from rxcover.llm.shared import keep_ids, stored
from rxcover.llm.textvec import mix, shingle_sets, text_chunks

# Text of one block: its documents are handled together, equal sets in it only once.
BLOCK_BYTES = 16 << 20
# Sets that are compared with as many others in one go.
TILE = 512
# N-grams of one fragment when overlaps are counted.
FRAGMENT = 4096
GROUP = ["component", "class", "i", "j", "between"]

_PACKED = "block long, bucket int, payload binary, docs array<struct<doc_id: long, n: long, node: long, class: int, sketch: binary>>"

_DOCS = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("class", pa.int32()), ("sketch", pa.binary())])
)


class Cut:
    """How sets of each size are cut, for a similarity of `numerator` / `denominator` or more.

    Sizes fall into classes between powers of the inverse similarity, so similar
    sets are of the same or of adjacent classes. A scheme is cut for pairs whose
    smaller set is in its class; each set uses the schemes of its own class and
    of the class below.
    """

    def __init__(self, numerator: int, denominator: int):
        self.numerator, self.denominator = numerator, denominator
        # Class c holds sizes from tops[c - 1] + 1 to tops[c].
        self.tops = [0, 1]

    def size_class(self, n: int) -> int:
        while self.tops[-1] < n:  # up to the largest size that can be similar to the smallest of the class
            smallest = self.tops[-1] + 1
            self.tops.append(max(self.tops[-1] + 1, smallest * self.denominator // self.numerator))
        return int(np.searchsorted(self.tops, n))

    def differences(self, size_class: int) -> int:
        """The most n-grams in which a pair can differ whose smaller set is in the class."""
        union = self.tops[size_class] * self.denominator // self.numerator
        return union * (self.denominator - self.numerator) // self.denominator

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """A 64-bit key for each fragment of each scheme of a sorted set.

        Empty fragments have no key, unless so many are empty that a similar set
        might be equal in empty ones only; then that holds for both sets.
        """
        own = self.size_class(len(grams))
        sums = np.zeros(len(grams) + 1, dtype=np.uint64)
        np.cumsum(mix(grams, 3), out=sums[1:])
        high = grams >> np.uint64(32)
        found = []
        for scheme in (own, own - 1):
            if scheme < 1:
                continue
            most = self.differences(scheme)
            if not most:  # only equal sets are similar, and those are one node
                continue
            parts = most + 2 + most // 16
            fragment = ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            counts = np.bincount(fragment, minlength=parts)
            ends = np.cumsum(counts)
            segment = sums[ends] - sums[ends - counts]
            key = mix(
                segment
                + np.arange(parts, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                + counts.astype(np.uint64) * np.uint64(0x165667B19E3779F9),
                100 + scheme,
            )
            filled = counts > 0
            found.append(key if parts - int(filled.sum()) >= parts - most else key[filled])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def set_id(grams: np.ndarray) -> int:
    """One 64-bit id for equal sets."""
    if not len(grams):
        return 0
    return int(mix(np.array([np.add.reduce(mix(grams, 5))], np.uint64) + np.uint64(len(grams)), 9).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """Of each of about 2 n groups of n-grams, whether the set has an odd number of them.

    Two sets that differ in d n-grams differ in at most d of these bits.
    """
    width = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all of the width of the narrowest."""
    width = min(map(len, sketches))
    rows = np.empty((len(sketches), width // 8), dtype=np.uint64)
    for i, raw in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(raw, dtype=np.uint64).reshape(-1, width // 8), axis=0)
    return rows


def _pack(size: int, cut: Cut, buckets: int):
    """Per block one row with its documents and one row of fragment keys for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, counts, nodes, classes, sketches, keys, refs, seen, held = [], [], [], [], [], [], [], set(), 0

        def flush():
            nonlocal block, ids, counts, nodes, classes, sketches, keys, refs, seen, held
            docs = [
                dict(zip(("doc_id", "n", "node", "class", "sketch"), doc))
                for doc in zip(ids, counts, nodes, classes, sketches)
            ]
            rows = [(block, -1, b"", docs)]
            if sum(map(len, keys)):
                key = np.concatenate(keys)
                ref = np.repeat(np.array([r for r, _ in refs], np.uint16), [c for _, c in refs])
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                key, ref, bucket = key[order], ref[order], bucket[order]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for low, high in zip(starts, np.r_[starts[1:], len(key)]):
                    # 6 bytes of the key (the bucket tells more) and the step to the next document of the block
                    tall = (key[low:high] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                    steps = np.diff(ref[low:high], prepend=np.uint16(0)).astype(np.uint16)
                    rows.append((block, int(bucket[low]), tall.tobytes() + steps.tobytes(), None))
            block += 1
            ids, counts, nodes, classes, sketches, keys, refs, seen, held = [], [], [], [], [], [], [], set(), 0
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.binary()),
                    pa.array(columns[3], _DOCS),
                ],
                ["block", "bucket", "payload", "docs"],
            )

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, data, offsets in text_chunks(batch.column("text")):
                if held + len(data) > BLOCK_BYTES or len(ids) + len(offsets) > 60_000:
                    if ids:
                        yield from flush()
                held += len(data)
                for i, grams in enumerate(shingle_sets(data, offsets, size)):
                    node = set_id(grams)
                    # Without an id nothing can be linked; without words neither.
                    new = len(grams) > 0 and doc_ids[first + i] is not None and node not in seen
                    sketches.append(sketch(grams) if new else None)
                    if new:
                        seen.add(node)
                        found = cut.keys(grams)
                        keys.append(found)
                        refs.append((len(ids), len(found)))
                    ids.append(doc_ids[first + i])
                    counts.append(len(grams))
                    nodes.append(node)
                    classes.append(cut.size_class(len(grams)))
        if ids:
            yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed rows sorted by bucket: the keys that occur more than once."""
    bucket, parts = None, []

    def flush():
        key = np.concatenate([k for _, k, _ in parts])
        block = np.repeat(np.array([b for b, _, _ in parts], np.int64), [len(k) for _, k, _ in parts])
        ref = np.concatenate([r for _, _, r in parts])
        order = np.argsort(key, kind="stable")
        key, block, ref = key[order], block[order], ref[order]
        same = key[1:] == key[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        key, block, ref = key[shared], block[shared], ref[shared]
        whole = ((key << np.uint64(16)) ^ np.uint64(bucket)).view(np.int64)
        for low in range(0, len(key), 100_000):
            part = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole[part]), pa.array(block[part]), pa.array(ref[part].astype(np.int32))],
                ["key", "block", "ref"],
            )

    for batch in batches:
        rows = zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("payload"))
        for block, new, payload in rows:
            if new != bucket and parts:
                yield from flush()
                parts = []
            bucket = new
            raw = np.frombuffer(payload.as_buffer(), dtype=np.uint8)
            n = len(raw) // 8
            tall = np.zeros((n, 8), dtype=np.uint8)
            tall[:, :6] = raw[: 6 * n].reshape(n, 6)
            steps = np.frombuffer(raw[6 * n :].tobytes(), dtype=np.uint16)
            parts.append((block, tall.view(np.uint64).ravel(), np.cumsum(steps, dtype=np.uint16)))
    if parts:
        yield from flush()


def _screen(numerator: int, denominator: int):
    """From (key, node, n, sketch) sorted by key: edges that connect what may be similar among the sets of a key.

    Sets of similarity t differ in at most (1 - t) / (1 + t) of the sum of their
    sizes, so in no more bits of their sketches. All that pass with the key's first
    set are connected by it; each of the others is held against all.
    """

    def near(rows: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
        differ = np.bitwise_count(rows ^ rows[i]).sum(axis=1, dtype=np.int64)
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        return (differ * (numerator + denominator) <= (denominator - numerator) * (sizes + sizes[i])) & (
            small * denominator >= large * numerator
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, counts, sketches = None, [], [], []

        def flush():
            rows, sizes = _folded(sketches), np.array(counts, dtype=np.int64)
            label = np.where(near(rows, sizes, 0), 0, np.arange(len(nodes)))
            for i in np.flatnonzero(label):
                met = np.unique(label[near(rows, sizes, i)])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
            joined = np.flatnonzero(label != np.arange(len(nodes)))
            ids = np.array(nodes, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[label[joined]]), pa.array(ids[joined])], ["a", "b"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "node", "n", "sketch"))
            for own, node, n, raw in zip(*columns):
                if own != key:
                    if len(nodes) > 1:
                        yield flush()
                    key, nodes, counts, sketches = own, [], [], []
                nodes.append(node)
                counts.append(n)
                sketches.append(raw)
        if len(nodes) > 1:
            yield flush()

    return run


def _sets(size: int):
    """The set of each document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("text")):
                found = [grams for grams in shingle_sets(data, offsets, size) if len(grams)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([set_id(g) for g in found], pa.int64()), pa.array([g.tobytes() for g in found])],
                        ["node", "grams"],
                    )

    return run


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which of the `left` sets are similar to which of the `right` ones.

    The order of n-grams is cut into fragments; the overlaps of all pairs are
    counted in one fragment at a time and summed.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # An n-gram of one set alone is in no overlap.
    place = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, int((times > 1).sum()), FRAGMENT):
        part = slice(*np.searchsorted(column, [low, low + FRAGMENT]))
        present = np.zeros((len(sets), FRAGMENT), dtype=np.float32)
        present[row[part], column[part] - low] = 1
        common += present[left] @ present[right].T
    common = common.astype(np.int64)
    return common * denominator >= (sizes[left][:, None] + sizes[right][None, :] - common) * numerator


def _compare(numerator: int, denominator: int):
    """From sets sorted by group: edges that connect what is similar in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, sets = None, [], [], []

        def flush():
            side = np.array(sides)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            alone = key[-1] == 0  # the group is one tile, compared with itself
            if alone:
                right = left
            if not len(left) or not len(right) or len(nodes) < 2:
                return
            near = np.zeros((len(nodes), len(nodes)), dtype=bool)
            near[np.ix_(left, right)] = _linked(sets, left, right, numerator, denominator)
            near |= near.T
            label = np.arange(len(nodes))
            while True:  # the first row that each row reaches
                least = np.minimum(label, np.where(near, label, len(nodes)).min(axis=1))
                least = least[least]
                if (least == label).all():
                    break
                label = least
            joined = np.flatnonzero(label != np.arange(len(nodes)))
            if len(joined):
                ids = np.array(nodes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[joined]]), pa.array(ids[joined])], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in GROUP))
            rows = zip(keys, batch.column("node").to_pylist(), batch.column("side").to_pylist(), batch.column("grams"))
            for own, node, side, grams in rows:
                if own != key:
                    if nodes:
                        yield from flush()
                    key, nodes, sides, sets = own, [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(np.frombuffer(grams.as_py(), dtype=np.uint64))
        if nodes:
            yield from flush()

    return run


class NgramJoin:
    """Documents linked when the Jaccard similarity of their word n-gram sets is at least a threshold.

    `size` words make an n-gram (A-Z lower-cased, split at white space); a shorter
    text is one n-gram, a text without words (or null) has none and no link. The
    threshold is `numerator` / `denominator`. Rows with null `doc_id` get null
    `component_id`; rows that repeat a `doc_id` are labelled by their own text each. An empty table gives an empty result. Other columns are ignored.

    Equal sets are one node, so a group of copies costs one row per block of 16 MB
    of text. Building runs jobs, as the components need rounds; every
    intermediate table goes to the shared folder. `buckets` should grow with the
    data: a bucket's keys, 8 bytes each, are held by one task. Comparing returns
    edges that span what is linked, never all pairs. What it costs grows with the
    square of the sets that are connected so within one size class; that work is
    dealt out by tiles of `tile` sets.
    """

    def __init__(
        self,
        docs: DataFrame,
        size: int = 5,
        numerator: int = 8,
        denominator: int = 10,
        buckets: int = 0,
        tile: int = TILE,
    ):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.size, self.numerator, self.denominator = size, numerator, denominator
        self.cut, self.tile = Cut(numerator, denominator), tile
        self.buckets = buckets or min(65_536, max(256, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def result(self) -> DataFrame:
        """`doc_id`, `n_shingles`, `component_id` for every row."""
        packed = self.docs.mapInArrow(_pack(self.size, self.cut, self.buckets), _PACKED)
        packed = stored(packed, "fragments", "lz4")
        members = (
            packed.filter("bucket < 0")
            .selectExpr("block", "posexplode(docs) AS (ref, doc)")
            .selectExpr("block", "ref", "doc.doc_id", "doc.n", "doc.node", "doc.class", "doc.sketch")
        )
        members = stored(members, "members")
        # Each different set once.
        nodes = members.filter("sketch IS NOT NULL").groupBy("node")
        nodes = nodes.agg(*[F.max(c).alias(c) for c in ("n", "class", "sketch")], F.min("doc_id").alias("doc_id"))
        return self._labelled(members, components(self._links(self._met(packed, members, nodes), nodes)))

    def _met(self, packed: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """`node`, `component`: different sets connected by equal fragments and similar sketches."""
        dealt = packed.filter("bucket >= 0").select("block", "bucket", "payload")
        shared = dealt.repartition("bucket").sortWithinPartitions("bucket", "block")
        shared = stored(shared.mapInArrow(_meet, "key long, block long, ref int"), "met")
        named = shared.join(members.select("block", "ref", "node"), ["block", "ref"]).select("key", "node")
        named = stored(named.distinct(), "keys")
        # Near duplicates share many fragments: of keys with the same sets one is enough.
        who = named.groupBy("key").agg(
            F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
        )
        once = who.filter("rows > 1").groupBy("rows", "x", "y").agg(F.min("key").alias("key")).select("key")
        met = stored(named.join(once, "key", "left_semi"), "shared")
        rows = met.join(nodes.select("node", "n", "sketch"), "node").select("key", "node", "n", "sketch")
        rows = rows.repartition("key").sortWithinPartitions("key", "node")
        return components(rows.mapInArrow(_screen(self.numerator, self.denominator), "a long, b long"))

    def _links(self, met: DataFrame, nodes: DataFrame) -> DataFrame:
        """Edges between similar sets: every pair that can be similar is compared in the tile of both."""
        # A row for each different set that met another one.
        wanted = stored(nodes.select("node", "doc_id", "class").join(met, "node"), "wanted")
        texts = keep_ids(self.docs, wanted.select("doc_id"), "doc_id", wanted.count())
        sets = texts.mapInArrow(_sets(self.size), "node long, grams binary")
        dealt = stored(self._tiles(wanted), "tiles")
        # A hot component is many groups, so neither side of this join is skewed beyond its tiles.
        rows = dealt.join(sets.dropDuplicates(["node"]), "node")
        rows = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "node")
        return rows.mapInArrow(_compare(self.numerator, self.denominator), "a long, b long")

    def _tiles(self, wanted: DataFrame) -> DataFrame:
        """(group, node, side): the groups in which each set is compared.

        A small component is one group. In a larger one the sets of a size class
        are dealt to tiles, and tiles of the same and of adjacent classes meet.
        """
        sizes = wanted.groupBy("component", "class").agg(F.count("*").alias("rows"))
        # Tables of their own, so that joins with them can split a large component.
        total = stored(wanted.groupBy("component").agg(F.count("*").alias("total")), "totals")
        small = total.filter(F.col("total") <= self.tile).select("component")
        zero = [F.lit(0).alias(c) for c in ("class", "i", "j")]
        whole = wanted.join(small, "component").select(
            "component", *zero, F.lit(0).alias("between"), "node", F.lit(0).alias("side")
        )
        tiles = sizes.join(total.filter(F.col("total") > self.tile), "component").select(
            "component", "class", F.expr(f"cast((rows + {self.tile - 1}) div {self.tile} as int)").alias("n")
        )
        tiles = stored(tiles, "tiles")
        placed = wanted.join(tiles, ["component", "class"]).withColumn(
            "own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")).cast("int")
        )
        own, other = F.col("own"), F.col("other")
        same = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
            "component",
            "class",
            F.least(own, other).alias("i"),
            F.greatest(own, other).alias("j"),
            (own != other).cast("int").alias("between"),
            "node",
            (own > other).cast("int").alias("side"),
        )
        every = lambda: F.explode(F.sequence(F.lit(0), F.col("m") - 1))
        above = tiles.select("component", (F.col("class") - 1).alias("class"), F.col("n").alias("m"))
        up = placed.join(above, ["component", "class"]).withColumn("other", every())
        up = up.select("component", "class", own.alias("i"), other.alias("j"), F.lit(2), "node", F.lit(0))
        below = tiles.select("component", (F.col("class") + 1).alias("class"), F.col("n").alias("m"))
        down = placed.join(below, ["component", "class"]).withColumn("other", every())
        down = down.select(
            "component", (F.col("class") - 1).alias("class"), other.alias("i"), own.alias("j"), F.lit(2), "node", F.lit(1)
        )
        return whole.union(same).union(up).union(down)

    def _labelled(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Each document with the smallest `doc_id` it can reach."""
        node = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("node"))
        named = members.withColumn("node", node).join(found, "node", "left")
        label = F.coalesce("component", "node")
        named = named.select("doc_id", F.col("n").alias("n_shingles"), label.alias("label"))
        least = named.filter("label IS NOT NULL").groupBy("label").agg(
            F.min("doc_id").alias("least"), F.count("*").alias("rows")
        )
        # Most labels have one row, which needs no join.
        crowded = least.filter("rows > 1").select("label", "least")
        return named.join(crowded, "label", "left").select(
            "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
        )


def ngram_components(docs: DataFrame, **options: int) -> DataFrame:
    return NgramJoin(docs, **options).result()
