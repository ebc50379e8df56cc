"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is a run of item words, a shingle a short run within it. A document holds
a window only if it holds all of its shingles, so one necessary shingle suffices to
meet: the rarest, by occurrences over all documents. Documents are read once and
keep the places of shingles that occur in any item; the join, the positional bound
and the exact comparison of whole windows then work on those places.
"""

from __future__ import annotations

import string
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxcover.llm.shared import stored

# Fixed value of the contract: what separates words once A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
# The bit set that screens places has 16 bits a shingle up to this many; beyond that more places pass it.
MOST_BITS = 1 << 22
# Windows are broadcast up to this many rows (about 200 bytes each); above, an ordinary join is used.
BROADCAST_WINDOWS = 200_000


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(folded)


def text_words(text: Column) -> Column:
    return F.filter(F.split(lowered(text), BETWEEN_WORDS), lambda word: word != "")


def _shingle_key(words: Column, first: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, first + i) for i in range(size)])


def _grams(words: Column, size: int) -> Column:
    """All runs of `size` words, joined by spaces."""
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))


def item_windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (`wid`, `words`, `size` of their shingles) and the items (`wid`, `item_id`) that have them."""
    words = items.select("item_id", text_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - (window - 1), F.lit(1))
    cut = words.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("words", i, F.lit(window)))).alias("words"),
    )
    cut = stored(cut.distinct(), "item-windows")
    windows = stored(
        cut.select("words").distinct().select(
            F.monotonically_increasing_id().alias("wid"), "words", F.least(F.size("words"), F.lit(shingle)).alias("size")
        ),
        "windows",
    )
    return windows, cut.join(windows, "words").select("wid", "item_id")


def _bits(keys: DataFrame, count: int) -> tuple[Column, int]:
    """A set of bits, 64 to a word, with those of the keys set; and its size."""
    size = min(MOST_BITS, max(1 << 12, 1 << (16 * count - 1).bit_length()))
    place = F.shiftrightunsigned("key", 64 - (size.bit_length() - 1))
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits")
    )
    values = [0] * (size // 64)
    for row in words.collect():  # at most MOST_BITS / 64 rows
        values[row["word"]] = row["bits"]
    # Text that the optimiser folds into one literal.
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), size


def _places(words: Column, size: int, bits: Column, bit_count: int) -> Column:
    """Positions and keys of the shingles of `size` words whose bit is set, in order."""
    every = F.transform(
        words, lambda _, i: F.struct(i.alias("p"), _shingle_key(words, i, size).alias("key"))
    )

    def may_be_in(place: Column) -> Column:
        at = F.shiftrightunsigned(place["key"], 64 - (bit_count.bit_length() - 1))
        word, shift = F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")
        bit = F.call_function("shiftrightunsigned", word, shift)
        return (place["p"] <= F.size(words) - size) & (bit.bitwiseAND(1) == 1)

    return F.filter(every, may_be_in)


def _place_grams(size: int) -> Column:
    return F.transform(f"places_{size}", lambda place: F.array_join(F.slice("words", place["p"] + 1, F.lit(size)), " "))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """`doc_id`, `n_words`, `n_hit`, `n_items`, `item_ids` (array of string, sorted) for every row of `docs`.

    A window is `window` consecutive words of an item, or all words of a shorter
    item. A word of a document is hit if it lies inside an occurrence of any
    window; `item_ids` are the items with occurring windows. Null texts and texts
    without words have no words and hit nothing; items without words have no
    windows; windows of items without an id hit words but name no item. Repeated
    rows are documents, or items, of their own, equal ids are named once. Other
    columns of both tables are ignored. No documents give no rows.

    The documents are read once. What is kept of them is their places with item
    shingles; a passage found in a third of all documents costs a few such places
    in each and is joined by broadcast, or beyond `broadcast_windows` windows by a
    join that leaves skew to adaptive execution.
    """
    windows, window_items = item_windows(items, window, shingle)
    shingles = windows.select(
        "wid", "size", F.posexplode(_grams_of(F.col("words"), F.col("size"), shingle)).alias("offset", "gram")
    ).withColumn("key", _gram_key(F.col("gram"), F.col("size"), shingle))
    shingles = stored(shingles, "item-shingles")
    sizes = [row["size"] for row in shingles.select("size").distinct().orderBy("size").collect()]  # 1 to `shingle`
    many = windows.count() > broadcast_windows
    small = (lambda df: df) if many else F.broadcast

    tokens = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text_words(F.col("text")).alias("words")
    )
    places = {}
    for size in sizes:
        keys = shingles.filter(F.col("size") == size).select("key").distinct()
        places[size] = _places(F.col("words"), size, *_bits(keys, keys.count()))
    found = tokens.select("row", "doc_id", "words", *[p.alias(f"places_{size}") for size, p in places.items()])
    kept = [F.col(f"places_{size}") for size in sizes]
    grams = [_place_grams(size).alias(f"grams_{size}") for size in sizes]
    found = found.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), *kept, *grams)
    found = stored(found, "places")

    hits = None
    for size in sizes:
        some = _hits(found, windows, shingles, window, size, small)
        hits = some if hits is None else hits.unionByName(some)
    base = found.select("row", "doc_id", "n_words")
    none = F.array().cast("array<string>")
    if hits is None:
        zero = F.lit(0).cast("long")
        return base.select("doc_id", "n_words", zero.alias("n_hit"), zero.alias("n_items"), none.alias("item_ids"))
    hits = stored(hits, "hits")
    named = (
        hits.select("row", "wid")
        .distinct()
        .join(small(window_items), "wid")
        .filter(F.col("item_id").isNotNull())
        .select("row", F.col("item_id").cast("string").alias("item_id"))
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    )
    joined = base.join(_hit_words(hits), "row", "left").join(named, "row", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )


def _grams_of(words: Column, size: Column, shingle: int) -> Column:
    chosen = F.when(size == shingle, _grams(words, shingle))
    for n in range(1, shingle):
        chosen = chosen.when(size == n, _grams(words, n))
    return chosen


def _gram_key(gram: Column, size: Column, shingle: int) -> Column:
    words, first = F.split(gram, " "), F.lit(0)
    chosen = F.when(size == shingle, _shingle_key(words, first, shingle))
    for n in range(1, shingle):
        chosen = chosen.when(size == n, _shingle_key(words, first, n))
    return chosen


def _hits(found: DataFrame, windows: DataFrame, shingles: DataFrame, window: int, size: int, small) -> DataFrame:
    """`row`, `start`, `stop`, `wid` of every occurrence of the windows with shingles of `size` words."""
    at, text = F.col(f"places_{size}"), F.col(f"grams_{size}")
    of_size = shingles.filter(F.col("size") == size)
    counts = found.select(F.explode(F.col(f"places_{size}.key")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    # Of a window the rarest shingle is its prefix; a shingle that occurs nowhere rules the window out.
    prefix = (
        of_size.join(counts, "key", "left")
        .groupBy("wid")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("least"),
            F.sort_array(F.collect_list(F.struct("offset", "gram")))["gram"].alias("grams"),
        )
        .filter("least.n > 0")
        .select("wid", "least.key", "least.offset", "grams", F.size("grams").alias("length"))
    )
    reach = window - size  # the largest offset of a shingle in its window
    around = found.select(
        "row",
        F.posexplode(F.col(f"places_{size}.key")).alias("j", "key"),
        at["p"].alias("p"),
        text.alias("grams"),
    )
    low = F.greatest(F.col("j") - reach, F.lit(0))
    around = around.select(
        "row",
        "key",
        (F.col("j") - low).alias("own"),
        F.slice("p", low + 1, F.lit(2 * reach + 1)).alias("near_p"),
        F.slice("grams", low + 1, F.lit(2 * reach + 1)).alias("near"),
    )
    # All shingles of an occurring window are found, so they stand side by side.
    begin = F.col("own") - F.col("offset")
    first, last = F.get("near_p", begin), F.get("near_p", begin + F.col("length") - 1)
    matched = around.join(small(prefix), "key").filter((begin >= 0) & (last - first == F.col("length") - 1))
    matched = matched.filter(F.slice("near", begin + 1, F.col("length")) == F.col("grams"))
    return matched.select("row", first.alias("start"), (last + size).alias("stop"), "wid")


def _hit_words(hits: DataFrame) -> DataFrame:
    """`row`, `n_hit`: words inside any occurrence."""
    spans = hits.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce("reached", F.col("start")))
    fresh = F.greatest(F.col("stop") - reached, F.lit(0))
    return spans.withColumn("reached", F.max("stop").over(before)).groupBy("row").agg(F.sum(fresh).alias("n_hit"))
