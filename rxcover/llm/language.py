"""Language identification with bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from rxcover.llm.shared import stored
from rxcover.llm.terms import letter_runs, lowered
from rxcover.llm.textvec import mix, text_chunks
from rxcover.llm.texts import with_text_columns

# Slots of the filters; a slot holds a bit for each language. 64 languages take 8 bytes a slot.
SLOTS = 1 << 20
HASHES = 3
GRAM = 4
# A language contains an n-gram whose rate in it is at least this share of the largest rate in any language.
SHARE = 0.5
UNDETERMINED = "und"


def grams(data: np.ndarray, offsets: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all runs of `size` bytes within words of letters, a space before and after each word."""
    low = lowered(data)
    starts, ends, rows = letter_runs(low, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # The words in a row, each behind a space, and one more space at the end.
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) + 1
    line = np.full(int(lengths.sum()) + len(lengths) + 1, 32, dtype=np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line[np.repeat(begin, lengths) + within] = low[np.repeat(starts, lengths) + within]
    count = len(line) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(count, dtype=np.uint64)
    for i in range(size):
        value = (value << np.uint64(8)) | line[i : i + count]
    # A run belongs to the word it starts in (its leading space included), and may end with the next space.
    word = np.repeat(np.arange(len(lengths)), lengths + 1)[:count]
    last = (begin + lengths)[word]  # place of the space behind the word
    inside = np.arange(count) + size - 1 <= last
    return rows[word[inside]], value[inside]


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray  # (words, slots): bit l % 64 of word l // 64 is set where language l's filter is
    rates: np.ndarray  # of each language the share of unknown n-grams its filter still reports

    def counts(self, rows: np.ndarray, values: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text its n-grams, and per text and language those that its filter contains."""
        slots = (self.table.shape[1] - 1) & (
            mix(values)[None, :] >> (np.arange(HASHES, dtype=np.uint64) * np.uint64(21))[:, None]
        ).astype(np.int64)
        bounds = np.searchsorted(rows, np.arange(texts + 1))
        found = np.zeros((texts, len(self.languages)))
        for w, line in enumerate(self.table):
            masks = line[slots[0]]
            for s in slots[1:]:
                masks &= line[s]
            for l in range(64 * w, min(len(self.languages), 64 * w + 64)):
                bits = np.zeros(len(masks) + 1, dtype=np.int64)
                np.cumsum((masks >> np.uint64(l % 64)) & np.uint64(1), out=bits[1:])
                found[:, l] = bits[bounds[1:]] - bits[bounds[:-1]]
        return np.diff(bounds), found


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language the distinct n-grams with counts, given out whenever many are held."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return values, np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

    def flush():
        for lang, parts in held.items():
            values, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
        for first, data, offsets in text_chunks(batch.column("text")):
            rows, values = grams(data, offsets)
            own = langs[first : first + len(offsets) - 1]
            for lang in sorted(set(own)):
                part, counts = np.unique(values[(own == lang)[rows]], return_counts=True)
                held.setdefault(lang, []).append((part, counts))
                size += len(part)
        if size > 4_000_000:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > 2_000_000:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def learn(docs: DataFrame, slots: int = SLOTS, share: float = SHARE) -> LanguageFilters:
    """Filters of the languages in `docs` (`text`, `lang`); rows without either teach nothing.

    The n-grams of all texts are counted, combined per task before the shuffle.
    A language contains an n-gram if its rate there is at least `share` of its
    largest rate in any language. Only the filters, `slots` masks of fixed size
    for each 64 languages, come to the driver.
    """
    if slots & (slots - 1) or slots > 1 << 21:
        raise ValueError("slots must be a power of 2, at most 2 ** 21")
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_gram_counts, "lang string, gram long, n long")
    counted = stored(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # Most text first, so that bit 0 wins a tie.
    languages = [r["lang"] for r in totals.orderBy(F.desc("total"), "lang").collect()]
    rated = counted.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    inside = best.select("gram", F.explode("all").alias("one"), "best").filter(F.col("one.rate") >= share * F.col("best"))
    number = F.map_from_arrays(F.array(*map(F.lit, languages)), F.array(*map(F.lit, range(len(languages))))) if languages else None
    masks = []
    if languages:
        numbered = inside.select("gram", F.element_at(number, F.col("one.lang")).alias("l"))
        per_gram = numbered.groupBy("gram", F.expr("l div 64").alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(l % 64 as int)))").alias("mask")
        )
        set_slots = per_gram.mapInArrow(_slots(slots), "word long, slot long, mask long")
        masks = set_slots.groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    table = np.zeros(((len(languages) + 63) // 64, slots), dtype=np.uint64)
    if languages:
        table[masks["word"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    rates = np.array(
        [np.mean((table[l // 64] >> np.uint64(l % 64)) & np.uint64(1)) ** HASHES for l in range(len(languages))]
    )
    return LanguageFilters(languages, table, rates)


def _slots(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = mix(batch.column("gram").to_numpy().view(np.uint64))
            for i in range(HASHES):
                slot = (hashed >> np.uint64(21 * i)).astype(np.int64) & (slots - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word"), pa.array(slot), batch.column("mask")], ["word", "slot", "mask"]
                )

    return run


def identified(docs: DataFrame, filters: LanguageFilters, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `carry` columns, `lang_pred` and `score` of every row.

    A language's count of contained n-grams is corrected for its filter's false
    positives: of n, about rate * n are reported by chance. The largest corrected
    count decides; ties go to the language with more text. `score` is its share of
    all corrected counts. Texts that are null or have no letter are `und` with
    score 0, as are all texts if nothing was learned. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def prepare():
        filters = shared.value

        def compute(data, offsets):
            texts = len(offsets) - 1
            strings = pa.Array.from_buffers(
                pa.large_string(), texts, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
            )
            letters = has_letter(strings)
            if not filters.languages:
                return [[UNDETERMINED] * texts, np.zeros(texts)]
            rows, values = grams(data, offsets)
            n, found = filters.counts(rows, values, texts)
            real = np.maximum(0, (found - n[:, None] * filters.rates) / np.maximum(1e-9, 1 - filters.rates))
            best = real.argmax(axis=1)
            total = real.sum(axis=1)
            score = np.where(letters & (total > 0), real.max(axis=1) / np.maximum(total, 1e-9), 0.0)
            names = [filters.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            return [names, score]

        return compute

    return with_text_columns(
        docs, carry, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], prepare
    )
