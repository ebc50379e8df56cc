"""Earliest deadline first over blocks with release times, as a scan over spans of slots.

A block is `struct<due, key, block, release>`; of those released, a slot takes the
least (due first, ties by key). What a span of slots does with the blocks released
in it alone is summed up in a row; rows of neighbouring spans combine, as blocks
that arrive late may take any slot of the next span: of these and the span's own
blocks the first due are done. The rows are combined upwards, `FAN` at a time, what
is pending is handed down the same way, and each span is then worked out by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxcover.llm.shared import stored

# Slots of the spans at the bottom, and how many spans one step combines.
LEAF = 64
FAN = 64
# Rows that one window of the running totals sees at most.
RUN = 4096
FOREVER = 1 << 62

BLOCKS = "array<struct<due: bigint, key: string, block: bigint, release: bigint>>"
_PLAN = "array<struct<slot: bigint, due: bigint, key: string, block: bigint, release: bigint>>"
_SPAN = f"struct<until: bigint, idle: bigint, done: {BLOCKS}, late: {BLOCKS}>"
_RUN = f"struct<slot: bigint, left: {BLOCKS}, plan: {_PLAN}>"
_HANDED = "array<struct<node: bigint, pending: " + BLOCKS + ", until: bigint>>"


def _with(value: Column, use) -> Column:
    """`use(value)`, with `value` worked out once."""
    return F.transform(F.array(value), use)[0]


def _edf(blocks: Column, start: Column, until: Column) -> Column:
    """`plan` (what is done from slot `start` to before `until`) and `left` (what is not)."""

    def step(state, _):
        ready = F.filter(state.left, lambda b: b.release <= state.slot)
        soonest = F.array_min(F.transform(state.left, lambda b: b.release))
        slot = F.when(F.size(ready) > 0, state.slot).otherwise(soonest)

        def take(now):
            pick = F.get(F.filter(state.left, lambda b: b.release <= now), F.lit(0))
            return _with(
                pick,
                lambda p: F.struct(
                    (now + 1).alias("slot"),
                    F.filter(state.left, lambda b: b != p).alias("left"),
                    F.concat(state.plan, F.array(F.struct(now.alias("slot"), p.due, p.key, p.block, p.release))).alias("plan"),
                ).cast(_RUN),
            )

        return _with(slot, lambda now: F.when(F.coalesce(now < until, F.lit(False)), take(now)).otherwise(state))

    first = F.struct(start.cast("long"), blocks, F.array()).cast(_RUN)
    return F.aggregate(F.sequence(F.lit(1), F.size(blocks)), first, step)


def _absorb(state: Column, idle: Column, done: Column, late: Column, until: Column) -> Column:
    """`state` followed by a span to `until` that has `idle` slots, has `done` blocks due later, and leaves `late` ones."""

    def choose(pool):
        taken = F.least(idle + F.size(done), F.size(pool)).cast("int")
        did = F.concat(state.done, F.slice(pool, F.lit(1), taken))
        return F.struct(
            until.alias("until"),
            (state.idle + idle + F.size(done) - taken).alias("idle"),
            F.filter(did, lambda b: b.due > until).alias("done"),
            F.concat(F.slice(pool, taken + 1, F.size(pool)), late).alias("late"),
        ).cast(_SPAN)

    return _with(F.array_sort(F.concat(state.late, done)), choose)


def _nothing() -> Column:
    return F.array().cast(BLOCKS)


def _wait(state: Column, until: Column) -> Column:
    """`state` after the slots up to `until`, in which nothing is released."""
    return _absorb(state, until - state.until, _nothing(), _nothing(), until)


def _begin(pending: Column, start: Column) -> Column:
    return F.struct(start, F.lit(0), F.array(), pending).cast(_SPAN)


def _join_span(state: Column, span: Column) -> Column:
    return _absorb(state, span.idle, span.done, span.late, span.until)


def _children(spans: DataFrame) -> DataFrame:
    """One row for each parent: its spans in order."""
    row = F.struct("start", "until", "idle", "done", "late", "node").alias("span")
    return spans.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.array_sort(F.collect_list(row)).alias("spans"))


def _combined(children: DataFrame) -> DataFrame:
    start = F.col("spans")[0].start
    summary = F.aggregate(
        "spans", _begin(_nothing(), start), lambda s, c: _with(_wait(s, c.start), lambda w: _join_span(w, c))
    )
    return children.select("node", start.alias("start"), summary.alias("s")).select("node", "start", "s.*")


def _handed_down(children: DataFrame, given: DataFrame) -> DataFrame:
    """`node`, `pending`, `until` of the spans, from those of their parents."""
    rows = children.join(given, "node")
    state = f"struct<state: {_SPAN}, out: {_HANDED}>"

    def step(s, i):
        span, following = F.get(F.col("spans"), i), F.get(F.col("spans"), i + 1)

        def after(w):
            until = F.coalesce(following.start, F.col("until"))
            one = F.struct(span.node.alias("node"), w.late.alias("pending"), until.alias("until"))
            return F.struct(_join_span(w, span).alias("state"), F.concat(s.out, F.array(one)).alias("out")).cast(state)

        return _with(_wait(s.state, span.start), after)

    first = F.struct(_begin(F.col("pending"), F.col("spans")[0].start), F.array()).cast(state)
    walked = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), first, step)
    return rows.select(F.inline(walked.out))


def earliest_deadline_first(blocks: DataFrame, horizon: int) -> DataFrame:
    """`node`, `slot`, `due`, `key`, `block`, `release` of every block of `blocks` (the last four).

    All releases are below `horizon`, and the first is 0. A slot holds one block;
    a slot for which none is released stays empty. If the blocks of each key have
    the windows of its share, and the shares add up to at most one, none is late.
    A task holds a span: its blocks, and of each key at most one from before.
    """
    levels = 0
    while LEAF * FAN**levels < horizon:
        levels += 1
    one = F.struct("due", "key", "block", "release")
    leaves = blocks.groupBy(F.expr(f"release div {LEAF}").alias("node")).agg(F.array_sort(F.collect_list(one)).alias("blocks"))
    start, until = F.col("node") * LEAF, (F.col("node") + 1) * LEAF
    alone = leaves.select("node", "blocks", _edf(F.col("blocks"), start, until).alias("run"))
    did = F.transform("run.plan", lambda b: F.struct(b.due, b.key, b.block, b.release)).cast(BLOCKS)
    spans = stored(
        alone.select(
            "node",
            "blocks",
            start.alias("start"),
            until.alias("until"),
            (LEAF - F.size("run.plan")).cast("long").alias("idle"),
            F.filter(did, lambda b: b.due > until).alias("done"),
            F.col("run.left").alias("late"),
        ),
        "spans",
    )
    children, level = [], spans
    for _ in range(levels):
        children.append(_children(level))
        level = _combined(children[-1])
    given = level.select("node", _nothing().alias("pending"), F.lit(FOREVER).alias("until"))
    for below in reversed(children):
        given = _handed_down(below, given)
    every = spans.select("node", "blocks", "start").join(given, "node")
    plan = _edf(F.array_sort(F.concat("pending", "blocks")), F.col("start"), F.col("until")).plan
    return every.select("node", F.inline(plan))


def running_total(df: DataFrame, size: str, horizon: int) -> DataFrame:
    """`df` (`node`, `slot`, ...) with `ahead`: the sum of `size` over all slots before."""
    sums = [df.groupBy("node").agg(F.sum(size).alias("total"))]
    reach = horizon // LEAF + 1
    while reach > RUN:
        sums.append(sums[-1].groupBy(F.expr(f"node div {RUN}").alias("node")).agg(F.sum("total").alias("total")))
        reach = reach // RUN + 1
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = None
    for level in reversed(sums):
        parent = F.expr(f"node div {RUN}")
        own = F.coalesce(F.sum("total").over(before(Window.partitionBy("parent").orderBy("node"))), F.lit(0))
        rows = level.withColumn("parent", parent).select("node", "parent", own.alias("own"))
        if offsets is not None:
            rows = rows.join(offsets.toDF("parent", "above"), "parent").withColumn("own", F.col("own") + F.col("above"))
        offsets = rows.select("node", F.col("own").alias("offset"))
    within = before(Window.partitionBy("node").orderBy("slot"))
    inside = df.withColumn("_inside", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return inside.join(offsets, "node").withColumn("ahead", F.col("offset") + F.col("_inside")).drop("_inside", "offset")
