"""Call policies over time: sliding-window rate limit and time-bounded reuse.

Both are one rule. A call at time ``t`` is admitted if fewer than ``max_calls``
admitted calls of its key lie less than ``reach`` before it; only admitted calls
count. For the rate limit ``reach`` is just over the window, as a call exactly one
window old still counts; for reuse it is the time to live with ``max_calls=1``, an
admitted call being a computed one and any other a hit.

Each decision rests on earlier ones, so a window frame cannot express it. Time is
cut into cells as long as ``reach``. A cell is *light* when it and the cell before
it hold at most ``max_calls`` calls: all of its calls are admitted, whatever came
before, and they are all the history that the next cell can see. Runs of other
cells, each led by the light cell before it, are therefore independent, and one
key splits into as many pieces as it has quiet spells.

A long spell above the limit is cut into blocks of cells. All that a block needs of the past is the admitted times
less than ``reach`` before it, at most ``max_calls`` of them; once they are known, all blocks are decided at once.
For ``max_calls=1`` they are found exactly: after an admitted call comes the first call ``reach`` later, so
every call that can be a block's first admitted one leads to a last one, all of them are followed at once (calls with one
successor go on as one), and the short table from first to last is looked up block by block. Otherwise blocks start from what
the cells before them lead to with an empty past; a block whose predecessor ends otherwise is decided again, and only that. Busy calls soon
forget how a spell began, so few blocks change more than once; what has not settled after some rounds is
decided in sequence from its first unsettled block. Every fold streams its calls in time order with at most ``max_calls``
times in memory and jumps over rejected calls.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.session import stored

MICROS = 1_000_000
_CELLS = 4096
# Cells of a block, cells before a block that it is started from, and how often blocks are decided again.
_BLOCK_CELLS = 256
_AHEAD_CELLS = 64
_ROUNDS = 8


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without time zone.

    Other numeric columns are taken as seconds.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        span = F.col(column) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return (span.cast("interval second").cast("decimal(20,6)") * MICROS).cast("long")
    return F.round(F.col(column).cast("decimal(30,6)") * MICROS).cast("long")


def admit(
    history: deque, times: np.ndarray, sizes: np.ndarray, max_calls: int, reach: int
) -> np.ndarray:
    """Admitted number of calls per distinct time; ``history`` is carried along."""
    taken = np.zeros(len(times), dtype=np.int64)
    i = 0
    while i < len(times):
        t = int(times[i])
        while history and t - history[0] >= reach:
            history.popleft()
        free = max_calls - len(history)
        if free <= 0:
            i += int(np.searchsorted(times[i:], history[0] + reach))
            continue
        k = min(free, int(sizes[i]))
        history.extend([t] * k)
        taken[i] = k
        i += 1
    return taken


def _runs(pdf: pd.DataFrame, lead: list[str], skip: np.ndarray | None = None) -> Iterator[tuple]:
    """Start, end and values of ``lead`` of each run of equal values, but for those whose first row is to ``skip``."""
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for name in lead:
        column = pdf[name].to_numpy()
        change[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(change)
    ends = np.r_[starts[1:], len(pdf)]
    if skip is not None:
        wanted = ~skip[starts]
        starts, ends = starts[wanted], ends[wanted]
    yield from zip(starts, ends, *[pdf[name].iloc[starts].tolist() for name in lead])


def _fold(keys: list[str], max_calls: int, reach: int):
    lead = [*keys, "__piece", "__block"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, history = None, deque()
        for pdf in batches:
            if pdf.empty:
                continue
            times = pdf["__t"].to_numpy()
            sizes = pdf["__n"].to_numpy()
            every = pdf["__all"].to_numpy()
            taken = np.where(every, sizes, 0)
            for a, b, *key in _runs(pdf, lead, every):
                if key != current:
                    current, history = key, deque()
                taken[a:b] = admit(history, times[a:b], sizes[a:b], max_calls, reach)
            out = pdf[[*keys, "__t"]].assign(__taken=taken)
            yield out[~pdf["__warm"]]

    return run


def _states(keys: list[str], max_calls: int, reach: int, columns: list[str]):
    """Admitted times that a block starts and ends with, as far as the next block can see them."""
    lead = [*keys, "__piece", "__block"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, history, began, end, out = None, deque(), None, 0, []

        def seen(at: int) -> list[int]:
            return [t for t in history if at - t < reach]

        def close() -> None:
            if current is not None:
                out.append((*current, seen(end - _BLOCK_CELLS * reach) if began is None else began, seen(end)))

        for pdf in batches:
            if pdf.empty:
                continue
            times, sizes, warm = (pdf[c].to_numpy() for c in ("__t", "__n", "__warm"))
            for a, b, *key in _runs(pdf, lead):
                if key != current:
                    close()
                    current, history, began = key, deque(), None
                    end = (key[-2] + (key[-1] + 1) * _BLOCK_CELLS) * reach
                # the past comes before the block's own calls
                own = a + int(np.searchsorted(~warm[a:b], True))
                if own > a:
                    admit(history, times[a:own], sizes[a:own], max_calls, reach)
                if own < b:
                    if began is None:
                        began = seen(end - _BLOCK_CELLS * reach)
                    admit(history, times[own:b], sizes[own:b], max_calls, reach)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def follow(times: np.ndarray, limit: int, reach: int, phases: deque, first: list[int], last: list[int]) -> None:
    """Carry on all ways through ``times`` in which one call is admitted at a time.

    ``first`` holds the calls that may come first, those before ``limit`` and the next one; ``last`` the last call admitted after each.
    ``phases`` are ``(last, members)``, oldest first; ways that meet go on as one.
    """
    i = 0
    while i < len(times):
        t = int(times[i])
        opens = not first or first[-1] < limit
        due = bool(phases) and t - phases[0][0] >= reach
        if not opens and not due:
            if not phases:
                return
            i += max(1, int(np.searchsorted(times[i:], phases[0][0] + reach)))
            continue
        members: list[int] = []
        while phases and t - phases[0][0] >= reach:
            more = phases.popleft()[1]
            members, more = (more, members) if len(more) > len(members) else (members, more)
            members.extend(more)
        if opens:
            members.append(len(first))
            first.append(t)
            last.append(t)
        phases.append((t, members))
        i += 1


def _ways(keys: list[str], reach: int, columns: list[str]):
    """For each block the calls that may be admitted first, the last one admitted after each, and the last admitted call before it."""
    lead = [*keys, "__piece", "__block"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, phases, first, last, before, out = None, deque(), [], [], [], []

        def close() -> None:
            if current is None:
                return
            for t, members in phases:
                for i in members:
                    last[i] = t
            # of first calls that lead to the same last one, the latest will do
            ends = [i for i in range(len(first)) if i + 1 == len(first) or last[i + 1] != last[i]]
            out.append((*current, before, [first[i] for i in ends], [last[i] for i in ends]))

        for pdf in batches:
            if pdf.empty:
                continue
            times, warm = pdf["__t"].to_numpy(), pdf["__warm"].to_numpy()
            for a, b, *key in _runs(pdf, lead):
                if key != current:
                    close()
                    current, phases, first, last, before = key, deque(), [], [], []
                own = a + int(np.searchsorted(~warm[a:b], True))
                if own > a:
                    before = [int(times[own - 1])]
                start = (key[-2] + key[-1] * _BLOCK_CELLS) * reach
                follow(times[own:b], start + reach, reach, phases, first, last)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _looked_up(keys: list[str], reach: int, columns: list[str]):
    """The last admitted call before each block, block by block."""
    lead = [*keys, "__piece"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, at = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            rows = zip(pdf["__block"], pdf["__before"], pdf["__first"], pdf["__last"], *[pdf[name] for name in lead])
            for block, before, first, last, *key in rows:
                if key != current:
                    current, at = key, int(before[0]) if len(before) else None
                out.append((*key, block, [] if at is None else [at]))
                i = 0 if at is None else int(np.searchsorted(first, at + reach))
                if i < len(first):
                    at = int(last[i])
            yield pd.DataFrame(out, columns=columns)

    return run


def _piecewise(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    lead = [*keys, "__piece", "__block"]
    return rows.repartition(*lead).sortWithinPartitions(*lead, *order)


def _as_rows(states: DataFrame, keys: list[str], past: str) -> DataFrame:
    """The past of blocks as calls that are known to be admitted."""
    return states.select(*keys, "__piece", "__block", F.explode(past).alias("__t")).select(
        *keys, "__piece", "__block", "__t", F.lit(1).cast("long").alias("__n"), F.lit(False).alias("__all"), F.lit(True).alias("__warm")
    )


def _single_past(rows: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """``__past`` of each block where one call is admitted at a time: exact, by following every way through each block."""
    lead = [rows.schema[k] for k in keys] + [T.StructField("__piece", T.LongType()), T.StructField("__block", T.LongType())]
    times = T.ArrayType(T.LongType())
    found = [T.StructField("__before", times), T.StructField("__first", times), T.StructField("__last", times)]
    ways = T.StructType(lead + found)
    table = _piecewise(rows, keys, "__t").mapInPandas(_ways(keys, reach, ways.names), ways)
    past = T.StructType([*lead, T.StructField("__past", times)])
    in_order = table.repartition(*keys, "__piece").sortWithinPartitions(*keys, "__piece", "__block")
    return in_order.mapInPandas(_looked_up(keys, reach, past.names), past).withColumn("__segment", F.col("__block"))


def _settled_past(rows: DataFrame, ahead: DataFrame, keys: list[str], max_calls: int, reach: int) -> DataFrame:
    """``__past`` of each block, started from the cells before it and decided again where the block before ends otherwise.

    ``__segment`` is the block itself, or the first block of its piece that has not settled.
    """
    lead = [*keys, "__piece", "__block"]
    times = T.ArrayType(T.LongType())
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField(c, T.LongType()) for c in ("__piece", "__block")]
        + [T.StructField("__past", times), T.StructField("__left", times)]
    )

    def decided(some: DataFrame) -> DataFrame:
        return _piecewise(some, keys, "__t").mapInPandas(_states(keys, max_calls, reach, schema.names), schema)

    states = stored(decided(rows.union(ahead)), "states")
    for turn in range(_ROUNDS + 1):
        before = states.select(*keys, "__piece", (F.col("__block") + 1).alias("__block"), F.col("__left").alias("__wanted"))
        both = states.join(before, lead, "left")
        changed = (F.col("__block") > 0) & (F.col("__past") != F.col("__wanted"))
        wanted = stored(both.filter(changed).select(*lead, "__wanted"), "wanted")
        if turn == _ROUNDS or wanted.isEmpty():
            break
        again = rows.filter("__block > 0").join(wanted.select(*lead), lead, "left_semi").union(_as_rows(wanted, keys, "__wanted"))
        new = decided(again).withColumnRenamed("__past", "__now").withColumnRenamed("__left", "__after")
        kept = states.join(new, lead, "left")
        states = stored(kept.select(*lead, F.coalesce("__now", "__past").alias("__past"), F.coalesce("__after", "__left").alias("__left")), "states")
    unsettled = wanted.groupBy(*keys, "__piece").agg(F.min("__block").alias("__open"))
    right = states.join(wanted, lead, "left").withColumn("__past", F.coalesce("__wanted", "__past"))
    return right.join(unsettled, [*keys, "__piece"], "left").select(
        *lead, "__past", F.coalesce(F.least("__block", "__open"), "__block").alias("__segment")
    )


def admitted_calls(
    df: DataFrame, keys: list[str], time: Column, max_calls: int, reach: int
) -> DataFrame:
    """``keys, __t, __taken``: how many calls of each distinct time are admitted.

    Keys and times must not be null. Some small tables are written and read while the plan is built.
    """
    if max_calls < 1 or reach < 1:
        raise ValueError("max_calls and the window must be positive")
    counts = (
        _timed(df, keys, time)
        .select(*keys, "__t")
        .groupBy(*keys, "__t")
        .agg(F.count("*").alias("__n"))
        .withColumn("__cell", F.coalesce(F.floor(F.col("__t") / F.lit(reach)).cast("long"), F.lit(0)))
    )
    cells = _pieces(counts.groupBy(*keys, "__cell").agg(F.sum("__n").alias("__size")), keys, max_calls)
    # a light cell is a piece of its own
    own_piece = F.when(F.col("__light"), F.col("__cell")).otherwise(F.col("__piece"))
    place = F.col("__cell") - own_piece
    cells = cells.withColumn("__piece", own_piece).withColumn("__block", F.floor(place / _BLOCK_CELLS).cast("long"))
    placed = counts.join(cells, [*keys, "__cell"])
    warm_up = F.struct((F.col("__cell") + 1).alias("piece"), F.lit(0).cast("long").alias("block"), F.lit(True).alias("warm"))
    own = F.struct(F.col("__piece").alias("piece"), F.col("__block").alias("block"), F.lit(False).alias("warm"))
    roles = F.when(F.col("__leads"), F.array(own, warm_up)).otherwise(F.array(own))
    rows = stored(
        placed.select(*keys, "__t", "__n", "__cell", "__light", F.explode_outer(roles).alias("__role")).select(
            *keys,
            F.col("__role.piece").alias("__piece"),
            F.col("__role.block").alias("__block"),
            "__t",
            "__n",
            (F.col("__light") & ~F.col("__role.warm")).alias("__all"),
            F.col("__role.warm").alias("__warm"),
            "__cell",
        ),
        "calls",
    )
    long = stored(rows.filter("__block > 0").select(*keys, "__piece").distinct(), "long")
    final = rows.drop("__cell")
    if not long.isEmpty():
        spells = rows.join(long, [*keys, "__piece"], "left_semi")
        place = F.pmod(F.col("__cell") - F.col("__piece"), F.lit(_BLOCK_CELLS))
        if max_calls == 1:
            past = _single_past(spells.drop("__cell"), keys, reach)
        else:
            near = ~F.col("__warm") & (place >= _BLOCK_CELLS - _AHEAD_CELLS)
            ahead = spells.filter(near).withColumn("__block", F.col("__block") + 1).withColumn("__warm", F.lit(True))
            # only for blocks that have calls of their own
            blocks = spells.filter("NOT __warm").select(*keys, "__piece", "__block").distinct()
            ahead = ahead.join(blocks, [*keys, "__piece", "__block"], "left_semi").select(*final.columns)
            past = _settled_past(spells.drop("__cell"), ahead, keys, max_calls, reach)
        past = stored(past, "past")
        joined = final.join(past.select(*keys, "__piece", "__block", "__segment"), [*keys, "__piece", "__block"], "left")
        segment = joined.withColumn("__block", F.coalesce("__segment", "__block")).select(*final.columns)
        final = segment.union(_as_rows(past.filter("__block > 0 AND __block = __segment"), keys, "__past"))
    ordered = _piecewise(final, keys, "__t")
    schema = T.StructType(
        [ordered.schema[k] for k in keys]
        + [T.StructField(c, T.LongType()) for c in ("__t", "__taken")]
    )
    return ordered.mapInPandas(_fold(keys, max_calls, reach), schema)


def _pieces(cells: DataFrame, keys: list[str], max_calls: int) -> DataFrame:
    """Per cell: whether it is light, whether it leads a busy run, and the start of its run.

    A key may have as many cells as calls, so its cells are windowed in ranges. Two cells
    before a range and one after it come along for context. Only the last run start
    of each range is carried over the whole key.
    """
    cell = F.col("__cell")
    home = F.floor(cell / F.lit(_CELLS)).cast("long")
    place = cell - home * _CELLS
    ranges = (
        F.when(place >= _CELLS - 2, F.array(home, home + 1))
        .when(place == 0, F.array(home, home - 1))
        .otherwise(F.array(home))
    )
    inside = Window.partitionBy(*keys, "__range").orderBy("__cell")
    next_to_last = F.coalesce(F.lag("__cell").over(inside) == cell - 1, F.lit(False))
    before_next = F.coalesce(F.lead("__cell").over(inside) == cell + 1, F.lit(False))
    starts = F.when(F.col("__own") & ~F.col("__light") & ~F.col("__after_busy"), cell)
    seen = (
        cells.select(*keys, "__cell", "__size", F.explode_outer(ranges).alias("__range"))
        .withColumn("__own", F.col("__range") == home)
        .withColumn("__before", F.when(next_to_last, F.lag("__size").over(inside)).otherwise(0))
        .withColumn("__light", F.col("__size") + F.col("__before") <= max_calls)
        .withColumn("__after_busy", next_to_last & ~F.lag("__light").over(inside))
        .withColumn("__leads", F.col("__light") & before_next & ~F.lead("__light").over(inside))
        .withColumn("__start", F.max(starts).over(inside))
        .filter("__own")
    )
    by_key = Window.partitionBy(*keys).orderBy("__range")
    carried = (
        seen.groupBy(*keys, "__range")
        .agg(F.max("__start").alias("__last"))
        .withColumn(
            "__carry", F.max("__last").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
        )
        .drop("__last")
    )
    return seen.join(carried, [*keys, "__range"]).select(
        *keys, "__cell", "__light", "__leads", F.coalesce("__start", "__carry").alias("__piece")
    )


def _timed(df: DataFrame, keys: list[str], time: Column) -> DataFrame:
    """Rows with a key and a time, ``__t`` being known as not null.

    Every branch then reads the source the same way, so its shuffle is reused.
    """
    known = df.dropna(subset=keys).filter(time.isNotNull())
    return known.withColumn("__t", F.coalesce(time, F.lit(0).cast("long")))


def _assigned(rows: DataFrame, known: DataFrame, keys: list[str], taken: DataFrame, tie: str, max_calls: int) -> DataFrame:
    """``rows`` with ``__last``, the last tie that is admitted at their key and time.

    Of equal times at most the first ``max_calls`` matter. That limit is applied before
    the shuffle as well as after it, so many calls at one instant do not pile up.
    """
    at = [*keys, "__t"]
    by_time = Window.partitionBy(*at).orderBy("__tie")
    last = (
        known.select(*at, F.col(tie).alias("__tie"))
        .withColumn("__rank", F.row_number().over(by_time))
        .filter(F.col("__rank") <= max_calls)
        .join(taken, at)
        .filter(F.col("__rank") <= F.col("__taken"))
        .groupBy(*at)
        .agg(F.max("__tie").alias("__last"))
    )
    return rows.join(last, at, "left")


def decide(
    df: DataFrame, keys: list[str], time: Column, tie: str, max_calls: int, reach: int, name: str
) -> DataFrame:
    """Add the boolean ``name``; calls of one time are taken in the order of ``tie``."""
    rows = df.withColumn("__t", time)
    taken = admitted_calls(df, keys, time, max_calls, reach)
    told = _assigned(rows, _timed(df, keys, time), keys, taken, tie, max_calls)
    return told.withColumn(name, F.coalesce(F.col(tie) <= F.col("__last"), F.lit(False))).select(*df.columns, name)


def admit_among(times: np.ndarray, sizes: np.ndarray, known: np.ndarray, history: deque, max_calls: int, reach: int) -> np.ndarray:
    """Admitted calls of each time, in time order, among calls that are ``known`` to be admitted."""
    taken = np.zeros(len(times), dtype=np.int64)
    fixed = np.flatnonzero(known)
    i = 0
    while i < len(times):
        t, n = int(times[i]), int(sizes[i])
        while history and t - history[0] >= reach:
            history.popleft()
        if not known[i]:
            n = min(max_calls - len(history), n)
            if n <= 0:
                # on to the time at which enough has passed, or to the next known call
                free = i + int(np.searchsorted(times[i:], history[len(history) - max_calls] + reach))
                after = np.searchsorted(fixed, i)
                i = max(i + 1, min(free, int(fixed[after]) if after < len(fixed) else free))
                continue
            taken[i] = n
        history.extend([t] * n)
        i += 1
    return taken


def admitted_after(counts: DataFrame, history: DataFrame, keys: list[str], max_calls: int, reach: int) -> DataFrame:
    """``keys, __t, __taken`` for new calls counted by time (``__t, __n``), given admitted ones, before, between or after them.

    A key is one task, which streams its calls in time order and holds the admitted ones within reach.
    """
    rows = counts.select(*keys, "__t", "__n", F.lit(False).alias("__known")).union(
        history.select(*keys, "__t", "__n", F.lit(True).alias("__known"))
    )
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "__t", F.col("__known").desc())
    schema = T.StructType([ordered.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in ("__t", "__taken")])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, past = None, deque()
        for pdf in batches:
            if pdf.empty:
                continue
            times, sizes, known = (pdf[c].to_numpy() for c in ("__t", "__n", "__known"))
            taken = np.zeros(len(pdf), dtype=np.int64)
            for a, b, *key in _runs(pdf, keys):
                if key != current:
                    current, past = key, deque()
                taken[a:b] = admit_among(times[a:b], sizes[a:b], known[a:b], past, max_calls, reach)
            yield pdf[[*keys, "__t"]].assign(__taken=taken)[~known]

    return ordered.mapInPandas(run, schema)


def rate_limit(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    max_calls: int = 10,
    window_seconds: float = 60,
) -> DataFrame:
    """Add ``allowed``: at most ``max_calls`` allowed calls in any closed window."""
    reach = round(window_seconds * MICROS) + 1
    return decide(df, keys, epoch_micros(df, ts), tie, max_calls, reach, "allowed")


def ttl_reuse(
    df: DataFrame, keys: list[str], ts: str, tie: str, ttl_seconds: float = 300
) -> DataFrame:
    """Add ``is_hit``: the result of an earlier call of the key is still valid."""
    reach = round(ttl_seconds * MICROS)
    out = decide(df, keys, epoch_micros(df, ts), tie, 1, reach, "__computed")
    return out.withColumn("is_hit", ~F.col("__computed")).drop("__computed")


def rate_usage(
    limited: DataFrame,
    keys: list[str],
    ts: str,
    max_calls: int = 10,
    window_seconds: float = 60,
) -> DataFrame:
    """Usage right after each allowed call: calls in the window and calls left.

    The window is evaluated per key and cell, each cell seeing the allowed calls
    of the one before. A cell cannot hold more allowed calls than the limit.
    """
    reach = round(window_seconds * MICROS) + 1
    allowed = limited.filter("allowed").withColumn("__t", epoch_micros(limited, ts))
    cell = F.floor(F.col("__t") / F.lit(reach)).cast("long")
    seen = allowed.withColumn("__cell", F.explode(F.array(cell, cell + 1))).withColumn(
        "__own", F.col("__cell") == cell
    )
    frame = Window.partitionBy(*keys, "__cell").orderBy("__t").rangeBetween(-(reach - 1), 0)
    return (
        seen.withColumn("current_calls", F.count("*").over(frame))
        .filter("__own")
        .withColumn("remaining_calls", F.greatest(F.lit(0), F.lit(max_calls) - F.col("current_calls")))
        .drop("__t", "__cell", "__own")
    )


def _json(value: Column) -> Column:
    """A scalar as JSON in ASCII: other characters as escapes, in lower-case digits."""
    text = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        text = F.replace(text, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    ascii_ = F.transform(
        units,
        lambda u: F.when(u < "007F", F.unhex(F.substring(u, 3, 2)).cast("string")).otherwise(F.concat(F.lit("\\u"), F.lower(u))),
    )
    return F.when(text.rlike(r"[^\x00-\x7E]"), F.array_join(ascii_, "")).otherwise(text)


def call_fingerprint(name: Column, args: list[Column], with_name: bool = True, kwargs: dict[str, Column] | None = None) -> Column:
    """First 16 hex digits of sha256 over name, arguments and named arguments (by name) as JSON.

    Without the name, calls of different functions with equal arguments share a
    fingerprint.
    """
    listed = F.concat(F.lit("["), F.concat_ws(", ", *[_json(a) for a in args]), F.lit("]"))
    named = [F.concat(F.lit(f'"{k}": '), _json(v)) for k, v in sorted((kwargs or {}).items())]
    body = F.concat(listed, F.lit(":{"), F.concat_ws(", ", *named), F.lit("}"))
    if with_name:
        body = F.concat(name, F.lit(":"), body)
    return F.substring(F.sha2(body, 256), 1, 16)
