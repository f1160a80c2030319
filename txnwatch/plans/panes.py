"""Sliding-window measures on tables.

Spark's ``window()`` copies each row into every window that covers it (5 to 12 here) before the
shuffle, and each rule would do so again. This plan moves rows once, before they are multiplied:

1. Rows are aggregated into *panes*, tumbling buckets one slide long, per key. Partial aggregation
   runs before this shuffle, and the hash covers key and pane, so a key that holds a third of all
   rows still spreads over all tasks.
2. Panes are shuffled by key alone. A key has at most a few rows per slide, however many
   transactions it has, so this shuffle is bounded by the time range and not by the hottest key.
3. Each pane is copied into the windows that cover it and summed up there. Rows of one key are
   already together: this step needs no shuffle.

All rules with the same key share one such plan, whatever their windows, because every window is a
union of panes of the common slide. All distinct counts come from one scan.

Two measures do not add up pane by pane and are first brought into a form that does:

* distinct values - a value is counted only in the windows where it shows up for the first time,
  see ``_first_sightings``;
* the Nth decline - found per window by a row number that Spark cuts off before the shuffle, see
  ``_nth_declines``.

Nothing is collected into arrays, so no group has to fit into one task's memory.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.buckets import EVENT_MICROS, MINUTE_US, Sliding, bucket_start
from txnwatch.operators.specs import Rule, slice_condition, slices_of, windows_of
from txnwatch.plans.totals import named, totals

# What a row of panes belongs to, where one shuffle carries several kinds.
TOTALS, SIGHTINGS, PLACED = 0, 1, 2


def window_measures(txns: DataFrame, rules: list[Rule], params: dict) -> DataFrame:
    """One row per key and non-empty window, with every column the rules' conditions read."""
    (key,) = {r.key for r in rules}
    windows = windows_of(rules)
    rows = txns.where("event_time is not null")
    distincts = sorted({(windows.index(r.window), r.distinct) for r in rules if r.distinct})
    sums = totals(key, rules, params)

    if len(windows) == len(distincts) == 1 and slices_of(rules) == ["all"] and "last_approval" not in sums:
        # The totals ride along with the only distinct count: one scan, one plan.
        panes = _first_sightings(rows, key, 0, windows[0], distincts[0][1], sums)
        return _spread(_by_key(panes, key), key, windows, rules, sums, alone=True)

    parts = [_total_panes(rows, key, windows, rules, params, sums)]
    if len(distincts) > 1:
        parts.append(_all_first_sightings(rows, key, windows, distincts))
    else:
        parts += [_first_sightings(rows, key, shape, windows[shape], column) for shape, column in distincts]
    for shape in {windows.index(r.window) for r in rules if r.sequence}:
        parts.append(_nth_declines(rows, key, shape, windows[shape], int(params["decline_min_count"])))
    panes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _spread(_by_key(panes, key), key, windows, rules, sums, alone=len(parts) == 1)


def _by_key(panes: DataFrame, key: str) -> DataFrame:
    # An explicit number: adaptive coalescing would size partitions by what comes in, but each
    # pane is about to be copied into every window that covers it.
    n = int(panes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return panes.repartition(n, key)


def _total_panes(
    rows: DataFrame, key: str, windows: list[Sliding], rules: list[Rule], params: dict, sums: dict[str, str]
) -> DataFrame:
    slices = slices_of(rules)
    if "all" not in slices:
        rows = rows.where(" or ".join(f"({slice_condition(s, params)})" for s in slices))
    slide_us = reduce(gcd, [w.slide for w in windows]) * MINUTE_US
    pane = F.expr(f"{bucket_start(EVENT_MICROS, slide_us)} as pane")
    return rows.groupBy(key, pane).agg(*named(sums)).selectExpr("*", f"{TOTALS} as kind")


def _all_first_sightings(rows: DataFrame, key: str, windows: list[Sliding], distincts: list[tuple[int, str]]) -> DataFrame:
    """``_first_sightings`` of several columns from one scan.

    Each row is fanned out to one row per column, with that column's value and pane. The copies are made
    and summed up in the scan's own tasks, so what is shuffled is what the columns would shuffle one by one.
    """
    slides = [windows[shape].slide_us for shape, _ in distincts]
    places = []
    for part, (slide_us, (_, column)) in enumerate(zip(slides, distincts)):
        pane = bucket_start(EVENT_MICROS, f"{slide_us}L")
        value = f"named_struct('part', {part}, 'pane', {pane}, 'value', cast({column} as string))"
        places.append(f"if({column} is not null, {value}, null)")
    fanned = rows.selectExpr(key, f"explode(array({', '.join(places)})) as place").where("place is not null")
    seen = fanned.selectExpr(key, "place.part as part", "place.pane as pane", "place.value as value").distinct()

    def of_part(numbers) -> str:
        return f"get(array({', '.join(f'{x}L' for x in numbers)}), part)"

    steps = of_part(windows[shape].steps for shape, _ in distincts)
    before = f"lag(pane) over (partition by {key}, part, value order by pane)"
    new_in = f"cast(least({steps}, coalesce((pane - {before}) div {of_part(slides)}, {steps})) as int)"
    counts = {f"distinct_{column}": f"count(case when part = {part} then 1 end)" for part, (_, column) in enumerate(distincts)}
    return (
        seen.selectExpr("*", f"{new_in} as new_in")
        .groupBy(key, "part", "pane", "new_in")
        .agg(*named(counts))
        .selectExpr("*", f"{SIGHTINGS} as kind", f"cast({of_part(shape for shape, _ in distincts)} as int) as shape")
        .drop("part")
    )


def _first_sightings(
    rows: DataFrame, key: str, shape: int, window: Sliding, column: str, sums: dict[str, str] | None = None
) -> DataFrame:
    """Per key and pane: how many values are seen there for the first time, and in which windows.

    A value whose previous pane lies d slides back is new in the d latest of the windows that
    cover its pane. Adding up what is new in a window's panes gives the window's distinct count,
    exactly and without holding any set of values. ``sums`` are carried through where given.
    """
    carried = dict(sums or {})
    if not carried:
        rows = rows.where(f"{column} is not null")
    # The largest card comes from the values themselves.
    top_card = {"top_card": carried.pop("top_card")} if "top_card" in carried else {}
    pane = F.expr(f"{bucket_start(EVENT_MICROS, window.slide_us)} as pane")
    seen = rows.groupBy(key, column, pane).agg(*named(carried or {"one": "first(1)"}))

    before = f"lag(pane) over (partition by {key}, {column} order by pane)"
    slides_back = f"cast((pane - {before}) / {window.slide_us} as int)"
    again = {name: f"sum({name})" for name in carried}
    return (
        seen.selectExpr("*", f"least({window.steps}, coalesce({slides_back}, {window.steps})) as new_in")
        .groupBy(key, "pane", "new_in")
        .agg(*named({f"distinct_{column}": f"count({column})", **again, **top_card}))
        .selectExpr("*", f"{SIGHTINGS} as kind", f"{shape} as shape")
    )


def _nth_declines(rows: DataFrame, key: str, shape: int, window: Sliding, n: int) -> DataFrame:
    """Per key and window: the time of the Nth decline, where there are that many.

    The Nth decline of a window is among the first N of each of its panes, so rows are cut per key
    and pane before they are copied into windows. Spark turns both row-number filters into group
    limits that run before their shuffles.
    """
    newest = bucket_start(EVENT_MICROS, window.slide_us)
    starts = ", ".join(f"pane - {step * window.slide_us}" for step in range(window.steps))
    return (
        rows.where("txn_status = 'DECLINED'")
        .selectExpr(key, f"{EVENT_MICROS} as nth_decline", f"{newest} as pane")
        .selectExpr("*", f"row_number() over (partition by {key}, pane order by nth_decline) as pane_rank")
        .where(f"pane_rank <= {n}")
        .selectExpr(key, "nth_decline", f"explode(array({starts})) as start")
        .selectExpr("*", f"row_number() over (partition by {key}, start order by nth_decline) as rank")
        .where(f"rank = {n}")
        .selectExpr(key, f"start + {shape} as pane", "nth_decline", f"{PLACED} as kind")
    )


def _spread(
    panes: DataFrame, key: str, windows: list[Sliding], rules: list[Rule], sums: dict[str, str], alone: bool
) -> DataFrame:
    """Copy panes into their windows and add them up; ``panes`` is partitioned by ``key``.

    A window is identified by its start plus the index of its shape: starts are whole minutes in
    microseconds, so both fit one integer. Where a row goes is looked up in constant arrays, which
    keeps the generated code small enough to be compiled.
    """
    shapes = range(len(windows))

    def places(of_shapes, steps: int | None = None) -> str:
        each = (
            f"named_struct('slide', {windows[i].slide_us}L, 'back', {step * windows[i].slide_us - i}L)"
            for i in of_shapes
            for step in range(steps or windows[i].steps)
        )
        return f"array({', '.join(each)})"

    if alone:
        place = places(shapes)
    else:
        cases = [f"when kind = {PLACED} then array(named_struct('slide', 1L, 'back', 0L))"]
        for i in sorted({windows.index(r.window) for r in rules if r.distinct}):
            newest = ", ".join(places([i], steps) for steps in range(1, windows[i].steps + 1))
            cases.append(f"when kind = {SIGHTINGS} and shape = {i} then element_at(array({newest}), new_in)")
        # Panes without a counted row stay out of windows that only look at some of the rows.
        partial = [i for i in shapes if all(r.slice != "all" for r in rules if r.window == windows[i])]
        rest = [i for i in shapes if i not in partial]
        if partial and rest:
            names = sorted({r.slice for r in rules if windows.index(r.window) in partial})
            counted = " or ".join(f"{s}_n > 0 or {s}_total is not null" for s in names)
            cases.append(f"when not ({counted}) then {places(rest)}")
        place = f"case {' '.join(cases)} else {places(shapes)} end"

    measures = {}
    for name in sums:
        total = f"{'max' if name in ('last_approval', 'top_card') else 'sum'}({name})"
        measures[name] = f"coalesce({total}, 0)" if name.endswith("_n") else total
    for column in sorted({r.distinct for r in rules if r.distinct}):
        new = f"distinct_{column}"
        measures[new] = f"coalesce(sum({f'case when step < new_in then {new} end' if alone else new}), 0)"
    if any(r.sequence for r in rules):
        measures["nth_decline"] = "max(nth_decline)"
    slot = F.expr(f"{bucket_start('pane', 'place.slide')} - place.back as slot")
    placed = panes.selectExpr("*", f"posexplode({place}) as (step, place)")
    summed = placed.groupBy(key, slot).agg(*named(measures))

    shape = f"pmod(slot, {MINUTE_US})"
    lengths = f"array({', '.join(f'{w.length_us}L' for w in windows)})"
    return summed.selectExpr(
        "*",
        f"{shape} as shape",
        f"timestamp_micros(slot - {shape}) as window_start",
        f"timestamp_micros(slot - {shape} + get({lengths}, cast({shape} as int))) as window_end",
    )
