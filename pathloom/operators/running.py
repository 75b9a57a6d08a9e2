"""Running evidence: what a corpus had seen of each slot when a URL arrived, carried on from a stored state.

Rows are cut into ranges of obs_id. Counts of each (key, value, range) are
small; an exclusive scan of them over the ranges, on top of the state, gives the
counts with which each range starts, and windows within (key, range) do the
rest. So a key that all rows share is spread over as many tasks as there are
ranges, and a batch costs what it and the keys that it touches have.

Positions where no segment asks for evidence (``undecided``) have no running
counts: what a state knows of them comes from one count of their values.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..sources.tables import ROWS, kept
from .infer import undecided
from .views import PARAM, POSITION, Observed, first_come

#: Times a value is seen until it counts as established.
ESTABLISHED = 3
TYPES = sorted(L.BUILT_IN_TYPES)


class RunningState(NamedTuple):
    """What is known of all slots after some observation: a row a key (``positions``, ``params``), and one a tracked value of each (``position_values``, ``param_values``: keys, value, seen)."""

    positions: DataFrame
    position_values: DataFrame
    params: DataFrame
    param_values: DataFrame


#: Keys of the tables of a state.
STATE_KEYS = {"positions": POSITION, "position_values": [*POSITION, "value"], "params": PARAM, "param_values": [*PARAM, "value"]}


class _Measure(NamedTuple):
    """A number of a key: of a row it is ``of`` (SQL over type and value), of rows and ranges what ``joined`` makes of them ('sum', 'min' or 'max')."""

    name: str
    of: str
    joined: str = "sum"


_NUMBER = "case when type in ('integer', 'float') and abs(try_cast(value as double)) < double('infinity') then try_cast(value as double) end"
_POSITION_MEASURES = [_Measure("variable_count", "if(type <> 'literal', 1, 0)")]
_NUMBERS = [_Measure("num_count", f"if({_NUMBER} is not null, 1, 0)"), _Measure("num_min", _NUMBER, "min"), _Measure("num_max", _NUMBER, "max")]
#: What a state has of a parameter's types and numbers, and what that is where there are none.
_TYPED = {**{f"n_{t}": "cast(0 as bigint)" for t in TYPES}, "num_count": "cast(0 as bigint)", "num_min": "cast(null as double)", "num_max": "cast(null as double)"}


def _param_measures(types: list[str]) -> list[_Measure]:
    return [*(_NUMBERS if {"integer", "float"} & {*types} else []), *(_Measure(f"n_{t}", f"if(type = '{t}', 1, 0)") for t in types)]


_JOINED: dict[str, tuple[Callable, Callable]] = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}
_ESTABLISHED = [_Measure("established", "null"), _Measure("established_count", "null")]


def _enough(seen: Column) -> Column:
    """Observations that a value seen so often adds to the established ones."""
    return F.when(seen >= ESTABLISHED, seen).otherwise(0)


def _range_of(urls: DataFrame, ranges: int = 0) -> Column:
    """The number of a row's range: of ``ranges`` equally wide ones of the obs_ids of ``urls``; without a number of one for each core, and of as many as have ``ROWS`` URLs each."""
    ends = urls.agg(F.min("obs_id").alias("low"), F.max("obs_id").alias("high"), F.count("*").alias("n")).first()
    ranges = ranges or max(urls.sparkSession.sparkContext.defaultParallelism, -(-ends["n"] // ROWS))
    wide = ((ends["high"] or 0) - (ends["low"] or 0)) // ranges + 1
    return F.floor((F.col("obs_id") - F.lit(ends["low"] or 0)) / wide).cast("int").alias("_r")


def _with_held(c: DataFrame, keys: list[str], values: DataFrame | None) -> DataFrame:
    """Counts of values plus how often the state has seen each; null if it doesn't track it."""
    if values is None:
        return c.withColumn("_held", F.lit(None).cast("long"))
    return c.join(values.select(*keys, "value", F.col("seen").alias("_held")), [*keys, "value"], "left")


def _sums(every: list[_Measure]) -> list[Column]:
    """Measures of keys over counts of their values."""
    return [F.sum(F.expr(m.of) * F.col("n")).alias(m.name) if m.joined == "sum" else _JOINED[m.joined][0](F.expr(m.of)).alias(m.name) for m in every]


def _after(rows: DataFrame, keys: list[str], measures: list[_Measure], totals: DataFrame | None, values: DataFrame | None, cap: int) -> tuple[DataFrame, DataFrame]:
    """(totals of the keys touched, tracked values touched) as ``_carried`` gives them, for rows that ask for no evidence themselves."""
    c = rows.groupBy(*keys, "value", "type").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_obs"))
    c = kept(_with_held(c, keys, values), "counted")
    every = [_Measure("total", "1"), *measures]
    k = c.groupBy(*keys).agg(F.count_if(F.col("_held").isNull()).alias("distinct_values"), *_sums(every))
    new = first_come(c.where(F.col("_held").isNull()), keys, cap, rank="_place")
    if totals is not None:
        every = [_Measure("distinct_values", "null"), *every]
        k = k.join(totals.select(*keys, *(F.col(m.name).alias(f"_{m.name}") for m in every)), keys, "left")
        k = k.select(*keys, *(_JOINED[m.joined][1](F.col(f"_{m.name}"), F.col(m.name)).alias(m.name) for m in every))
        ago = totals.select(*keys, F.col("distinct_values").alias("_ago"))
        new = new.join(ago, keys, "left").where(F.coalesce("_ago", F.lit(0)) + F.col("_place") <= cap)
    seen = new.select(*keys, "value", F.col("n").alias("seen"))
    return k, seen.union(c.where(F.col("_held").isNotNull()).select(*keys, "value", F.col("_held") + F.col("n")))


def _carried(rows: DataFrame, keys: list[str], measures: Callable[[DataFrame], list[_Measure]], totals: DataFrame | None, values: DataFrame | None, cap: int, range_of: Column, established: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with running evidence, totals of the keys touched, tracked values touched), both with all that came before. ``measures`` gives those of the counted values."""
    columns, rows = rows.columns, rows.select("*", range_of)
    by_value, by_key = Window.partitionBy(*keys, "value"), Window.partitionBy(*keys)
    before = Window.unboundedPreceding
    c = _with_held(rows.groupBy(*keys, "value", "type", "_r").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_obs")), keys, values)
    scan = by_value.orderBy("_r")
    earlier = F.coalesce(F.sum("n").over(scan.rowsBetween(before, -1)), F.lit(0))
    c = c.withColumn("_seen", F.coalesce("_held", F.lit(0)) + earlier).withColumn("_new", F.col("_held").isNull() & (F.row_number().over(scan) == 1))
    c = kept(c, "ranged")

    every = [_Measure("total", "1"), *measures(c)]
    k = c.groupBy(*keys, "_r").agg(F.count_if("_new").alias("distinct_values"), *_sums(every))
    every = [_Measure("distinct_values", "null"), *every]

    def scanned(k: DataFrame, every: list[_Measure], start: DataFrame | None) -> DataFrame:
        """``k`` plus, for each number, ``_`` and its name: what it was before the range."""
        if start is not None:
            start = start.join(k.select(*keys).distinct(), keys, "left_semi").select(*keys, *(F.col(m.name).alias(f"_{m.name}") for m in every))
            k = k.join(start, keys, "left")
        own = [c for c in k.columns if c not in {f"_{m.name}" for m in every}]
        ago = []
        for m in every:
            fold, both = _JOINED[m.joined]
            held = F.col(f"_{m.name}") if start is not None else F.lit(None).cast(k.schema[m.name].dataType)
            ago.append(both(held, fold(m.name).over(by_key.orderBy("_r").rowsBetween(before, -1))).alias(f"_{m.name}"))
        return k.select(*own, *ago)

    k = kept(scanned(k, every, totals), "scanned")
    # The place of a new value among the key's distinct ones; a value that the state has is tracked.
    new = c.where("_new").select(*keys, "value", "_r", "first_obs").join(k.select(*keys, "_r", "_distinct_values"), [*keys, "_r"])
    place = F.col("_distinct_values") + F.row_number().over(Window.partitionBy(*keys, "_r").orderBy("first_obs"))
    new = new.select(*keys, "value", F.col("first_obs").alias("_first"), (place <= cap).alias("_in"))
    c = c.join(new, [*keys, "value"], "left").withColumn("_tracked", F.coalesce("_in", F.lit(True)))
    if established:
        c = kept(c, "placed")
        grown = F.col("_seen") + F.col("n")
        e = c.where("_tracked").groupBy(*keys, "_r").agg(F.count_if((F.col("_seen") < ESTABLISHED) & (grown >= ESTABLISHED)).alias("established"), F.sum(_enough(grown) - _enough(F.col("_seen"))).alias("established_count"))
        e = scanned(k.select(*keys, "_r").join(e, [*keys, "_r"], "left").fillna(0, ["established", "established_count"]), _ESTABLISHED, totals)
        k = kept(k.join(e, [*keys, "_r"]), "scanned")
        every = [*every, *_ESTABLISHED]

    # Type and value have their numbers already: rows are joined by what is small, and one shuffle does for both windows.
    rows = rows.join(c.select(*keys, "value", "_r", "_seen", "_tracked", "_first"), [*keys, "value", "_r"]).repartition(*keys, "_r")
    rows = rows.withColumn("seen", F.col("_seen") + F.row_number().over(Window.partitionBy(*keys, "value", "_r").orderBy("obs_id")))
    rows = rows.withColumn("value_count", F.when(F.col("_tracked"), F.col("seen")))
    rows = rows.join(k.select(*keys, "_r", *(f"_{m.name}" for m in every)), [*keys, "_r"])
    now = Window.partitionBy(*keys, "_r").orderBy("obs_id").rowsBetween(before, Window.currentRow)
    own = {
        "distinct_values": F.when(F.col("_first") == F.col("obs_id"), 1).otherwise(0),
        "established": F.when(F.col("value_count") == ESTABLISHED, 1).otherwise(0),
        "established_count": F.when(F.col("value_count") == ESTABLISHED, ESTABLISHED).when(F.col("value_count") > ESTABLISHED, 1).otherwise(0),
    }
    numbers = {}
    for m in every:
        fold, both = _JOINED[m.joined]
        numbers[m.name] = both(F.col(f"_{m.name}"), fold(own[m.name] if m.name in own else F.expr(m.of)).over(now))
    numbers["cardinality"] = F.least(numbers["distinct_values"], F.lit(cap))
    rows = rows.select(*columns, "value_count", *(x.alias(name) for name, x in numbers.items()))

    last = k.withColumn("_last", F.row_number().over(by_key.orderBy(F.desc("_r")))).where("_last = 1")
    totals = last.select(*keys, *(_JOINED[m.joined][1](F.col(f"_{m.name}"), F.col(m.name)).alias(m.name) for m in every))
    values = c.where("_tracked").groupBy(*keys, "value").agg(F.max(F.col("_seen") + F.col("n")).alias("seen"))
    return rows, totals, values


def advance(o: Observed, state: RunningState | None = None, *, cap: int = L.VALUE_CAP, ranges: int = 0, after: bool = True) -> tuple[DataFrame, DataFrame, RunningState | None]:
    """(segments, params, state): the segments that evidence decides and all parameters of ``o`` with the evidence up to and with their URL, and what is known of the slots that ``o`` touches after it.

    ``state`` is what was known before the first URL of ``o``, None for nothing.
    A URL touches a position or a parameter once at most, so obs_id orders each
    key fully. A value is tracked if it was among a key's first ``cap`` distinct
    ones. ``ranges`` is how many ranges of obs_id are dealt out (0: as many as
    cores and rows ask for); results don't depend on it. Without ``after`` the
    state is not computed.
    """
    range_of = _range_of(o.urls, ranges)
    segments = o.segments.drop("cluster_key")
    asked = kept(segments.where(undecided(F.col("type"))).select(*POSITION).distinct(), "asked")
    old = (state and state.positions, state and state.position_values)
    s, positions, position_values = _carried(segments.join(asked, POSITION, "left_semi"), POSITION, lambda c: _POSITION_MEASURES, *old, cap, range_of, False)
    if after:
        more = _after(segments.join(asked, POSITION, "left_anti"), POSITION, _POSITION_MEASURES, *old, cap)
        positions, position_values = positions.unionByName(more[0]), position_values.unionByName(more[1])

    types: list[str] = []

    def measures(c: DataFrame) -> list[_Measure]:
        """Of the types that these parameters have or had: a window for each of all types takes longer than all else."""
        found = {r["type"] for r in c.select("type").distinct().collect()}
        if state is not None:
            had = state.params.agg(*(F.max(f"n_{t}").alias(t) for t in TYPES)).first()
            found |= {t for t in TYPES if had[t]}
        types.extend(sorted(found) or ["literal"])
        return _param_measures(types)

    p, params, param_values = _carried(o.params, PARAM, measures, state and state.params, state and state.param_values, cap, range_of, True)

    def whole(df: DataFrame) -> DataFrame:
        return df.select("*", *(F.expr(none).alias(name) for name, none in _TYPED.items() if name not in df.columns))

    # The most frequent type so far; of equals the smallest name.
    counts = {t: F.struct((-F.col(f"n_{t}")).alias("m"), F.lit(t).alias("t")) for t in types}
    undated = F.array(*(F.when(F.col(f"n_{t}") > 0, x) for t, x in counts.items() if t != "date")) if {*types} - {"date"} else F.array(F.lit(None).cast("struct<m:bigint,t:string>"))
    read = ["value_count", "total", "cardinality", "num_count", "num_min", "num_max", "established", "established_count"]
    p = whole(p).select(*o.params.columns, *read, F.col("n_date").alias("dates"), F.col("n_integer").alias("integers"), F.col("n_float").alias("floats"), F.array_min(F.array(*counts.values()))["t"].alias("dominant"), F.array_min(undated)["t"].alias("dominant_undated"))
    return s.where(undecided(F.col("type"))), p, RunningState(positions, position_values, whole(params), param_values) if after else None


def merged_state(state: RunningState | None, touched: RunningState) -> RunningState:
    """The state with the keys that a batch has touched in place of what it had of them."""
    if state is None:
        return touched
    out = []
    for (name, keys), old, new in zip(STATE_KEYS.items(), state, touched, strict=True):
        out.append(old.join(new.select(*keys), keys, "left_anti").unionByName(new))
    return RunningState(*out)


def kept_state(state: RunningState) -> RunningState:
    """The state, written: the next batch reads its tables several times."""
    return RunningState(*(kept(t, name) for name, t in zip(STATE_KEYS, state, strict=True)))
