"""State handlers of the streaming detectors.

The time and place detectors work in two steps, for Spark sends all rows that a state handler gets of a key to Python in one piece. The
handler sees sums of the micro-batch only; it brings the state up to date and gives out a row with the state before. A second
function then passes over the rows of a task in order, each user's behind that row, and holds no more than a block of them.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql.streaming.state import GroupState

from logvigil.streaming.ordered import in_order

# Tasks get this module's code along with the job and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ORDER = ["us", "file_path", "line_seq"]
_PLACE = ["latitude", "longitude", "city", "country"]
CARRY = np.iinfo(np.int64).min  # the time of the row with a user's state, which precedes all others
HELD_SUMS = 20_000
OUT_ROWS = 10_000


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(_ORDER, kind="stable", ignore_index=True)


def count_failures(width: int):
    """State: the distinct times that later rows can still need and how many failures each has.

    A row counts the failures known so far in the ``width`` before it, whatever order rows come in; times are
    given up once the watermark has left them behind by ``width``.
    """

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, counts = (np.array(part, np.int64) for part in (state.get if state.exists else ([], [])))
        rows = _in_order(batches)
        us = rows["us"].to_numpy(np.int64)
        before = np.concatenate(([0], np.cumsum(counts)))
        low, high = np.searchsorted(times, us - width), np.searchsorted(times, us, side="right")
        own = np.searchsorted(us, us - width)
        totals = before[high] - before[low] + np.arange(len(us)) - own + 1
        oldest = np.append(times, np.iinfo(np.int64).max)[low]
        firsts = np.where(low < high, np.minimum(oldest, us[own]), us[own])
        known, place = np.unique(np.concatenate((times, us)), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate((counts, np.ones(len(us))))).astype(np.int64)
        watermark = state.getCurrentWatermarkMs() * 1000
        live = known >= min(watermark, int(known[-1])) - width
        state.update((known[live].tolist(), total[live].tolist()))
        state.setTimeoutTimestamp(max(int(known[-1]) + width, watermark) // 1000 + 1)
        yield rows.drop(columns="event_time").assign(trailing_count=totals, first_us=firsts)

    return handle


def _forget_after(state: GroupState, last_us: int, keep: int | None) -> None:
    """Let the state go when the watermark has left the key's last row behind by ``keep`` micros."""
    if keep is not None:
        state.setTimeoutTimestamp(max((last_us + keep) // 1000, state.getCurrentWatermarkMs()) + 1)


# -- sums of a micro-batch ------------------------------------------------------------------


def _summed(group):
    """Add up the rows of a task: sums are merged with those of the rows before, and leave when they are many."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = group(pa.Table.from_batches([batch]))
            held = part if held is None else group(pa.concat_tables([held, part]))
            if held.num_rows > HELD_SUMS:
                yield from held.to_batches(max_chunksize=OUT_ROWS)
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches(max_chunksize=OUT_ROWS)

    return add_up


def sum_hours():
    """Per user, span and hour: first and last time, events, weekend events."""

    def group(rows: pa.Table) -> pa.Table:
        sums = rows.group_by(["user", "span", "hour"]).aggregate([("lo", "min"), ("hi", "max"), ("n", "sum"), ("weekend", "sum")])
        names = {"lo_min": "lo", "hi_max": "hi", "n_sum": "n", "weekend_sum": "weekend"}
        return sums.rename_columns([names.get(c, c) for c in sums.column_names]).select(rows.column_names)

    return _summed(group)


def sum_places():
    """Per user, span and country: the last row, with the first time of all in ``lo``."""

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in _ORDER], null_placement="at_end"))
        numbered = rows.append_column("at", pa.array(np.arange(rows.num_rows)))
        sums = numbered.group_by(["user", "span", "code"]).aggregate([("at", "max"), ("lo", "min")])
        return rows.take(sums["at_max"]).set_column(rows.column_names.index("lo"), "lo", sums["lo_min"]).combine_chunks()

    return _summed(group)


# -- state ----------------------------------------------------------------------------------


def _forget_after(state: GroupState, last_us: int, keep: int | None) -> None:
    """Let the state go when the watermark has left the key's last row behind by ``keep`` micros."""
    if keep is not None:
        state.setTimeoutTimestamp(max((last_us + keep) // 1000, state.getCurrentWatermarkMs()) + 1)


def _carry(key: tuple, first_us: int, *before) -> pd.DataFrame:
    """The row with the state before the micro-batch. No row of the user before ``first_us`` counts: those are behind the watermark.

    One text holds all: a list that is null in most rows makes Spark's Arrow writer take quadratic time.
    """
    return pd.DataFrame({"user": [key[0]], "us": [CARRY], "carried": [json.dumps([first_us, *before])]})


def count_hours(keep: int | None = None):
    """State: time of the user's last row, events per hour of the day, weekend events, all events. Spans are no longer than ``keep``."""

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, hours, weekend, events = state.get if state.exists else (None, [0] * 24, 0, 0)
        sums = pd.concat(list(batches), ignore_index=True)
        carry = _carry(key, int(sums["lo"].min()), last, list(hours), weekend, events)
        hours = np.array(hours, np.int64)
        for _, span in sums.groupby("span"):
            if keep is not None and last is not None and int(span["lo"].min()) - last > keep:
                hours, weekend, events = np.zeros(24, np.int64), 0, 0
            np.add.at(hours, span["hour"].to_numpy(np.int64), span["n"].to_numpy(np.int64))
            weekend, events = weekend + int(span["weekend"].sum()), events + int(span["n"].sum())
            last = int(span["hi"].max()) if last is None else max(last, int(span["hi"].max()))
        state.update((last, hours.tolist(), weekend, events))
        _forget_after(state, last, keep)
        yield carry

    return handle


def follow_user(keep: int | None = None):
    """State: time and place of the user's last row, and the countries seen. Spans are no longer than ``keep``."""

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        us, lat, lon, city, country, seen = state.get if state.exists else (None, None, None, None, None, [])
        seen = list(seen)
        sums = _in_order(batches)
        carry = _carry(key, int(sums["lo"].min()), us, lat, lon, city, country, seen)
        known = dict.fromkeys(seen)
        for _, span in sums.groupby("span"):
            if keep is not None and us is not None and int(span["lo"].min()) - us > keep:
                known = {}
            known |= dict.fromkeys(span["code"])
            us = int(span["us"].max())
        place = [sums[c].iloc[-1:].tolist()[0] for c in _PLACE]
        state.update((us, *(None if pd.isna(v) else v for v in place), list(known)))
        _forget_after(state, us, keep)
        yield carry

    return handle


# -- rows behind their user's state -----------------------------------------------------------


def _users(table: pa.Table) -> Iterator[tuple[str, int, int]]:
    """User, begin and end of each user's rows in an ordered table."""
    users = table["user"].combine_chunks()
    codes = users.dictionary_encode().indices.to_numpy()
    ends = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes))
    for lo, hi in zip((0, *ends[:-1].tolist()), ends.tolist()):
        yield users[lo].as_py(), lo, hi


def _out(table: pa.Table, taken: np.ndarray, drop: list[str], **more: pa.Array) -> Iterator[pa.RecordBatch]:
    """The taken rows without what only this step needs and with what it adds."""
    table = table.drop_columns([c for c in table.column_names if c == "carried" or c in drop])
    for name, values in more.items():
        table = table.append_column(name, values)
    yield from table.filter(pa.array(taken)).combine_chunks().to_batches(max_chunksize=OUT_ROWS)


def with_counts(keep: int | None = None):
    """Add the user's events, weekend events and events of the hour up to and with the row."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = state = None
        for table in in_order(batches):
            us, hour, off = (pc.fill_null(table[c], v).to_numpy() for c, v in (("us", 0), ("hour", 0), ("is_weekend", False)))
            taken, counts = np.zeros(len(us), bool), np.zeros((3, len(us)), np.int64)
            for name, begin, end in _users(table):
                if name != user:
                    user, state = name, None
                if us[begin] == CARRY:
                    first, last, hours, weekend, events = json.loads(table["carried"][begin].as_py())
                    state, begin = (last, np.array(hours, np.int64), weekend, events), begin + 1
                if state is None:  # all rows are behind the watermark
                    continue
                begin += int(np.searchsorted(us[begin:end], first))
                if begin < end:
                    taken[begin:end] = True
                    state = _count(us[begin:end], hour[begin:end], off[begin:end], counts[:, begin:end], state, keep)
            added = dict(zip(("events", "weekend_events", "hour_events"), map(pa.array, counts)))
            yield from _out(table, taken, ["hour", "is_weekend"], **added)

    return walk


def _count(us, hour, off, counts, state: tuple, keep: int | None) -> tuple:
    """Fill in the counts of a user's next rows, and give the state after them."""
    last, hours, weekend, events = state
    latest = np.maximum.accumulate(np.append(us[0] if last is None else last, us))
    breaks = np.flatnonzero(us - latest[:-1] > keep) if keep is not None else np.empty(0, np.int64)
    for lo, hi in zip((0, *breaks), (*breaks, len(us))):
        if lo in breaks:
            hours, weekend, events = np.zeros(24, np.int64), 0, 0
        part = slice(lo, hi)
        counts[0, part] = events + np.arange(1, hi - lo + 1)
        counts[1, part] = weekend + np.cumsum(off[part])
        for h in np.unique(hour[part]):  # at most 24
            at = lo + np.flatnonzero(hour[part] == h)
            counts[2, at] = hours[h] + np.arange(1, len(at) + 1)
        hours, weekend, events = hours + np.bincount(hour[part], minlength=24), weekend + int(off[part].sum()), events + int(hi - lo)
    return int(latest[-1]), hours, weekend, events


def with_places(min_countries: int, keep: int | None = None):
    """Add time and place of the user's row before, and for a new country how many were known, if enough were."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = place = None
        for table in in_order(batches):
            us = table["us"].to_numpy()
            codes = pc.fill_null(table["country_code"], "").combine_chunks().dictionary_encode()
            names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            # where the place before is: a row of the table, or behind them one of the places brought along; -1 for none
            before, brought = np.arange(len(us)) - 1, []
            taken, fresh = np.zeros(len(us), bool), np.full(len(us), -1)
            for name, begin, end in _users(table):
                if name != user:
                    user, place = name, None
                if us[begin] == CARRY:
                    first, *place, seen = json.loads(table["carried"][begin].as_py())
                    known, begin = set(seen), begin + 1
                if place is None:  # all rows are behind the watermark
                    continue
                begin += int(np.searchsorted(us[begin:end], first))
                if begin == end:
                    continue
                taken[begin:end] = True
                before[begin] = -1 if place[0] is None else len(us) + len(brought)
                brought += [place] * (place[0] is not None)
                gaps = np.diff(us[begin:end], prepend=us[begin] if place[0] is None else place[0])
                breaks = begin + np.flatnonzero(gaps > keep) if keep is not None else np.empty(0, np.int64)
                before[breaks] = -1
                for lo, hi in zip((begin, *breaks), (*breaks, end)):
                    if lo in breaks:
                        known = set()
                    for at in np.sort(np.unique(codes[lo:hi], return_index=True)[1]) + lo:
                        code = names[codes[at]]
                        if code not in known:
                            fresh[at] = len(known) if len(known) >= min_countries else -1
                            known.add(code)
                place = [int(us[end - 1]), *(table[c][end - 1].as_py() for c in _PLACE)]
            source = pa.array(before, mask=before < 0)
            added = {}
            for k, (name, column) in enumerate(zip(("p_us", "p_lat", "p_lon", "p_city", "p_country"), ["us", *_PLACE])):
                values = table[column].combine_chunks()
                added[name] = pa.concat_arrays([values, pa.array([p[k] for p in brought], values.type)]).take(source)
            yield from _out(table, taken, [], **added, known_countries=pa.array(fresh, mask=fresh < 0))

    return walk
