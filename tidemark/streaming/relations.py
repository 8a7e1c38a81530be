"""Operators of interval relations on streams, with a state for each key.

Rows have ``vs`` and ``ve`` in ms and the key's columns; ``at`` is the timestamp
of ``vs``, and its watermark is the progress: no row that starts before it will
come. A key's rows wait until the progress makes their results final; then they
are handed to the batch rule and forgotten. So the state of a key is what
overlaps the watermark, and an idle key is woken by a timer to give its last
results and go.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.pattern import Automaton, Matcher, Pattern

INF = (1 << 63) - 1
#: From the waiting rows (sorted by vs), a carried value and the progress: result rows, rows that still wait, the value to carry on, and when to look again (None: with the next row).
Rule = Callable[[list[dict], Any, int], tuple[list[tuple], list[dict], Any, int | None]]


def with_event_time(df: DataFrame, latency: int) -> DataFrame:
    return df.withColumn("at", F.timestamp_millis("vs")).withWatermark("at", f"{latency} milliseconds")


def by_progress(df: DataFrame, key: str, rule: Rule, out: str) -> DataFrame:
    """Run a rule for each key of a stream that has ``at``; ``out`` is the schema of its result rows after the key."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *[x.split()[0] for x in out.split(", ")]]
    fields = [c for c in df.columns if c not in ("at", key)]

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, carry = pickle.loads(state.get[0]) if state.exists else ([], None)
        for part in [] if state.hasTimedOut else parts:
            waiting += part[fields].astype(object).where(part[fields].notna(), None).to_dict("records")
        waiting.sort(key=lambda r: r["vs"])
        progress = state.getCurrentWatermarkMs()
        rows, waiting, carry, again = rule(waiting, carry, progress)
        if waiting or carry is not None:
            state.update((pickle.dumps((waiting, carry)),))
            state.setTimeoutTimestamp(max(progress + 1, min(again if again is not None else progress + 1, 1 << 53)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(keys[0], *r) for r in rows], columns=names)

    schema = f"`{key}` {kind}, {out}"
    return df.select(key, "at", *fields).groupBy(key).applyInPandasWithState(step, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def sides(left: DataFrame, right: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Both relations as one stream, with ``is_left``; the right has no payload."""
    l = left.select(key, "at", "vs", "ve", *payload, F.lit(True).alias("is_left"))  # noqa: E741
    r = right.select(key, "at", "vs", "ve", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in payload], F.lit(False).alias("is_left"))
    return l.union(r)


def anti_join(left: DataFrame, right: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Left rows for the times at which no right row of the key is alive; a row's pieces come when the progress has passed its end."""

    def rule(rows: list[dict], carry: Any, progress: int):
        out, keep = [], []
        cover = [(r["vs"], r["ve"]) for r in rows if not r["is_left"]]
        for r in rows:
            if not r["is_left"]:
                continue
            if r["ve"] > progress:
                keep.append(r)
                continue
            at = r["vs"]
            for s, e in cover:
                if e <= at or s >= r["ve"]:
                    continue
                if s > at:
                    out.append((at, s, *[r[c] for c in payload]))
                at = max(at, e)
            if at < r["ve"]:
                out.append((at, r["ve"], *[r[c] for c in payload]))
        first = min([progress, *[r["vs"] for r in keep]])
        keep += [r for r in rows if not r["is_left"] and r["ve"] > first]
        return out, keep, None, min([r["ve"] for r in keep], default=None)

    schema = ", ".join(["vs bigint", "ve bigint", *[f"{c} {left.schema[c].dataType.simpleString()}" for c in payload]])
    return by_progress(sides(left, right, key, payload), key, rule, schema)


def clip_by(left: DataFrame, right: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Left rows end at the first later start of the right; they come when the progress has passed their end."""

    def rule(rows: list[dict], carry: Any, progress: int):
        out, keep = [], []
        starts = [r["vs"] for r in rows if not r["is_left"]]
        for r in rows:
            if not r["is_left"]:
                continue
            end = min([r["ve"], *[s for s in starts if s > r["vs"]]])
            if end <= progress:
                out.append((r["vs"], end, *[r[c] for c in payload]))
            else:
                keep.append(r)
        first = min([progress, *[r["vs"] for r in keep]])
        again = min([r["ve"] for r in keep], default=None)
        held = [r for r in rows if not r["is_left"] and r["vs"] > first]
        return out, keep + held, None, again if again is not None else max([r["vs"] for r in held], default=None)

    schema = ", ".join(["vs bigint", "ve bigint", *[f"{c} {left.schema[c].dataType.simpleString()}" for c in payload]])
    return by_progress(sides(left, right, key, payload), key, rule, schema)


def stitch(df: DataFrame, key: str) -> DataFrame:
    """Chains of the key's rows where one starts as another ends; a chain comes when no row can lengthen it any more."""

    def rule(rows: list[dict], chains: list | None, progress: int):
        chains = list(chains or [])
        keep = [r for r in rows if r["vs"] >= progress]
        for r in (r for r in rows if r["vs"] < progress):
            meets = next((c for c in chains if c[1] == r["vs"]), None)
            if meets is None:
                chains.append([r["vs"], r["ve"]])
            else:
                meets[1] = r["ve"]
        done = [c for c in chains if c[1] < progress]
        chains = [c for c in chains if c[1] >= progress]
        times = [c[1] + 1 for c in chains] + [r["vs"] + 1 for r in keep]
        return [tuple(c) for c in done], keep, chains or None, min(times, default=None)

    return by_progress(df.select(key, "at", "vs", "ve"), key, rule, "vs bigint, ve bigint")


def sliding(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count and sum of the key's live rows at every instant; a stretch comes when the progress has passed its end."""

    def rule(rows: list[dict], since: int | None, progress: int):
        times = sorted({t for r in rows for t in (r["vs"], r["ve"]) if t <= progress and (since is None or t >= since)} | ({since} if since is not None else set()))
        out = []
        for a, b in zip(times[:-1], times[1:], strict=True):
            live = [r for r in rows if r["vs"] <= a and r["ve"] >= b]
            if live:
                values = [r[value] for r in live if r[value] is not None]
                out.append((a, b, len(live), float(sum(values)) if values else None))
        last = times[-1] if times else since
        keep = [r for r in rows if r["ve"] > (last if last is not None else -INF) or r["vs"] >= progress]
        return out, keep, last if keep else None, min([t for r in keep for t in (r["vs"], r["ve"]) if t > progress], default=None)

    return by_progress(df.select(key, "at", "vs", "ve", value), key, rule, "vs bigint, ve bigint, count bigint, sum double")


def detect(df: DataFrame, key: str, pattern: Pattern | Automaton, max_duration: int, register: str = "string", overlapping: bool = True, deterministic: bool = False) -> DataFrame:
    """Matches of an automaton in the key's events, in order of time; its live instances are the state, and go once they are too old."""
    automaton = pattern.build() if isinstance(pattern, Pattern) else pattern

    def rule(rows: list[dict], live: list | None, progress: int):
        matcher = Matcher(automaton, max_duration, overlapping, deterministic, list(live or []))
        out, now = [], [r for r in rows if r["vs"] < progress]
        for time in sorted({r["vs"] for r in now}):
            out += [(start, end + 1, value) for start, end, value in matcher.at(time, [r for r in now if r["vs"] == time])]
        keep = [r for r in rows if r["vs"] >= progress]
        live = [x for x in matcher.live if progress - x[0] < max_duration]
        times = [r["vs"] + 1 for r in keep] + [x[0] + max_duration for x in live]
        return out, keep, live or None, min(times, default=None)

    return by_progress(df, key, rule, f"vs bigint, ve bigint, register {register}")


def keyed_progress(df: DataFrame, key: str, latency: int, policy: str = "drop", idle: int = 0) -> DataFrame:
    """Late rows by the progress of their own key: the highest ``vs`` of it in earlier batches and rows, less ``latency``.

    Adds ``late`` and ``moved_by``. ``drop`` and ``adjust`` leave the audit to a
    filter: kept rows are those not late or with ``moved_by``, and the late ones
    are a side stream. With ``idle`` a key is forgotten when the watermark is so
    far beyond its progress.
    """
    kind = df.schema[key].dataType.simpleString()
    fields = [c for c in df.columns if c not in ("at", key)]
    out = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in fields)

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        top = state.get[0] if state.exists else None
        rows = []
        for part in parts:
            for r in part[fields].to_dict("records"):
                late = top is not None and r["vs"] < top - latency
                moved = top - latency - r["vs"] if late and policy == "adjust" and r["ve"] > top - latency else None
                rows.append((keys[0], *[r["vs"] + moved if c == "vs" and moved else r[c] for c in fields], late, moved))
                top = r["vs"] if top is None else max(top, r["vs"])
        state.update((int(top),))
        if idle:
            state.setTimeoutTimestamp(max(int(top) + idle, state.getCurrentWatermarkMs() + 1))
        done = pd.DataFrame(rows, columns=[key, *fields, "late", "moved_by"])
        done["moved_by"] = done["moved_by"].astype("Int64")
        yield done

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.select(key, "at", *fields).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {out}, late boolean, moved_by bigint", "top bigint", "append", timeout)
