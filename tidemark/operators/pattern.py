"""Patterns in event sequences: neighbours, and automata over each key's events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.frame import VE, VS, over


def followed_by(df: DataFrame, first: Column, second: Column, within: int, keys: Sequence[str] = (), prefix: str = "next_") -> DataFrame:
    """Events that meet ``first`` whose next later event (all of that time) meets ``second`` in less than ``within``.

    The events of the next time are gathered once per time and looked up by
    ``lead``, so there is no self-join.
    """
    within = max(within, 2)
    payload = [c for c in df.columns if c not in (VS, VE) and c not in keys]
    times = df.groupBy(*keys, VS).agg(F.collect_list(F.struct(*payload, F.col(VS).alias("t"))).alias("own"), F.collect_list(F.when(second, F.struct(*payload, F.col(VS).alias("t")))).alias("hits"))
    w = over(keys, VS)
    ahead = times.withColumns({"after": F.lead("hits").over(w), "at": F.lead(VS).over(w)}).filter(F.col("at") - F.col(VS) < within)
    starts = ahead.select(*keys, VS, F.col("at").alias(VE), F.explode("own").alias("own"), "after").select(*keys, VS, VE, *[F.col(f"own.{c}").alias(c) for c in payload], "after").filter(first)
    return starts.withColumn("hit", F.explode("after")).select(*keys, VS, VE, *payload, *[F.col(f"hit.{c}").alias(f"{prefix}{c}") for c in payload])


def consecutive_pairs(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = (), prefix: str = "next_") -> DataFrame:
    """Each event with the one after it (ties by ``order``), valid until that one."""
    payload = [c for c in df.columns if c not in (VS, VE) and c not in keys]
    w = over(keys, VS, *order)
    out = df.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in payload} | {"__at": F.lead(VS).over(w)})
    return out.filter(F.col("__at").isNotNull()).withColumn(VE, F.col("__at")).drop("__at")


def followed_by_stream(left: DataFrame, right: DataFrame, within: int, keys: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """Left events with the first later right event of the keys, in less than ``within``."""
    payload = [c for c in right.columns if c not in (VS, VE) and c not in keys]
    r = right.groupBy(*keys, VS).agg(F.min(F.struct(*payload)).alias("__hit")).withColumn("__side", F.lit(1))
    both = left.withColumn("__side", F.lit(0)).unionByName(r, allowMissingColumns=True)
    w = over(keys, VS).rangeBetween(1, Window.unboundedFollowing)
    hit = F.min(F.when(F.col("__side") == 1, F.struct(F.col(VS).alias("t"), "__hit"))).over(w)
    found = both.withColumn("__next", hit).filter((F.col("__side") == 0) & (F.col("__next.t") - F.col(VS) < max(within, 2)))
    return found.select(*[c for c in left.columns if c not in (VS, VE)], VS, F.col("__next.t").alias(VE), *[F.col(f"__next.__hit.{c}").alias(f"{prefix}{c}") for c in payload])


#: A fence decides on an event and the register; an update gives the next register.
Fence = Callable[[dict, Any], bool]
Update = Callable[[dict, Any], Any]


@dataclass(frozen=True)
class Arc:
    """kind: 'single' (one event), 'list' (all events of one time), 'epsilon' (none)."""

    source: int
    target: int
    kind: str = "single"
    fence: Callable[[Any, Any], bool] | None = None
    update: Callable[[Any, Any], Any] | None = None


@dataclass(frozen=True)
class Automaton:
    arcs: tuple[Arc, ...]
    start: int
    final: frozenset[int]
    register: Any = None

    def states(self) -> int:
        return 1 + max([self.start, *self.final, *[a.source for a in self.arcs], *[a.target for a in self.arcs]])


@dataclass(frozen=True)
class Pattern:
    """A builder of automata: every method gives a new pattern; start is state 0 and final is state ``n - 1``."""

    arcs: tuple[Arc, ...] = ()
    n: int = 1
    register: Any = None

    @staticmethod
    def single(fence: Fence | None = None, update: Update | None = None) -> Pattern:
        return Pattern((Arc(0, 1, "single", fence, update),), 2)

    @staticmethod
    def any_element() -> Pattern:
        return Pattern.single()

    @staticmethod
    def list_of(fence: Callable[[list[dict], Any], bool] | None = None, update: Callable[[list[dict], Any], Any] | None = None) -> Pattern:
        return Pattern((Arc(0, 1, "list", fence, update),), 2)

    @staticmethod
    def multi(start: Any, step: Callable[[Any, dict], Any], fence: Callable[[Any, Any], bool] | None = None, update: Callable[[Any, Any], Any] | None = None) -> Pattern:
        """An accumulator over all events of one time."""

        def folded(events: list[dict]) -> Any:
            acc = start
            for e in events:
                acc = step(acc, e)
            return acc

        return Pattern.list_of(lambda es, r: fence is None or fence(folded(es), r), None if update is None else (lambda es, r: update(folded(es), r)))

    @staticmethod
    def epsilon() -> Pattern:
        return Pattern((Arc(0, 1, "epsilon"),), 2)

    def moved(self, by: int) -> tuple[Arc, ...]:
        return tuple(Arc(a.source + by, a.target + by, a.kind, a.fence, a.update) for a in self.arcs)

    def then(self, other: Pattern) -> Pattern:
        link = Arc(self.n - 1, self.n, "epsilon")
        return Pattern((*self.arcs, link, *other.moved(self.n)), self.n + other.n, self.register)

    def or_(self, *others: Pattern) -> Pattern:
        every, arcs, at = (self, *others), [], 1
        end = 1 + sum(p.n for p in every)
        for p in every:
            arcs += [Arc(0, at, "epsilon"), *p.moved(at), Arc(at + p.n - 1, end, "epsilon")]
            at += p.n
        return Pattern(tuple(arcs), end + 1, self.register)

    def star(self) -> Pattern:
        end = self.n + 1
        return Pattern((Arc(0, 1, "epsilon"), *self.moved(1), Arc(self.n, 1, "epsilon"), Arc(self.n, end, "epsilon"), Arc(0, end, "epsilon")), self.n + 2, self.register)

    def plus(self) -> Pattern:
        return self.then(self.star())

    def optional(self) -> Pattern:
        return self.or_(Pattern.epsilon())

    def with_register(self, value: Any) -> Pattern:
        return Pattern(self.arcs, self.n, value)

    def build(self) -> Automaton:
        return Automaton(self.arcs, 0, frozenset({self.n - 1}), self.register)


@dataclass
class Matcher:
    """Runs an automaton over one key's events, time by time; also the state of a streaming query."""

    automaton: Automaton
    max_duration: int
    overlapping: bool = True
    deterministic: bool = False
    #: Live instances: start time, state, register.
    live: list[tuple[int, int, Any]] = field(default_factory=list)

    def closure(self, state: int, register: Any) -> list[tuple[int, Any]]:
        seen, todo = [(state, register)], [state]
        reached = {state}
        while todo:
            s = todo.pop()
            for a in self.automaton.arcs:
                if a.kind == "epsilon" and a.source == s and a.target not in reached:
                    reached.add(a.target)
                    todo.append(a.target)
                    seen.append((a.target, register))
        return seen

    def at(self, time: int, events: list[dict]) -> list[tuple[int, int, Any]]:
        """Matches (start, end, register) that end with the events of this time."""
        out: list[tuple[int, int, Any]] = []
        live = [(t, s, r) for t, s, r in self.live if time - t < self.max_duration]
        waiting = list(live)
        arrived: list[tuple[int, int, Any]] = []
        for i, event in enumerate(events):
            fresh = [] if live and not self.overlapping else [(time, s, r) for s, r in self.closure(self.automaton.start, self.automaton.register)]
            # A step takes instances from before this time, or just started: events of one time don't follow each other.
            for t, s, r in [*waiting, *fresh]:
                for a in self.automaton.arcs:
                    if a.kind == "single" and a.source == s and (a.fence is None or a.fence(event, r)):
                        arrived += [(t, s2, r2) for s2, r2 in self.closure(a.target, a.update(event, r) if a.update else r)]
                        if self.deterministic:
                            break
            if i == 0:
                for t, s, r in [*waiting, *fresh]:
                    for a in self.automaton.arcs:
                        if a.kind == "list" and a.source == s and (a.fence is None or a.fence(events, r)):
                            arrived += [(t, s2, r2) for s2, r2 in self.closure(a.target, a.update(events, r) if a.update else r)]
        kept: list[tuple[int, int, Any]] = []
        for t, s, r in arrived:
            if s in self.automaton.final:
                out.append((t, time, r))
                if not self.overlapping:
                    self.live = []
                    return out[:1]
            if (t, s, r) not in kept:
                kept.append((t, s, r))
        self.live = kept
        return out


def detect(df: DataFrame, pattern: Pattern | Automaton, max_duration: int, keys: Sequence[str], register_schema: str = "string", overlapping: bool = True, deterministic: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Matches of an automaton in the events of each key: vs and ve of the match (ve is one after its last event) and the register.

    An automaton is sequential, so a key's events are one task; a pattern must
    be contiguous: an event that no arc of an instance takes ends it.
    """
    automaton = pattern.build() if isinstance(pattern, Pattern) else pattern
    names = [c for c in df.columns if c not in (VE,)]
    key_types = [f"`{k}` {dict(df.dtypes)[k]}" for k in keys]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([VS, *order], kind="stable")
        matcher = Matcher(automaton, max_duration, overlapping, deterministic)
        rows = []
        key = [group[k].iloc[0] for k in keys]
        for time, same in group[names].groupby(VS, sort=False):
            for start, end, register in matcher.at(int(time), same.to_dict("records")):
                rows.append((*key, start, end + 1, register))
        return pd.DataFrame(rows, columns=[*keys, VS, VE, "register"])

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*key_types, f"{VS} long", f"{VE} long", f"register {register_schema}"]))
