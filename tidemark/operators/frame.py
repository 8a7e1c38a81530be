"""The interval relation that all temporal operators share.

Rows are valid in a half-open interval ``[vs, ve)`` of integers; ``INF`` is an
open end. A relation has key columns (may be none), within which operators
such as joins and windows keep apart, and payload columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

INF = (1 << 63) - 1
VS, VE = "vs", "ve"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plus(x: Column, d: Column | int) -> Column:
    """x + d, but an open end stays open."""
    return F.when(x == INF, F.lit(INF)).otherwise(x + d)


def valid(df: DataFrame) -> DataFrame:
    """Rows with an empty lifetime vanish."""
    return df.filter(F.col(VS) < F.col(VE))


def over(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    t = col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    return days * 86_400_000 + seconds.cast("long") * 1000 + (F.date_part(F.lit("SECONDS"), t) * 1000).cast("long")


@dataclass(frozen=True)
class Props:
    """Promises about a relation that operators may rely on and ``check`` verifies."""

    interval_free: bool = False
    constant_duration: int | None = None
    no_open_ends: bool = False
    snapshot_sorted: bool = False
    distinct_payload: bool = False


@dataclass(frozen=True)
class TemporalFrame:
    """A DataFrame with its keys; every operator of ``tidemark.operators`` is a method.

    ``frame.hopping(60, 10)`` is ``hopping(frame.df, 60, 10)``; operators that
    take ``keys`` get those of the frame unless they are given.
    """

    df: DataFrame
    keys: tuple[str, ...] = ()
    props: Props = field(default_factory=Props)

    def __getattr__(self, name: str):
        import inspect

        from tidemark.operators import REGISTRY

        if name not in REGISTRY:
            raise AttributeError(name)
        f: Callable = REGISTRY[name]
        takes_keys = "keys" in inspect.signature(f).parameters

        def call(*args, **kwargs):
            if takes_keys and "keys" not in kwargs:
                kwargs["keys"] = self.keys
            args = [a.df if isinstance(a, TemporalFrame) else a for a in args]
            out = f(self.df, *args, **kwargs)
            return replace(self, df=out, props=Props()) if isinstance(out, DataFrame) else out

        return call

    def multicast(self, *selectors: Callable[[TemporalFrame], TemporalFrame]) -> list[TemporalFrame]:
        """Several sub-queries over one source; a plan is a value, so sharing is reuse."""
        return [s(self) for s in selectors]

    def multicast_with(self, other: TemporalFrame, selector: Callable[[TemporalFrame, TemporalFrame], TemporalFrame]) -> TemporalFrame:
        """A sub-query over two sources."""
        return selector(self, other)

    def equi_join(self, other: TemporalFrame, prefix: str = "r_") -> TemporalFrame:
        """The join that the promises of both sides allow: without ends an equi-join, with constant durations one without statistics."""
        from tidemark.operators import join as J

        a, b = self.props, other.props
        if a.interval_free and b.interval_free:
            out = J.start_edge_join(self.df, other.df, self.keys, prefix)
        elif a.constant_duration and b.constant_duration:
            out = J.fixed_interval_join(self.df, other.df, a.constant_duration, b.constant_duration, self.keys, prefix)
        else:
            out = J.join(self.df, other.df, self.keys, None, prefix)
        return replace(self, df=out, props=Props(interval_free=a.interval_free and b.interval_free))

    def get_properties(self) -> Props:
        return self.props

    def copies(self, n: int) -> list[TemporalFrame]:
        return [self] * n

    def set_property(self, **promises) -> TemporalFrame:
        return replace(self, props=replace(self.props, **promises))

    def cache(self) -> TemporalFrame:
        return replace(self, df=self.df.persist())

    def explain(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def check(self) -> DataFrame:
        """Rows that break a promise; empty if all hold."""
        p, df = self.props, self.df
        broken = F.col(VS) >= F.col(VE)
        if p.interval_free:
            broken = broken | (F.col(VE) != INF)
        if p.no_open_ends:
            broken = broken | (F.col(VE) == INF)
        if p.constant_duration is not None:
            broken = broken | (F.col(VE) - F.col(VS) != p.constant_duration)
        out = df.filter(broken)
        if p.distinct_payload:
            payload = [c for c in df.columns if c not in (VS, VE)]
            before = F.max(VE).over(over(payload, VS).rowsBetween(Window.unboundedPreceding, -1))
            out = out.union(df.withColumn("before", before).filter(F.col("before") > F.col(VS)).drop("before"))
        return out


@dataclass
class QueryContext:
    """Named relations, for fluent queries and for SQL."""

    spark: object
    frames: dict[str, TemporalFrame] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, keys: Sequence[str] = (), props: Props | None = None) -> TemporalFrame:
        self.frames[name] = frame = TemporalFrame(df, tuple(keys), props or Props())
        df.createOrReplaceTempView(name)
        return frame

    def __getitem__(self, name: str) -> TemporalFrame:
        return self.frames[name]

    def sql(self, text: str) -> TemporalFrame:
        return TemporalFrame(self.spark.sql(text))
