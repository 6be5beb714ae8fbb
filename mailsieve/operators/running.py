"""Running values over the earlier rows of a key, by a two-level scan.

An ordered window over a key sends all of its rows to one task. Here rows are dealt out by key and block of time. A block's
totals are aggregated on the map side and scanned in order, one narrow row a block, which gives what every block starts
from; inside a block a window adds the rest. So a key that holds most of all rows is spread over as many tasks as it has
blocks, and no task sees more of it than one block.

The totals read their columns once more than the rows do, so scans of one set of rows belong into one call, or name the
rows that their totals come from: a scan over the result of another reads everything below it twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block. A key has some 1,500 of them a year.
BLOCK_SECONDS = 6 * 3600


@dataclass(frozen=True)
class Scan:
    """Over the earlier rows of the same ``keys``: running ``sums`` (nulls count as 0, no rows give 0), the value of ``last`` in
    the row just before (null if there is none), and ``folds`` of a linear recurrence u' = exp(a) u + b, given as (a, b), from 0
    on. Null keys are a group of their own. Column names of the result are the dictionaries' keys. ``source``: other
    rows that give the same totals, at less cost; every block of the rows must be in it."""

    keys: list[str]
    sums: dict[str, Column] = field(default_factory=dict)
    last: dict[str, Column] = field(default_factory=dict)
    folds: dict[str, tuple[Column, Column]] = field(default_factory=dict)
    source: DataFrame | None = None

    def names(self) -> list[str]:
        return [*self.sums, *self.last, *self.folds]


def block_of(df: DataFrame, ts: str, width: int = BLOCK_SECONDS) -> Column:
    """The number of a row's block; rows without a time come first, as in an ordered window."""
    kind = dict(df.dtypes)[ts]
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 if kind.startswith(("timestamp", "date")) else F.col(ts)
    return F.coalesce(F.floor(seconds / width).cast("long"), F.lit(-(1 << 62)))


def with_running(df: DataFrame, ts: str, tie: str, *scans: Scan, width: int = BLOCK_SECONDS) -> DataFrame:
    """Adds the values of the ``scans``, in order of (``ts``, ``tie``)."""
    out = df
    for scan in scans:
        out = _joined(out, _dealt(df if scan.source is None else scan.source, ts, scan, width), ts, tie, scan, width)
    return out.select(*df.columns, *(n for scan in scans for n in scan.names()))


def _dealt(df: DataFrame, ts: str, scan: Scan, width: int) -> DataFrame:
    """Rows with their key, block and the values that a scan takes."""
    values = {f"__s{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(scan.sums.values())} | {f"__l{i}": c for i, c in enumerate(scan.last.values())}
    for i, (a, b) in enumerate(scan.folds.values()):
        values |= {f"__a{i}": a, f"__b{i}": b}
    return df.withColumns({"__key": F.struct(*scan.keys), "__block": block_of(df, ts, width)} | values)


def _folded(x: DataFrame, i: int, rows, to: str) -> DataFrame:
    """Adds the sum of __a and the fold's value from 0 on, over the earlier rows of a window: __g, __u and __v with ``to``."""
    x = x.withColumn(f"__g{to}", F.coalesce(F.sum(f"__a{i}").over(rows), F.lit(0.0)))
    hits = F.coalesce(F.sum(F.col(f"__b{i}") * F.exp(-(F.col(f"__g{to}") + F.col(f"__a{i}")))).over(rows), F.lit(0.0))
    return x.withColumn(f"__u{to}", F.exp(f"__g{to}") * hits)


def _joined(rows: DataFrame, dealt: DataFrame, ts: str, tie: str, scan: Scan, width: int) -> DataFrame:
    at = F.struct(ts, tie)
    inside = Window.partitionBy("__key", "__block").orderBy(ts, tie)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum(f"__s{i}").alias(f"__t{i}") for i in range(len(scan.sums))] + [F.max_by(f"__l{i}", at).alias(f"__e{i}") for i in range(len(scan.last))]
    given = dealt
    for i in range(len(scan.folds)):  # a block as one step: its factor, and what it gives from 0 on
        given = _folded(given, i, earlier, f"i{i}")
        after = F.exp(f"__a{i}") * F.col(f"__ui{i}") + F.col(f"__b{i}")
        totals += [F.sum(f"__a{i}").alias(f"__a{i}"), F.max_by(after, at).alias(f"__b{i}")]
    blocks = given.groupBy("__key", "__block").agg(*totals)
    over = Window.partitionBy("__key").orderBy("__block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    starts = {f"__t{i}": F.sum(f"__t{i}").over(before) for i in range(len(scan.sums))} | {f"__e{i}": F.lag(f"__e{i}").over(over) for i in range(len(scan.last))}
    blocks = blocks.withColumns(starts)
    for i in range(len(scan.folds)):
        blocks = _folded(blocks, i, before, f"o{i}").drop(f"__a{i}", f"__b{i}", f"__go{i}")
    x = _dealt(rows, ts, scan, width).join(blocks, ["__key", "__block"])
    for i in range(len(scan.folds)):
        x = _folded(x, i, earlier, f"i{i}")
    out = {n: F.coalesce(F.col(f"__t{i}"), F.lit(0)) + F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)) for i, n in enumerate(scan.sums)}
    out |= {n: F.when(F.row_number().over(inside) == 1, F.col(f"__e{i}")).otherwise(F.lag(f"__l{i}").over(inside)) for i, n in enumerate(scan.last)}
    out |= {n: F.exp(f"__gi{i}") * F.col(f"__uo{i}") + F.col(f"__ui{i}") for i, n in enumerate(scan.folds)}
    return x.withColumns(out).select(*rows.columns, *scan.names())
