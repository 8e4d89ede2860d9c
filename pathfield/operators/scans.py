"""Running values along tracks, dealt over tasks where a track is large.

A window over a track puts all its rows into one task. Here a track of more than `large` rows is cut into pieces by frame ranges: each piece is scanned apart, its summary (last known
value, sum, extremum) is folded over the track's pieces before it, or behind it, and carried back to the piece's rows. A track of n rows has about
n / max(PIECE, sqrt(n)) pieces, so neither a piece nor the row of summaries of one track holds much more than sqrt(n). Other tracks, and tables without large ones, take plain windows over one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which a track is cut, and rows of a piece at least.
LARGE, PIECE = 1_000_000, 4_096
#: Tracks that are cut, the largest first. Any other has fewer rows than the table has over this number, or than LARGE.
MOST = 100_000


@dataclass
class Kind:
    """A running value: within a piece, over the windows up to a row, before it, from it on or behind it; of a piece; of pieces; of what is carried and what is within."""

    within: Callable[[Column, dict], Column]
    summary: Callable[[Column], Column]
    fold: Callable[[Column], Column]
    forward: bool | None
    merge: Callable[[Column, Column], Column]


def _struct(c: Column) -> Column:
    return F.struct(F.col("__f").alias("f"), c.alias("v"))


def _known(c: Column) -> Column:
    return F.when(c.isNotNull(), _struct(c))


def _known_kind(window: str, known: Callable[[Column], Column], forward: bool) -> Kind:
    pick = F.max if forward else F.min
    return Kind(lambda c, w: F.last(known(c), True).over(w[window]), lambda c: pick(known(c)), pick, forward, lambda own, carried: F.coalesce(own, carried))


def _add(own: Column, carried: Column) -> Column:
    return F.coalesce(own + carried, own, carried)


#: The values along a track by name. Those of (f, v) have the frame f that the value v is from.
KINDS = {
    # the last known value up to a row or before it, the next one from it on or behind it
    "last": _known_kind("upto", _known, True),
    "before": _known_kind("past", _known, True),
    "next": _known_kind("from", _known, False),
    "after": _known_kind("ahead", _known, False),
    # the neighbouring rows' values, known or not
    "lag": _known_kind("past", _struct, True),
    "lead": _known_kind("ahead", _struct, False),
    "sum": Kind(lambda c, w: F.sum(c).over(w["upto"]), F.sum, F.sum, True, _add),
    "sum_back": Kind(lambda c, w: F.sum(c).over(w["from"]), F.sum, F.sum, False, _add),
    "max": Kind(lambda c, w: F.max(c).over(w["upto"]), F.max, F.max, True, lambda own, carried: F.greatest(own, carried)),
    "min_back": Kind(lambda c, w: F.min(c).over(w["from"]), F.min, F.min, False, lambda own, carried: F.least(own, carried)),
    # of the whole track
    "first": Kind(lambda c, w: F.min(_struct(c)).over(w["all"]), lambda c: F.min(_struct(c)), F.min, None, lambda own, carried: F.coalesce(carried, own)),
    "final": Kind(lambda c, w: F.max(_struct(c)).over(w["all"]), lambda c: F.max(_struct(c)), F.max, None, lambda own, carried: F.coalesce(carried, own)),
    "total": Kind(lambda c, w: F.sum(c).over(w["all"]), F.sum, F.sum, None, lambda own, carried: F.coalesce(carried, own)),
    "top": Kind(lambda c, w: F.max(c).over(w["all"]), F.max, F.max, None, lambda own, carried: F.coalesce(carried, own)),
}


class Scan:
    """A table in the order of its tracks' frames. df has the rows; `add` gives it running values as columns; `done` gives the table back.

    large: None for plain windows without counting.
    """

    def __init__(self, tracks: DataFrame, t: str = "t", f: str = "f", large: int | None = LARGE, piece: int = PIECE):
        self.t, self.columns = t, tracks.columns
        self.df = tracks.withColumn("__f", F.col(f))
        self.cut = False
        if large is None:
            return
        counts = tracks.groupBy(t).agg(F.count(F.lit(1)).alias("n"), F.min(f).alias("lo"), F.max(f).alias("hi")).where((F.col("n") > large) & (F.col("hi") > F.col("lo")))
        found = counts.orderBy(F.desc("n")).limit(MOST).collect()
        if not found:
            return
        self.cut = True
        names = {"n": "__n", "lo": "__lo", "hi": "__hi"}
        big = tracks.sparkSession.createDataFrame(found, counts.schema).withColumnsRenamed(names).withColumnRenamed(t, "__t")
        many = F.ceil(F.col("__n") / F.greatest(F.lit(float(piece)), F.sqrt(F.col("__n").cast("double"))))
        at = (F.col("__f") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
        part = F.least(F.floor(at.cast("double") * many), many - 1)
        rows = self.df.join(F.broadcast(big), self.df[t].eqNullSafe(F.col("__t")), "left")
        # rows without a frame come first, as in a window
        self.df = rows.withColumn("__s", F.when(F.col("__n").isNotNull(), F.coalesce(part, F.lit(-1)))).drop("__t", *names.values())

    def _windows(self) -> dict:
        keys = [self.t, "__s"] if self.cut else [self.t]
        up, down = Window.partitionBy(*keys).orderBy("__f"), Window.partitionBy(*keys).orderBy(F.desc("__f"))
        begin = Window.unboundedPreceding
        return {"upto": up.rowsBetween(begin, 0), "past": up.rowsBetween(begin, -1), "from": down.rowsBetween(begin, 0), "ahead": down.rowsBetween(begin, -1), "all": Window.partitionBy(*keys)}

    def add(self, **values: tuple[str, Column]) -> Scan:
        """Columns by name: a kind and what it runs over."""
        w = self._windows()
        if not self.cut:
            near = {"lag": F.lag, "lead": F.lead}
            own = Window.partitionBy(self.t).orderBy("__f")
            self.df = self.df.withColumns({k: near[kind](_struct(c)).over(own) if kind in near else KINDS[kind].within(c, w) for k, (kind, c) in values.items()})
            return self
        pieces = self.df.where("__s is not null").groupBy(F.col(self.t).alias("__ct"), F.col("__s").alias("__cs")).agg(*[KINDS[kind].summary(c).alias(k) for k, (kind, c) in values.items()])
        track = Window.partitionBy("__ct")
        order = {True: track.orderBy("__cs").rowsBetween(Window.unboundedPreceding, -1), False: track.orderBy(F.desc("__cs")).rowsBetween(Window.unboundedPreceding, -1), None: track}
        carried = pieces.select("__ct", "__cs", *[KINDS[kind].fold(F.col(k)).over(order[KINDS[kind].forward]).alias(f"__c_{k}") for k, (kind, _) in values.items()])
        rows = self.df.withColumns({k: KINDS[kind].within(c, w) for k, (kind, c) in values.items()})
        rows = rows.join(carried, rows[self.t].eqNullSafe(carried["__ct"]) & (rows["__s"] == carried["__cs"]), "left")
        merged = {k: KINDS[kind].merge(F.col(k), F.col(f"__c_{k}")) for k, (kind, _) in values.items()}
        self.df = rows.withColumns(merged).drop("__ct", "__cs", *[f"__c_{k}" for k in values])
        return self

    def with_columns(self, **columns: Column) -> Scan:
        self.df = self.df.withColumns(columns)
        return self

    def done(self, *more: str | Column) -> DataFrame:
        """The table's own columns, and others."""
        return self.df.select(*self.columns, *more)


def halo(tracks: DataFrame, reach: int, t: str = "t", f: str = "f", large: int | None = LARGE, piece: int = PIECE) -> tuple[DataFrame, list[str]]:
    """(rows, keys): rows with __row, __n (their number from 1, their track's rows) and __own, to be scanned by keys, with the `reach` rows on either side in the same group.

    Where a track is cut, rows near a border are also in the neighbouring group, and not __own there.
    """
    scan = Scan(tracks, t, f, large, piece)
    rows = scan.add(__row=("sum", F.lit(1)), __n=("total", F.lit(1))).done("__row", "__n", *(["__s"] if scan.cut else []))
    if not scan.cut:
        return rows.withColumn("__own", F.lit(True)), [t]
    size = max(piece, 2 * reach)
    home = F.floor((F.col("__row") - 1) / size)
    copies = F.array_distinct(F.array(home, F.floor((F.col("__row") - 1 - reach) / size), F.floor((F.col("__row") - 1 + reach) / size)))
    cut = F.when(F.col("__s").isNotNull(), copies).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.withColumns({"__b": F.explode(cut), "__home": F.when(F.col("__s").isNotNull(), home).otherwise(0)}).drop("__s")
    return rows.withColumn("__own", F.col("__b") == F.col("__home")).drop("__home"), [t, "__b"]
