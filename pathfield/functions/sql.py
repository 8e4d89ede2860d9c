"""Forms, scalars and gap filling that SQL can call in a session: `register(spark)`, then `spark.sql`.

Scalars are SQL functions, which the optimizer puts into the query like any expression. fill_gaps is a table function: `SELECT * FROM fill_gaps(10, TABLE(tracks) PARTITION BY t ORDER BY f)` gives
every partition a row for each frame between its first and last, and fills runs of up to so many missing numbers by lines.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, LongType, ShortType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_D = "DOUBLE"
#: Name to parameters (with their SQL defaults) and body; all numbers are doubles.
FUNCTIONS: dict[str, tuple[str, str]] = {
    "exp_decay": (f"t {_D}, sig {_D} DEFAULT 1, a {_D} DEFAULT 1, c {_D} DEFAULT 0", "c + a * exp(-t / sig)"),
    "log_decay": (f"t {_D}, a {_D} DEFAULT 1, tl {_D} DEFAULT 1, c {_D} DEFAULT 0", "c - a * ln(t / tl)"),
    "powerlaw": (f"t {_D}, b {_D} DEFAULT 1, a {_D} DEFAULT 1, c {_D} DEFAULT 0", "c + a * pow(t, -b)"),
    "chained_power": (f"t {_D}, d1 {_D}, d2 {_D}, b1 {_D}, b2 {_D} DEFAULT 1", "greatest(d1 * pow(t, b1), d2 * pow(t, b2))"),
    "gauss_form": (f"x {_D}, a {_D} DEFAULT 1, x0 {_D} DEFAULT 0, sig {_D} DEFAULT 1, c {_D} DEFAULT 0", "c + a * exp(-pow((x - x0) / sig, 2))"),
    "nn_form": (f"t {_D}, dr {_D}, tr {_D} DEFAULT NULL", "exp(-dr * (t + coalesce(tr * expm1(-t / tr), 0)))"),
    "rn_form": (f"t {_D}, lp {_D}, dr {_D}, tr {_D} DEFAULT NULL", "lp * signum(t) * -expm1(-dr * abs(t)) * exp(dr * coalesce(tr, 0))"),
    "rr_form": (f"t {_D}, v0 {_D}, dt {_D}, dr {_D}", "2 * pow(v0 / dr, 2) * (dr * t + expm1(-dr * t)) + 4 * dt * t"),
    "wrapped_angle": (f"a {_D}, b {_D}, m {_D} DEFAULT 1", "pmod(b - a + pi() / m, 2 * pi() / m) - pi() / m"),
    "distance_of": (f"x1 {_D}, y1 {_D}, x2 {_D}, y2 {_D}", "hypot(x2 - x1, y2 - y1)"),
    "decade": (f"x {_D}", "CASE WHEN x > 0 THEN pow(10, floor(log10(x))) END"),
}


class FillGaps:
    """The rows of a partition in the order of a whole-number column, the second of the table's, with the missing ones. The first column is the partition's; fractions among the rest are filled by lines."""

    @staticmethod
    def analyze(most: AnalyzeArgument, tracks: AnalyzeArgument) -> AnalyzeResult:
        if not tracks.isTable or len(tracks.dataType.fields) < 2:
            raise ValueError("a table of at least two columns: key, frame")
        if not isinstance(tracks.dataType.fields[1].dataType, (ShortType, IntegerType, LongType)):
            raise ValueError("the second column counts frames")
        return AnalyzeResult(StructType([*tracks.dataType.fields, StructField("is_filled", BooleanType())]), withSinglePartition=False)

    def __init__(self):
        self.last: list | None = None
        #: rows that wait for the next known values
        self.held: list[list] = []
        self.names: list[str] = []
        self.most = 0

    def eval(self, most: int, row: Row):
        values = list(row)
        if not self.names:
            self.names, self.most = list(row.__fields__), most
        if values[1] is None:
            yield (*values, False)
            return
        if self.last is not None:
            for f in range(self.last[1] + 1, values[1]):
                self.held.append([values[0], f, *[None] * (len(values) - 2), True])
                yield from self._settled()
        for k, v in enumerate(values[2:], 2):
            if isinstance(v, float):
                self._line(k, values)
        self.held.append([*values, False])
        self.last = values
        yield from self._settled()

    def _line(self, k: int, values: list) -> None:
        """Column k's missing numbers since its last known one, if these are few."""
        run = []
        for h in reversed(self.held):
            if h[k] is not None:
                if len(run) <= self.most:
                    for r in run:
                        r[k] = h[k] + (values[k] - h[k]) * (r[1] - h[1]) / (values[1] - h[1])
                return
            run.append(h)

    def _settled(self):
        # what is more than `most` frames back can't change any more, but the last row a line may begin at stays
        while len(self.held) > self.most + 2:
            yield tuple(self.held.pop(0))

    def terminate(self):
        for h in self.held:
            yield tuple(h)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for name, (args, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    spark.udtf.register("fill_gaps", udtf(FillGaps))
    return [*FUNCTIONS, "fill_gaps"]
