"""Queries by name over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.functions import forms, scalars
from pathfield.operators import binning, detect, fit, groups, lag, linking, noise, orient, sequence, shells, simulate, slices, spatial, tracksets, voronoi
from pathfield.sources import adapters
from pathfield.streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns to so many digits, so that engines that add in another order agree; what is not finite becomes NULL.

    Rounding goes by decimals of ten digits: an exact half, which means of the data's two decimals often are, is one in every engine.
    """
    return df.select(*[F.round(F.col(c).try_cast("decimal(38,10)"), digits).cast("double").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str) -> str:
    """SQL whose roundings to 6 or 4 digits go by decimals as well."""
    out, at = [], 0
    for m in re.finditer(r"(?<![a-z_])round\(", sql):
        if m.start() < at:
            continue
        depth, end, comma = 1, m.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        if comma and sql[comma + 1 : end - 1].strip() in ("6", "4"):
            inner = rounded_sql(sql[m.end() : comma])
            out += [sql[at : m.start()], f"CAST(round(TRY_CAST({inner} AS DECIMAL(38, 10)), {sql[comma + 1 : end - 1].strip()}) AS DOUBLE)"]
            at = end
    return "".join([*out, sql[at:]])


def query(source: str | None, sql: str | None = None, digits: int = 6):
    """Register a function of the adapter's table (or of spark, sf_dir), rounded; sql: what follows the adapter's WITH."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(getattr(adapters, source)(spark, sf_dir)) if source else f(spark, sf_dir), digits)

        QUERIES[f.__name__] = run
        if sql:
            text = rounded_sql(sql)
            ORACLES[f.__name__] = f"WITH {adapters.SQL[source]}{',' if not text.lstrip().upper().startswith('SELECT') else ''} {text}" if source else text
        return f

    return keep


_PAIRS = "p AS (SELECT a.t, a.f, b.f - a.f AS tau, a.x AS x1, b.x AS x2, a.y AS y1, b.y AS y2, a.o AS o1, b.o AS o2 FROM tracks_dense a JOIN tracks_dense b ON a.t = b.t AND b.f >= a.f)"
_BOTH = _PAIRS.replace(" AND b.f >= a.f", "")
_MSD = f"{_PAIRS}, m AS (SELECT t, tau, avg((x2 - x1) ** 2 + (y2 - y1) ** 2) AS msd FROM p GROUP BY ALL)"
_ENSEMBLE = "SELECT tau, round(avg(c), 6) AS mean, round(stddev_samp(c) / sqrt(count(c)), 6) AS stderr, count(c) AS n FROM m GROUP BY tau HAVING count(c) >= 3"
_NEIGHBOURS = "q AS (SELECT a.f, a.id AS id1, b.id AS id2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.o AS o1, b.o AS o2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM points a JOIN points b ON a.f = b.f AND a.id <> b.id)"
_KNN = f"{_NEIGHBOURS}, k AS (SELECT *, row_number() OVER (PARTITION BY f, id1 ORDER BY d, id2) AS rank FROM q QUALIFY rank <= 4)"
_BOND = f"{_KNN}, s AS (SELECT f, id1 AS id, avg(cos(4 * atan2(y2 - y1, x2 - x1))) AS re, avg(sin(4 * atan2(y2 - y1, x2 - x1))) AS im FROM k GROUP BY ALL)"


# -- groups, sets, bins


@query("tracks_dense", "n AS (SELECT t, count(*) AS n FROM tracks_dense GROUP BY t) SELECT t, f, id, round(x, 6) AS x, round(y, 6) AS y, round(o, 6) AS o FROM tracks_dense JOIN n USING (t) WHERE n >= 60")
def length_filter(d):
    return groups.length_filter(d, 60)


@query("tracks_dense", "SELECT t, count(*) AS n FROM tracks_dense GROUP BY t ORDER BY n DESC, t LIMIT 10")
def top_n_tracks(d):
    return groups.longest(d, 10)


@query("tracks_dense", "n AS (SELECT t, count(*) AS size FROM tracks_dense GROUP BY t) SELECT size, count(*) AS groups FROM n GROUP BY size ORDER BY groups DESC, size LIMIT 1")
def mode_group_size(d):
    return groups.modal_group_size(d, "t")


@query("dup_lines", "SELECT f, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(x)), 6) AS stderr, count(x) AS n FROM dup_lines GROUP BY f HAVING count(x) >= 3")
def uneven_mean(d):
    return groups.uneven_mean(d, "x", "f")


@query(
    "orders_series",
    "kept AS (SELECT * FROM orders_series QUALIFY count(*) OVER (PARTITION BY f) >= 3), w AS (SELECT *, sqrt(count(*) OVER (PARTITION BY t)) AS w FROM kept), "
    "g AS (SELECT f, sum(w) AS sw, sum(w * x) AS wx, sum(w * x * x) AS wxx, count(*) AS n FROM w GROUP BY f) "
    "SELECT f, round(wx / sw, 6) AS mean, round(sqrt(greatest(wxx / sw - (wx / sw) ** 2, 0)) / sqrt(n), 6) AS stderr, n FROM g",
)
def uneven_mean_weighted(d):
    return groups.uneven_mean_weighted(d, "x", "f", "t")


@query(
    "orders_series",
    "m AS (SELECT t, avg(x) AS mu, count(*) AS n, var_samp(x) AS v FROM orders_series GROUP BY t), c AS (SELECT t, avg((x - mu) ** 2) AS m2, avg((x - mu) ** 3) AS m3, avg((x - mu) ** 4) AS m4 FROM orders_series JOIN m USING (t) GROUP BY t) "
    "SELECT t, n, round(mu, 6) AS mean, round(v, 6) AS variance, round(sqrt(v) / sqrt(n), 6) AS stderr, CASE WHEN m2 > 0 THEN round(m3 / m2 ** 1.5, 6) END AS skew, CASE WHEN m2 > 0 THEN round(m4 / m2 ** 2 - 3, 6) END AS kurtosis FROM m JOIN c USING (t) WHERE n >= 3",
)
def moments(d):
    return groups.moments(d, "x", ["t"]).where("n >= 3")


@query("tracks_dense", "SELECT least(CAST(floor(x / 25.0) AS INTEGER), 19) AS bin, count(*) AS n, round(sum(y), 6) AS sum_y, round(avg(y), 6) AS avg_y FROM tracks_dense WHERE x BETWEEN 0 AND 500 GROUP BY 1")
def bin_average(d):
    return binning.bin_average(d, {"bin": binning.bin_index(F.col("x"), 0.0, 500.0, 20)}, {"y": F.col("y")})


@query(
    "tracks_dense",
    "SELECT least(CAST(floor(x / 50.0) AS INTEGER), 9) AS i, least(CAST(floor(y / 10.0) AS INTEGER), 9) AS j, count(*) AS n, round(sum(o), 6) AS sum_o, round(avg(o), 6) AS avg_o FROM tracks_dense WHERE x BETWEEN 0 AND 500 AND y BETWEEN 0 AND 100 GROUP BY 1, 2",
)
def bin_sum_2d(d):
    return binning.bin_average(d, {"i": binning.bin_index(F.col("x"), 0.0, 500.0, 10), "j": binning.bin_index(F.col("y"), 0.0, 100.0, 10)}, {"o": F.col("o")})


@query("dots", "c AS (SELECT f, least(CAST(floor(x / 50.0) AS INTEGER), 9) AS bin, count(*) AS n FROM dots WHERE x BETWEEN 0 AND 500 GROUP BY 1, 2) SELECT f, bin, n, round(n / sum(n) OVER (PARTITION BY f), 6) AS share FROM c")
def histogram_time(d):
    return binning.histogram(d, F.col("x"), 0.0, 500.0, 10, ["f"])


@query("dots", "c AS (SELECT f, least(CAST(floor(x / 50.0) AS INTEGER), 9) AS bin, count(*) AS n FROM dots WHERE x BETWEEN 0 AND 500 GROUP BY 1, 2) SELECT bin, round(avg(n), 6) AS mean, round(var_pop(n), 6) AS variance, round(stddev_pop(n) / sqrt(count(*)), 6) AS stderr FROM c GROUP BY bin")
def mean_histogram(d):
    return binning.mean_histogram(binning.histogram(d, F.col("x"), 0.0, 500.0, 10, ["f"]))


@query("points", "SELECT CAST(floor(sqrt(x * x + y * y) / 0.05) AS BIGINT) AS i, count(o) AS n, round(avg(o), 6) AS mean FROM points GROUP BY 1")
def site_mean_radial(d):
    return binning.site_mean(d, "o", 0.05, "r")


@query("tracks_gappy", "u AS (SELECT DISTINCT t, f FROM tracks_gappy), g AS (SELECT lead(f) OVER (PARTITION BY t ORDER BY f) - f - 1 AS gap FROM u) SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap")
def gap_distribution(d):
    return groups.gap_distribution(d)


@query(
    None,
    "WITH a AS (SELECT o_custkey AS t, o_orderkey AS id FROM orders), b AS (SELECT user_id AS t, event_id AS id FROM events) "
    "SELECT t, id, 0 AS dataset FROM a UNION ALL SELECT t + (SELECT max(t) + 1 FROM a), id, 1 FROM b",
)
def merge_offset(spark, sf_dir):
    a = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("t"), F.col("o_orderkey").alias("id"))
    b = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("t"), F.col("event_id").alias("id"))
    return groups.merge([a, b])


@query(
    None,
    "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events) "
    "SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)",
)
def set_ops(spark, sf_dir):
    a = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).distinct()
    parts = {"both": a.intersect(b), "left": a.subtract(b), "any": a.union(b).distinct()}
    counts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, d in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("tracks_gappy", "m AS (SELECT t % 5 AS trial, f // 24 AS f, median(x) AS m FROM tracks_gappy GROUP BY 1, 2), e AS (SELECT min(e) AS e FROM (SELECT max(f) AS e FROM m GROUP BY trial)) SELECT f, round(avg(m), 6) AS mean, count(m) AS n FROM m, e WHERE f <= e GROUP BY f")
def trial_medians(d):
    return groups.trial_median_mean(d.select((F.col("t") % 5).alias("trial"), F.floor(F.col("f") / 24).cast("int").alias("f"), "x"), "x", "trial")


@query("tracks_dense", "n AS (SELECT t, count(*) AS n FROM tracks_dense GROUP BY t ORDER BY n DESC, t LIMIT 5) SELECT t, f, id, round(x, 6) AS x, round(y, 6) AS y, round(o, 6) AS o FROM tracks_dense SEMI JOIN n USING (t)")
def longest_rows(d):
    return groups.length_filter(d, -5)


@query(
    "tracks_dense",
    "fr AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS i FROM (SELECT DISTINCT f FROM tracks_dense)), a AS (SELECT d.* FROM tracks_dense d JOIN fr USING (f) WHERE i >= 2 AND i < 40), b AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY t) >= 10), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f) - 1 AS i FROM b), e AS (SELECT * FROM c WHERE i % 2 = 0), s AS (SELECT *, coalesce(CASE WHEN abs(o - lag(o) OVER w) > pi() THEN sign(o - lag(o) OVER w) END, 0) AS turn FROM e WINDOW w AS (PARTITION BY t ORDER BY f)), "
    "u AS (SELECT t, f, x, y, o - 2 * pi() * sum(turn) OVER (PARTITION BY t ORDER BY f) AS o FROM s), g AS (SELECT *, lead(f) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(o) OVER w AS no FROM u WINDOW w AS (PARTITION BY t ORDER BY f)), "
    "z AS (SELECT t, f + i AS f, x + (coalesce(nx, x) - x) * i / coalesce(nf - f, 1) AS x, y + (coalesce(ny, y) - y) * i / coalesce(nf - f, 1) AS y, o + (coalesce(no, o) - o) * i / coalesce(nf - f, 1) AS o FROM g, LATERAL (SELECT unnest(range(0, coalesce(nf - f, 1))) AS i)) "
    "SELECT t, CAST(f AS INTEGER) AS f, round(x, 6) AS x, round(y, 6) AS y, round(o, 6) AS o FROM z QUALIFY row_number() OVER (PARTITION BY t ORDER BY z.f) BETWEEN 2 AND 20",
)
def track_sets(d):
    return tracksets.tracksets(d, 10, "1:20:2", "2:40", gaps="interp", unwrap=True).select("t", "f", "x", "y", "o")


@query("tracks_dense", "r AS (SELECT t, max(f) OVER (PARTITION BY t) - f AS f, id FROM tracks_dense) SELECT t, f, id FROM r QUALIFY row_number() OVER (PARTITION BY t ORDER BY r.f) <= 7")
def reversed_rows(d):
    return tracksets.sliced(d, ":7:-1").select("t", "f", "id")


@query("tracks_dense", "n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM tracks_dense GROUP BY t)), r AS (SELECT t, f, id, CAST(row_number() OVER (PARTITION BY t ORDER BY f) - 1 AS INTEGER) AS row FROM tracks_dense) SELECT t, f, id, row FROM r, n WHERE row < n")
def stacked_tracks(d):
    return groups.stacked(d).select("t", "f", "id", "row")


@query("tracks_dense", "r AS (SELECT t, id, row_number() OVER (PARTITION BY t ORDER BY f) - 1 AS pos FROM tracks_dense), g AS (SELECT t, i FROM (SELECT DISTINCT t FROM tracks_dense), (SELECT unnest(range(12)) AS i)) SELECT g.t, CAST(i AS INTEGER) AS pos, id FROM g LEFT JOIN r ON r.t = g.t AND r.pos = i")
def padded_tracks(d):
    return groups.padded(d, "id", 12).select("t", F.posexplode_outer("values").alias("pos", "id"))


@query("dots", "c AS (SELECT f, least(CAST(floor(x / 50.0) AS INTEGER), 9) AS bin, count(*) AS n FROM dots WHERE x > 0 AND x < 500 GROUP BY 1, 2) SELECT f, bin, n, round(n / sum(n) OVER (PARTITION BY f), 6) AS share FROM c")
def histogram_open(d):
    return binning.histogram(d, F.col("x"), 0.0, 500.0, 10, ["f"], True)


@query("points", "SELECT CAST(floor(x / 0.05) AS BIGINT) AS i, CAST(floor(y / 0.05) AS BIGINT) AS j, count(o) AS n, round(avg(o), 6) AS mean FROM points GROUP BY 1, 2")
def site_mean_xy(d):
    return binning.site_mean(d, "o", 0.05)


@query("tracks_dense", "m AS (SELECT avg(x + 1) AS mx, avg(y + 1) AS my FROM tracks_dense), r AS (SELECT x + 1 - mx AS x, y + 1 - my AS y, o FROM tracks_dense, m) SELECT CAST(floor(sqrt(x * x + y * y) / 20) AS BIGINT) AS i, CAST(floor(atan2(y, x) / (pi() / 2)) AS BIGINT) AS j, count(o) AS n, round(avg(o), 6) AS mean FROM r GROUP BY 1, 2")
def site_mean_polar(d):
    return binning.site_mean(d.withColumns({"x": F.col("x") + 1, "y": F.col("y") + 1}), "o", 20.0, "polar", recentre=True)


@query("tracks_gappy", "n AS (SELECT DISTINCT t, f FROM tracks_gappy WHERE x > 20), g AS (SELECT lead(f) OVER (PARTITION BY t ORDER BY f) - f - 1 AS gap FROM n) SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap")
def gaps_of_nulls(d):
    return groups.gap_distribution(d.withColumn("v", F.when(F.col("x") > 20, F.col("x"))), field="v")


@query("orders_series", "r AS (SELECT t % 7 AS trial, f AS r, avg(x) AS v FROM orders_series GROUP BY 1, 2), n AS (SELECT trial, r, v / first_value(v) OVER (PARTITION BY trial ORDER BY r) AS v FROM r), e AS (SELECT min(e) AS e FROM (SELECT max(r) AS e FROM n GROUP BY trial)) SELECT r, round(avg(v), 6) AS mean, count(v) AS n FROM n, e WHERE r <= e GROUP BY r")
def radial_mean(d):
    c = d.groupBy((F.col("t") % 7).alias("trial"), F.col("f").alias("r")).agg(F.avg("x").alias("v"))
    return groups.radial_mean(c, "v", "r", "trial", True)


@query("orders_series", "m AS (SELECT f, avg(x) AS mid FROM orders_series GROUP BY f), o AS (SELECT 0 AS g, mid, lag(mid) OVER w AS a, lead(mid) OVER w AS b FROM m WINDOW w AS (ORDER BY mid)) SELECT round(mid, 6) AS mid, round(coalesce((a + mid) / 2, mid - (b - mid) / 2), 6) AS low, round(coalesce((mid + b) / 2, mid + (mid - a) / 2), 6) AS high FROM o")
def bin_edges(d):
    return binning.bin_edges(d.groupBy("f").agg(F.avg("x").alias("mid")).select(F.lit(0).alias("g"), "mid"), "mid", ["g"]).drop("g")


# -- windows over tracks


@query(
    "dup_lines",
    "g AS (SELECT t, f, avg(x) AS mx, avg(y) AS my FROM dup_lines GROUP BY t, f), n AS (SELECT t, f, lag(mx) OVER w AS px, lag(my) OVER w AS py, lead(mx) OVER w AS nx, lead(my) OVER w AS ny FROM g WINDOW w AS (PARTITION BY t ORDER BY f)), "
    "s AS (SELECT d.*, round(coalesce((x - px) ** 2 + (y - py) ** 2, 0) + coalesce((x - nx) ** 2 + (y - ny) ** 2, 0), 9) AS s FROM dup_lines d JOIN n USING (t, f)) "
    "SELECT t, f, id, round(x, 6) AS x, round(y, 6) AS y FROM s QUALIFY row_number() OVER (PARTITION BY t, f ORDER BY s, id) = 1",
)
def dedupe(d):
    return sequence.dedupe(d)


_ONE = "u AS (SELECT t, f, min(id) AS id, avg(x) AS x FROM tracks_gappy GROUP BY t, f), g AS (SELECT *, coalesce(lead(f) OVER (PARTITION BY t ORDER BY f) - f - 1, 0) AS gap FROM u), dn AS (SELECT t, CAST(f + i AS INTEGER) AS f, CASE WHEN i = 0 THEN id END AS id, CASE WHEN i = 0 THEN x END AS x, i > 0 AS is_filled FROM g, LATERAL (SELECT unnest(range(0, gap + 1)) AS i))"


def _single(d: DataFrame) -> DataFrame:
    return d.groupBy("t", "f").agg(F.min("id").alias("id"), F.avg("x").alias("x"))


@query("tracks_gappy", f"{_ONE} SELECT t, f, id, round(x, 6) AS x, is_filled FROM dn")
def densify(d):
    return sequence.densify(_single(d))


@query(
    "tracks_gappy",
    f"{_ONE}, r AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS a, first_value(x IGNORE NULLS) OVER n AS b, last_value(CASE WHEN x IS NOT NULL THEN f END IGNORE NULLS) OVER p AS fa, first_value(CASE WHEN x IS NOT NULL THEN f END IGNORE NULLS) OVER n AS fb FROM dn "
    "WINDOW p AS (PARTITION BY t ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY t ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT t, f, id, is_filled, round(CASE WHEN x IS NOT NULL THEN x WHEN fb - fa - 1 <= 10 THEN a + (b - a) * (f - fa) / nullif(fb - fa, 0) END, 6) AS x FROM r",
)
def interpolate(d):
    return sequence.interpolate(sequence.densify(_single(d)), ["x"])


@query(
    "tracks_dense",
    "s AS (SELECT *, coalesce(CASE WHEN abs(o - lag(o) OVER w) > pi() THEN sign(o - lag(o) OVER w) END, 0) AS turn FROM tracks_dense WINDOW w AS (PARTITION BY t ORDER BY f)) "
    "SELECT t, f, id, round(x, 6) AS x, round(y, 6) AS y, round(o - 2 * pi() * sum(turn) OVER (PARTITION BY t ORDER BY f), 6) AS o FROM s",
)
def unwrap(d):
    return sequence.unwrap(d)


@query("tracks_dense", "SELECT t, f, round(coalesce(lead(x) OVER w - x, x - lag(x) OVER w), 6) AS dx FROM tracks_dense WINDOW w AS (PARTITION BY t ORDER BY f)")
def diff_forward(d):
    return sequence.differenced(d, "dx", "x").select("t", "f", "dx")


@query("tracks_dense", "SELECT t, f, round(coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w), 6) AS dx FROM tracks_dense WINDOW w AS (PARTITION BY t ORDER BY f)")
def gradient(d):
    return sequence.differenced(d, "dx", "x", True).select("t", "f", "dx")


def _gauss_sql(c: str, sigma: float = 0.65, order: int = 1) -> str:
    terms = []
    weights = sequence.gauss_weights(sigma, order)
    for k, w in zip(range(-(len(weights) // 2), len(weights)), weights, strict=False):
        v = f"lag({c}, {-k}) OVER w" if k < 0 else f"lead({c}, {k}) OVER w"
        terms.append(f"({w!r}) * coalesce({v}, {'first_value' if k < 0 else 'last_value'}({c}) OVER z)")
    return " + ".join(terms)


_FILTER = "WINDOW w AS (PARTITION BY t ORDER BY f), z AS (PARTITION BY t ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query("tracks_dense", f"SELECT t, f, round({_gauss_sql('x')}, 6) AS dx FROM tracks_dense {_FILTER}")
def gauss_derivative(d):
    return sequence.gauss_filtered(d, {"dx": ("x", 0.65, 1)}).select("t", "f", "dx")


@query("tracks_dense", "SELECT t, f, round(sum(coalesce((f - lf) * (x + lx) / 2, 0)) OVER (PARTITION BY t ORDER BY f), 6) AS area FROM (SELECT *, lag(f) OVER w AS lf, lag(x) OVER w AS lx FROM tracks_dense WINDOW w AS (PARTITION BY t ORDER BY f))")
def cumulative_trapezoid(d):
    return sequence.cumulative_trapezoid(d, "x", "f", "t").select("t", "f", "area")


@query(
    "tracks_dense",
    "r AS (SELECT t, row_number() OVER u AS i, row_number() OVER d AS j, count(*) OVER (PARTITION BY t) AS n, avg(x) OVER u AS head, avg(x) OVER d AS tail FROM tracks_dense WINDOW u AS (PARTITION BY t ORDER BY f), d AS (PARTITION BY t ORDER BY f DESC)) "
    "SELECT a.t, a.n - a.i AS lag, round(a.head, 6) AS head, round(b.tail, 6) AS tail FROM r a JOIN r b ON a.t = b.t AND a.i = b.j",
)
def limited_mean(d):
    return sequence.limited_means(d, "x")


@query(
    "tracks_dense",
    "r AS (SELECT t, f, max(x) OVER (PARTITION BY t ORDER BY f) AS top, min(x) OVER (PARTITION BY t ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM tracks_dense) SELECT t, min(CASE WHEN top = low THEN f END) AS start FROM r GROUP BY t",
)
def running_extrema(d):
    return sequence.running_extrema_start(d, "x", "t", "f")


@query("dots", "c AS (SELECT f, count(*) AS n FROM dots GROUP BY f), r AS (SELECT f, n, lag(n) OVER (ORDER BY f) AS a, lead(n) OVER (ORDER BY f) AS b FROM c) SELECT 0 AS g, f, n, CASE WHEN n > a AND n > b THEN 'max' ELSE 'min' END AS kind FROM r WHERE (n > a AND n > b) OR (n < a AND n < b)")
def peaks(d):
    return sequence.peaks(d.groupBy("f").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("g"), "f", "n"), "f", "n", ["g"])


@query("tracks_gappy", f"{_ONE}, r AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS a, first_value(x IGNORE NULLS) OVER n AS b, last_value(CASE WHEN x IS NOT NULL THEN f END IGNORE NULLS) OVER p AS fa, first_value(CASE WHEN x IS NOT NULL THEN f END IGNORE NULLS) OVER n AS fb FROM dn WINDOW p AS (PARTITION BY t ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY t ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT t, f, round(CASE WHEN x IS NOT NULL THEN x WHEN fb - fa - 1 <= 5 THEN a + (b - a) * (f - fa) / nullif(fb - fa, 0) END, 6) AS x FROM r")
def repaired(d):
    return sequence.repair(_single(d), ["x"], 5).select("t", "f", "x")


@query("tracks_dense", f"SELECT t, f, round({_gauss_sql('x', 1.5, 0)}, 6) AS x FROM tracks_dense {_FILTER}")
def gauss_smooth(d):
    return sequence.gauss_filtered(d, {"x": ("x", 1.5, 0)}).select("t", "f", "x")


@query("tracks_dense", "SELECT t, max(f) OVER (PARTITION BY t) - f AS f, id FROM tracks_dense")
def time_reversal(d):
    return sequence.rezero(d, "t", backwards=True).select("t", "f", "id")


@query("tracks_gappy", "SELECT t, f - min(f) OVER (PARTITION BY t) AS f, id FROM tracks_gappy")
def frame_rezero(d):
    return sequence.rezero(d, "t").select("t", "f", "id")


@query("tracks_dense", "r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f) AS i, f * 0.1 AS s FROM tracks_dense) SELECT a.t, a.f, round(sum(exp(-(((b.i - a.i) / CASE WHEN a.s = 0 THEN 1 ELSE a.s END) ** 2)) * b.x) / sum(exp(-(((b.i - a.i) / CASE WHEN a.s = 0 THEN 1 ELSE a.s END) ** 2))), 6) AS x FROM r a JOIN r b ON a.t = b.t AND abs(b.i - a.i) <= round_even(2 * a.s, 0) GROUP BY a.t, a.f")
def variable_smooth(d):
    return sequence.variable_smooth(d, "x", F.col("f") * 0.1).select("t", "f", "x")


@query("tracks_dense", "SELECT t, f, round(x - first_value(x) OVER w, 6) AS dx, round(y - first_value(y) OVER w, 6) AS dy FROM tracks_dense WINDOW w AS (PARTITION BY t ORDER BY f)")
def displaced(d):
    return sequence.displaced(d).select("t", "f", "dx", "dy")


@query(
    "tracks_dense",
    "r AS (SELECT t % 3 AS dataset, t, f, sqrt((x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2) AS d, sqrt(coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w) ** 2 + coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w) ** 2) AS st FROM tracks_dense WINDOW w AS (PARTITION BY t ORDER BY f)), "
    "g AS (SELECT dataset, f, avg(d) * avg(st) AS s, count(DISTINCT t) AS n FROM r GROUP BY 1, 2), m AS (SELECT dataset, count(DISTINCT t) AS m FROM r GROUP BY 1), k AS (SELECT g.dataset, f, s FROM g JOIN m USING (dataset) WHERE n = m), "
    "x AS (SELECT dataset, f, max(s) OVER (PARTITION BY dataset ORDER BY f) AS top, min(s) OVER (PARTITION BY dataset ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM k) "
    "SELECT dataset, min(CASE WHEN top = low AND f >= 1 THEN f END) - 1 AS start FROM x GROUP BY dataset",
)
def motion_onset(d):
    return sequence.motion_onset(d.withColumn("dataset", F.col("t") % 3), (1, None))


@query("tracks_dense", "s AS (SELECT t, coalesce(x >= lag(x) OVER (PARTITION BY t ORDER BY f), true) AS ok FROM tracks_dense WHERE f < 3) SELECT t, bool_and(ok) AS sorted FROM s GROUP BY t")
def is_sorted(d):
    return sequence.is_sorted(d.where("f < 3"), "x", "t", "f")


@query("tracks_dense", "SELECT t, f, id FROM tracks_dense WHERE (f - (SELECT min(f) FROM tracks_dense)) % 4 = 0 AND f <= 60")
def frame_stepping(d):
    return sequence.every_kth(sequence.truncated(d, 61), 4).select("t", "f", "id")


@query(
    "tracks_dense",
    "r AS (SELECT t, f, x, max(x) OVER b AS xb, max(x) OVER a AS xa, min(x) OVER b AS nb, min(x) OVER a AS na, count(x) OVER b AS cb, count(x) OVER a AS ca FROM tracks_dense WINDOW b AS (PARTITION BY t ORDER BY f ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY t ORDER BY f ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) "
    "SELECT t, f, round(x, 6) AS x, CASE WHEN x > xb THEN 'max' ELSE 'min' END AS kind FROM r WHERE cb = 2 AND ca = 2 AND ((x > xb AND x > xa AND x - nb >= 10 AND x - na >= 10) OR (x < nb AND x < na AND xb - x >= 10 AND xa - x >= 10))",
)
def peaks_lookahead(d):
    return sequence.peaks(d.select("t", "f", "x"), "f", "x", ["t"], 2, 10.0)


# -- lags


@query("tracks_dense", f"{_MSD} SELECT t, tau, round(msd, 6) AS msd FROM m")
def msd(d):
    return lag.msd(d)


@query("tracks_dense", f"{_MSD.replace('AS msd', 'AS c')} {_ENSEMBLE}")
def msd_ensemble(d):
    return lag.msd_ensemble(d)


@query("tracks_dense", f"{_PAIRS} SELECT t, tau, round(avg((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS msd FROM p WHERE tau IN (1, 2, 4, 8, 16) AND (f - 1) % 3 = 0 GROUP BY ALL")
def msd_strided(d):
    return lag.msd(d, lags=[1, 2, 4, 8, 16], start_step=3)


@query("tracks_dense", f"{_PAIRS} SELECT t, tau, round(avg(((x2 - x1) * cos(o1) + (y2 - y1) * sin(o1)) ** 2), 6) AS prog, round(avg(((y2 - y1) * cos(o1) - (x2 - x1) * sin(o1)) ** 2), 6) AS div FROM p GROUP BY ALL")
def msd_body(d):
    return lag.msd_body(d)


@query("tracks_dense", f"{_PAIRS} SELECT t, tau, round(avg((o2 - o1) ** 2), 6) AS msd FROM p GROUP BY ALL")
def angular_msd(d):
    return lag.angular_msd(d)


@query("tracks_dense", f"{_PAIRS}, c AS (SELECT t, tau, avg(x2 * x1) - avg(x2) * avg(x1) AS c FROM p GROUP BY ALL) SELECT a.t, a.tau, round(a.c / nullif(b.c, 0), 6) AS c FROM c a JOIN c b ON a.t = b.t AND b.tau = 0")
def autocorr(d):
    return lag.autocorr(d, "x")


@query("tracks_dense", f"{_BOTH} SELECT t, tau, round(avg((x2 - x1) * y1), 6) AS c FROM p GROUP BY ALL")
def crosscorr(d):
    return lag.crosscorr(d, "x", "y", "init")


@query("tracks_dense", f"{_PAIRS}, m AS (SELECT t, tau, avg(cos(o2 - o1)) AS c FROM p GROUP BY ALL) {_ENSEMBLE}")
def nn_corr(d):
    return lag.nn_corr(d)


@query("tracks_dense", f"{_BOTH}, m AS (SELECT t, tau, avg((x2 - x1) * cos(o1) + (y2 - y1) * sin(o1)) AS c FROM p GROUP BY ALL) {_ENSEMBLE}")
def rn_corr(d):
    return lag.rn_corr(d)


_CROSS = f"{_BOTH}, c AS (SELECT tau, avg(x2 * y1) AS c FROM p GROUP BY tau), s AS (SELECT a.tau AS x, (a.c + b.c) / 2 AS even, (a.c - b.c) / 2 AS odd FROM c a JOIN c b ON a.tau = -b.tau), g AS (SELECT *, abs(even) / nullif(abs(even) + abs(odd), 0) AS even_degree FROM s)"


def _cross(d: DataFrame) -> DataFrame:
    return lag.lag_pairs(d, ["x", "y"], two_sided=True).groupBy("tau").agg(F.avg(F.col("x2") * F.col("y1")).alias("c"))


@query("tracks_dense", f"{_CROSS} SELECT x, round(even, 6) AS even, round(odd, 6) AS odd, round(even_degree, 6) AS even_degree FROM g")
def sym_antisym(d):
    return lag.symmetry(_cross(d), "tau", "c")


@query("tracks_dense", f"{_CROSS} SELECT round(avg(even_degree), 6) AS even, round(1 - avg(even_degree), 6) AS odd FROM g WHERE x >= 0")
def symmetry_degree(d):
    return lag.symmetry_degree(_cross(d), "tau", "c")


_SCALE = (
    f"{_PAIRS}, c AS (SELECT t, tau AS x, greatest(avg(cos(o2 - o1)), 0) AS y FROM p GROUP BY ALL), "
    "s AS (SELECT *, lead(x) OVER w - x AS h, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(y) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY t ORDER BY x)) "
)


def _decay(d: DataFrame, method: str) -> DataFrame:
    c = lag.orientation_means(d).select("t", "tau", F.col("cc").alias("c"))
    return lag.decay_scale(c, "tau", "c", ["t"], method)


@query("tracks_dense", f"{_SCALE} SELECT t, round(sum(h * (x * y + nx * ny) / 2) / nullif(sum(h * (y + ny) / 2), 0), 6) AS scale FROM s GROUP BY t")
def decay_scale(d):
    return _decay(d, "mean")


@query("tracks_dense", f"{_SCALE} SELECT t, round(sum(h * (y + ny) / 2) / nullif(max(y0), 0), 6) AS scale FROM s GROUP BY t")
def decay_scale_integral(d):
    return _decay(d, "integrate")


@query("tracks_dense", f"{_SCALE} SELECT t, round(sum(h * (y + ny) / 2) / nullif(sum(h * (y / (x + 1) + ny / (nx + 1)) / 2), 0), 6) AS scale FROM s GROUP BY t")
def decay_scale_inverse(d):
    return _decay(d, "inverse")


@query("tracks_dense", f"{_SCALE} SELECT t, round(min(CASE WHEN y > y0 * exp(-1) AND ny <= y0 * exp(-1) THEN x + (nx - x) * (y - y0 * exp(-1)) / (y - ny) END), 6) AS scale FROM s GROUP BY t")
def decay_scale_threshold(d):
    return _decay(d, "threshold")


@query("tracks_dense", f"{_MSD}, e AS (SELECT tau, avg(msd) AS y FROM m WHERE tau > 0 GROUP BY tau HAVING avg(msd) > 0) SELECT 0 AS g, (tau + ntau) / 2 AS mid, round((ln(ny) - ln(y)) / (ln(ntau) - ln(tau)), 6) AS slope FROM (SELECT *, lead(tau) OVER (ORDER BY tau) AS ntau, lead(y) OVER (ORDER BY tau) AS ny FROM e) WHERE ntau IS NOT NULL")
def log_slope(d):
    e = lag.msd(d).groupBy("tau").agg(F.avg("msd").alias("y")).select(F.lit(0).alias("g"), F.col("tau").cast("double").alias("tau"), "y")
    return sequence.log_slope(e, "tau", "y", ["g"])


@query("tracks_dense", f"{_MSD} SELECT t, round(sum(msd / tau / tau) / sum(1.0 / tau) / 4, 6) AS d FROM m WHERE tau BETWEEN 1 AND 10 GROUP BY t")
def diffusion_from_msd(d):
    return noise.diffusion_from_msd(lag.msd(d, 10), 1, 10, ["t"])


@query("tracks_dense", f"{_PAIRS} SELECT t, tau, round(avg((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS msd FROM p WHERE tau IN (SELECT CAST(round_even(2 * 1.5 ** k, 0) AS INTEGER) FROM (SELECT unnest(range(50)) AS k)) GROUP BY ALL")
def msd_geometric(d):
    frames = d.agg(F.max("f")).first()[0]
    return lag.msd(d, lags=lag.tau_grid(frames, 1.5, 2))


@query(
    "tracks_dense",
    f"{_PAIRS}, b AS (SELECT t, tau, avg(((x2 - x1) * cos(o1) + (y2 - y1) * sin(o1)) ** 2) AS prog, avg(((y2 - y1) * cos(o1) - (x2 - x1) * sin(o1)) ** 2) AS div FROM p GROUP BY ALL), "
    "g AS (SELECT tau, avg(prog) AS prog, stddev_samp(prog) / sqrt(count(*)) AS pe, avg(div) AS div, stddev_samp(div) / sqrt(count(*)) AS de, count(*) AS n FROM b GROUP BY tau HAVING count(*) >= 3) "
    "SELECT tau, round(prog + div, 6) AS total, round(sqrt(pe * pe + de * de), 6) AS total_err, round(prog, 6) AS prog, round(pe, 6) AS prog_err, round(div, 6) AS div, round(de, 6) AS div_err, n FROM g",
)
def rr_stack(d):
    return lag.rr_stack(d)


@query("tracks_dense", f"{_PAIRS}, b AS (SELECT t, tau, avg(cos(o1) * cos(o2)) AS c, avg(sin(o1) * sin(o2)) AS s FROM p GROUP BY ALL), m AS (SELECT tau, unnest([c, s]) AS c FROM b) {_ENSEMBLE}")
def nn_components(d):
    return lag.nn_corr(d, dot=False)


@query("tracks_dense", f"{_MSD}, k AS (SELECT *, min_by(tau, msd / tau) OVER (PARTITION BY t) AS least FROM m WHERE tau >= 1) SELECT t, round(sum(msd / tau / tau) / sum(1.0 / tau) / 4, 6) AS d FROM k WHERE tau BETWEEN 1 AND least GROUP BY t")
def diffusion_to_minimum(d):
    return noise.diffusion_from_msd(lag.msd(d), 1, "min", ["t"])


@query("tracks_dense", f"{_MSD} SELECT t, round(exp(regr_intercept(ln(msd), ln(tau))), 6) AS d, round(regr_slope(ln(msd), ln(tau)), 6) AS b FROM m WHERE tau BETWEEN 1 AND 10 AND msd > 0 GROUP BY t")
def power_law(d):
    return noise.power_law(lag.msd(d, 10), 1, 10, ["t"])


@query("tracks_dense", "g AS (SELECT t % 9 AS k, t % 2 AS half, avg(x) AS d, stddev_samp(x) / sqrt(count(x)) AS e FROM tracks_dense GROUP BY 1, 2) SELECT a.k, round(a.d / b.d, 6) AS ratio, round(abs(a.d / b.d) * sqrt((a.e / a.d) ** 2 + (b.e / b.d) ** 2), 6) AS stderr FROM g a JOIN g b ON a.k = b.k AND a.half = 0 AND b.half = 1")
def ratio_with_error(d):
    g = groups.moments(d.select((F.col("t") % 9).alias("k"), (F.col("t") % 2).alias("half"), "x"), "x", ["k", "half"]).withColumnRenamed("mean", "d")
    return noise.ratio_with_error(g.where("half = 0"), g.where("half = 1"), ["k"])


@query(
    "points",
    "g AS (SELECT f, avg(cos(4 * o)) AS re, avg(sin(4 * o)) AS im FROM points GROUP BY f), s AS (SELECT 0 AS t, f, sqrt(re * re + im * im) AS phi FROM g), p AS (SELECT b.f - a.f AS tau, avg(a.phi * b.phi) - avg(a.phi) * avg(b.phi) AS c FROM s a JOIN s b ON b.f >= a.f GROUP BY 1) "
    "SELECT a.tau, round(a.c / nullif(b.c, 0), 4) AS c FROM p a JOIN p b ON b.tau = 0",
    digits=4,
)
def order_series(d):
    s = spatial.phi_global(d).select(F.lit(0).alias("t"), F.col("f").cast("int").alias("f"), "phi")
    return lag.autocorr(s, "phi").select("tau", "c")


_VELOCITY = (
    f"v0 AS (SELECT t, f, o AS a, {_gauss_sql('o')} AS vo, {_gauss_sql('x')} AS vx, {_gauss_sql('y')} AS vy FROM tracks_dense {_FILTER}), "
    "v1 AS (SELECT *, vx * cos(a) + vy * sin(a) AS par, vx * sin(a) - vy * cos(a) AS perp FROM v0), v2 AS (SELECT *, avg(par) OVER (PARTITION BY t) AS m FROM v1), "
    "v AS (SELECT t, f, vo AS o, sqrt(vx * vx + vy * vy) AS v, vx AS x, vy AS y, par, perp, vx - m * cos(a) AS etax, vy - m * sin(a) AS etay, par - m AS etapar FROM v2)"
)


@query("tracks_dense", f"{_VELOCITY} SELECT t, f, round(sqrt(etax ** 2 + etay ** 2), 6) AS eta, {', '.join(f'round({c}, 6) AS {c}' for c in 'o v x y par perp etax etay etapar'.split())} FROM v")
def noise_velocity(d):
    return noise.velocities(d)


@query("tracks_dense", f"{_VELOCITY}, l AS (SELECT 'o' AS component, o AS value FROM v UNION ALL SELECT 'perp', perp FROM v UNION ALL SELECT 'par', par FROM v) SELECT component, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value) * sqrt(3) * 0.65, 6) AS d FROM l GROUP BY component")
def diffusion_from_velocity(d):
    return noise.diffusion_from_velocity(noise.velocities(d))


_FIELDS = ", ".join(f"avg(a.{c} * b.{c}) - avg(b.{c}) * avg(a.{c}) AS {c}" for c in noise.FIELDS)


@query(
    "tracks_dense",
    f"{_VELOCITY.replace('etapar FROM v2', 'etapar, sqrt((vx - m * cos(a)) ** 2 + (vy - m * sin(a)) ** 2) AS eta FROM v2')}, c AS (SELECT a.t, b.f - a.f AS tau, {_FIELDS} FROM v a JOIN v b ON a.t = b.t AND b.f >= a.f GROUP BY ALL), "
    f"l AS (UNPIVOT c ON {', '.join(noise.FIELDS)} INTO NAME field VALUE c), k AS (SELECT * FROM l QUALIFY count(*) OVER (PARTITION BY field, tau) >= 3), w AS (SELECT *, sqrt(count(*) OVER (PARTITION BY field, t)) AS w FROM k), "
    "g AS (SELECT field, tau, sum(w) AS sw, sum(w * c) AS wx, sum(w * c * c) AS wxx, count(*) AS n FROM w GROUP BY field, tau) "
    "SELECT field, tau, round(wx / sw, 4) AS mean, round(sqrt(greatest(wxx / sw - (wx / sw) ** 2, 0)) / sqrt(n), 4) AS stderr, n FROM g",
    digits=4,
)
def vv_corr(d):
    return noise.vv_corr(d)


@query(
    "tracks_dense",
    f"{_VELOCITY}, l AS (SELECT 'o' AS component, o AS value FROM v UNION ALL SELECT 'perp', perp FROM v UNION ALL SELECT 'par', par FROM v), a AS (SELECT *, avg(value) OVER (PARTITION BY component) AS mu FROM l), "
    "m AS (SELECT component, count(value)::DOUBLE AS n, avg(value) AS mean, var_samp(value) AS v, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM a GROUP BY component), "
    "k AS (SELECT *, m3 / m2 ** 1.5 AS skew, m4 / m2 ** 2 - 3 AS kurtosis FROM m), y AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2, 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)) AS vk, "
    "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM k), "
    "z AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, (kurtosis + 3 - 3 * (n - 1) / (n + 1)) / sqrt(vk) AS xk, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS ak FROM y), q AS (SELECT *, sqrt(2 / (w2 - 1)) AS al, (1 - 2 / ak) / (1 + xk * sqrt(2 / (ak - 4))) AS cube FROM z) "
    "SELECT component, CAST(n AS BIGINT) AS n, round(mean, 4) AS mean, round(v * sqrt(3) * 0.65, 4) AS d, round(sqrt(v / n), 4) AS stderr, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round(1 / sqrt(0.5 * ln(w2)) * ln(y / al + sqrt((y / al) ** 2 + 1)), 4) AS skew_z, round((1 - 2 / (9 * ak) - sign(cube) * abs(cube) ** (1 / 3.0)) / sqrt(2 / (9 * ak)), 4) AS kurtosis_z FROM q",
    digits=4,
)
def velocity_stats(d):
    return noise.velocity_stats(noise.velocities(d))


def _widths_sql(widths: tuple[float, ...]) -> str:
    tables, parts = [], []
    for k, w in enumerate(widths):
        tables.append(f"w{k} AS (SELECT o AS a, {_gauss_sql('o', w)} AS vo, {_gauss_sql('x', w)} AS vx, {_gauss_sql('y', w)} AS vy FROM tracks_dense {_FILTER})")
        long = f"SELECT 'o' AS component, vo AS value FROM w{k} UNION ALL SELECT 'perp', vx * sin(a) - vy * cos(a) FROM w{k} UNION ALL SELECT 'par', vx * cos(a) + vy * sin(a) FROM w{k}"
        parts.append(f"SELECT {w}::DOUBLE AS width, component, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value) * sqrt(3) * {w}, 6) AS d FROM ({long}) GROUP BY component")
    return f"{', '.join(tables)} {' UNION ALL '.join(parts)}"


@query("tracks_dense", _widths_sql((0.65, 1.3)))
def velocity_widths(d):
    return noise.velocity_widths(d, [0.65, 1.3])


@query("points", f"{_NEIGHBOURS}, v AS (SELECT f, id, o, sqrt(x * x + y * y) AS v, x, y FROM points), j AS (SELECT q.d, a.o * b.o AS o, a.v * b.v AS v, a.x * b.x + a.y * b.y AS xy FROM q JOIN v a ON a.f = q.f AND a.id = q.id1 JOIN v b ON b.f = q.f AND b.id = q.id2 WHERE q.id1 < q.id2 AND q.d / 0.5 <= 0.8) SELECT least(CAST(floor(d / 0.5 / 0.1) AS INTEGER), 7) AS bin, count(*) AS n, round(avg(o), 6) AS o, round(avg(v), 6) AS v, round(avg(v), 6) AS eta, round(avg(xy), 6) AS xy FROM j GROUP BY 1")
def radial_vv(d):
    v = F.hypot("x", "y")
    return noise.radial_vv(d.withColumns({"v": v, "eta": v, "vx": F.col("x"), "vy": F.col("y")}), 8, 0.8, 0.5)


# -- space


@query("points", f"{_NEIGHBOURS} SELECT f, id1, id2, round(d, 6) AS d FROM q WHERE id1 < id2")
def pairs(d):
    return spatial.pairs(d).select("f", "id1", "id2", "d")


@query("points", f"{_KNN} SELECT f, id1, id2, CAST(rank AS INTEGER) AS rank, round(d, 6) AS d FROM k")
def knn(d):
    return spatial.knn(d, 4).select("f", "id1", "id2", "rank", "d")


@query("points", f"{_NEIGHBOURS} SELECT f, id1, id2, round(d, 6) AS d FROM q WHERE d < 0.08")
def ball_neighbors(d):
    return spatial.close_pairs(d, 0.08).select("f", "id1", "id2", "d")


@query("points", f"{_KNN}, l AS (SELECT *, 1.1 * avg(d) OVER (PARTITION BY f, id1) AS lim FROM k) SELECT f, id1, id2, round(d, 6) AS d FROM l WHERE d <= lim")
def knn_adaptive(d):
    return spatial.adaptive_neighbours(d, 4, 1.1).select("f", "id1", "id2", "d")


_MOD = lambda x: f"((({x}) % (2 * pi()) + 2 * pi()) % (2 * pi()))"


@query("points", f"{_KNN}, a AS (SELECT *, {_MOD('atan2(y2 - y1, x2 - x1)')} AS angle FROM k) SELECT f, id1, id2, round(angle, 6) AS angle, round({_MOD('angle - first_value(angle) OVER (PARTITION BY f, id1 ORDER BY d, id2)')}, 6) AS relative FROM a")
def pair_angles(d):
    return spatial.bond_angles(spatial.knn(d, 4)).select("f", "id1", "id2", "angle", "relative")


@query("points", f"{_BOND} SELECT f, id, round(sqrt(re * re + im * im), 6) AS psi FROM s")
def psi_local(d):
    return spatial.psi_local(spatial.knn(d, 4))


@query("points", f"{_BOND}, g AS (SELECT f, avg(re) AS re, avg(im) AS im FROM s GROUP BY f) SELECT f, round(sqrt(re * re + im * im), 6) AS psi, round(atan2(im, re) / 4, 6) AS phase FROM g")
def psi_global(d):
    return spatial.psi_global(spatial.knn(d, 4))


@query("points", "g AS (SELECT f, avg(cos(4 * o)) AS re, avg(sin(4 * o)) AS im, count(o) AS n FROM points GROUP BY f) SELECT f, round(sqrt(re * re + im * im), 6) AS phi, round(atan2(im, re) / 4, 6) AS phase, round(sqrt(greatest(1 - re * re - im * im, 0) / n), 6) AS stderr FROM g")
def phi_global(d):
    return spatial.phi_global(d)


@query("points", f"{_KNN} SELECT f, id1 AS id, round(1 / avg(d) ** 2, 6) AS dens FROM k GROUP BY ALL")
def density_dist(d):
    return spatial.density(spatial.knn(d, 4), "dist")


@query("points", f"{_KNN} SELECT f, id1 AS id, round(avg(1 / d) ** 2, 4) AS dens FROM k GROUP BY ALL", digits=4)
def density_inv(d):
    return spatial.density(spatial.knn(d, 4), "inv")


_CENTRED = "c AS (SELECT *, sqrt((x - mx) ** 2 + (y - my) ** 2) AS d0 FROM (SELECT *, (min(x) OVER w + max(x) OVER w) / 2 AS mx, (min(y) OVER w + max(y) OVER w) / 2 AS my FROM points WINDOW w AS (PARTITION BY f)))"


@query("points", f"{_CENTRED} SELECT f, id, round(greatest(least(0.5 - (d0 - (max(d0) OVER (PARTITION BY f) + 0.025 - 0.1)) / 0.05, 1), 0), 6) AS weight FROM c")
def bulk_weight(d):
    return spatial.bulk_weight(d, 0.1, 0.05)


@query(
    "points",
    f"{_CENTRED}, q AS (SELECT a.f, a.d0 AS d1, b.d0 AS d2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM c a JOIN c b ON a.f = b.f AND a.id < b.id), r AS (SELECT f, greatest((SELECT max(d) / 2 FROM q WHERE q.f = c.f), max(d0)) + 0.025 AS rs FROM c GROUP BY f), "
    "i AS (SELECT f, count(*) AS n FROM c JOIN r USING (f) WHERE d0 <= rs - 0.05 GROUP BY f), "
    "w AS (SELECT f, least(CAST(floor(d / 0.02) AS INTEGER), 19) AS bin, n, CASE WHEN d1 <= rs - 0.05 THEN 1 / (2 * acos(coalesce(greatest(-1, (d * d + d1 * d1 - rs * rs) / nullif(2 * d * d1, 0)), -1)) * d * 0.02) ELSE 0 END + CASE WHEN d2 <= rs - 0.05 THEN 1 / (2 * acos(coalesce(greatest(-1, (d * d + d2 * d2 - rs * rs) / nullif(2 * d * d2, 0)), -1)) * d * 0.02) ELSE 0 END AS w "
    "FROM q JOIN r USING (f) JOIN i USING (f) WHERE d > 0 AND d <= 0.4) SELECT f, bin, round(sum(w / n), 4) AS g FROM w GROUP BY f, bin",
    digits=4,
)
def g_r(d):
    return spatial.pair_distribution(d, 20, 0.4, 0.05, 0.05)


@query("points", f"{_NEIGHBOURS} SELECT least(CAST(floor((x2 - x1 + 0.4) / 0.08) AS INTEGER), 9) AS i, least(CAST(floor((y2 - y1 + 0.4) / 0.08) AS INTEGER), 9) AS j, count(*) AS n FROM q WHERE x2 - x1 BETWEEN -0.4 AND 0.4 AND y2 - y1 BETWEEN -0.4 AND 0.4 GROUP BY 1, 2")
def g_xy(d):
    return spatial.displacement_histogram(d, 10, 0.4)


@query("points", f"{_NEIGHBOURS} SELECT least(CAST(floor(d / 0.05) AS INTEGER), 9) AS bin, count(*) AS n, round(avg(cos(4 * (o1 - o2))), 6) AS c FROM q WHERE id1 < id2 AND d <= 0.5 GROUP BY 1")
def g_orient(d):
    return spatial.orientation_correlation(d, 10, 0.5)


@query("points", f"{_NEIGHBOURS} SELECT least(CAST(floor(d / 0.05) AS INTEGER), 9) AS bin, count(*) AS n, round(avg(o1 * o2), 6) AS c FROM q WHERE id1 < id2 AND d <= 0.5 GROUP BY 1")
def radial_corr(d):
    return spatial.radial_correlation(d, lambda a, b: a["o"] * b["o"], ["o"], 10, 0.5)


@query("points", f"{_BOND}, z AS (SELECT p.f, p.x, p.y, p.id, re, im FROM points p JOIN s USING (f, id)), h AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.re * b.re + a.im * b.im AS v FROM z a JOIN z b ON a.f = b.f AND a.id < b.id) SELECT least(CAST(floor(d / 0.05) AS INTEGER), 9) AS bin, count(*) AS n, round(avg(v), 6) AS c FROM h WHERE d <= 0.5 GROUP BY 1")
def bond_correlation(d):
    return spatial.bond_correlation(spatial.knn(d, 4), d, 10, 0.5)


@query(
    "points",
    f"{_NEIGHBOURS}, u AS (SELECT f, id1 AS id, o2 AS o FROM q WHERE d < 0.1 UNION ALL SELECT f, id, o FROM points), g AS (SELECT f, id, avg(cos(4 * o)) AS a, avg(sin(4 * o)) AS b FROM u GROUP BY ALL), h AS (SELECT f, a * a - b * b AS p, 2 * a * b AS q FROM g), "
    "s AS (SELECT f, avg(p * p - q * q) AS u, avg(2 * p * q) AS v, 3 * (avg(p) ** 2 - avg(q) ** 2) AS c, 6 * avg(p) * avg(q) AS d FROM h GROUP BY f) SELECT f, round(1 - (u * c + v * d) / (c * c + d * d), 4) AS re, round(-(v * c - u * d) / (c * c + d * d), 4) AS im FROM s",
    digits=4,
)
def binder(d):
    return spatial.binder(d, 0.1)


@query("points", f"{_NEIGHBOURS}, k AS (SELECT *, row_number() OVER (PARTITION BY f, id1 ORDER BY d, id2) AS rank FROM q QUALIFY rank <= 4), l AS (SELECT *, 1.8 * min(d) OVER (PARTITION BY f, id1) ** 2 AS lim FROM k), n AS (SELECT * FROM l WHERE d * d < lim) SELECT f, id1, id2, round(d, 6) AS d FROM n QUALIFY count(*) OVER (PARTITION BY f, id1) >= 2")
def close_ratio(d):
    return spatial.close_ratio_neighbours(d).select("f", "id1", "id2", "d")


@query("points", f"{_KNN}, l AS (SELECT *, 1.1 * median(d) OVER (PARTITION BY f, id1) AS lim FROM k), n AS (SELECT * FROM l WHERE d <= lim) SELECT f, id1, id2, round(d, 6) AS d FROM n QUALIFY count(*) OVER (PARTITION BY f, id1) >= 3")
def knn_median(d):
    return spatial.adaptive_neighbours(d, 4, 1.1, "median", 3).select("f", "id1", "id2", "d")


@query("points", f"{_KNN}, a AS (SELECT *, {_MOD('atan2(y2 - y1, x2 - x1)')} AS angle FROM k) SELECT f, id1 AS id, round(coalesce(lead(angle) OVER (PARTITION BY f, id1 ORDER BY angle, id2), min(angle) OVER (PARTITION BY f, id1) + 2 * pi()) - angle, 6) AS gap FROM a QUALIFY count(*) OVER (PARTITION BY f, id1) = 4")
def angle_gaps(d):
    return spatial.angle_gaps(spatial.knn(d, 4), 4)


_INSIDE = f"{_CENTRED}, ins AS (SELECT * FROM c QUALIFY d0 < max(d0) OVER (PARTITION BY f) - 0.1)"


@query("points", f"{_INSIDE}, q AS (SELECT a.f, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.o AS o1, b.o AS o2 FROM ins a JOIN ins b ON a.f = b.f AND a.id < b.id) SELECT least(CAST(floor(d / 0.05) AS INTEGER), 9) AS bin, count(*) AS n, round(avg(cos(4 * (o1 - o2))), 6) AS c FROM q WHERE d <= 0.5 GROUP BY 1")
def g_orient_margin(d):
    return spatial.orientation_correlation(d, 10, 0.5, margin=0.1)


@query("points", f"{_INSIDE}, g AS (SELECT f, avg(cos(4 * o)) AS re, avg(sin(4 * o)) AS im, count(o) AS n FROM ins GROUP BY f) SELECT f, round(sqrt(re * re + im * im), 6) AS phi, round(atan2(im, re) / 4, 6) AS phase, round(sqrt(greatest(1 - re * re - im * im, 0) / n), 6) AS stderr FROM g")
def phi_margin(d):
    return spatial.phi_global(d, margin=0.1)


@query("points", f"{_CENTRED}, m AS (SELECT f, id, greatest(least(0.5 - (d0 - (0.45 - 0.1)) / 0.05, 1), 0) AS w FROM c) SELECT f, round(sum(w) * 60 / count(*), 6) AS n FROM m GROUP BY f")
def bulk_count(d):
    return spatial.bulk_count(d, 0.1, 0.05, 0.45, 60)


@query("points", f"{_CENTRED}, mg AS (SELECT unnest(range(0, 21)) / 100.0::DOUBLE AS margin), s AS (SELECT margin, sum(greatest(least(0.5 - (d0 - (0.45 - margin)) / 0.05, 1), 0)) AS n, count(DISTINCT f) AS frames FROM c, mg GROUP BY margin) SELECT round(min(n / (pi() * ((0.45 - margin) / 0.05) ** 2) / frames), 6) AS density FROM s")
def bulk_density(d):
    return spatial.bulk_density(d, [k / 100 for k in range(21)], 0.05, 0.45).agg(F.min("density").alias("density"))


@query("points", "SELECT a.f, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS d FROM points a JOIN points b ON a.f = b.f GROUP BY a.f")
def diameter(d):
    return spatial.diameter(d)


@query("points", f"{_KNN.replace('rank <= 4', 'rank <= 2')}, s AS (SELECT f, id1 AS id, avg(cos(4 * atan2(y2 - y1, x2 - x1))) AS re, avg(sin(4 * atan2(y2 - y1, x2 - x1))) AS im FROM k GROUP BY ALL), ax AS (SELECT f, atan2(avg(im), avg(re)) / 4 AS a FROM s GROUP BY f), z AS (SELECT p.f, id, a, x - avg(x) OVER (PARTITION BY p.f) AS x, y - avg(y) OVER (PARTITION BY p.f) AS y, o FROM points p JOIN ax USING (f)) SELECT f, id, round(x * cos(a) + y * sin(a), 6) AS x, round(y * cos(a) - x * sin(a), 6) AS y, round(o - a, 6) AS o FROM z")
def rectify(d):
    return spatial.rectify(d).select("f", "id", "x", "y", "o")


def _overlap_sql() -> str:
    h = 0.02 * 0.9
    tests = " OR ".join(f"abs((x2 - x1) * cos({o} + {k}) + (y2 - y1) * sin({o} + {k})) > {h!r} * (1 + abs(cos(o2 - o1)) + abs(sin(o2 - o1)))" for o in ("o1", "o2") for k in ("0", "pi() / 2"))
    return f"{_NEIGHBOURS} SELECT f, id1, id2 FROM q WHERE id1 < id2 AND NOT ({tests})"


@query("points", _overlap_sql())
def square_overlap(d):
    return spatial.square_overlaps(d, 0.02)


@query("points", "r AS (SELECT f, id, row_number() OVER (PARTITION BY f ORDER BY round((x - mx) ** 2 + (y - my) ** 2, 9), id) AS k FROM (SELECT *, avg(x) OVER (PARTITION BY f) AS mx, avg(y) OVER (PARTITION BY f) AS my FROM points)) SELECT f, id, CAST(ceil((sqrt(k) + 1) / 2) AS INTEGER) AS ring FROM r")
def ring_valency(d):
    return shells.ring_valency(d)


def _shell_sql(near: str) -> str:
    return (
        f"s AS (SELECT f, id1 AS id, avg(cos(4 * atan2(y2 - y1, x2 - x1))) AS re, avg(sin(4 * atan2(y2 - y1, x2 - x1))) AS im FROM {near} GROUP BY ALL), ax AS (SELECT f, atan2(avg(im), avg(re)) / 4 AS a FROM s GROUP BY f), "
        "uv AS (SELECT f, id, x * cos(a) + y * sin(a) AS u, y * cos(a) - x * sin(a) AS v FROM points JOIN ax USING (f)), "
        "sh AS (SELECT f, id, CAST(round_even(greatest(abs((u - avg(u) OVER w) / ((max(u) OVER w - min(u) OVER w) / 6)), abs((v - avg(v) OVER w) / ((max(v) OVER w - min(v) OVER w) / 6))), 0) AS INTEGER) AS sh FROM uv WINDOW w AS (PARTITION BY f))"
    )


_SHELL = f"{_KNN.replace('rank <= 4', 'rank <= 2')}, {_shell_sql('k')}"


@query("points", f"{_SHELL} SELECT f, id, sh FROM sh")
def shell_assign(d):
    return shells.assign_shells(d, 7)


@query("points", f"{_SHELL}, j AS (SELECT sh.f, sh, o FROM sh JOIN points USING (f, id)) SELECT f, sh, count(o) AS n, round(avg(o), 6) AS mean FROM j GROUP BY GROUPING SETS ((f, sh), (f))")
def shell_series(d):
    return shells.by_shell(shells.assign_shells(d, 7).join(d, ["f", "id"]), "o")


_MELT = (
    f"{_KNN}, k2 AS (SELECT * FROM k WHERE rank <= 2), {_shell_sql('k2')}, pt AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) - 1 AS t FROM points), "
    "f0 AS (SELECT pt.t, sh.sh FROM sh JOIN pt USING (f, id) WHERE f = (SELECT min(f) FROM points)), ts AS (SELECT pt.*, coalesce(f0.sh, -1) AS sh FROM pt LEFT JOIN f0 USING (t)), "
    "n0 AS (SELECT k.*, ts.sh FROM k JOIN ts ON ts.f = k.f AND ts.id = k.id1 WHERE rank <= 3 OR ts.sh <> 3), nb AS (SELECT * FROM n0 QUALIFY count(*) OVER (PARTITION BY f, id1) >= 2), "
    "st AS (SELECT f, id1 AS id, 1 / avg(d) ** 2 AS dens, sqrt(avg(cos(4 * atan2(y2 - y1, x2 - x1))) ** 2 + avg(sin(4 * atan2(y2 - y1, x2 - x1))) ** 2) AS psi, sqrt(avg(cos(4 * (o2 - o1))) ** 2 + avg(sin(4 * (o2 - o1))) ** 2) AS phi FROM nb GROUP BY ALL)"
)


def _numbered(d: DataFrame) -> DataFrame:
    return d.withColumn("t", (F.row_number().over(Window.partitionBy("f").orderBy("id")) - 1).cast("long"))


@query("points", f"{_MELT} SELECT f, id, t, sh, round(dens / max(dens) OVER (), 6) AS dens, round(psi, 6) AS psi, round(phi, 6) AS phi FROM ts LEFT JOIN st USING (f, id)")
def melt_stats(d):
    return shells.normalised(shells.melt_stats(_numbered(d), 7), "dens")


_CORNERS = (
    "m AS (SELECT a.f, a.id, b.id AS cid, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM points a JOIN points b ON a.f = b.f AND a.id % 2 = 0 AND b.id % 2 = 1), near AS (SELECT *, atan2(dy, dx) AS a FROM m WHERE abs(d - 0.1) < 0.05), "
    "pr AS (SELECT p.f, p.id, p.cid, q.cid AS cid2, round(abs(abs((((q.a - p.a + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi())) - pi()) - 1.5), 9) AS off FROM near p JOIN near q ON p.f = q.f AND p.id = q.id AND p.cid < q.cid)"
)
_CORNER_TAIL = (
    "lg AS (SELECT DISTINCT f, id, unnest([cid, cid2]) AS cid FROM kept), r AS (SELECT n.*, row_number() OVER (PARTITION BY f, id ORDER BY round(abs(d - 0.1), 9), cid) AS k FROM near n SEMI JOIN lg USING (f, id, cid)), g AS (SELECT f, id, "
    + _MOD("atan2(sum(dy / d), sum(dx / d))")
    + " AS orient FROM r WHERE k <= 2 GROUP BY f, id HAVING count(*) >= 2) SELECT p.f, p.id, round(orient, 6) AS orient FROM points p LEFT JOIN g ON g.f = p.f AND g.id = p.id WHERE p.id % 2 = 0"
)


@query("points", f"{_CORNERS}, kept AS (SELECT * FROM pr WHERE off < 0.3), {_CORNER_TAIL}")
def corner_angle(d):
    return orient.match_corners(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 0.1, 0.05, 2, 1.5, 0.3).select("f", "id", "orient")


@query("points", f"{_CORNERS}, kept AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY f, id ORDER BY off, cid, cid2) <= 1), {_CORNER_TAIL}")
def corner_best_angle(d):
    return orient.match_corners(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 0.1, 0.05, 2, 1.5).select("f", "id", "orient")


@query(
    "points",
    f"{_NEIGHBOURS}, m AS (SELECT f, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM points GROUP BY f), c AS (SELECT f, id, sqrt((x - mx) ** 2 + (y - my) ** 2) AS d0 FROM points JOIN m USING (f)), t AS (SELECT f, max(d0) AS top FROM c GROUP BY f), "
    "w AS (SELECT q.*, d0, top + 0.01 AS rad, greatest((d * d + d0 * d0 - (top + 0.01) ** 2) / (2 * d * d0), -1) AS cs FROM q JOIN c ON c.f = q.f AND c.id = q.id1 JOIN t ON t.f = q.f WHERE d < 0.3 AND d0 < top - 0.1) "
    "SELECT least(CAST(floor((x2 - x1 + 0.3) / 0.1) AS INTEGER), 5) AS i, least(CAST(floor((y2 - y1 + 0.3) / 0.1) AS INTEGER), 5) AS j, count(*) AS n, round(sum(CASE WHEN cs < 1 THEN (6 / rad) ** 2 * pi() / acos(cs) ELSE 0 END), 4) AS g FROM w GROUP BY 1, 2",
    4,
)
def g_xy_weighted(d):
    return spatial.weighted_displacements(d, 6, 0.3, 0.1, 0.02)


@query(
    "points",
    "SELECT f, id, CAST(k AS INTEGER) AS corner, round(x + 0.05 / sqrt(2) * 0.9 * cos(o - pi() / 4 * (2 * k + 1)), 6) AS x, round(y + 0.05 / sqrt(2) * 0.9 * sin(o - pi() / 4 * (2 * k + 1)), 6) AS y FROM points, (SELECT unnest(range(4)) AS k)",
)
def square_corners(d):
    return spatial.squares(d, 0.05)


# -- Voronoi cells

_BISECTED = (
    "pair AS (SELECT a.f, a.id AS i, b.id AS j, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM points a JOIN points b ON a.f = b.f AND a.id <> b.id), "
    # where the bisector of i and j, from its middle on, is nearer to k: c t <= r is what k leaves of it
    "part AS (SELECT p.f, p.i, p.j, p.d, (p.dx * (k.y - p.y) - p.dy * (k.x - p.x)) / p.d AS c, ((k.x - p.x) ** 2 + (k.y - p.y) ** 2 - p.dx * (k.x - p.x) - p.dy * (k.y - p.y)) / 2 AS r FROM pair p JOIN points k ON k.f = p.f AND k.id NOT IN (p.i, p.j)), "
    "edge AS (SELECT f, i, j, d, max(CASE WHEN c < 0 THEN r / c END) AS lo, min(CASE WHEN c > 0 THEN r / c END) AS hi FROM part GROUP BY ALL), "
    "kept AS (SELECT *, hi - lo AS size FROM edge WHERE lo IS NULL OR hi IS NULL OR hi - lo > 1e-9)"
)


@query("points", f"{_BISECTED} SELECT f, i AS id, CASE WHEN count(size) = count(*) THEN round(sum(size * d) / 4, 6) END AS area, count(*) AS n, min(j) AS first FROM kept GROUP BY f, i")
def voronoi_cells(d):
    return voronoi.voronoi(d).select("f", "id", "area", F.size("edges").cast("long").alias("n"), F.array_min("edges.id").alias("first"))


@query("points", f"{_BISECTED} SELECT f, i AS id1, j AS id2, round(d, 6) AS d, row_number() OVER (PARTITION BY f, i ORDER BY d, j) AS rank FROM kept")
def voronoi_neighbours(d):
    return voronoi.voronoi_neighbours(d).select("f", "id1", "id2", "d", "rank")


@query("points", f"{_BISECTED} SELECT f, i AS id, CASE WHEN count(size) = count(*) THEN round(4 / sum(size * d), 4) ELSE 0 END AS dens FROM kept GROUP BY f, i", 4)
def voronoi_density(d):
    return voronoi.voronoi_density(voronoi.voronoi(d))


@query(
    "points",
    f"{_BISECTED}, z AS (SELECT f, i AS id, avg(cos(6 * atan2(q.y - p.y, q.x - p.x))) AS re, avg(sin(6 * atan2(q.y - p.y, q.x - p.x))) AS im FROM kept JOIN points p USING (f) JOIN points q USING (f) WHERE p.id = i AND q.id = j GROUP BY f, i) SELECT f, id, round(sqrt(re * re + im * im), 6) AS psi FROM z",
)
def voronoi_psi(d):
    return spatial.psi_local(voronoi.voronoi_neighbours(d), 6)


# -- linking

_PARENTS = (
    "nr AS (SELECT a.id, a.f, b.id AS p, a.f - b.f AS n, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM dots a JOIN dots b ON a.f - b.f BETWEEN 1 AND 3 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 2 * sqrt(a.f - b.f)), "
    "rv AS (SELECT *, min(d) OVER (PARTITION BY p, n) AS rival, row_number() OVER (PARTITION BY id ORDER BY n, d, p) AS k FROM nr), pa AS (SELECT id, p AS parent FROM rv WHERE k = 1 AND d <= rival)"
)


@query("dots", f"{_PARENTS} SELECT id, f, parent FROM dots LEFT JOIN pa USING (id)")
def parent_pointers(d):
    return linking.parents(d, 2.0, 3)


def _labels_sql(tail: str) -> str:
    walk = "up(id, top) AS (SELECT id, id FROM dots UNION ALL SELECT up.id, pa.parent FROM up JOIN pa ON pa.id = up.top), rt AS (SELECT up.id, min_by(top, dots.f) AS root FROM up JOIN dots ON dots.id = up.top GROUP BY up.id)"
    return f"WITH RECURSIVE {adapters.SQL['dots']}, {_PARENTS}, {walk}, {tail}"


@query(None, _labels_sql("lb AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS t FROM rt) SELECT id, t FROM lb"))
def track_labels(spark, sf_dir):
    return linking.track_labels(adapters.dots(spark, sf_dir), 2.0, 3)


@query(None, _labels_sql("lb AS (SELECT id, root, dense_rank() OVER (ORDER BY root) - 1 AS t, count(*) OVER (PARTITION BY root) AS n FROM rt) SELECT id, CASE WHEN n >= 3 THEN t ELSE -1 END AS t FROM lb"))
def stub_filter(spark, sf_dir):
    return linking.track_labels(adapters.dots(spark, sf_dir), 2.0, 3, stub=3)


@query("points", "SELECT f, id, round(x, 6) AS x, round(y, 6) AS y, round(o, 6) AS o, sqrt(x * x + y * y) > 0.2 AS cut FROM points")
def boundary_cut(d):
    return linking.outside(d, 0.0, 0.0, 0.3, 0.1)


@query(
    "points",
    "m AS (SELECT a.f, a.id, b.id AS cid, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM points a JOIN points b ON a.f = b.f AND a.id % 2 = 0 AND b.id % 2 = 1), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY f, id ORDER BY round(abs(d - 0.1), 9), cid) AS k FROM m WHERE abs(d - 0.1) < 0.03), g AS (SELECT f, id, " + _MOD("atan2(sum(dy / d), sum(dx / d))") + " AS orient FROM r WHERE k <= 2 GROUP BY f, id HAVING count(*) >= 2) "
    "SELECT p.f, p.id, round(orient, 6) AS orient FROM points p LEFT JOIN g ON g.f = p.f AND g.id = p.id WHERE p.id % 2 = 0",
)
def corner_match(d):
    return orient.match_corners(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 0.1, 0.03).select("f", "id", "orient")


# -- forms, fits, simulation, detection, streaming


@query(
    "tracks_dense",
    "SELECT t, f, round(0.5 + 2 * exp(-f / 7.0), 6) AS exp_decay, round(1 + 3 * (f + 1.0) ** -0.5, 6) AS powerlaw, round(exp(-(f / 21.0)), 6) AS nn, round(2 * (0.3 / 0.05) ** 2 * (0.05 * f + exp(-0.05 * f) - 1) + 0.04 * f, 6) AS rr, round((((x - y) + pi() / 4) % (pi() / 2) + pi() / 2) % (pi() / 2) - pi() / 4, 6) AS wrapped FROM tracks_dense",
)
def functional_forms(d):
    f = F.col("f").cast("double")
    return d.select("t", "f", forms.exp_decay(f, 7.0, 2.0, 0.5).alias("exp_decay"), forms.powerlaw(f + 1, 0.5, 3.0, 1.0).alias("powerlaw"), forms.nn_form(f, 1 / 21).alias("nn"), forms.rr_form(f, 0.3, 0.01, 0.05).alias("rr"), scalars.dtheta(F.col("x"), F.col("y"), 4, True).alias("wrapped"))


def _walker_sql(tracks: int, size: int, dr: float, dt: float, v0: float) -> str:
    u = lambda key: f"((CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"
    n = lambda k: f"sqrt(-2 * ln({u(f"t || '|' || f || '|{k}|1'")})) * cos(2 * pi() * {u(f"t || '|' || f || '|{k}|2'")})"
    return (
        f"r AS (SELECT t, f, {n(1)} AS n1, {n(2)} AS n2, {n(3)} AS n3, 2 * pi() * {u("t || '|0|0'")} AS o0 FROM (SELECT unnest(range({tracks})) AS t), (SELECT unnest(range({size})) AS f)), "
        f"q AS (SELECT *, sum(sqrt(2 * {dr!r}) * n1) OVER (PARTITION BY t ORDER BY f) + o0 AS o, {v0!r} + sqrt(2 * {dt!r}) * n2 AS al, sqrt(2 * {dt!r}) * n3 AS ac FROM r), "
        "walkers AS (SELECT t, f, o, sum(al * cos(o) - ac * sin(o)) OVER w AS x, sum(al * sin(o) + ac * cos(o)) OVER w AS y FROM q WINDOW w AS (PARTITION BY t ORDER BY f))"
    )


@query(None, f"WITH {_walker_sql(100, 100, 1 / 21, 0.01, 0.3678)}, {_MSD.replace('AS msd', 'AS c').replace('tracks_dense', 'walkers')} {_ENSEMBLE}")
def simulated_msd(spark, sf_dir):
    return lag.msd_ensemble(simulate.walkers(spark, 100, 100, 1 / 21, 0.01, 0.3678))


@query(
    "tracks_dense",
    "s AS (SELECT t, f, f / 10.0::DOUBLE AS s FROM tracks_dense), q AS (SELECT *, exp(0.05 * 1.6) AS c, exp(-0.05 * s) AS d FROM s), z AS (SELECT *, c * 9 * (d - 1 + 0.05 * s) AS a, c * 9 * c ** 4 * (d ** 4 - 4 * d + 3) / 12 AS b FROM q) "
    "SELECT t, f, round(a + b + 0.02 * s, 6) AS prog, round(a - b + 0.02 * s, 6) AS div, round(2 * a + 0.04 * s, 6) AS total, round(3 - 2 * ln((s + 1) / 4.0), 6) AS log_decay, round(greatest(0.5 + 2 * s ** 0.5, 3 * s ** 2.0), 6) AS chained, round(1 + 2 * exp(-(((s - 3) / 2.0) ** 2)), 6) AS gauss, "
    "round(2 * exp(-(s ** 1.5) / (1 + 0.5 * s)), 6) AS poly_exp, round(3 * sign(s) * (1 - exp(-0.05 * s)) * exp(0.05 * 1.6), 6) AS rn, round(CASE WHEN s < 12 THEN 1 + 2 * (12 - s) ** -0.5 END, 6) AS shift FROM z",
)
def more_forms(d):
    s = F.col("f") / 10.0
    part = {
        "prog": forms.rr_form_prog(s, 0.01, 3.0, 0.05, 1.6), "div": forms.rr_form_div(s, 0.01, 3.0, 0.05, 1.6), "total": forms.rr_form_total(s, 0.01, 3.0, 0.05, 1.6),
        "log_decay": forms.log_decay(s + 1, 2.0, 4.0, 3.0), "chained": forms.chained_power(s, 2.0, 3.0, 0.5, 2.0, 0.5), "gauss": forms.gauss(s, 2.0, 3.0, 2.0, 1.0),
        "poly_exp": forms.poly_exp(s, 1.5, 2.0, 1.0, 0.5), "rn": forms.rn_form(s, 3.0, 0.05, 1.6), "shift": forms.shift_power(s, 12.0, 2.0, 0.5, 1.0),
    }
    return d.select("t", "f", *[c.alias(n) for n, c in part.items()])


@query(
    "tracks_dense",
    "SELECT t, f, round(sqrt((x - y) ** 2 + (y - o) ** 2), 6) AS dist, round(x * cos(o) - y * sin(o), 6) AS rx, round(x * sin(o) + y * cos(o), 6) AS ry, round(CASE WHEN x > 0 THEN 10.0 ** floor(log10(x)) END, 6) AS decade, translate(CAST(id AS VARCHAR), '13', 'xx') AS replaced, "
    "round(sqrt((y / 2 - x / 2) ** 2 + 0) * 0 + sqrt(x * x + y * y) / 2, 6) AS radius FROM tracks_dense WHERE x > 0 AND y > 0",
)
def scalar_functions(d):
    x, y, o = F.col("x"), F.col("y"), F.col("o")
    rx, ry = scalars.rotate(x, y, o)
    # the circle through the corners of a right angle has its far side as diameter
    circle = scalars.circle_through(F.lit(0.0), F.lit(0.0), x, F.lit(0.0), F.lit(0.0), y)
    return d.where("x > 0 and y > 0").select("t", "f", scalars.distance(x, y, y, o).alias("dist"), rx.alias("rx"), ry.alias("ry"), scalars.decade(x).alias("decade"), scalars.replace_all(F.col("id").cast("string"), "13", "x").alias("replaced"), circle["r"].alias("radius"))


def _curves(d: DataFrame, lags: int = 40) -> dict[str, DataFrame]:
    """Ensemble curves (dataset, tau, mean, stderr) of the walks, those of every third track a dataset."""
    out: dict[str, DataFrame] = {}
    # the walks are read for every curve, the curves for several fits
    d = staged(d.select("t", "f", "x", "y", "o"), "walks")
    for k in range(3):
        w = d.where(F.col("t") % 3 == k)
        rr = staged(lag.rr_stack(w, max_lag=lags), "rr")
        mine = {"nn": staged(lag.nn_corr(w, lags), "nn"), "rn": staged(lag.rn_corr(w, max_lag=lags), "rn")}
        mine |= {c: rr.select("tau", F.col(c).alias("mean"), F.col(f"{c}_err").alias("stderr")) for c in ("total", "prog", "div")}
        for n, c in mine.items():
            c = c.select(F.lit(f"d{k}").alias("dataset"), "tau", "mean", "stderr")
            out[n] = out[n].unionByName(c) if n in out else c
    return out


@query("walks", digits=4)
def fit_walks(d):
    """Not in SQL: an iterative fit. tests/test_fits.py compares the solver with a plain one, and the chain with known curves."""
    c = _curves(d)
    return fit.fit_chain(c["nn"], c["rn"], c["total"], dtheta=0.01, dx=0.01, parts={n: c[n] for n in ("prog", "div")})


@query("walks", digits=4)
def fit_walks_max(d):
    """Not in SQL: as fit_walks, with the largest antisymmetric displacement."""
    c = _curves(d)
    return fit.fit_chain(c["nn"], c["rn"], c["total"], dtheta=0.01, dx=0.01, mode="max")


@query("walks", digits=4)
def cage_times(d):
    """Not in SQL: an iterative fit of every track's squared displacement; tests/test_fits.py has known curves."""
    return fit.cage_time(lag.msd(d, 30).select(F.col("t").alias("dataset"), "tau", "msd"))


@query("walks", digits=4)
def decay_fits(d):
    """Not in SQL: an iterative fit of every track's orientation correlation; tests/test_fits.py has known curves."""
    return fit.decay_fit(lag.orientation_means(d, 30).select("t", "tau", F.col("cc").alias("c")), "tau", "c", "t")


@query("points", digits=4)
def crystal_axis(d):
    """Not in SQL: an iterative fit; tests/test_more_operators.py has known directions. The bonds of all frames' four nearest neighbours."""
    return fit.primary_angles(spatial.bond_angles(spatial.knn(d, 4)).select(F.lit("points").alias("dataset"), "angle"), "angle", 4, 180)


@query("points", digits=4)
def peak_decays(d):
    """Not in SQL: an iterative fit through the maxima of every frame's pair distribution; tests/test_fits.py has known curves."""
    g = spatial.pair_distribution(d, 40, 0.6, 0.0, 0.02).select("f", ((F.col("bin") + 0.5) * 0.015).alias("r"), "g")
    return fit.peak_decay(g, "r", "g", "f", lookahead=1)


# -- slices and names

_GRID = "g AS (SELECT CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS stop FROM (SELECT unnest(range(0, 50, 10)) AS a), (SELECT unnest([0, -10, -20, -30, 25]) AS b))"


@query(
    "tracks_dense",
    f"{_GRID}, e AS (SELECT t, min(f) AS lo, max(f) - min(f) + 1 AS n FROM tracks_dense GROUP BY t), z AS (SELECT d.t, start, stop, x, y FROM tracks_dense d JOIN e USING (t), g WHERE f - lo >= start AND f - lo < CASE WHEN stop > 0 THEN stop ELSE n + stop END) "
    "SELECT t, start, stop, count(*) AS rows, count(x) AS n_x, round(avg(x), 6) AS mean_x, round(var_samp(x), 6) AS var_x, count(y) AS n_y, round(avg(y), 6) AS mean_y, round(var_samp(y), 6) AS var_y FROM z GROUP BY ALL",
)
def slice_grid(d):
    return slices.slice_grid(d, ["x", "y"], range(0, 50, 10), [0, -10, -20, -30, 25], "t").drop("skew_x", "skew_y")


@query(
    None,
    "WITH r AS (SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation)), c AS (SELECT name, k, substr(name, 1, k) AS prefix, substr(name, k + 1, 1) AS nxt FROM r, LATERAL (SELECT unnest(range(1, length(name) + 1)) AS k)), "
    "n AS (SELECT prefix, length(prefix) AS k FROM c GROUP BY prefix HAVING count(DISTINCT nxt) > 1), a AS (SELECT r.name, coalesce(max(n.k), 0) AS k FROM r LEFT JOIN n ON starts_with(r.name, n.prefix) GROUP BY r.name), "
    "u AS (SELECT x.prefix, coalesce(max(y.k), 0) AS k FROM n x LEFT JOIN n y ON y.k < x.k AND starts_with(x.prefix, y.prefix) GROUP BY x.prefix) "
    "SELECT substr(name, 1, k + 1) AS prefix, substr(name, 1, k) AS parent, name FROM a UNION ALL SELECT prefix, substr(prefix, 1, k), NULL FROM u",
)
def name_tree(spark, sf_dir):
    names = None
    for table, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("nation", "n_name")):
        part = adapters.table(spark, sf_dir, table).select(F.col(c).alias("name"))
        names = part if names is None else names.unionByName(part)
    return slices.prefix_tree(names, "name")


_PIXELS = (
    "p AS (SELECT f, CAST(floor(y * 40) AS INTEGER) AS r, CAST(floor(x * 40) AS INTEGER) AS c, count(*) AS n FROM points GROUP BY ALL), e AS (SELECT min(r) - 2 AS r0, max(r) + 2 AS r1, min(c) - 2 AS c0, max(c) + 2 AS c1 FROM p), "
    "grid AS (SELECT f, r, c FROM (SELECT DISTINCT f FROM p), (SELECT unnest(range(r0, r1 + 1)) AS r FROM e), (SELECT unnest(range(c0, c1 + 1)) AS c FROM e)), px AS (SELECT f, r, c, coalesce(n, 0)::DOUBLE AS v FROM grid LEFT JOIN p USING (f, r, c)), "
    "cl AS (SELECT f, r, c, greatest(least(v, avg(v) OVER w + 4 * stddev_pop(v) OVER w), avg(v) OVER w - 4 * stddev_pop(v) OVER w) AS v FROM px WINDOW w AS (PARTITION BY f)), "
    "pixels AS (SELECT f, r, c, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS v FROM cl WINDOW w AS (PARTITION BY f))"
)


def _pixels(d: DataFrame) -> DataFrame:
    """Points on a grid of 40 cells a unit that the data's range spans, two cells around; values are counts, clipped and scaled."""
    p = d.groupBy("f", F.floor(F.col("y") * 40).cast("int").alias("r"), F.floor(F.col("x") * 40).cast("int").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    ends = p.agg(*[g(n).alias(f"{n}{k}") for n in ("r", "c") for k, g in enumerate((F.min, F.max))])
    grid = p.select("f").distinct().join(F.broadcast(ends)).withColumn("r", F.explode(F.sequence(F.col("r0") - 2, F.col("r1") + 2))).withColumn("c", F.explode(F.sequence(F.col("c0") - 2, F.col("c1") + 2)))
    return detect.clip_scale(grid.select("f", "r", "c").join(p, ["f", "r", "c"], "left").fillna(0.0, ["v"]), 4.0)


def _detect_sql(tail: str) -> str:
    kernel = ", ".join(f"({i}, {j}, {w!r})" for i, j, w in detect.disk_kernel(0.5, 1.0))
    convolved = "k AS (SELECT * FROM (VALUES " + kernel + ") AS k(dr, dc, w)), sm AS (SELECT a.f, a.r, a.c, coalesce(sum(b.v * k.w), 0) AS v FROM pixels a CROSS JOIN k LEFT JOIN pixels b ON b.f = a.f AND b.r = a.r - k.dr AND b.c = a.c - k.dc GROUP BY a.f, a.r, a.c)"
    stretched = "st AS (SELECT f, r, c, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS v FROM sm WINDOW w AS (PARTITION BY f))"
    on = "lev AS (SELECT *, 1.5 * stddev_pop(v) OVER (PARTITION BY f) + avg(v) OVER (PARTITION BY f) AS k FROM st), lit AS (SELECT f, r, c FROM lev WHERE v > k)"
    walk = "near AS (SELECT a.f, a.r, a.c, b.r AS r2, b.c AS c2 FROM lit a JOIN lit b ON a.f = b.f AND abs(a.r - b.r) + abs(a.c - b.c) = 1), reach(f, r, c, r2, c2) AS (SELECT f, r, c, r, c FROM lit UNION SELECT x.f, x.r, x.c, n.r2, n.c2 FROM reach x JOIN near n ON n.f = x.f AND n.r = x.r2 AND n.c = x.c2)"
    lab = "lab AS (SELECT f, r, c, min((CAST(f AS BIGINT) << 44) + ((r2 + 1024) << 22) + c2 + 1024) AS label FROM reach GROUP BY f, r, c), lv AS (SELECT l.*, p.v FROM lab l JOIN pixels p USING (f, r, c))"
    return f"WITH RECURSIVE {adapters.SQL['points']}, {_PIXELS}, {convolved}, {stretched}, {on}, {walk}, {lab}, {tail}"


@query(
    None,
    _detect_sql(
        "g AS (SELECT f, label, count(*) AS area, coalesce(sum(v * c) / nullif(sum(v), 0), avg(c)) AS x, coalesce(sum(v * r) / nullif(sum(v), 0), avg(r)) AS y, var_pop(c) + 1 / 12.0 AS a, var_pop(r) + 1 / 12.0 AS b, covar_pop(c, r) AS m FROM lv GROUP BY f, label), "
        "h AS (SELECT *, (a + b) / 2 AS half, sqrt(((a - b) / 2) ** 2 + m * m) AS root FROM g), q AS (SELECT *, sqrt(greatest(1 - (half - root) / (half + root), 0)) AS ecc FROM h) "
        "SELECT f, round(x, 6) AS x, round(y, 6) AS y, round(ecc, 6) AS ecc, area FROM q WHERE area BETWEEN 2 AND 200 AND ecc <= 0.95"
    ),
)
def detect_dots(spark, sf_dir):
    p = _pixels(adapters.points(spark, sf_dir))
    smooth = detect.stretch(detect.convolve(p, detect.disk_kernel(0.5, 1.0)))
    # rows and columns from 0 on, as a pixel's number has no sign
    lit = detect.label(smooth.withColumns({"r": F.col("r") + 1024, "c": F.col("c") + 1024}), 1.5).withColumns({"r": F.col("r") - 1024, "c": F.col("c") - 1024})
    return detect.segments(lit.drop("v").join(p, ["f", "r", "c"]), 2, 200, 0.95).select("f", "x", "y", "ecc", "area")


@query("points", f"{_PIXELS}, b AS (SELECT f, round_even(y * 40, 0)::INTEGER AS r, round_even(x * 40, 0)::INTEGER AS c FROM points WHERE id % 7 = 0), z AS (SELECT DISTINCT p.f, p.r, p.c FROM pixels p JOIN b ON p.f = b.f AND (p.r - b.r) ** 2 + (p.c - b.c) ** 2 <= 4) SELECT p.f, p.r, p.c, round(CASE WHEN z.f IS NOT NULL THEN avg(v) OVER (PARTITION BY p.f) ELSE v END, 6) AS v FROM pixels p LEFT JOIN z USING (f, r, c)")
def disk_removal(d):
    return detect.remove_disks(_pixels(d), d.where("id % 7 = 0").select("f", (F.col("x") * 40).alias("x"), (F.col("y") * 40).alias("y")), 2.0)


@query(
    None,
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sqrt(avg(cos(4 * o)) ** 2 + avg(sin(4 * o)) ** 2), 6) AS phi FROM (SELECT ts, 2 * pi() * (((value * 0.1) % 1.0 + 1.0) % 1.0) AS o FROM events) GROUP BY 1",
)
def windowed_order(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events").select("ts", (2 * 3.141592653589793 * F.pmod(F.col("value") * 0.1, F.lit(1.0))).alias("o"))
    return frames.windowed_order(e, "ts", "1 day", "1 hour")
