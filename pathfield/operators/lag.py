"""Time-lag statistics: means over the pairs of rows of a track at each lag, then means over tracks.

Without max_lag all lags of a track are met. Tracks of up to BLOCK rows meet their own rows pair by pair, in one row a track, so their work grows with the rows
times BLOCK. In longer ones every mean is a sum of products of a later and an earlier value, over the same sum of ones, and these sums come from transforms
whose work grows as L log L (`transform`); tracks with so few rows for their span that all pairs are less work than that meet in pairs of blocks, dealt over the tasks. With max_lag, rows meet in one equi-join on (t, block of that many frames); some lags
alone come as an array on the left side of one on (t, f).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfield.operators.groups import uneven_mean
from pathfield.operators.transform import Products, lag_sums

#: Frames of a block; rows of a track that meets itself in one row.
BLOCK = 512
#: A transform over a span counts as so many pairs for each frame.
SPARSE = 40


def lag_pairs(tracks: DataFrame, columns: list[str], max_lag: int | None = None, lags: list[int] | None = None, two_sided: bool = False, t: str = "t", f: str = "f") -> DataFrame:
    """(t, f, tau, c1.., c2..): rows of a track at f and f + tau.

    lags: these alone; else 0 to the track's length or max_lag. Negative ones too if two_sided.
    """
    if max_lag is None and lags is None:
        return _all_pairs(tracks, columns, two_sided, t, f)
    if lags is None:
        return _near_pairs(tracks, columns, max_lag, two_sided, t, f)
    ends = tracks.groupBy(t).agg(F.min(f).alias("__lo"), F.max(f).alias("__hi"))
    a = tracks.select(F.col(t), F.col(f), *[F.col(c).alias(f"{c}1") for c in columns]).join(ends, t)
    most = F.lit(max_lag) if max_lag is not None else F.col("__hi") - F.col("__lo")
    up = F.least(F.col("__hi") - F.col(f), most)
    taus = F.filter(F.array(*[F.lit(x) for x in lags]), lambda x: x <= up)
    a = a.withColumn("tau", F.explode(taus)).withColumn("__g", (F.col(f) + F.col("tau")).cast("int")).drop("__lo", "__hi")
    b = tracks.select(F.col(t).alias("__t"), F.col(f).cast("int").alias("__f"), *[F.col(c).alias(f"{c}2") for c in columns])
    return a.join(b, (F.col(t) == F.col("__t")) & (F.col("__g") == F.col("__f"))).drop("__t", "__f", "__g")


def _near_pairs(tracks: DataFrame, columns: list[str], max_lag: int, two_sided: bool, t: str, f: str) -> DataFrame:
    """lag_pairs at lags up to max_lag: rows meet those of their block of frames and of the blocks beside it, so a row is shuffled three or four times and not once for each lag."""
    block = F.floor(F.col(f) / (max_lag + 1))
    a = tracks.select(F.col(t), F.col(f), block.alias("__i"), *[F.col(c).alias(f"{c}1") for c in columns])
    copies = F.explode(F.array(*[block - k for k in ((-1, 0, 1) if two_sided else (0, 1))]))
    b = tracks.select(F.col(t).alias("__t"), F.col(f).alias("__f"), copies.alias("__j"), *[F.col(c).alias(f"{c}2") for c in columns])
    tau = F.col("__f") - F.col(f)
    met = a.join(b, (F.col(t) == F.col("__t")) & (F.col("__i") == F.col("__j")) & tau.between(-max_lag if two_sided else 0, max_lag))
    return met.select(t, f, tau.alias("tau"), *[f"{c}{n}" for n in "12" for c in columns])


def _all_pairs(tracks: DataFrame, columns: list[str], two_sided: bool, t: str, f: str) -> DataFrame:
    """lag_pairs at all lags."""
    block = F.floor(F.col(f) / BLOCK).cast("int")
    rows = tracks.where(F.col(f).isNotNull()).groupBy(F.col(t), block.alias("__i")).agg(F.collect_list(F.struct(f, *columns)).alias("__a"))
    ends = rows.groupBy(t).agg(F.sort_array(F.collect_list("__i")).alias("__js"))
    a = rows.join(ends, t).withColumn("__j", F.explode(F.col("__js") if two_sided else F.filter("__js", lambda j: j >= F.col("__i")))).drop("__js")
    b = rows.select(F.col(t).alias("__t"), F.col("__i").alias("__k"), F.col("__a").alias("__b"))
    met = a.join(b, (F.col(t) == F.col("__t")) & (F.col("__j") == F.col("__k"))).select(t, "__i", "__j", "__a", "__b")
    # the number is given, else few MB of blocks would be put into few tasks
    met = met.repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), t, "__i", "__j")
    pairs = met.select(t, F.explode("__a").alias("__p"), "__b").select(t, "__p", F.explode("__b").alias("__q"))
    pairs = pairs.select(F.col(t), F.col(f"__p.{f}").alias(f), (F.col(f"__q.{f}") - F.col(f"__p.{f}")).alias("tau"), *[F.col(f"__p.{c}").alias(f"{c}1") for c in columns], *[F.col(f"__q.{c}").alias(f"{c}2") for c in columns])
    return pairs if two_sided else pairs.where("tau >= 0")


def _own_pairs(tracks: DataFrame, columns: list[str], two_sided: bool) -> DataFrame:
    """lag_pairs at all lags of tracks with few rows: each is one row that meets itself."""
    # the number is given, else few MB of tracks would be put into few tasks
    dealt = tracks.where("f is not null").repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t")
    rows = dealt.groupBy("t").agg(F.collect_list(F.struct("f", *columns)).alias("a"))
    now = rows.select("t", "a", F.explode("a").alias("p"))
    later = F.col("a") if two_sided else F.filter("a", lambda q: q["f"] >= F.col("p.f"))
    met = now.select("t", "p", F.explode(later).alias("q"))
    return met.select("t", F.col("p.f").alias("f"), (F.col("q.f") - F.col("p.f")).alias("tau"), *[F.col(f"p.{c}").alias(f"{c}1") for c in columns], *[F.col(f"q.{c}").alias(f"{c}2") for c in columns])


@dataclass
class Means:
    """Statistics over the pairs at a lag, in two forms.

    pairs: name to a Column of the earlier (c1) and later (c2) values of `columns`, whose mean over the pairs is meant. channels: name to a Column of a row, NULL where
    the row has no say; terms: name to the sum of products that is the mean's numerator and the one that is its denominator. centred: columns that are taken from their track's mean first, which changes
    no statistic here but keeps the sums small.
    """

    columns: list[str]
    pairs: dict[str, Column]
    channels: dict[str, Column]
    terms: dict[str, tuple[list[tuple[float, str, str]], tuple[str, str]]]
    centred: tuple[str, ...] = ()


def lag_means(tracks: DataFrame, what: Means, max_lag: int | None = None, lags: list[int] | None = None, two_sided: bool = False, start_step: int = 1) -> DataFrame:
    """(t, tau, means...): the means of each track at each lag."""
    means = [F.avg(c).alias(k) for k, c in what.pairs.items()]
    if max_lag is not None or lags is not None or start_step > 1:
        p = lag_pairs(tracks, what.columns, max_lag, lags, two_sided)
        return (p.where((F.col("f") - 1) % start_step == 0) if start_step > 1 else p).groupBy("t", "tau").agg(*means)
    rows = tracks.select("t", "f", *what.columns)
    n, span = F.col("__n"), F.col("__span")
    kind = F.when(n <= BLOCK, "own").when(n * n > SPARSE * span, "dense").otherwise("sparse")
    kinds = rows.where("f is not null").groupBy("t").agg(F.count(F.lit(1)).alias("__n"), (F.max("f") - F.min("f") + 1).cast("double").alias("__span")).select("t", kind.alias("__kind"))
    form = {
        "own": lambda rows: _own_pairs(rows, what.columns, two_sided).groupBy("t", "tau").agg(*means),
        "sparse": lambda rows: _all_pairs(rows, what.columns, two_sided, "t", "f").groupBy("t", "tau").agg(*means),
        "dense": lambda rows: _by_transform(rows, what, two_sided),
    }
    met = sorted(r[0] for r in kinds.select("__kind").distinct().collect())
    if len(met) < 2:
        return form[met[0] if met else "own"](rows)
    out = None
    for k in met:
        part = form[k](rows.join(kinds.where(F.col("__kind") == k).select("t"), "t", "left_semi"))
        out = part if out is None else out.unionByName(part)
    return out


def _by_transform(rows: DataFrame, what: Means, two_sided: bool, **sizes) -> DataFrame:
    """lag_means by sums of products, at all lags."""
    if what.centred:
        middle = rows.groupBy("t").agg(*[F.avg(c).alias(f"__m{c}") for c in what.centred])
        rows = rows.join(middle, "t").select(*[(F.col(c) - F.col(f"__m{c}")).alias(c) if c in what.centred else c for c in ("t", "f", *what.columns)])
    products: Products = {}
    for k, (terms, (a, b)) in what.terms.items():
        products |= {f"__{k}": terms, f"__n_{a}_{b}": [(1.0, a, b)]}
    # every pair counts, whether its values are known or not
    products["__pairs"] = [(1.0, "__one", "__one")]
    sums = lag_sums(rows, what.channels | {"__one": F.lit(1.0)}, products, two_sided, **sizes).where("__pairs > 0.5")
    count = lambda a, b: F.rint(F.col(f"__n_{a}_{b}"))
    return sums.select("t", F.col("tau").cast("int").alias("tau"), *[F.when(count(*n) > 0, F.col(f"__{k}") / count(*n)).alias(k) for k, (_, n) in what.terms.items()])


def _given(value: Column, *needed: str) -> Column:
    """A value where all columns are known, else NULL."""
    known = F.lit(True)
    for c in needed:
        known = known & F.col(c).isNotNull()
    return F.when(known, value)


def _displacement() -> Means:
    x, y = F.col("x"), F.col("y")
    pairs = {"msd": F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)}
    channels = {"x": _given(x, "x", "y"), "y": _given(y, "x", "y"), "q": x * x + y * y, "v": _given(F.lit(1.0), "x", "y")}
    return Means(["x", "y"], pairs, channels, {"msd": ([(1, "q", "v"), (1, "v", "q"), (-2, "x", "x"), (-2, "y", "y")], ("v", "v"))}, ("x", "y"))


def msd(tracks: DataFrame, max_lag: int | None = None, start_step: int = 1, lags: list[int] | None = None) -> DataFrame:
    """(t, tau, msd): mean squared displacement of each track."""
    return lag_means(tracks, _displacement(), max_lag, lags, start_step=start_step)


def _body() -> Means:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    c, s = F.cos("o1"), F.sin("o1")
    x, y, cos, sin = F.col("x"), F.col("y"), F.cos("o"), F.sin("o")
    known = lambda v: _given(v, "x", "y")
    channels = {"x": known(x), "y": known(y), "xx": known(x * x), "xy": known(x * y), "yy": known(y * y), "v": known(F.lit(1.0)), "w": _given(F.lit(1.0), "x", "y", "o")}
    terms = {}
    # (dx a + dy b)^2 by what is later and what is earlier; an unknown place or direction leaves all earlier parts unknown
    for k, a, b in (("prog", cos, sin), ("div", -sin, cos)):
        p = x * a + y * b
        now = {"aa": a * a, "ab": a * b, "bb": b * b, "ap": a * p, "bp": b * p, "pp": p * p}
        channels |= {f"{k}_{n}": _given(v, "x", "y", "o") for n, v in now.items()}
        parts = [(1, "xx", "aa"), (2, "xy", "ab"), (1, "yy", "bb"), (-2, "x", "ap"), (-2, "y", "bp"), (1, "v", "pp")]
        terms[k] = ([(w, later, f"{k}_{n}") for w, later, n in parts], ("v", "w"))
    return Means(["x", "y", "o"], {"prog": F.pow(dx * c + dy * s, 2), "div": F.pow(dy * c - dx * s, 2)}, channels, terms, ("x", "y"))


def msd_body(tracks: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(t, tau, prog, div): squared displacement along and across the first orientation."""
    return lag_means(tracks, _body(), max_lag)


def msd_ensemble(tracks: DataFrame, least: int = 3, max_lag: int | None = None, flat: float | None = None, jump: float | None = None) -> DataFrame:
    """(tau, mean, stderr, n) over tracks. flat, jump: tracks whose last 50, or first 2, values average below, above it are left out."""
    rows = msd(tracks, max_lag)
    if flat is not None or jump is not None:
        up, down = Window.partitionBy("t").orderBy("tau"), Window.partitionBy("t").orderBy(F.desc("tau"))
        marked = rows.withColumns({"__i": F.row_number().over(up), "__j": F.row_number().over(down)})
        ends = marked.groupBy("t").agg(F.avg(F.when(F.col("__j") <= 50, F.col("msd"))).alias("__tail"), F.avg(F.when(F.col("__i") <= 2, F.col("msd"))).alias("__head"))
        good = ends.where((F.col("__tail") >= (0 if flat is None else flat)) & (F.col("__head") <= (float("inf") if jump is None else jump)))
        rows = rows.join(good.select("t"), "t", "left_semi")
    return uneven_mean(rows, "msd", "tau", least)


def tau_grid(frames: int, step: int | float, first: int = 1, most: int | None = None) -> list[int]:
    """Lags up to a number of frames: every step-th for a whole step, else first times the powers of the step, rounded, each once."""
    if isinstance(step, int):
        taus = list(range(step, frames + 1, step))
    else:
        if step <= 1:
            raise ValueError("a factor above 1")
        n = int(math.log((frames + 1) / first) / math.log(step) + 1e-9)
        taus = sorted({t for k in range(n + 1) if (t := round(first * step**k)) <= frames})
    return taus[:most]


def rr_stack(tracks: DataFrame, least: int = 3, max_lag: int | None = None) -> DataFrame:
    """(tau, total, total_err, prog, prog_err, div, div_err, n): ensemble means of the body-frame displacements and of their sum; errors of the sum add as squares."""
    parts = msd_body(tracks, max_lag)
    err = lambda c: F.stddev_samp(c) / F.sqrt(F.count(c).cast("double"))
    g = parts.groupBy("tau").agg(*[a for c in ("prog", "div") for a in (F.avg(c).alias(c), err(c).alias(f"{c}_err"))], F.count("prog").alias("n")).where(F.col("n") >= least)
    return g.select("tau", (F.col("prog") + F.col("div")).alias("total"), F.hypot("prog_err", "div_err").alias("total_err"), "prog", "prog_err", "div", "div_err", "n")


def angular_msd(tracks: DataFrame, max_lag: int | None = None, modulo: bool = False) -> DataFrame:
    """(t, tau, msd) of unwrapped orientations; modulo: of the orientations' differences taken into [-pi, pi), whatever turns lie between, pair by pair."""
    d = F.col("o2") - F.col("o1")
    if modulo:
        turned = F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi
        return lag_pairs(tracks, ["o"], max_lag).groupBy("t", "tau").agg(F.avg(F.pow(turned, 2)).alias("msd"))
    channels = {"o": F.col("o"), "q": F.col("o") * F.col("o"), "v": _given(F.lit(1.0), "o")}
    return lag_means(tracks, Means(["o"], {"msd": F.pow(d, 2)}, channels, {"msd": ([(1, "q", "v"), (1, "v", "q"), (-2, "o", "o")], ("v", "v"))}, ("o",)), max_lag)


def _product(a: str, b: str, cumulant: str | None, name: str = "") -> Means:
    """Means of a(later) b(now), and what the cumulant takes off them."""
    later, now, before = F.col(f"{a}2"), F.col(f"{b}1"), F.col(f"{a}1")
    known = lambda c: _given(F.lit(1.0), c)
    channels = {a: F.col(a), b: F.col(b), f"v_{a}": known(a), f"v_{b}": known(b)}
    if cumulant == "init":
        both = f"{a}_{b}"
        channels |= {f"{both}_b": _given(F.col(b), a, b), f"{both}_ab": F.col(a) * F.col(b), f"{both}_v": _given(F.lit(1.0), a, b)}
        return Means(list(dict.fromkeys([a, b])), {f"m{name}": (later - before) * now}, channels, {f"m{name}": ([(1, a, f"{both}_b"), (-1, f"v_{a}", f"{both}_ab")], (f"v_{a}", f"{both}_v"))})
    pairs, terms = {f"m{name}": later * now}, {f"m{name}": ([(1, a, b)], (f"v_{a}", f"v_{b}"))}
    if cumulant == "mean":
        pairs |= {f"a{name}": F.when(now.isNotNull(), later), f"b{name}": F.when(later.isNotNull(), now)}
        terms |= {f"a{name}": ([(1, a, f"v_{b}")], (f"v_{a}", f"v_{b}")), f"b{name}": ([(1, f"v_{a}", b)], (f"v_{a}", f"v_{b}"))}
    # the mean of products less the product of means, over the same pairs, stays the same if both are taken from their tracks' means
    return Means(list(dict.fromkeys([a, b])), pairs, channels, terms, tuple(dict.fromkeys([a, b])) if cumulant == "mean" else ())


def crosscorr(tracks: DataFrame, a: str, b: str, cumulant: str | None = None, two_sided: bool = True, norm: bool = False, max_lag: int | None = None) -> DataFrame:
    """(t, tau, c): mean of a(f + tau) b(f) over the pairs of each lag.

    Only pairs with both values known count. cumulant: 'mean' subtracts the product of both means over the same pairs, 'init' the mean of a(f) b(f) over them. norm divides by
    the value at lag 0.
    """
    found = lag_means(tracks, _product(a, b, cumulant), max_lag, None, two_sided)
    value = F.col("m") - F.col("a") * F.col("b") if cumulant == "mean" else F.col("m")
    out = found.select("t", "tau", value.alias("c"))
    if norm:
        at0 = out.where("tau = 0").select("t", F.col("c").alias("__c"))
        out = out.join(at0, "t").select("t", "tau", F.try_divide("c", F.col("__c")).alias("c"))
    return out


def autocorr(tracks: DataFrame, c: str, max_lag: int | None = None, norm: bool = True) -> DataFrame:
    """(t, tau, c): one-sided autocorrelation about the means, 1 at lag 0."""
    return crosscorr(tracks, c, c, "mean", False, norm, max_lag)


def field_autocorr(series: DataFrame, fields: list[str], max_lag: int | None = None) -> DataFrame:
    """(t, tau, field, c): autocorrelation about the means, not normalised, of several fields from one pass."""
    parts = [_product(c, c, "mean", f"_{c}") for c in fields]
    merged = Means(fields, {}, {}, {}, tuple(fields))
    for p in parts:
        merged.pairs, merged.channels, merged.terms = merged.pairs | p.pairs, merged.channels | p.channels, merged.terms | p.terms
    found = lag_means(series, merged, max_lag)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(f"m_{c}") - F.col(f"a_{c}") * F.col(f"b_{c}")).alias("c")) for c in fields]))
    return found.select("t", "tau", long.alias("s")).select("t", "tau", "s.*")


def nn_corr(tracks: DataFrame, max_lag: int | None = None, least: int = 3, dot: bool = True) -> DataFrame:
    """(tau, mean, stderr, n): orientation correlation over tracks: cos(o2 - o1), or, not dot, both components' products as series of their own."""
    found = orientation_means(tracks, max_lag)
    if dot:
        return uneven_mean(found.select("tau", F.col("cc").alias("c")), "c", "tau", least)
    return uneven_mean(found.select("tau", F.explode(F.array("xx", "yy")).alias("c")), "c", "tau", least)


def orientation_means(tracks: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(t, tau, cc, xx, yy): mean cos(o2 - o1), and of the products of both components, of each track."""
    pairs = {"cc": F.cos(F.col("o2") - F.col("o1")), "xx": F.cos("o1") * F.cos("o2"), "yy": F.sin("o1") * F.sin("o2")}
    channels = {"c": F.cos("o"), "s": F.sin("o"), "v": _given(F.lit(1.0), "o")}
    terms = {"cc": ([(1, "c", "c"), (1, "s", "s")], ("v", "v")), "xx": ([(1, "c", "c")], ("v", "v")), "yy": ([(1, "s", "s")], ("v", "v"))}
    return lag_means(tracks, Means(["o"], pairs, channels, terms), max_lag)


def rn_corr(tracks: DataFrame, side: float = 1.0, max_lag: int | None = None, least: int = 3) -> DataFrame:
    """(tau, mean, stderr, n): displacement along the first orientation, both signs of the lag."""
    along = (F.col("x2") - F.col("x1")) * F.cos("o1") + (F.col("y2") - F.col("y1")) * F.sin("o1")
    x, y, c, s = F.col("x"), F.col("y"), F.cos("o"), F.sin("o")
    now = {"c": c, "s": s, "p": x * c + y * s, "w": F.lit(1.0)}
    channels = {"x": _given(x, "x", "y"), "y": _given(y, "x", "y"), "v": _given(F.lit(1.0), "x", "y")} | {k: _given(v, "x", "y", "o") for k, v in now.items()}
    terms = {"c": ([(1 / side, "x", "c"), (1 / side, "y", "s"), (-1 / side, "v", "p")], ("v", "w"))}
    return uneven_mean(lag_means(tracks, Means(["x", "y", "o"], {"c": along / side}, channels, terms, ("x", "y")), max_lag, None, True), "c", "tau", least)


def symmetry(curve: DataFrame, x: str, y: str) -> DataFrame:
    """(x, even, odd, even_degree): a curve's symmetric and antisymmetric parts where both x and -x are known, and the first one's share of their sizes."""
    a, b = curve.select(F.col(x).alias("x"), F.col(y).alias("a")), curve.select((-F.col(x)).alias("x"), F.col(y).alias("b"))
    both = a.join(b, "x").select("x", ((F.col("a") + F.col("b")) / 2).alias("even"), ((F.col("a") - F.col("b")) / 2).alias("odd"))
    return both.withColumn("even_degree", F.try_divide(F.abs("even"), F.abs("even") + F.abs("odd")))


def symmetry_degree(curve: DataFrame, x: str, y: str) -> DataFrame:
    """(even, odd): mean shares of a curve's parts over x >= 0."""
    share = F.avg("even_degree")
    return symmetry(curve, x, y).where("x >= 0").agg(share.alias("even"), (1 - share).alias("odd"))


def decay_scale(curves: DataFrame, x: str, y: str, by: list[str], method: str = "mean") -> DataFrame:
    """Decay length of each curve, of its values or 0 if these are less, by trapezoids.

    mean: of x under y; integrate: the integral over the first value; inverse: the integral over that of y / (x + 1); threshold: the
    first crossing of 1/e of the first value.
    """
    w = Window.partitionBy(*by).orderBy("x")
    rows = curves.select(*by, F.col(x).cast("double").alias("x"), F.greatest(F.col(y), F.lit(0.0)).alias("y"))
    rows = rows.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "y0": F.first("y").over(w)})
    area = lambda f: F.sum((F.col("nx") - F.col("x")) * (f(F.col("x"), F.col("y")) + f(F.col("nx"), F.col("ny"))) / 2)
    level = F.col("y0") * math.exp(-1)
    crossed = (F.col("y") > level) & (F.col("ny") <= level)
    scale = {
        "mean": lambda: F.try_divide(area(lambda x, y: x * y), area(lambda x, y: y)),
        "integrate": lambda: F.try_divide(area(lambda x, y: y), F.max("y0")),
        "inverse": lambda: F.try_divide(area(lambda x, y: y), area(lambda x, y: y / (x + 1))),
        "threshold": lambda: F.min(F.when(crossed, F.col("x") + (F.col("nx") - F.col("x")) * (F.col("y") - level) / (F.col("y") - F.col("ny")))),
    }[method]()
    return rows.groupBy(*by).agg(scale.alias("scale"))
