"""Features of a series within each key: differences, runs, volatility, episodes, drawdowns, recursive means.

All are window expressions, which stay in the JVM. `order` should give a total order of a key's rows; times are numbers
(microseconds). With `bucket` (see `stretch`) a key's rows are sorted by stretches, so that a key that holds much of the
data is spread over many tasks; without it, a key is one task's.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stretch
from .order import ordinal
from .stretch import Bucket


def _by(key: str | Sequence[str], order: str | Sequence[str]):
    keys, orders = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    return Window.partitionBy(*keys).orderBy(*orders)


def velocity(df: DataFrame, key: str, ts: str, value: str, name: str = "velocity", bucket: Bucket = None) -> DataFrame:
    """Change of value per second since the row before; NULL for the first row or without time passed."""
    out = stretch.prior(df, key, ts, F.struct(ts, value), "_before", bucket)
    passed = (F.col(ts) - F.col("_before")[ts]) / F.lit(1e6)
    return out.withColumn(name, F.when(passed > 0, (F.col(value) - F.col("_before")[value]) / passed)).drop("_before")


def acceleration(df: DataFrame, key: str, ts: str, value: str, name: str = "acceleration", bucket: Bucket = None) -> DataFrame:
    """Change of the velocity over the time since the row before, a nanosecond at least."""
    out = stretch.prior(velocity(df, key, ts, value, "_v", bucket), key, ts, F.struct(ts, "_v"), "_before", bucket)
    passed = F.greatest(F.lit(1e-9), (F.col(ts) - F.col("_before")[ts]) / F.lit(1e6))
    return out.withColumn(name, F.when(F.col("_before").isNotNull(), (F.col("_v") - F.col("_before._v")) / passed)).drop("_v", "_before")


def difference(df: DataFrame, key: str, order: str, value: str, name: str = "difference", bucket: Bucket = None) -> DataFrame:
    return stretch.prior(df, key, order, F.col(value), "_before", bucket).withColumn(name, F.col(value) - F.col("_before")).drop("_before")


def changed(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], value: str | Sequence[str], name: str, bucket: Bucket = None) -> DataFrame:
    """df with whether a value differs from the row before, NULLs being equal; NULL for the key's first row."""
    values = F.struct(*stretch.names(value))
    out = stretch.prior(df, key, order, F.struct(values.alias("v")), "_before", bucket)
    return out.withColumn(name, F.when(F.col("_before").isNotNull(), ~values.eqNullSafe(F.col("_before.v")))).drop("_before")


def run_length(df: DataFrame, key: str, order: str, value: str | Sequence[str], name: str = "run_length", bucket: Bucket = None) -> DataFrame:
    """How many rows in a row, this one included, have had this value."""
    values = F.struct(*stretch.names(value))
    out = stretch.carried(df, key, order, {"_before": ("prior", F.struct(values.alias("v"))), "_n": ("total", F.lit(1))}, bucket)
    new = F.col("_before").isNull() | ~values.eqNullSafe(F.col("_before.v"))
    out = stretch.latest(out, key, order, F.when(new, F.col("_n")), "_from", bucket)
    return out.withColumn(name, (F.col("_n") - F.col("_from") + 1).cast("int")).drop("_before", "_n", "_from")


def time_since_change(df: DataFrame, key: str, ts: str, value: str | Sequence[str], name: str = "since_change", bucket: Bucket = None) -> DataFrame:
    """Seconds since the value last changed, from the first row on."""
    out = stretch.latest(changed(df, key, ts, value, "_new", bucket), key, ts, F.when(F.coalesce("_new", F.lit(True)), F.col(ts)), "_at", bucket)
    return out.withColumn(name, (F.col(ts) - F.col("_at")) / F.lit(1e6)).drop("_new", "_at")


def change_frequency(df: DataFrame, key: str, ts: str, value: str | Sequence[str], span: int, name: str = "change_frequency", bucket: int | None = None) -> DataFrame:
    """Changes between neighbours that both lie in the trailing span (microseconds), per second of it."""
    out = changed(df, key, ts, value, "_new", bucket).withColumn("_change", F.coalesce(F.col("_new").cast("int"), F.lit(0)))
    # The first row of the frame changed against a row outside of it.
    out = stretch.framed(out, key, ts, span, {name: lambda w: (F.sum("_change").over(w) - F.first("_change").over(w)) / F.lit(span / 1e6)}, bucket)
    return out.drop("_new", "_change")


def realized_volatility(df: DataFrame, key: str, ts: str, value: str, span: int, name: str = "volatility", least: int = 3, bucket: int | None = None) -> DataFrame:
    """Population deviation of the log returns between neighbours in the trailing span; NULL with fewer than `least` positive values."""
    prices = stretch.prior(df.withColumn("_price", F.when(F.col(value) > 0, F.col(value))), key, ts, F.col("_price"), "_last", bucket)
    out = prices.withColumn("_return", F.when(F.col("_last") > 0, F.ln(F.col("_price") / F.col("_last"))))
    frames = {
        "_first": lambda w: F.first("_return").over(w),
        "_n": lambda w: F.count("_return").over(w),
        "_sum": lambda w: F.coalesce(F.sum("_return").over(w), F.lit(0.0)),
        "_squares": lambda w: F.coalesce(F.sum(F.col("_return") * F.col("_return")).over(w), F.lit(0.0)),
        "_prices": lambda w: F.count("_price").over(w),
    }
    out = stretch.framed(out, key, ts, span, frames, bucket)
    # Sums over the frame less those of its first row, whose return reaches outside.
    first = F.col("_first")
    n = F.col("_n") - F.when(first.isNotNull(), 1).otherwise(0)
    mean = F.try_divide(F.col("_sum") - F.coalesce(first, F.lit(0.0)), n)
    variance = F.try_divide(F.col("_squares") - F.coalesce(first * first, F.lit(0.0)), n) - F.pow(mean, 2)
    enough = (F.col("_prices") >= least) & (n >= 2)
    return out.withColumn(name, F.when(enough, F.sqrt(F.greatest(F.lit(0.0), variance)))).drop("_price", "_last", "_return", *frames)


def rolling_mean(df: DataFrame, key: str, order: str, value: str, rows: int, name: str = "rolling_mean") -> DataFrame:
    return df.withColumn(name, F.avg(value).over(_by(key, order).rowsBetween(1 - rows, 0)))


def ewma(df: DataFrame, key: str, order: str, value: str, alpha: float, name: str = "ewma") -> DataFrame:
    """Recursive mean m = alpha * value + (1 - alpha) * m, from the first value on; null values leave it as it is.

    With k values so far and b = 1 - alpha, m = b^k * (first + sum over the later ones of alpha * value_i / b^i). The sums
    are taken over stretches of rows short enough for b^-i to stay exact, and each stretch starts from the mean at the
    end of the one before it; a key's rows are sorted, never collected.
    """
    b = 1.0 - alpha
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    # b^-i grows by at most e^20 within a stretch; what lies e^-45 back is below the last digit.
    length = max(1, min(4096, floor(20 / -log(b))))
    back = ceil(45 / (length * -log(b)))
    w = _by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_k", F.count(value).over(w)).withColumn("_stretch", F.floor((F.col("_k") - 1) / length))
    place = (F.col("_k") - 1 - F.col("_stretch") * length).cast("double")
    x = F.col(value).cast("double")
    # The first value of all enters whole; others with alpha.
    term = F.when(x.isNotNull(), F.when(F.col("_k") == 1, x).otherwise(alpha * x) * F.pow(F.lit(b), -place))
    out = out.withColumn("_own", F.coalesce(F.sum(term).over(_by([key, "_stretch"], order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) * F.pow(F.lit(b), place)).withColumn("_place", place)
    # The mean at the end of each stretch, one row each, carried over the stretches: b^length per whole stretch.
    ends = out.filter("_k > 0").groupBy(key, "_stretch").agg(F.max_by("_own", F.struct("_k", order)).alias("_end"))
    full = b**length
    before = F.collect_list(F.struct("_stretch", "_end")).over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(-back, -1))
    carried = F.aggregate(before, F.lit(0.0), lambda m, e: m * full + e["_end"])
    starts = ends.select(key, "_stretch", carried.alias("_start"))
    out = out.join(starts, [key, "_stretch"], "left")
    mean = F.col("_own") + F.coalesce("_start", F.lit(0.0)) * F.pow(F.lit(b), F.col("_place") + 1)
    return out.withColumn(name, F.when(F.col("_k") > 0, mean)).drop("_k", "_stretch", "_own", "_place", "_start")


def resampled(df: DataFrame, key: str, ts: str, step: int, tie: str | Sequence[str] | None = None) -> DataFrame:
    """The first row of each key and step of time; of rows of one time, that of the least `tie`, or of the least of all columns."""
    order = F.struct(ts, *(stretch.names(tie) if tie else [c for c in df.columns if c != ts]))
    out = df.withColumn("_bucket", F.floor(F.col(ts) / F.lit(step)))
    out = out.groupBy(key, "_bucket").agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_row"))
    return out.select(key, "_row.*", (F.col("_bucket") * F.lit(step)).alias("bucket")).select(*df.columns, "bucket")


def without_repeats(df: DataFrame, key: str, order: str, value: str | Sequence[str], bucket: Bucket = None) -> DataFrame:
    """The rows whose value differs from that of the row before."""
    return changed(df, key, order, value, "_new", bucket).filter(F.coalesce("_new", F.lit(True))).drop("_new")


def episodes(df: DataFrame, key: str, ts: str, holds: Column, gap: int, bucket: Bucket = None) -> DataFrame:
    """key, episode, start, end, observations, seconds: stretches of rows where the condition holds, no more than `gap` apart."""
    out = stretch.prior(df.withColumn("_holds", F.coalesce(holds, F.lit(False))), key, ts, F.struct(ts, "_holds"), "_before", bucket)
    goes_on = F.coalesce(F.col("_before._holds") & (F.col(ts) - F.col("_before")[ts] <= gap), F.lit(False))
    out = out.withColumn("_opens", (F.col("_holds") & ~goes_on).cast("int"))
    out = stretch.total(out, key, ts, F.col("_opens"), "episode", bucket).filter("_holds")
    return out.groupBy(key, "episode").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("observations"), ((F.max(ts) - F.min(ts)) / F.lit(1e6)).alias("seconds"))


def gaps(df: DataFrame, key: str, ts: str, name: str = "gap", bucket: Bucket = None) -> DataFrame:
    """Seconds since the key's row before."""
    return stretch.prior(df, key, ts, F.col(ts), "_before", bucket).withColumn(name, (F.col(ts) - F.col("_before")) / F.lit(1e6)).drop("_before")


def sequence_gaps(df: DataFrame, key: str, sequence: str, bucket: Bucket = None) -> DataFrame:
    """key, after, next, missing: places where a sequence number is skipped."""
    out = stretch.prior(df, key, sequence, F.col(sequence), "after", bucket).select(key, "after", F.col(sequence).alias("next"))
    return out.filter("next > after + 1").withColumn("missing", F.col("next") - F.col("after") - 1)


def numbered(df: DataFrame, key: str, order: str | Sequence[str], name: str = "number", bucket: Bucket = None) -> DataFrame:
    if not bucket:
        return df.withColumn(name, F.row_number().over(_by(key, order)))
    return stretch.total(df, key, order, F.lit(1), name, bucket).withColumn(name, F.col(name).cast("int"))


def equity(df: DataFrame, key: str, order: str, pnl: str, name: str = "equity", bucket: Bucket = None) -> DataFrame:
    return stretch.total(df, key, order, F.col(pnl), name, bucket)


def drawdowns(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], pnl: str, start: float = 0.0) -> DataFrame:
    """key and the three conventions of the greatest drawdown of the running sum of pnl, from `start` on.

    absolute: from the peak, which starts at `start`; fraction: of a positive peak (the start is one only if it is
    positive); negative: the least of equity less its own peak. Rows lie in ranges of (key, order), each folded to its
    sum and greatest prefix, so that no task holds a whole key.
    """
    keys, orders = stretch.names(key), stretch.names(order)
    rows = stretch.ranged(df.select(*dict.fromkeys([*keys, *orders, pnl])), keys, orders)
    out = stretch.peaked(rows, keys, orders, F.col(pnl), "_equity", "_own_peak", "_part", start)
    peak = F.greatest(F.lit(start), F.col("_own_peak"))
    fraction = peak if start > 0 else F.col("_own_peak")
    return out.groupBy(*keys).agg(
        F.max(peak - F.col("_equity")).alias("drawdown_absolute"),
        F.coalesce(F.max(F.when(fraction > 0, (fraction - F.col("_equity")) / F.nullif(fraction, F.lit(0.0)))), F.lit(0.0)).alias("drawdown_fraction"),
        F.min(F.col("_equity") - F.col("_own_peak")).alias("drawdown_negative"),
    )


def dispersion(df: DataFrame, group: str, ts: str, asset: str, value: str, assets: Sequence[str], age: int, bucket: Bucket = None) -> DataFrame:
    """For each row, the spread (max - min) of the assets' latest values no older than `age`, and the own value less their mean.

    All assets' latest values are carried in one pass over the group's rows.
    """
    values = {f"_latest{i}": ("latest", F.when(F.col(asset) == a, F.struct(ts, value))) for i, a in enumerate(assets)}
    out = stretch.carried(df, group, [ts, asset], values, bucket)
    fresh = F.array_compact(F.array(*[F.when(F.col(ts) - F.col(n)[ts] <= age, F.col(n)[value]) for n in values]))
    out = out.withColumn("_fresh", fresh).drop(*values)
    several = F.size("_fresh") >= 2
    mean = F.aggregate("_fresh", F.lit(0.0), lambda s, x: s + x) / F.size("_fresh")
    return out.withColumn("dispersion", F.when(several, F.array_max("_fresh") - F.array_min("_fresh"))).withColumn("relative", F.when(several, F.col(value) - mean)).drop("_fresh")


def equal_count_windows(df: DataFrame, at: str, n: int, name: str = "window") -> DataFrame:
    """The distinct values of `at` in n parts of equal number, 0 to n - 1, by rank * n // distinct values.

    The ranks are of distinct values, counted by range partitions.
    """
    ranked = ordinal(df.select(at).filter(F.col(at).isNotNull()).distinct(), [at], "_rank")
    total = ranked.count()
    ranked = ranked.withColumn(name, F.floor(F.col("_rank") * n / F.lit(max(1, total))).cast("int")).drop("_rank")
    return df.join(ranked, at)


def state_changes(df: DataFrame, key: str, order: str, state: str, bucket: Bucket = None) -> DataFrame:
    """Rows where the state differs from the one before, with that one as `previous`."""
    out = stretch.prior(df, key, order, F.col(state), "previous", bucket)
    return out.filter(~F.col(state).eqNullSafe(F.col("previous")))


def chain_violations(df: DataFrame, key: str, sequence: str, ts: str, own: str, previous: str, bucket: Bucket = None) -> DataFrame:
    """key, links, broken: rows that don't name the row before them, skip a number or go back in time."""
    df = stretch.prior(df, key, sequence, F.struct(sequence, ts, own), "_before", bucket)
    before = F.col("_before")
    bad = before.isNotNull() & ((before[own] != F.col(previous)) | (F.col(sequence) != before[sequence] + 1) | (F.col(ts) < before[ts]))
    return df.withColumn("_bad", F.coalesce(bad, F.lit(True)).cast("int")).groupBy(key).agg(F.count("*").alias("links"), F.sum("_bad").alias("broken"))


def halves(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key and the means of the value over the earlier and later half of its rows, and their difference."""
    w = Window.partitionBy(key)
    out = df.withColumn("_n", F.row_number().over(_by(key, order))).withColumn("_early", F.col("_n") <= F.floor(F.count("*").over(w) / 2))
    out = out.groupBy(key).agg(F.avg(F.when(F.col("_early"), F.col(value))).alias("early"), F.avg(F.when(~F.col("_early"), F.col(value))).alias("late"))
    return out.withColumn("decay", F.col("late") - F.col("early"))


def lagged_signal(df: DataFrame, key: str, order: str, value: str, steps: int, name: str = "lagged") -> DataFrame:
    return df.withColumn(name, F.lag(value, steps).over(_by(key, order)))
