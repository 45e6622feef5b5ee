"""Models against baselines: metrics by scope, deltas of predictions, feature drift, advancement, verdicts, continuity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, clip_probability, first_reason, wilson_open
from ..storage import written
from .metrics import probability_metrics
from .order import ordinal
from .ranks import of_columns
from .series import drawdowns, equal_count_windows

# A redundant correlation, the least rows of a regime, what a candidate must gain and may lose, assets it must win.
REDUNDANT, LEAST_REGIME, GAIN, LOSS, LEAST_ASSETS = 0.95, 20, 0.01, -0.005, 2
QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def log_loss(outcome: Column, p: Column) -> Column:
    q, y = clip_probability(p), outcome.cast("double")
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def long_predictions(df: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep, model, p: a row for each model's column."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models])).alias("r")).select(*keep, "r.*")


def evaluation(df: DataFrame, outcome: str, models: Sequence[str], asset: str, window: str, periods: int = 3) -> DataFrame:
    """scope, value, model and probability metrics: overall, by asset, and by period of equally many windows, in one pass.

    Each row is expanded to its scopes before the map-side aggregation.
    """
    rows = equal_count_windows(df, window, periods, "_period")
    rows = long_predictions(rows, models, [outcome, asset, "_period"])
    scope = lambda name, value: F.struct(F.lit(name).alias("scope"), value.cast("string").alias("value"))
    scopes = F.array(scope("overall", F.lit("all")), scope("asset", F.col(asset)), scope("period", F.col("_period") + 1))
    return probability_metrics(rows.withColumn("_s", F.explode(scopes)).select(outcome, "model", "p", "_s.*"), outcome, "p", ["scope", "value", "model"])


def calibration_by_scope(df: DataFrame, outcome: str, models: Sequence[str], asset: str, bins: int = 10) -> DataFrame:
    """scope (`overall` or an asset), model, bin, n, mean_p, rate of the bins that have rows."""
    rows = long_predictions(df, models, [outcome, asset])
    scoped = rows.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col(asset).cast("string"))))
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return scoped.groupBy("scope", "model", bin_).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col(outcome).cast("double")).alias("rate"))


def prediction_deltas(df: DataFrame, outcome: str, candidate: str, baseline: str) -> DataFrame:
    """One row: n, rows where the candidate's log loss is less, mean, median and quantiles of both losses' differences."""
    y = F.col(outcome).cast("double")
    log = log_loss(y, F.col(candidate)) - log_loss(y, F.col(baseline))
    brier = F.pow(F.col(candidate) - y, 2) - F.pow(F.col(baseline) - y, 2)
    rows = df.select(log.alias("log"), brier.alias("brier"))
    rows = written(rows, "deltas")  # read for the means and for the ranks of both
    wanted = {"median": ("linear", 0.5)} | {f"q{i}": ("linear", q) for i, q in enumerate(QUANTILES)}
    found = of_columns(rows, ["log", "brier"], wanted)
    several = lambda c: F.array(*[F.lit(found[c][f"q{i}"]).cast("double") for i in range(len(QUANTILES))])
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("log") < 0, 1)).alias("better"), F.avg("log").alias("mean_log"), F.lit(found["log"]["median"]).cast("double").alias("median_log"), F.avg("brier").alias("mean_brier"), several("log").alias("log_quantiles"), several("brier").alias("brier_quantiles"))


def winners(metrics: DataFrame, by: Sequence[str], candidate: str, baseline: str) -> DataFrame:
    """by, n and `winner`: candidate or baseline where it has both lesser losses, else mixed; from metrics with a model column."""
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    out = metrics.groupBy(*by).agg(F.max("n").alias("n"), *[of(m, c).alias(f"{k}_{c}") for k, m in (("a", candidate), ("b", baseline)) for c in ("log_loss", "brier")])
    wins = (F.col("a_log_loss") < F.col("b_log_loss")) & (F.col("a_brier") < F.col("b_brier"))
    loses = (F.col("b_log_loss") <= F.col("a_log_loss")) & (F.col("b_brier") <= F.col("a_brier"))
    return out.withColumn("winner", F.when(wins, candidate).when(loses, baseline).otherwise("mixed"))


def incremental_summary(groups: DataFrame, regimes: DataFrame, baseline_log: float, baseline_brier: float) -> DataFrame:
    """kind, name: groups that beat the baseline on both losses, those that beat it on neither, regimes of 20 rows or more that do.

    groups has name, log_loss and brier; regimes is `winners` by name.
    """
    beats = (F.col("log_loss") < baseline_log) & (F.col("brier") < baseline_brier)
    loses = (F.col("log_loss") >= baseline_log) & (F.col("brier") >= baseline_brier)
    own = groups.select(F.when(beats, "group_beats").when(loses, "group_dominated").alias("kind"), "name").filter("kind is not null")
    rest = regimes.filter((F.col("n") >= LEAST_REGIME) & (F.col("a_log_loss") < F.col("b_log_loss")) & (F.col("a_brier") < F.col("b_brier"))).select(F.lit("regime_beats").alias("kind"), "name")
    return own.unionByName(rest)


def conclusion(summary: DataFrame) -> DataFrame:
    """One row: WEAK_INFORMATION_PRESENT with a group that beats the baseline, REGIME_SPECIFIC_SIGNAL_PRESENT with a regime only, else FEATURE_SET_INCOMPLETE."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    one = summary.agg(n("group_beats").alias("groups"), n("regime_beats").alias("regimes"))
    return one.withColumn("conclusion", first_reason((F.col("groups") > 0, "WEAK_INFORMATION_PRESENT"), (F.col("regimes") > 0, "REGIME_SPECIFIC_SIGNAL_PRESENT"), otherwise="FEATURE_SET_INCOMPLETE"))


def feature_diagnostics(df: DataFrame, features: Sequence[str], outcome: str, part: str, train: str = "train", validation: str = "validation") -> DataFrame:
    """feature, means, deviations and missing rates of both parts, standardised drift, correlation with the outcome, redundancy.

    Missing values become the training median. Correlations with other features are those of the training part; a
    feature's `redundant_with` are those at 0.95 or more either way. Two passes: medians, then all sums.
    """
    known = df.filter(F.col(part).isin(train, validation))
    medians = of_columns(known.filter(F.col(part) == train), features, {"median": ("linear", 0.5)})
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(medians[f]["median"] or 0.0)) for f in features}
    filled = known.select(part, F.col(outcome).cast("double").alias("_y"), *[x[f].alias(f) for f in features], *[F.col(f).isNull().cast("double").alias(f"_m_{f}") for f in features])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    corr = lambda a, b: F.coalesce(F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))), F.lit(0.0))
    sums = filled.groupBy(part).agg(
        *[a.alias(f"{k}_{f}") for f in features for k, a in (("mean", F.avg(f)), ("std", F.stddev_pop(f)), ("missing", F.avg(f"_m_{f}")), ("corr", corr(f, "_y")))],
        *[corr(a, b).alias(f"pair_{a}|{b}") for a, b in pairs],
    )
    rows = {r[part]: r.asDict() for r in sums.collect()}  # two rows
    out = []
    for f in features:
        t, v = rows.get(train, {}), rows.get(validation, {})
        mine = {b if a == f else a: t.get(f"pair_{a}|{b}", 0.0) or 0.0 for a, b in pairs if f in (a, b)}
        std = t.get(f"std_{f}") or 0.0
        drift = ((v.get(f"mean_{f}") or 0.0) - (t.get(f"mean_{f}") or 0.0)) / std if std else 0.0
        out.append((f, t.get(f"mean_{f}"), v.get(f"mean_{f}"), t.get(f"std_{f}"), v.get(f"std_{f}"), drift, t.get(f"missing_{f}"), v.get(f"missing_{f}"), t.get(f"corr_{f}"), v.get(f"corr_{f}"), max(map(abs, mine.values()), default=0.0), "|".join(b for b in features if abs(mine.get(b, 0.0)) >= REDUNDANT)))
    return df.sparkSession.createDataFrame(out, "feature string, train_mean double, validation_mean double, train_std double, validation_std double, drift double, train_missing double, validation_missing double, train_corr double, validation_corr double, max_corr double, redundant_with string")


def advancement(metrics: DataFrame, candidate: str, baselines: Sequence[str], price: str) -> DataFrame:
    """One row: beats_all, rule, assets_won and `passes`, from `evaluation`.

    The candidate must have both lesser losses than every baseline overall; against the price, one of them must be 1%
    better and neither over 0.5% worse; and it must beat the price on both losses for two assets.
    """
    of = lambda m, c, s: F.max(F.when((F.col("model") == m) & (F.col("scope") == s), F.col(c)))
    whole = metrics.agg(*[of(m, c, "overall").alias(f"{m}_{c}") for m in (candidate, *baselines) for c in ("log_loss", "brier")])
    beats = F.lit(True)
    for b in baselines:
        for c in ("log_loss", "brier"):
            beats = beats & (F.col(f"{candidate}_{c}") < F.col(f"{b}_{c}"))
    gain = [(F.col(f"{price}_{c}") - F.col(f"{candidate}_{c}")) / F.col(f"{price}_{c}") for c in ("log_loss", "brier")]
    rule = (F.greatest(*gain) >= GAIN) & (F.least(*gain) >= LOSS)
    won = winners(metrics.filter("scope = 'asset'"), ["value"], candidate, price).agg(F.count(F.when(F.col("winner") == candidate, 1)).alias("assets_won"))
    out = whole.select(F.coalesce(beats, F.lit(False)).alias("beats_all"), F.coalesce(rule, F.lit(False)).alias("rule")).crossJoin(F.broadcast(won))  # two single rows
    return out.withColumn("passes", F.col("beats_all") & F.col("rule") & (F.col("assets_won") >= LEAST_ASSETS))


def best_model(metrics: DataFrame) -> DataFrame:
    """One row: the model of the least log loss, then Brier score, then name, among overall metrics."""
    return metrics.filter("scope = 'overall'").agg(F.min(F.struct("log_loss", "brier", "model")).alias("b")).select("b.model", "b.log_loss", "b.brier")


# Evidence


def evidence_metrics(trades: DataFrame, order: str, markets: int, windows: int, opportunities: int, expected: tuple[int, int], seen: tuple[int, int], start: float = 10_000.0) -> DataFrame:
    """One row of a session's evidence; trades has pnl and quantity, expected and seen are of reference and market points.

    The drawdown is relative to the peak of an account; decay compares the halves of the trades; latency takes 20 basis
    points a share off. Places and the drawdown are counted by ranges of the order.
    """
    rows = ordinal(trades.select(order, "pnl", "quantity", F.lit(0).alias("_all")), [order], "_place")
    deep = drawdowns(rows, "_all", order, "pnl", start).select(F.max("drawdown_fraction").alias("_deep"))
    half = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("_half"))
    rows = rows.crossJoin(F.broadcast(half)).crossJoin(F.broadcast(deep))  # single rows
    n, total = F.count("*"), F.coalesce(F.sum("pnl"), F.lit(0.0))
    early = F.coalesce(F.sum(F.when(F.col("_place") < F.col("_half"), F.col("pnl"))), F.lit(0.0))
    cost = F.coalesce(F.sum(F.col("quantity") * 0.002), F.lit(0.0))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return rows.agg(
        F.lit(markets).alias("markets"),
        F.lit(windows).alias("windows"),
        F.round(F.lit(opportunities / windows if windows else 0.0), 6).alias("opportunity_rate"),
        n.alias("trades"),
        F.round(total, 6).alias("pnl"),
        F.round(F.coalesce(F.try_divide(F.count(F.when(F.col("pnl") > 0, 1)), n), F.lit(0.0)), 6).alias("win_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)), 6).alias("mean_win"),
        F.round(F.coalesce(F.avg(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0)), 6).alias("mean_loss"),
        F.round(F.coalesce(F.max("_deep"), F.lit(0.0)), 8).alias("max_drawdown"),
        F.round(unit((2 * early - total) / F.greatest(F.abs(early), F.lit(1.0))), 6).alias("edge_decay"),
        F.round(unit(cost / F.greatest(F.abs(total), F.lit(1.0))), 6).alias("latency_sensitivity"),
        F.round(F.lit(100.0 * seen[0] / expected[0] if expected[0] else 0.0), 4).alias("reference_coverage"),
        F.round(F.lit(100.0 * (1 - seen[1] / expected[1]) if expected[1] else 100.0), 4).alias("data_gap"),
    )


# Fixed bounds of a verdict on evidence.
EVIDENCE = {"windows": 30, "trades": 20, "coverage": 0.95, "gap": 0.10, "drawdown": 0.05, "decay": 0.50, "latency": 0.50}


def evidence_verdict(bounds: dict[str, float] = EVIDENCE) -> Column:
    """INSUFFICIENT_DATA, NO_EDGE, POTENTIAL_EDGE or WEAK_EDGE, of the columns of `evidence_metrics`."""
    c = F.col
    thin = (c("windows") < bounds["windows"]) | (c("trades") < bounds["trades"]) | (c("reference_coverage") / 100 < bounds["coverage"]) | (c("data_gap") / 100 > bounds["gap"])
    none = (c("pnl") <= 0) | (c("win_rate") < 0.45) | (c("max_drawdown") > 2 * bounds["drawdown"]) | (c("edge_decay") > 0.80)
    good = (c("win_rate") >= 0.50) & (c("max_drawdown") <= bounds["drawdown"]) & (c("edge_decay") <= bounds["decay"]) & (c("latency_sensitivity") <= bounds["latency"])
    return first_reason((thin, "INSUFFICIENT_DATA"), (none, "NO_EDGE"), (good, "POTENTIAL_EDGE"), otherwise="WEAK_EDGE")


#: Events that end a capture (fixed values).
FATAL = ("capture_fatal_error", "fatal_capture_error", "fatal_error")


def continuity(events: DataFrame, session: str = "session") -> DataFrame:
    """One row a session: checkpoints against those expected, gaps between start, checkpoints and end, and whether it is continuous.

    events has session, event, t (microseconds) and, of session_started, duration and interval in seconds. A session
    fails with under 0.99 of its time or 0.95 of its checkpoints, a gap over 300 s, no end, or a fatal error.
    """
    of = lambda kind, f, c: f(F.when(F.col("event") == kind, F.col(c)))
    marks = events.filter(F.col("event").isin("session_started", "capture_checkpoint", "session_completed"))
    marks = marks.groupBy(session, "event", "t").agg(F.max("duration").alias("duration"), F.max("interval").alias("interval"))
    before = F.lag("t").over(Window.partitionBy(session).orderBy("t", F.expr("case event when 'session_started' then 0 when 'capture_checkpoint' then 1 else 2 end")))
    marks = marks.withColumn("gap", (F.col("t") - before) / F.lit(1e6))
    gap = lambda s: F.count(F.when(F.col("gap") > s, 1))
    out = marks.groupBy(session).agg(
        of("session_started", F.min, "t").alias("_a"),
        of("session_completed", F.max, "t").alias("_z"),
        of("capture_checkpoint", F.min, "t").alias("first"),
        of("capture_checkpoint", F.max, "t").alias("last"),
        F.max("duration").alias("duration"),
        F.max("interval").alias("interval"),
        F.count(F.when(F.col("event") == "capture_checkpoint", 1)).alias("checkpoints"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"),
        gap(10).alias("gaps_over_10"),
        gap(60).alias("gaps_over_60"),
        gap(300).alias("gaps_over_300"),
    )
    fatal = events.filter(F.col("event").isin(*FATAL)).groupBy(session).agg(F.count("*").alias("fatal"))
    out = out.join(fatal, session, "left").withColumn("fatal", F.coalesce("fatal", F.lit(0)))
    expected = F.greatest(F.lit(1), F.ceil(F.col("duration") / F.col("interval")))
    span = F.when(F.col("_z").isNotNull(), F.greatest(F.lit(0.0), (F.col("_z") - F.col("_a")) / F.lit(1e6))).otherwise(0.0)
    out = out.withColumns({"expected": expected, "coverage": F.least(F.lit(1.0), F.col("checkpoints") / expected), "time_coverage": F.least(F.lit(1.0), F.coalesce(F.try_divide(span, "duration"), F.lit(0.0))), "terminal_gap": F.coalesce((F.col("_z") - F.col("last")) / F.lit(1e6), span)})
    checks = ((F.col("time_coverage") < 0.99, "temporal_coverage_below_99_percent"), (F.col("coverage") < 0.95, "checkpoint_coverage_below_95_percent"), (F.col("max_gap") > 300, "checkpoint_gap_over_300_seconds"), (F.col("_z").isNull(), "session_completed_missing"), (F.col("fatal") > 0, "fatal_capture_errors_present"))
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return out.withColumn("reasons", found).withColumn("status", F.when(F.size("reasons") == 0, "continuous").otherwise("incomplete")).drop("_a", "_z")


def progress(counts: DataFrame, asset: str, target: int, each: int) -> DataFrame:
    """scope, current, target, percentage (100 at most): all rows, and each asset's."""
    own = counts.groupBy(F.col(asset).cast("string").alias("scope")).agg(F.count("*").alias("current")).withColumn("target", F.lit(each))
    whole = counts.agg(F.count("*").alias("current")).select(F.lit("total").alias("scope"), "current", F.lit(target).alias("target"))
    return own.unionByName(whole).withColumn("percentage", F.round(100 * F.least(F.lit(1.0), F.col("current") / F.col("target")), 2))


def batch_verdict(rows: DataFrame, recommended: bool) -> DataFrame:
    """One row: INSUFFICIENT_PUBLIC_SAMPLE while a scope of `progress` is under its target, else by the quality gates."""
    short = F.count(F.when(F.col("current") < F.col("target"), 1))
    return rows.agg(short.alias("short")).withColumn("verdict", F.when(F.col("short") > 0, "INSUFFICIENT_PUBLIC_SAMPLE").when(F.lit(recommended), "DATA_GATE_PASSED").otherwise("DATA_QUALITY_FAILED"))


def hypothesis_status(successes: Column, trials: Column, ready: Column, support: tuple[float, float], reject: tuple[float, float]) -> Column:
    """SUPPORTED if the share and its lower bound reach `support`, REJECTED if it and the upper one are within `reject`."""
    point, interval = F.coalesce(F.try_divide(successes, trials), F.lit(0.0)), wilson_open(successes, trials)
    return F.when(ready & (point >= support[0]) & (interval["low"] >= support[1]), "SUPPORTED").when(ready & (point <= reject[0]) & (interval["high"] <= reject[1]), "REJECTED").otherwise("INCONCLUSIVE")


# Fixed bounds of evidence on visibility and decision time.
GATES = {"trades": 100, "wallets": 3, "each_wallet": 10, "wallet_share": 0.60, "sessions": 10, "dates": 5, "assets": 2, "each_asset": 20, "complete": 0.95}


def hypothesis_gates(evidence: DataFrame, sessions: int, requests: tuple[int, int], bounds: dict[str, float] = GATES) -> DataFrame:
    """gate, value, passed over evidence rows (wallet, asset, delay, window, day, trade); requests are those that succeeded and failed."""
    one = evidence.agg(F.count("*").alias("n"), F.count("delay").alias("d"), F.count("window").alias("w"), F.countDistinct("trade").alias("ids"), F.countDistinct("day").alias("days"))
    for c in ("wallet", "asset"):
        each = evidence.groupBy(c).agg(F.count("*").alias("k")).agg(F.count("*").alias(f"{c}s"), F.coalesce(F.min("k"), F.lit(0)).alias(f"least_{c}"), F.coalesce(F.max("k"), F.lit(0)).alias(f"most_{c}"))
        one = one.crossJoin(F.broadcast(each))  # two single rows
    rate = requests[0] / sum(requests) if sum(requests) else 0.0
    share = lambda c: F.coalesce(F.try_divide(c, "n"), F.lit(0.0))
    v, b = F.col, bounds
    gates = [
        ("eligible_trades", v("n"), v("n") >= b["trades"]),
        ("wallet_count", v("wallets"), v("wallets") >= b["wallets"]),
        ("trades_per_wallet", v("least_wallet"), (v("wallets") >= b["wallets"]) & (v("least_wallet") >= b["each_wallet"])),
        ("wallet_concentration", share("most_wallet"), (v("n") > 0) & (share("most_wallet") <= b["wallet_share"])),
        ("sessions", F.lit(sessions), F.lit(sessions >= b["sessions"])),
        ("dates", v("days"), v("days") >= b["dates"]),
        ("asset_count", v("assets"), v("assets") >= b["assets"]),
        ("trades_per_asset", v("least_asset"), (v("assets") >= b["assets"]) & (v("least_asset") >= b["each_asset"])),
        ("timestamp_completeness", share("d"), share("d") >= b["complete"]),
        ("expiry_completeness", share("w"), share("w") >= b["complete"]),
        ("identity_uniqueness", share("ids"), share("ids") == 1),
        ("request_completeness", F.lit(rate), F.lit(rate >= b["complete"])),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), x.cast("double").alias("value"), p.alias("passed")) for g, x, p in gates])).alias("r")).select("r.*")


def coefficient_stability(mean: Column, deviation: Column) -> Column:
    """100 / (1 + deviation / |mean|), from 0 to 100; without a mean, 100 for a constant and 0 else."""
    size = F.abs(mean)
    return F.round(clip(F.when(size < 1e-9, F.when(deviation > 0, 0.0).otherwise(100.0)).otherwise(100 / (1 + deviation / F.nullif(size, F.lit(0.0)))), 0.0, 100.0), 2)


def downside_ratio(value: Column, reference: Column) -> Column:
    return F.when(reference <= 0, 0.0).otherwise(clip(F.try_divide(value, F.nullif(reference, F.lit(0.0))), 0.0, 1.0))


def robustness(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: consistency, noise resilience, stability, drawdown control, their weighted score, and the verdict.

    runs has kind (baseline, noise, dropout, signal_lag, execution_latency), pnl, drawdown and trades of each scenario;
    windows window and pnl of the baseline's windows. POTENTIAL_ALPHA needs a score of 60, gains in all noise, dropout
    and latency runs and in two thirds of the lagged ones, and in 60% of windows with a trade each.
    """
    w = windows.agg(F.count("*").alias("w"), F.avg((F.col("pnl") > 0).cast("double")).alias("ratio"), F.avg("pnl").alias("m"), F.when(F.count("*") > 1, F.stddev_pop("pnl")).otherwise(0.0).alias("d"), F.max(F.abs("pnl")).alias("big"))
    of = lambda c: F.max(F.when(F.col("kind") == "baseline", F.col(c)))
    base = runs.agg(of("pnl").alias("b"), of("drawdown").alias("dd"), of("trades").alias("t"))
    rows = runs.filter("kind <> 'baseline'").crossJoin(F.broadcast(base))  # a single row
    noisy, lag, late = F.col("kind").isin("noise", "dropout"), F.col("kind") == "signal_lag", F.col("kind") == "execution_latency"
    wins = lambda c: F.avg(F.when(c, (F.col("pnl") > 0).cast("double")))
    part = rows.agg(F.avg(F.when(noisy, downside_ratio(F.col("pnl"), F.col("b")))).alias("resilience"), wins(noisy).alias("n"), wins(lag).alias("l"), wins(late).alias("e"))
    one = part.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(w))  # single rows
    score = lambda x: F.round(clip(x, 0.0, 100.0), 2)
    one = one.withColumns({"consistency": score(100 * F.col("ratio")), "noise_resilience": score(100 * F.coalesce("resilience", F.lit(0.0))), "stability": F.when(F.col("big") < 1e-9, 0.0).otherwise(coefficient_stability(F.col("m"), F.col("d"))), "drawdown_control": score(100 * (1 - F.least(F.lit(1.0), F.col("dd") / 0.20)))})
    one = one.withColumn("score", score(0.30 * F.col("consistency") + 0.25 * F.col("noise_resilience") + 0.25 * F.col("stability") + 0.20 * F.col("drawdown_control")))
    ok = (F.col("score") >= 60) & (F.col("n") == 1) & (F.col("e") == 1) & (F.col("l") >= 2 / 3) & (F.col("ratio") >= 0.60) & (F.col("b") > 0) & (F.col("t") >= F.col("w"))
    return one.select("consistency", "noise_resilience", "stability", "drawdown_control", "score", F.when(F.coalesce(ok, F.lit(False)), "POTENTIAL_ALPHA").otherwise("OVERFIT_OR_INCONCLUSIVE").alias("verdict"))


def out_of_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, violations: values outside 0 to 1."""
    bad = [F.count(F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), 1)).alias(c) for c in columns]
    return df.agg(*bad).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns])).alias("r")).select("r.*")


def repricing_summary(rows: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """One row a session: n, wins, pnl before and after costs, mean excursions, drawdown, expectancy and signals an hour.

    rows has session, t (microseconds), won, before, after, mfe and mae; a session's rows are sorted for the drawdown.
    """
    hours = F.greatest((F.max("t") - F.min("t")) / F.lit(3.6e9), F.lit(1e-9))
    out = rows.groupBy(session).agg(F.count("*").alias("n"), F.count(F.when(F.col("won"), 1)).alias("wins"), F.sum("before").alias("pnl_before"), F.sum("after").alias("pnl_after"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"), F.avg("after").alias("expectancy"), F.when(F.max("t") > F.min("t"), F.count("*") / hours).alias("per_hour"))
    deep = drawdowns(rows, session, list(order), "after").select(session, F.col("drawdown_absolute").alias("max_drawdown"))
    return out.join(deep, session).withColumn("win_rate", F.try_divide("wins", "n"))
