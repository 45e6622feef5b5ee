"""Queries over trades of wallets: lines of orders (customer = wallet, part = market), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scores as K
from ..operators import wallets as W
from ..storage import written
from .tables import table
from .time_queries import _r

KEYS = ("wallet", "condition", "outcome")
CARRIED = ("asset_class", "market_type")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R is a sale (in small letters), N on line 7 neither; one market in four is of no known asset, a third isn't fast."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    market = F.col("l_partkey") % 40
    asset = F.element_at(F.array(*map(F.lit, ("other", "BTC", "ETH", "SOL"))), (market % 4 + 1).cast("int"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("wallet"),
        market.alias("condition"),
        F.when(F.col("l_linestatus") == "F", "Up").otherwise("Down").alias("outcome"),
        asset.alias("asset_class"),
        F.when(asset == "other", "other").when(market % 3 == 0, "crypto_other").otherwise("fast_crypto_up_down").alias("market_type"),
        F.when(F.col("l_returnflag") == "R", "sell").when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7), "HOLD").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("decimal(20,8)").alias("size"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(20,8)").alias("price"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"),
        F.when(F.col("l_discount") == 0, "none").when(F.col("l_discount") > 0.08, "wide;late").otherwise("late").alias("flags"),
        F.concat(F.lit("0xA"), F.col("l_suppkey") % 5).alias("tx"),
    )


TRADES = """tr AS (SELECT o_custkey AS wallet, l_partkey % 40 AS condition, CASE WHEN l_linestatus = 'F' THEN 'Up' ELSE 'Down' END AS outcome, (['other', 'BTC', 'ETH', 'SOL'])[l_partkey % 40 % 4 + 1] AS asset_class,
  CASE WHEN l_partkey % 40 % 4 = 0 THEN 'other' WHEN l_partkey % 40 % 3 = 0 THEN 'crypto_other' ELSE 'fast_crypto_up_down' END AS market_type,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 'HOLD' ELSE 'BUY' END AS side, l_quantity::DECIMAL(20,8) AS size, (l_extendedprice / l_quantity)::DECIMAL(20,8) AS price, l_orderkey * 10 + l_linenumber AS t,
  CASE WHEN l_discount = 0 THEN [] WHEN l_discount > 0.08 THEN ['wide', 'late'] ELSE ['late'] END AS flags, '0xa' || (l_suppkey % 5) AS tx FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
l0 AS (SELECT wallet, condition, outcome, any_value(asset_class) AS asset_class, any_value(market_type) AS market_type, coalesce(sum(size) FILTER (side = 'BUY'), 0)::DOUBLE AS bought, coalesce(sum(size) FILTER (side = 'SELL'), 0)::DOUBLE AS sold,
  coalesce(sum(size::DOUBLE * price::DOUBLE) FILTER (side = 'BUY'), 0) AS entry_cost, coalesce(sum(size::DOUBLE * price::DOUBLE) FILTER (side = 'SELL'), 0) AS exit_value, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, count(*) FILTER (side = 'HOLD') AS others,
  min(t) AS opened, max(t) AS last, flatten(list(flags)) AS flags, array_to_string(list_sort(list_distinct(list(tx))), ';') AS transactions FROM tr GROUP BY 1, 2, 3),
lc AS (SELECT *, greatest(bought - sold, 0) AS remaining, greatest(sold - bought, 0) AS oversold, CASE WHEN sold > bought THEN 'oversold_bounded_history' WHEN bought > 0 AND sold = 0 THEN 'still_open' WHEN bought > sold THEN 'partial_exit' WHEN bought = sold AND bought > 0 THEN 'full_exit' ELSE 'no_position_change' END AS status,
  coalesce(nullif(array_to_string(list_sort(list_distinct(list_concat(flags, CASE WHEN others > 0 THEN ['ignored_non_buy_sell_side'] ELSE [] END, CASE WHEN sold > bought THEN ['bounded_history_missing_prior_buy'] ELSE [] END))), ';'), ''), 'none') AS quality FROM l0),
ca AS (SELECT wallet, asset_class AS v, count(*) AS c FROM lc GROUP BY 1, 2), co AS (SELECT wallet, outcome AS v, count(*) AS c FROM lc GROUP BY 1, 2),
da AS (SELECT wallet, v AS dominant_asset, c / sum(c) OVER (PARTITION BY wallet) AS asset_concentration FROM ca QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY c DESC, v) = 1),
dc AS (SELECT wallet, v AS dominant_outcome, c / sum(c) OVER (PARTITION BY wallet) AS outcome_concentration FROM co QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY c DESC, v) = 1),
m0 AS (SELECT wallet, count(*) AS positions, count(*) FILTER (status = 'still_open') AS still_open, count(*) FILTER (status = 'partial_exit') AS partial_exit, count(*) FILTER (status = 'full_exit') AS full_exit, count(*) FILTER (status = 'oversold_bounded_history') AS oversold_bounded_history, count(*) FILTER (status = 'no_position_change') AS no_position_change,
  avg(CASE WHEN bought > 0 THEN bought ELSE sold END) AS mean_size, quantile_cont(CASE WHEN bought > 0 THEN bought ELSE sold END, 0.5) AS median_size, sum(buys)::BIGINT AS buys, sum(sells)::BIGINT AS sells, sum(sells) / count(*) AS sells_each, sum(buys + sells) / count(*) AS events_each,
  count(*) FILTER (status = 'still_open') / count(*) AS open_share, count(*) FILTER (buys = 0 AND sells > 0) / count(*) AS sell_only_share, count(*) FILTER (bought > 0 AND sold > 0 AND abs(bought - sold) > 0 AND abs(bought - sold) <= 0.1) AS near_flat,
  count(*) FILTER (market_type = 'fast_crypto_up_down') AS fast, count(*) FILTER (market_type = 'fast_crypto_up_down') / count(*) AS fast_share FROM lc GROUP BY 1),
wm AS (SELECT * FROM m0 JOIN da USING (wallet) JOIN dc USING (wallet)),
sp AS (SELECT *, CASE WHEN positions >= 50 THEN 25 WHEN positions >= 25 THEN 21 WHEN positions >= 10 THEN 15 WHEN positions >= 5 THEN 8 ELSE 0 END::DOUBLE AS coverage,
  least(25.0, 20 * fast_share + CASE WHEN fast >= 25 THEN 5 WHEN fast >= 10 THEN 4 WHEN fast >= 5 THEN 2 ELSE 0 END) AS fast_crypto,
  least(15, CASE WHEN partial_exit = 0 THEN 0 WHEN partial_exit / positions < 0.10 THEN 4 WHEN partial_exit / positions < 0.35 THEN 8 WHEN partial_exit / positions <= 0.75 THEN 12 ELSE 8 END + CASE WHEN sells_each > 0 THEN 3 ELSE 0 END)::DOUBLE AS lifecycle_activity,
  CASE WHEN events_each < 1 THEN 0 WHEN events_each < 2 THEN 8 WHEN events_each <= 8 THEN 15 WHEN events_each <= 20 THEN 11 ELSE 6 END::DOUBLE AS event_density,
  (CASE WHEN dominant_asset IN ('BTC', 'ETH', 'SOL') THEN 4 ELSE 0 END + CASE WHEN asset_concentration > 0.95 THEN 1 WHEN asset_concentration > 0.80 THEN 3 WHEN asset_concentration >= 0.30 THEN 4 ELSE 0 END + CASE WHEN outcome_concentration <= 0.70 THEN 2 ELSE 0 END)::DOUBLE AS specialization,
  least(15.0, 20 * sell_only_share) + least(5.0, 2.5 * oversold_bounded_history) AS bounded_history, CASE WHEN open_share > 0.90 THEN 15 WHEN open_share > 0.75 THEN 10 WHEN open_share > 0.50 THEN 5 ELSE 0 END::DOUBLE AS still_open_penalty,
  CASE WHEN positions < 5 THEN 20 WHEN positions <= 9 THEN 10 WHEN positions <= 14 THEN 5 ELSE 0 END::DOUBLE AS small_sample, (CASE WHEN asset_concentration > 0.95 THEN 5 ELSE 0 END + CASE WHEN outcome_concentration > 0.75 THEN 5 ELSE 0 END)::DOUBLE AS concentration,
  CASE WHEN near_flat / positions > 0.20 THEN 5 WHEN near_flat / positions > 0.05 THEN 2 ELSE 0 END::DOUBLE AS near_flat_ambiguity FROM wm),
sc AS (SELECT *, greatest(0.0, least(100.0, coverage + fast_crypto + lifecycle_activity + event_density + specialization - bounded_history - still_open_penalty - small_sample - concentration - near_flat_ambiguity)) AS score FROM sp),
sb AS (SELECT *, CASE WHEN score >= 75 THEN 'high_priority' WHEN score >= 50 THEN 'medium_priority' WHEN score >= 25 THEN 'low_priority' ELSE 'insufficient_visible_structure' END AS score_band FROM sc),
wl AS (SELECT *, array_to_string(list_filter(['bucket_' || score_band, 'minimum_visibility_passed', CASE WHEN fast_share >= 0.75 THEN 'fast_crypto_relevant' END, CASE WHEN fast_share = 0 THEN 'no_fast_crypto_visibility' END, CASE WHEN partial_exit > 0 THEN 'visible_partial_exit_activity' END,
  CASE WHEN open_share >= 0.90 THEN 'all_or_mostly_open_visibility' END, CASE WHEN bounded_history > 0 OR oversold_bounded_history > 0 THEN 'bounded_history_artifact_risk' END, CASE WHEN concentration > 0 THEN 'concentration_risk' END, CASE WHEN small_sample > 0 THEN 'small_visible_sample' END, CASE WHEN near_flat_ambiguity > 0 THEN 'near_flat_residual_ambiguity' END], lambda x: x IS NOT NULL), ';') AS reason_codes FROM sb WHERE positions >= 5)"""


def _positions(spark, sf_dir) -> DataFrame:
    return W.lifecycles(trades(spark, sf_dir), KEYS, CARRIED, ("t",), "tx", "flags")


def _measured(spark, sf_dir) -> DataFrame:
    """What metrics read of positions; written, as they read it several times."""
    p = _positions(spark, sf_dir)
    return written(p.select("wallet", "outcome", *CARRIED, "status", "bought", "sold", "remaining", "oversold", "buys", "sells"), "positions")


def _scores(spark, sf_dir) -> DataFrame:
    return K.wallet_scores(W.wallet_metrics(_measured(spark, sf_dir)))


def lifecycle_positions(spark, sf_dir):
    p = _positions(spark, sf_dir).select(*KEYS, *CARRIED, *[F.col(c).cast("double").alias(c) for c in ("bought", "sold", "remaining", "oversold")], "opened", "last", "buys", "sells", "others", "status", F.round("entry_cost", 4).alias("entry_cost"), F.round("exit_value", 4).alias("exit_value"), "quality", "transactions")
    return p


def lifecycle_conservation(spark, sf_dir):
    return W.conservation_violations(_positions(spark, sf_dir)).agg(F.count("*").alias("violations"))


METRICS = ("positions", *W.STATUSES, "buys", "sells", "near_flat", "fast", "dominant_asset", "dominant_outcome")
RATES = ("mean_size", "median_size", "sells_each", "events_each", "open_share", "sell_only_share", "fast_share", "asset_concentration", "outcome_concentration")


def wallet_metrics(spark, sf_dir):
    return W.wallet_metrics(_measured(spark, sf_dir)).select("wallet", *METRICS, *_r(*RATES))


def wallet_metrics_checks(spark, sf_dir):
    p = _measured(spark, sf_dir)
    return W.metrics_violations(W.wallet_metrics(p), p)


def lifecycle_totals(spark, sf_dir):
    return W.aggregate_summary(_positions(spark, sf_dir)).withColumn("status", F.coalesce("status", F.lit("all")))


def wallet_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("wallet", *_r(*K.COMPONENTS, *K.PENALTIES, "score"), "score_band")


def score_checks(spark, sf_dir):
    return K.score_violations(_scores(spark, sf_dir))


def score_ranges(spark, sf_dir):
    return K.component_ranges(_scores(spark, sf_dir)).select("component", *_r("low", "high", "range", "mean"))


def wallet_watchlist(spark, sf_dir):
    return K.watchlist(_scores(spark, sf_dir)).select("wallet", *_r("score"), "bucket", "bucket_order", "reason_codes", "strengths")


def copyability(spark, sf_dir):
    s = written(_scores(spark, sf_dir), "scores")
    return K.copyability(s, K.watchlist(s)).select("wallet", *_r("score"), "score_band", "included", "reason_codes", "confidence", "recommendation", "missing_evidence")


def _results(spark, sf_dir):
    return _positions(spark, sf_dir).filter("realized is not null").withColumn("won", F.col("realized") > 0)


def wallet_skill(spark, sf_dir):
    return W.skill(_results(spark, sf_dir), "wallet", "won").select("wallet", "n", "wins", *_r("rate", "population", "baseline", "z", "z_population", "z_random", "low", "high"), "evidence")


def skill_by_asset(spark, sf_dir):
    return W.skill(_results(spark, sf_dir), "asset_class", "won").select("asset_class", "n", "wins", *_r("rate", "baseline", "z_population", "low", "high"), "evidence")


def skill_verdict(spark, sf_dir):
    return W.h1_conclusion(W.skill(_results(spark, sf_dir), "wallet", "won")).select("above", "below", *_r("population"), "verdict")


def outcome_breakdown(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("resolution", F.when(F.col("won"), "matched_outcome").otherwise("unmatched_outcome"))
    return W.outcome_breakdown(r, "asset_class")


def _skill_sql(key: str, columns: str) -> str:
    half = "sqrt(r * (1 - r) / n + 1.96 * 1.96 / (4 * n * n)) * 1.96 / (1 + 1.96 * 1.96 / n)"
    centre = "(r + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)"
    return f"""WITH {TRADES}, o AS (SELECT {key}, count(*)::DOUBLE AS n, count(*) FILTER (exit_value / sold > entry_cost / bought)::DOUBLE AS k FROM lc WHERE bought > 0 AND sold > 0 GROUP BY 1),
b AS (SELECT *, k / n AS r, sum(k) OVER () / sum(n) OVER () AS p, coalesce((sum(k) OVER () - k) / nullif(sum(n) OVER () - n, 0), sum(k) OVER () / sum(n) OVER ()) AS b FROM o),
c AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (r - p) / sqrt(p * (1 - p) / n) ELSE 0 END AS zp, greatest(0.0, {centre} - {half}) AS lo, least(1.0, {centre} + {half}) AS hi FROM b),
d AS (SELECT *, CASE WHEN n < 30 THEN 'insufficient_evidence' WHEN zp >= 1.96 AND lo > 0.5 AND lo > p THEN 'above_baseline_evidence' WHEN zp <= -1.96 AND hi < p THEN 'below_baseline_evidence' ELSE 'sample_size_consistent_with_baseline' END AS evidence FROM c)
SELECT {columns} FROM d"""


_PARTS = ", ".join(f"round({c}, 6) AS {c}" for c in (*K.COMPONENTS, *K.PENALTIES, "score"))
_CHECKS = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", 0::BIGINT AS violations" for c in ("score_bounds", "part_bounds", "formula", "band", "wallet_present", "wallet_unique"))
_METRIC_CHECKS = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", 0::BIGINT AS violations" for c in ("status_counts", "size_conservation", "open_share", "sell_only_share", "fast_share", "asset_concentration", "outcome_concentration", "repeated_wallets", "positions_covered"))
_STRENGTHS = "coalesce(nullif(array_to_string(list_filter([CASE WHEN positions >= 25 THEN 'strong visible lifecycle coverage' ELSE 'minimum visible lifecycle coverage' END, CASE WHEN fast_share >= 0.75 THEN 'high fast-crypto lifecycle share' END, CASE WHEN partial_exit > 0 THEN 'visible partial-exit structure' END, CASE WHEN event_density >= 8 THEN 'visible repeated event density' END, CASE WHEN specialization >= 7 THEN 'interpretable market specialization' END], lambda x: x IS NOT NULL), '; '), ''), 'none')"

WALLETS = {
    "lifecycle_positions": (lifecycle_positions, f"WITH {TRADES} SELECT wallet, condition, outcome, asset_class, market_type, bought, sold, remaining, oversold, opened, last, buys, sells, others, status, round(entry_cost, 4) AS entry_cost, round(exit_value, 4) AS exit_value, quality, transactions FROM lc"),
    "lifecycle_conservation": (lifecycle_conservation, f"WITH {TRADES} SELECT count(*) AS violations FROM lc WHERE bought + oversold <> sold + remaining"),
    "wallet_metrics": (wallet_metrics, f"WITH {TRADES} SELECT wallet, {', '.join(METRICS)}, {', '.join(f'round({c}, 6) AS {c}' for c in RATES)} FROM wm"),
    "wallet_metrics_checks": (wallet_metrics_checks, _METRIC_CHECKS),
    "lifecycle_totals": (lifecycle_totals, f"WITH {TRADES} SELECT coalesce(status, 'all') AS status, count(*) AS n, sum(buys)::BIGINT AS buys, sum(sells)::BIGINT AS sells, count(*) FILTER (bought > 0 AND sold > 0 AND abs(bought - sold) > 0 AND abs(bought - sold) <= 0.1) AS near_flat, count(*) FILTER (buys = 0 AND sells > 0) AS sell_only FROM lc GROUP BY ROLLUP (status)"),
    "wallet_score": (wallet_score, f"WITH {TRADES} SELECT wallet, {_PARTS}, score_band FROM sb"),
    "score_checks": (score_checks, _CHECKS),
    "score_ranges": (score_ranges, f"WITH {TRADES}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS component, {c} AS x FROM sb" for c in (*K.COMPONENTS, *K.PENALTIES)) + ') SELECT component, round(min(x), 6) AS low, round(max(x), 6) AS high, round(max(x) - min(x), 6) AS "range", round(avg(x), 6) AS mean FROM u GROUP BY 1'),
    "wallet_watchlist": (wallet_watchlist, f"WITH {TRADES} SELECT wallet, round(score, 6) AS score, score_band AS bucket, CASE score_band WHEN 'high_priority' THEN 0 WHEN 'medium_priority' THEN 1 WHEN 'low_priority' THEN 2 ELSE 3 END AS bucket_order, reason_codes, {_STRENGTHS} AS strengths FROM wl"),
    "copyability": (copyability, f"""WITH {TRADES} SELECT sb.wallet, round(sb.score, 6) AS score, sb.score_band, CASE WHEN wl.wallet IS NULL THEN 'excluded_minimum_visibility' ELSE 'included' END AS included, coalesce(wl.reason_codes, 'minimum_visibility_failed') AS reason_codes,
 CASE WHEN sb.positions >= 25 AND sb.fast_share >= 0.5 AND sb.open_share < 0.75 AND sb.oversold_bounded_history = 0 THEN 'medium_structural' WHEN sb.positions >= 10 THEN 'low_to_medium_structural' WHEN sb.positions >= 5 THEN 'low_structural' ELSE 'insufficient_visible_history' END AS confidence,
 CASE WHEN wl.wallet IS NOT NULL AND sb.score >= 50 AND sb.positions >= 15 AND sb.fast_share >= 0.5 AND sb.open_share < 0.9 THEN 'monitor_candidate' WHEN wl.wallet IS NOT NULL AND sb.score >= 25 AND sb.score < 75 THEN 'needs_more_history' WHEN sb.positions >= 5 THEN 'insufficient_signal' ELSE 'exclude_for_now' END AS recommendation,
 array_to_string(list_filter([CASE WHEN sb.open_share >= 0.9 THEN 'later exits beyond bounded window' END, CASE WHEN sb.oversold_bounded_history > 0 THEN 'prior buys before bounded window' END, CASE WHEN sb.fast_share = 0 THEN 'fast crypto relevance' END], lambda x: x IS NOT NULL), '; ') AS missing_evidence FROM sb LEFT JOIN wl USING (wallet)"""),
    "wallet_skill": (wallet_skill, _skill_sql("wallet", "wallet, n::BIGINT AS n, k::BIGINT AS wins, round(r, 6) AS rate, round(p, 6) AS population, round(b, 6) AS baseline, round(CASE WHEN b > 0 AND b < 1 THEN (r - b) / sqrt(b * (1 - b) / n) ELSE 0 END, 6) AS z, round(zp, 6) AS z_population, round((r - 0.5) / sqrt(0.25 / n), 6) AS z_random, round(lo, 6) AS low, round(hi, 6) AS high, evidence")),
    "skill_by_asset": (skill_by_asset, _skill_sql("asset_class", "asset_class, n::BIGINT AS n, k::BIGINT AS wins, round(r, 6) AS rate, round(b, 6) AS baseline, round(zp, 6) AS z_population, round(lo, 6) AS low, round(hi, 6) AS high, evidence")),
    "skill_verdict": (skill_verdict, _skill_sql("wallet", "count(*) FILTER (evidence = 'above_baseline_evidence') AS above, count(*) FILTER (evidence = 'below_baseline_evidence') AS below, round(max(p), 6) AS population, CASE WHEN count(*) FILTER (evidence = 'above_baseline_evidence') >= 2 AND count(*) FILTER (evidence = 'below_baseline_evidence') = 0 AND max(p) >= 0.53 THEN 'SUPPORTED' WHEN count(*) FILTER (evidence = 'above_baseline_evidence') = 0 AND max(p) <= 0.51 THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS verdict")),
    "outcome_breakdown": (outcome_breakdown, f"WITH {TRADES} SELECT asset_class, count(*) AS resolved, count(*) FILTER (exit_value / sold > entry_cost / bought) AS matched, count(*) FILTER (NOT exit_value / sold > entry_cost / bought) AS unmatched FROM lc WHERE bought > 0 AND sold > 0 GROUP BY 1"),
}
