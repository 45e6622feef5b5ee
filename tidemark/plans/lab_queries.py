"""Queries of model evaluation, evidence and short-market experiments over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import evaluation as V
from ..operators import governance as G
from ..operators import lab as L
from ..operators import refits as FG
from ..operators import stats as S
from .table_queries import SCORED, _scored
from .tables import table
from .time_queries import _r


def _models(spark, sf_dir):
    s = _scored(spark, sf_dir)
    h = F.pmod("doc_id", F.lit(7))
    return s.withColumns({"asset": F.coalesce("lang", F.lit("none")), "window": F.pmod("doc_id", F.lit(31)), "candidate": F.round(F.least(F.lit(0.99), 0.9 * F.col("p") + 0.01 * h), 4), "price": F.col("p"), "prior": F.lit(0.4)})


MODELS = f"""{SCORED}, mo AS (SELECT *, coalesce(lang, 'none') AS asset, doc_id % 31 AS w, round(least(0.99, 0.9 * p + 0.01 * (doc_id % 7)), 4) AS candidate, p AS price, 0.4 AS prior FROM s),
ml AS (SELECT doc_id, y, asset, w, 'candidate' AS model, candidate::DOUBLE AS q FROM mo UNION ALL SELECT doc_id, y, asset, w, 'price', price FROM mo UNION ALL SELECT doc_id, y, asset, w, 'prior', prior FROM mo),
wr AS (SELECT w, (row_number() OVER (ORDER BY w) - 1) * 3 // count(*) OVER () + 1 AS period FROM (SELECT DISTINCT w FROM mo)),
me AS (SELECT 'overall' AS scope, 'all' AS value, model, y, q FROM ml UNION ALL SELECT 'asset', asset, model, y, q FROM ml UNION ALL SELECT 'period', period::VARCHAR, model, y, q FROM ml JOIN wr USING (w)),
mx AS (SELECT scope, value, model, count(*) AS n, avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, q))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, q))))) AS log_loss, avg((q - y) * (q - y)) AS brier, count(*) FILTER ((q >= 0.5) = (y = 1)) / count(*) AS accuracy FROM me GROUP BY 1, 2, 3)"""

NAMES = ["candidate", "price", "prior"]


def _evaluated(spark, sf_dir):
    return V.evaluation(_models(spark, sf_dir), "y", NAMES, "asset", "window")


def model_evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("scope", "value", "model", "n", *_r("log_loss", "brier", "accuracy"))


def model_winners(spark, sf_dir):
    return V.winners(_evaluated(spark, sf_dir), ["scope", "value"], "candidate", "price").select("scope", "value", "n", "winner")


def advancement_rule(spark, sf_dir):
    return V.advancement(_evaluated(spark, sf_dir), "candidate", ["price", "prior"], "price")


def best_model(spark, sf_dir):
    return V.best_model(_evaluated(spark, sf_dir)).select("model", *_r("log_loss", "brier"))


def calibration_scopes(spark, sf_dir):
    return V.calibration_by_scope(_models(spark, sf_dir), "y", NAMES, "asset").select("scope", "model", "bin", "n", *_r("mean_p", "rate"))


def prediction_deltas(spark, sf_dir):
    d = V.prediction_deltas(_models(spark, sf_dir), "y", "candidate", "price")
    return d.select("n", "better", *_r("mean_log", "median_log", "mean_brier"), F.round(F.element_at("log_quantiles", 1), 6).alias("log_p10"), F.round(F.element_at("log_quantiles", 5), 6).alias("log_p90"), F.round(F.element_at("brier_quantiles", 3), 6).alias("brier_p50"))


def incremental_summary(spark, sf_dir):
    e = _evaluated(spark, sf_dir)
    base = e.filter("scope = 'overall' and model = 'price'").first()
    groups = e.filter("scope = 'overall' and model <> 'price'").select(F.col("model").alias("name"), "log_loss", "brier")
    regimes = V.winners(e.filter("scope <> 'overall'"), ["scope", "value"], "candidate", "price").withColumn("name", F.concat_ws("_", "scope", "value"))
    return V.incremental_summary(groups, regimes, base.log_loss, base.brier)


def feature_diagnostics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") < 6, F.col("l_discount")).alias("l_discount"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.when(F.col("l_orderkey") % 4 == 0, "validation").otherwise("train").alias("part")
    )
    d = V.feature_diagnostics(lines, ["l_quantity", "l_extendedprice", "l_discount", "twice"], "y", "part")
    return d.select("feature", *[F.round(c, 5).alias(c) for c in ("train_mean", "validation_mean", "train_std", "validation_std", "drift", "train_missing", "validation_missing", "train_corr", "validation_corr", "max_corr")], "redundant_with")


_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "twice")
_FD = "fd0 AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber < 6 THEN l_discount END AS l_discount, l_quantity * 2 + l_tax AS twice, (l_returnflag = 'R')::INTEGER AS y, l_orderkey % 4 = 0 AS v, l_linenumber >= 6 AS miss FROM lineitem), fd AS (SELECT * REPLACE (coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM fd0 WHERE NOT v)) AS l_discount) FROM fd0)"
_FD_SQL = f"WITH {_FD} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg({f}) FILTER (NOT v), 5) AS train_mean, round(avg({f}) FILTER (v), 5) AS validation_mean, round(stddev_pop({f}) FILTER (NOT v), 5) AS train_std, round(stddev_pop({f}) FILTER (v), 5) AS validation_std, round((avg({f}) FILTER (v) - avg({f}) FILTER (NOT v)) / stddev_pop({f}) FILTER (NOT v), 5) AS drift, round({'avg(miss::INTEGER) FILTER (NOT v)' if f == 'l_discount' else '0.0'}, 5) AS train_missing, round({'avg(miss::INTEGER) FILTER (v)' if f == 'l_discount' else '0.0'}, 5) AS validation_missing, round(corr({f}, y) FILTER (NOT v), 5) AS train_corr, round(corr({f}, y) FILTER (v), 5) AS validation_corr, round(greatest({', '.join(f'abs(corr({f}, {g}) FILTER (NOT v))' for g in _FEATURES if g != f)}), 5) AS max_corr, concat_ws('|', {', '.join(f'CASE WHEN abs(corr({f}, {g}) FILTER (NOT v)) >= 0.95 THEN {chr(39)}{g}{chr(39)} END' for g in _FEATURES if g != f)}) AS redundant_with FROM fd"
    for f in _FEATURES
)


def _account(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.round(F.pmod("o_orderkey", F.lit(37)) * 3.0 - 50, 2).alias("pnl"), (F.pmod("o_orderkey", F.lit(9)) + 1).cast("double").alias("quantity"))


def evidence_metrics(spark, sf_dir):
    m = V.evidence_metrics(_account(spark, sf_dir), "k", 120, 110, 60, (1000, 1000), (980, 970))
    return m.withColumn("verdict", V.evidence_verdict())


def _session_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 12).alias("session"), F.floor(X.micros("ts") / 1000).alias("t"))
    edge = e.groupBy("session").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    marks = e.select("session", F.when(F.col("event_id") % 97 == 5, "fatal_error").otherwise("capture_checkpoint").alias("event"), "t", F.lit(None).cast("double").alias("duration"), F.lit(None).cast("double").alias("interval"))
    start = edge.select("session", F.lit("session_started").alias("event"), (F.col("a") - 1_000_000).alias("t"), F.lit(2590.0).alias("duration"), F.lit(30.0).alias("interval"))
    end = edge.filter("session % 3 > 0").select("session", F.lit("session_completed").alias("event"), (F.col("z") + 2_000_000).alias("t"), F.lit(None).cast("double").alias("duration"), F.lit(None).cast("double").alias("interval"))
    return marks.unionByName(start).unionByName(end)


def session_continuity(spark, sf_dir):
    c = V.continuity(_session_events(spark, sf_dir))
    return c.select("session", "checkpoints", "expected", "fatal", "gaps_over_10", "gaps_over_60", "gaps_over_300", *_r("coverage", "time_coverage", "max_gap", "terminal_gap"), F.array_join("reasons", ";").alias("reasons"), "status")


def batch_progress(spark, sf_dir):
    return V.progress(table(spark, sf_dir, "orders"), "o_orderstatus", 2000, 600).select("scope", "current", "target", "percentage")


def batch_verdict(spark, sf_dir):
    return V.batch_verdict(V.progress(table(spark, sf_dir, "orders"), "o_orderstatus", 100, 1), False)


def hypothesis_gates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    e = o.select((F.col("o_custkey") % 5).alias("wallet"), F.col("o_orderpriority").alias("asset"), F.when(k % 50 > 0, k % 60).alias("delay"), F.when(k % 10 > 0, k % 200).alias("window"), F.to_date("o_orderdate").alias("day"), k.alias("trade"))
    return V.hypothesis_gates(e, 12, (97, 3)).select("gate", *_r("value"), "passed")


def robustness_score(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("baseline", "noise", "dropout", "signal_lag", "execution_latency"))), F.least(F.lit(5), F.col("l_linenumber")).cast("int"))
    runs = lines.groupBy(kind.alias("kind"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).otherwise("all").alias("scenario")).agg(F.sum(F.col("l_tax") - 0.03).alias("pnl"), F.lit(0.05).alias("drawdown"), F.count("*").alias("trades"))
    windows = lines.filter("l_linenumber = 1").groupBy((F.col("l_partkey") % 6).alias("window")).agg(F.sum(F.col("l_tax") - 0.03).alias("pnl"))
    return V.robustness(runs, windows)


def out_of_range(spark, sf_dir):
    return V.out_of_range(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


def repricing_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(F.col("o_orderpriority").alias("session"), (k * 1_000_000).alias("t"), (k % 3 == 0).alias("won"), ((k % 7 - 3) / 100).alias("before"), ((k % 7 - 3) / 100 - 0.002).alias("after"), (k % 5 / 100).alias("mfe"), (-(k % 4) / 100).alias("mae"))
    return V.repricing_summary(rows, "session", ["t"]).select("session", "n", "wins", *_r("pnl_before", "pnl_after", "mean_mfe", "mean_mae", "expectancy", "per_hour", "max_drawdown", "win_rate"))


# Experiments


def _edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return lines.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("k"), F.round(n % 97 / 100, 2).alias("market"), F.round((n * 3) % 89 / 90, 4).alias("model"), (F.col("l_returnflag") == "R").cast("int").alias("outcome"), F.when(n % 11 > 0, F.round((n % 97 + 2) / 100, 2)).alias("ask_yes"), F.round(1.03 - n % 97 / 100, 2).alias("ask_no"))


EDGES = "ed AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS k, l_orderkey * 7 + l_linenumber AS n, l_returnflag = 'R' AS o, round((l_orderkey * 7 + l_linenumber) % 97 / 100, 2) AS mk, round((l_orderkey * 7 + l_linenumber) * 3 % 89 / 90, 4) AS md FROM lineitem)"


def edge_trades(spark, sf_dir):
    t = L.edge_trades(_edges(spark, sf_dir), [0.02, 0.05, 0.1])
    return L.trading_summary(t, ["threshold"], "contract", "base_pnl", ["k"]).select("threshold", "n", "wins", "up", "down", *[F.round(c, 5).alias(c) for c in ("cost", "pnl", "roi", "win_rate", "max_drawdown")])


def ask_trades(spark, sf_dir):
    t = L.ask_trades(_edges(spark, sf_dir), 0.05)
    return t.select("k", "side", "ask", "skipped", F.col("win").cast("int").alias("win"), *_r("pnl"))


def snapshot_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("market"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 300).alias("left"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return L.snapshot_rows(lines, "market", "left", "k")


def _grouped(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.lit(0.2) + F.col("l_linenumber") / 50).alias("price"))


GROUPS = {"quantity": ["l_quantity"], "discount": ["l_discount"], "tax": ["l_tax"]}


def feature_group_refits(spark, sf_dir):
    rows = _grouped(spark, sf_dir)
    out, _ = FG.refit_groups(rows.filter("l_orderkey % 4 > 0"), rows.filter("l_orderkey % 4 = 0"), GROUPS, "y", "price")
    return out.select("name", "n", *_r("log_loss", "brier", "accuracy", "delta_log_loss", "delta_brier"))


def _snapshot_tables(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("market"), F.floor(X.micros("ts") / 60_000_000).alias("at"), F.col("value").alias("probability"), "event_id")
    points = e.groupBy("market", "at").agg(F.max("probability").alias("probability"))
    markets = e.groupBy("market").agg(F.max("at").alias("end")).withColumns({"key": F.col("market") % 3, "outcome": (F.col("market") % 2).cast("int")})
    closes = e.groupBy((F.col("market") % 3).alias("key"), F.floor(F.col("at") / 60).alias("minute")).agg(F.max("probability").alias("value"))
    return FG.datasets(points, markets, closes, {"t600": 600, "t3000": 3_000, "t9000": 9_000})


def snapshot_datasets(spark, sf_dir):
    return _snapshot_tables(spark, sf_dir).select("dataset", "market", "at", "outcome", *_r("probability", "close", "return_1m", "return_5m", "return_15m", "volatility"))


def dataset_comparison(spark, sf_dir):
    rows = _snapshot_tables(spark, sf_dir).withColumn("p", F.least(F.lit(0.99), F.col("probability") / 400))
    closes = ["return_1m", "return_5m", "return_15m", "volatility"]
    out = FG.compare_datasets(rows, {"market": ["p"], "closes": closes, "both": ["p", *closes]}, "outcome", "p", ["at", "market"])
    return out.select("dataset", "name", "train", "n", *_r("log_loss", "brier", "accuracy"), "beats_raw")


def batch_descent(spark, sf_dir):
    rows = _grouped(spark, sf_dir)
    w = FG.descent_fit(rows.select((F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("t"), "y"), ["d", "t"], "y", epochs=40)
    return S.coefficients(spark, ["discount", "tax"], w).select("feature", *_r("weight"))


def prefix_scaler(spark, sf_dir):
    return FG.prefix_scaler(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], ["o_orderdate", "o_orderkey"]).select("column", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


def snapshot_before(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor(X.micros("ts") / 1_000_000).alias("at"), "value")
    ends = e.groupBy("user_id").agg((F.max("at") - F.col("user_id") % 3 * 3_000_000).alias("end"))
    return L.snapshot_before(e, ends, "user_id", "at", "value", "end", 86_400).select("user_id", "at", *_r("value"))


def minute_returns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("key"), F.floor(X.micros("ts") / 60_000_000).alias("at"), "value")
    closes = e.groupBy("key", F.floor(F.col("at") / 60).alias("minute")).agg(F.max("value").alias("value"))
    return L.minute_return(closes, e.select("event_id", "key", "at"), "key", "minute", "value", "at", 5).select("event_id", *_r("minute_return"))


def close_features(spark, sf_dir):
    closes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("x")).select("l_orderkey", L.close_features(F.transform("x", lambda r: r["l_extendedprice"])).alias("f"))
    return closes.select("l_orderkey", *[F.round(f"f.{c}", 6).alias(c) for c in ("price", "return_1", "return_5", "return_15", "volatility")])


def rotation_states(spark, sf_dir):
    now = F.pmod("o_orderkey", F.lit(400))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.rotation_state(now, F.lit(20), F.lit(320), F.col("o_orderstatus") == "P").alias("state"))


def parsed_markets(spark, sf_dir):
    k = F.col("p_partkey")
    slug = F.when(k % 3 == 0, F.concat(F.lit("btc-updown-5m-"), 1_700_000_000 + k)).otherwise("btc-daily")
    r = L.parsed_market(slug, F.when(k % 7 == 0, "Bitcoin price").otherwise("Bitcoin up or down"), F.when(k % 11 > 0, k * 300), F.when(k % 5 > 0, k * 300 + 300).otherwise(k * 300 + 900), F.when(k % 13 == 0, '["Over","Under"]').when(k % 17 == 0, '["Up"]').otherwise('[" Up","Down"]'), F.concat(F.lit('["y'), k, F.lit('","n'), k, F.lit('"]')), k % 19 > 0, k % 23 == 0, F.when(k % 29 > 0, "BTC"))
    return table(spark, sf_dir, "part").select("p_partkey", r["reason"].alias("reason"), r["start"].alias("start"), F.when(r["reason"] == "", r["yes_token"]).alias("yes_token"))


def book_ticks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n, b = F.col("event_id"), F.pmod("event_id", F.lit(50)).cast("double")
    asset = F.concat(F.lit("a"), F.col("user_id"))
    kind = F.element_at(F.array(*map(F.lit, ("book", "best_bid_ask", "price_change", "last_trade_price"))), (n % 4 + 1).cast("int"))
    level = lambda p: F.struct(p.alias("price"), F.lit(1.0).alias("size"))
    body = F.to_json(
        F.struct(
            asset.alias("asset_id"),
            F.when(kind == "book", F.array(level((b - 3) / 100), level(b / 100))).alias("bids"),
            F.when(kind == "book", F.array(level((b + 4) / 100), level((b + 2) / 100))).alias("asks"),
            F.when(kind == "best_bid_ask", b / 100).alias("best_bid"),
            F.when(kind == "best_bid_ask", (b + 1) / 100).alias("best_ask"),
            F.when(kind == "last_trade_price", (b + 5) / 100).alias("price"),
            F.when(kind == "last_trade_price", (n % 9).cast("double")).alias("size"),
            F.when(kind == "price_change", F.array(F.struct(asset.alias("asset_id"), (b / 100).alias("best_bid"), ((b + n % 3 - 1) / 100).alias("best_ask")))).alias("price_changes"),
        )
    )
    ticks = L.book_ticks(e.select(n.alias("event"), X.micros("ts").alias("t"), kind.alias("kind"), body.alias("payload")))
    return ticks.select("event", "asset_id", "kind", *_r("bid", "ask", "trade", "size"))


def protocol_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("market_id"), F.date_trunc("month", "o_orderdate").alias("window_start"))
    return G.bounds(G.assigned(rows)).select("assignment", F.to_date("first").cast("string").alias("first"), F.to_date("last").cast("string").alias("last"), "windows", "rows")


def window_overlaps(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.pmod("o_orderkey", F.lit(997)).alias("s"), (F.pmod("o_orderkey", F.lit(997)) + F.pmod("o_orderkey", F.lit(3))).alias("e"))
    return G.window_overlaps(rows, "s", "e")


_BINS = "UNION ALL".join(f" SELECT {s} AS scope, model, y, q FROM ml " for s in ("'overall'", "asset"))
_LOSS = "-(y * ln({q}) + (1 - y) * ln(1 - {q}))"

def _refit_sql(steps: int = 8) -> str:
    """Newton's steps of one-feature regressions, each a 2 x 2 system solved in place."""
    rows = ["z AS (SELECT l_orderkey % 4 > 0 AS tr, (l_returnflag = 'R')::INTEGER AS y, 0.2 + l_linenumber / 50 AS price, f.name, f.x FROM lineitem, LATERAL (VALUES ('quantity', l_quantity), ('discount', l_discount), ('tax', l_tax)) f(name, x))",
        "fi AS (SELECT name, avg(x) AS m, stddev_pop(x) AS s FROM z WHERE tr GROUP BY 1)", "zz AS MATERIALIZED (SELECT z.tr, z.y, z.price, name, (z.x - m) / s AS x FROM z JOIN fi USING (name))", "w0 AS (SELECT DISTINCT name, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM zz)"]
    for i in range(steps):
        rows.append(f"g{i} AS (SELECT name, a, b, sum(q - y) AS ga, sum((q - y) * x) + b AS gb, sum(q * (1 - q)) + 1e-9 AS haa, sum(q * (1 - q) * x) AS hab, sum(q * (1 - q) * x * x) + 1 + 1e-9 AS hbb FROM (SELECT zz.*, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM zz JOIN w{i} USING (name) WHERE tr) GROUP BY name, a, b)")
        rows.append(f"w{i + 1} AS MATERIALIZED (SELECT name, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{i})")
    loss = lambda p: f"avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, {p}))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, {p}))))), avg(({p} - y) * ({p} - y))"
    rows.append(f"v AS (SELECT zz.*, 1 / (1 + exp(-(a + b * x))) AS q FROM zz JOIN w{steps} USING (name) WHERE NOT tr)")
    rows.append(f"o(name, n, accuracy, l, b, pl, pb) AS (SELECT name, count(*), avg(((q >= 0.5) = (y = 1))::INTEGER), {loss('q')}, {loss('price')} FROM v GROUP BY name)")
    return "WITH " + ",\n".join(rows) + " SELECT name, n, round(l, 6) AS log_loss, round(b, 6) AS brier, round(accuracy, 6) AS accuracy, round(l - pl, 6) AS delta_log_loss, round(b - pb, 6) AS delta_brier FROM o"


def _descent_sql(epochs: int = 40) -> str:
    rows = ["c AS MATERIALIZED (SELECT l_discount * 10 AS d, l_tax * 10 AS t, (l_returnflag = 'R')::INTEGER AS y, count(*) AS n FROM lineitem GROUP BY ALL)", "w0 AS (SELECT ln(p / (1 - p)) AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS e, s FROM (SELECT sum(n * y) / sum(n) AS p, sum(n) AS s FROM c))"]
    for i in range(epochs):
        rows.append(f"w{i + 1} AS MATERIALIZED (SELECT a - 0.08 * sum(n * (q - y)) / s AS a, b - 0.08 * (sum(n * (q - y) * d) + b) / s AS b, e - 0.08 * (sum(n * (q - y) * t) + e) / s AS e, s FROM (SELECT c.*, w.*, 1 / (1 + exp(-(a + b * d + e * t))) AS q FROM c, w{i} w) GROUP BY a, b, e, s)")
    return "WITH " + ",\n".join(rows) + f" SELECT unnest(['intercept', 'discount', 'tax']) AS feature, round(unnest([a, b, e]), 6) AS weight FROM w{epochs}"


_DATASETS = """WITH e AS (SELECT user_id AS market, epoch_us(ts) // 60000000 AS tt, value FROM events), p AS (SELECT market, tt, max(value) AS probability FROM e GROUP BY 1, 2), m AS (SELECT market, max(tt) AS z, market % 3 AS key, market % 2 AS outcome FROM e GROUP BY 1),
c AS (SELECT market % 3 AS key, tt // 60 AS minute, max(value) AS v FROM e GROUP BY 1, 2), h AS (SELECT m.*, dataset, z - s AS target FROM m, (VALUES ('t600', 600), ('t3000', 3000), ('t9000', 9000)) g(dataset, s)),
s AS (SELECT dataset, market, key, outcome, coalesce(max(CASE WHEN tt <= target THEN struct_pack(tt := tt, p := probability) END), arg_min(struct_pack(tt := tt, p := probability), struct_pack(a := abs(tt - target), b := tt))) AS r FROM p JOIN h USING (market) GROUP BY dataset, market, key, outcome),
k AS (SELECT dataset, market, key, outcome, r.tt AS tt, r.p AS probability, i, (r.tt - 60 * i) // 60 AS minute FROM s, range(16) g(i)),
l AS (SELECT k.dataset, k.market, k.outcome, k.tt, k.probability, k.i, max_by(c.v, c.minute) AS v FROM k LEFT JOIN c ON c.key = k.key AND c.minute BETWEEN k.minute - 9 AND k.minute GROUP BY ALL),
f AS (SELECT a.*, CASE WHEN b.v > 0 AND a.v <> 0 THEN ln(a.v / b.v) END AS lr FROM l a LEFT JOIN l b ON a.dataset = b.dataset AND a.market = b.market AND b.i = a.i + 1),
o AS (SELECT dataset, market, tt, outcome, probability, max(v) FILTER (i = 0) AS close, max(v) FILTER (i = 0) / max(v) FILTER (i = 1) - 1 AS return_1m, max(v) FILTER (i = 0) / max(v) FILTER (i = 5) - 1 AS return_5m, max(v) FILTER (i = 0) / max(v) FILTER (i = 15) - 1 AS return_15m, CASE WHEN count(lr) >= 5 THEN stddev_pop(lr) END AS volatility FROM f GROUP BY ALL)
SELECT dataset, market, tt AS "at", outcome::INTEGER AS outcome, """ + ", ".join(f"round({c}, 6) AS {c}" for c in ("probability", "close", "return_1m", "return_5m", "return_15m", "volatility")) + " FROM o WHERE close IS NOT NULL AND return_1m IS NOT NULL AND return_5m IS NOT NULL AND return_15m IS NOT NULL AND volatility IS NOT NULL"

LAB = {
    "feature_group_refits": (feature_group_refits, _refit_sql()),
    "snapshot_datasets": (snapshot_datasets, _DATASETS),
    "dataset_comparison": (dataset_comparison, ""),
    "batch_descent": (batch_descent, _descent_sql()),
    "prefix_scaler": (prefix_scaler, "WITH o AS (SELECT o_totalprice, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), t AS (SELECT * FROM o WHERE i < floor(n * 0.7)) SELECT 'o_totalprice' AS column, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS deviation FROM t UNION ALL SELECT 'o_custkey', round(avg(o_custkey), 4), round(stddev_pop(o_custkey), 4) FROM t"),
    "model_evaluation": (model_evaluation, f"WITH {MODELS} SELECT scope, value, model, n, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy FROM mx"),
    "model_winners": (model_winners, f"WITH {MODELS} SELECT a.scope, a.value, a.n, CASE WHEN a.log_loss < b.log_loss AND a.brier < b.brier THEN 'candidate' WHEN b.log_loss <= a.log_loss AND b.brier <= a.brier THEN 'price' ELSE 'mixed' END AS winner FROM mx a JOIN mx b ON a.scope = b.scope AND a.value = b.value AND a.model = 'candidate' AND b.model = 'price'"),
    "advancement_rule": (advancement_rule, f"""WITH {MODELS}, o AS (SELECT * FROM mx WHERE scope = 'overall'), c AS (SELECT * FROM o WHERE model = 'candidate'), p AS (SELECT * FROM o WHERE model = 'price'), r AS (SELECT * FROM o WHERE model = 'prior'), x AS (SELECT c.log_loss < p.log_loss AND c.brier < p.brier AND c.log_loss < r.log_loss AND c.brier < r.brier AS beats_all, greatest((p.log_loss - c.log_loss) / p.log_loss, (p.brier - c.brier) / p.brier) >= 0.01 AND least((p.log_loss - c.log_loss) / p.log_loss, (p.brier - c.brier) / p.brier) >= -0.005 AS rule FROM c, p, r),
a AS (SELECT count(*) AS assets_won FROM mx a JOIN mx b ON a.scope = 'asset' AND b.scope = 'asset' AND a.value = b.value AND a.model = 'candidate' AND b.model = 'price' AND a.log_loss < b.log_loss AND a.brier < b.brier) SELECT beats_all, rule, assets_won, beats_all AND rule AND assets_won >= 2 AS passes FROM x, a"""),
    "best_model": (best_model, f"WITH {MODELS} SELECT model, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM mx WHERE scope = 'overall' ORDER BY mx.log_loss, mx.brier, model LIMIT 1"),
    "calibration_scopes": (calibration_scopes, f"WITH {MODELS}, u AS ({_BINS}) SELECT scope, model, least(floor(q * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(q), 6) AS mean_p, round(avg(y), 6) AS rate FROM u GROUP BY 1, 2, 3"),
    "prediction_deltas": (prediction_deltas, f"WITH {MODELS}, d AS (SELECT {_LOSS.format(q='greatest(1e-12, least(1 - 1e-12, candidate))')} - ({_LOSS.format(q='greatest(1e-12, least(1 - 1e-12, price))')}) AS l, (candidate - y) ** 2 - (price - y) ** 2 AS b FROM mo) SELECT count(*) AS n, count(*) FILTER (l < 0) AS better, round(avg(l), 6) AS mean_log, round(quantile_cont(l, 0.5), 6) AS median_log, round(avg(b), 6) AS mean_brier, round(quantile_cont(l, 0.1), 6) AS log_p10, round(quantile_cont(l, 0.9), 6) AS log_p90, round(quantile_cont(b, 0.5), 6) AS brier_p50 FROM d"),
    "incremental_summary": (incremental_summary, f"""WITH {MODELS}, p AS (SELECT * FROM mx WHERE scope = 'overall' AND model = 'price'), g AS (SELECT CASE WHEN m.log_loss < p.log_loss AND m.brier < p.brier THEN 'group_beats' WHEN m.log_loss >= p.log_loss AND m.brier >= p.brier THEN 'group_dominated' END AS kind, m.model AS name FROM mx m, p WHERE m.scope = 'overall' AND m.model <> 'price')
SELECT kind, name FROM g WHERE kind IS NOT NULL UNION ALL SELECT 'regime_beats', a.scope || '_' || a.value FROM mx a JOIN mx b ON a.scope <> 'overall' AND a.scope = b.scope AND a.value = b.value AND a.model = 'candidate' AND b.model = 'price' AND a.n >= 20 AND a.log_loss < b.log_loss AND a.brier < b.brier"""),
    "feature_diagnostics": (feature_diagnostics, _FD_SQL),
    "evidence_metrics": (evidence_metrics, """WITH a AS (SELECT o_orderkey AS k, round(o_orderkey % 37 * 3.0 - 50, 2) AS pnl, o_orderkey % 9 + 1 AS q FROM orders), b AS (SELECT *, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS n, 10000 + sum(pnl) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS eq FROM a), c AS (SELECT *, greatest(10000, max(eq) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS pk FROM b),
d AS (SELECT 120 AS markets, 110 AS windows, round(60 / 110, 6) AS opportunity_rate, count(*) AS trades, round(sum(pnl), 6) AS pnl, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate, round(avg(pnl) FILTER (pnl > 0), 6) AS mean_win, round(avg(pnl) FILTER (pnl < 0), 6) AS mean_loss, round(max((pk - eq) / pk), 8) AS max_drawdown, round(greatest(0, least(1, (2 * sum(pnl) FILTER (i <= greatest(1, n // 2)) - sum(pnl)) / greatest(abs(sum(pnl) FILTER (i <= greatest(1, n // 2))), 1))), 6) AS edge_decay, round(greatest(0, least(1, sum(q * 0.002) / greatest(abs(sum(pnl)), 1))), 6) AS latency_sensitivity, 98.0 AS reference_coverage, 3.0 AS data_gap FROM c)
SELECT *, CASE WHEN trades < 20 THEN 'INSUFFICIENT_DATA' WHEN pnl <= 0 OR win_rate < 0.45 OR max_drawdown > 0.10 OR edge_decay > 0.80 THEN 'NO_EDGE' WHEN win_rate >= 0.5 AND max_drawdown <= 0.05 AND edge_decay <= 0.5 AND latency_sensitivity <= 0.5 THEN 'POTENTIAL_EDGE' ELSE 'WEAK_EDGE' END AS verdict FROM d"""),
    "session_continuity": (session_continuity, """WITH e AS (SELECT user_id % 12 AS session, event_id % 97 = 5 AS f, epoch_us(ts) // 1000 AS t FROM events), g AS (SELECT session, min(t) - 1000000 AS a, CASE WHEN session % 3 > 0 THEN max(t) + 2000000 END AS z, count(*) FILTER (f) AS fatal FROM e GROUP BY 1), c AS (SELECT DISTINCT session, t FROM e WHERE NOT f),
m AS (SELECT session, t FROM c UNION ALL SELECT session, a FROM g UNION ALL SELECT session, z FROM g WHERE z IS NOT NULL), p AS (SELECT session, (t - lag(t) OVER (PARTITION BY session ORDER BY t)) / 1e6 AS gap FROM m), q AS (SELECT session, max(gap) AS mg, count(*) FILTER (gap > 10) AS g10, count(*) FILTER (gap > 60) AS g60, count(*) FILTER (gap > 300) AS g300 FROM p GROUP BY 1), k AS (SELECT session, count(*) AS n, max(t) AS last FROM c GROUP BY 1),
s AS (SELECT session, n, fatal, g10, g60, g300, mg, z, least(1.0, n / 87.0) AS cov, least(1.0, coalesce((z - a) / 1e6, 0) / 2590.0) AS tc, coalesce((z - last) / 1e6, 0) AS tg FROM g JOIN q USING (session) JOIN k USING (session)),
r AS (SELECT *, concat_ws(';', CASE WHEN tc < 0.99 THEN 'temporal_coverage_below_99_percent' END, CASE WHEN cov < 0.95 THEN 'checkpoint_coverage_below_95_percent' END, CASE WHEN mg > 300 THEN 'checkpoint_gap_over_300_seconds' END, CASE WHEN z IS NULL THEN 'session_completed_missing' END, CASE WHEN fatal > 0 THEN 'fatal_capture_errors_present' END) AS reasons FROM s)
SELECT session, n AS checkpoints, 87 AS expected, fatal, g10 AS gaps_over_10, g60 AS gaps_over_60, g300 AS gaps_over_300, round(cov, 6) AS coverage, round(tc, 6) AS time_coverage, round(mg, 6) AS max_gap, round(tg, 6) AS terminal_gap, reasons, CASE WHEN reasons = '' THEN 'continuous' ELSE 'incomplete' END AS status FROM r"""),
    "batch_progress": (batch_progress, "SELECT scope, current, target, round(100 * least(1.0, current / target), 2) AS percentage FROM (SELECT o_orderstatus AS scope, count(*) AS current, 600 AS target FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*), 2000 FROM orders)"),
    "batch_verdict": (batch_verdict, "WITH p AS (SELECT count(*) AS c, 1 AS t FROM orders GROUP BY o_orderstatus UNION ALL SELECT count(*), 100 FROM orders) SELECT count(*) FILTER (c < t) AS short, CASE WHEN count(*) FILTER (c < t) > 0 THEN 'INSUFFICIENT_PUBLIC_SAMPLE' ELSE 'DATA_QUALITY_FAILED' END AS verdict FROM p"),
    "hypothesis_gates": (hypothesis_gates, """WITH e AS (SELECT o_custkey % 5 AS w, o_orderpriority AS a, CASE WHEN o_orderkey % 50 > 0 THEN 1 END AS d, CASE WHEN o_orderkey % 10 > 0 THEN 1 END AS x, o_orderdate::DATE AS day, o_orderkey AS t FROM orders), o AS (SELECT count(*) AS n, count(d) AS d, count(x) AS x, count(DISTINCT t) AS ids, count(DISTINCT day) AS days FROM e), w AS (SELECT count(*) AS k, min(c) AS lo, max(c) AS hi FROM (SELECT count(*) AS c FROM e GROUP BY w)), a AS (SELECT count(*) AS k, min(c) AS lo FROM (SELECT count(*) AS c FROM e GROUP BY a)),
g AS (SELECT unnest([{'gate': 'eligible_trades', 'value': n::DOUBLE, 'passed': n >= 100}, {'gate': 'wallet_count', 'value': w.k::DOUBLE, 'passed': w.k >= 3}, {'gate': 'trades_per_wallet', 'value': w.lo::DOUBLE, 'passed': w.k >= 3 AND w.lo >= 10}, {'gate': 'wallet_concentration', 'value': w.hi / n, 'passed': w.hi / n <= 0.6}, {'gate': 'sessions', 'value': 12.0::DOUBLE, 'passed': true}, {'gate': 'dates', 'value': days::DOUBLE, 'passed': days >= 5}, {'gate': 'asset_count', 'value': a.k::DOUBLE, 'passed': a.k >= 2}, {'gate': 'trades_per_asset', 'value': a.lo::DOUBLE, 'passed': a.k >= 2 AND a.lo >= 20}, {'gate': 'timestamp_completeness', 'value': d / n, 'passed': d / n >= 0.95}, {'gate': 'expiry_completeness', 'value': x / n, 'passed': x / n >= 0.95}, {'gate': 'identity_uniqueness', 'value': ids / n, 'passed': ids = n}, {'gate': 'request_completeness', 'value': 0.97::DOUBLE, 'passed': true}]) AS u FROM o, w, a)
SELECT u.gate AS gate, round(u.value, 6) AS value, u.passed AS passed FROM g"""),
    "robustness_score": (robustness_score, """WITH r AS (SELECT CASE WHEN l_linenumber = 1 THEN 'baseline' WHEN l_linenumber = 2 THEN 'noise' WHEN l_linenumber = 3 THEN 'dropout' WHEN l_linenumber = 4 THEN 'signal_lag' ELSE 'execution_latency' END AS kind, CASE WHEN l_linenumber > 1 THEN l_returnflag ELSE 'all' END AS s, sum(l_tax - 0.03) AS pnl, count(*) AS t FROM lineitem GROUP BY 1, 2), b AS (SELECT max(pnl) AS b, max(t) AS t FROM r WHERE kind = 'baseline'), w AS (SELECT count(*) AS w, avg((p > 0)::INTEGER) AS ra, avg(p) AS m, stddev_pop(p) AS d FROM (SELECT sum(l_tax - 0.03) AS p FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey % 6)),
p AS (SELECT avg(CASE WHEN b.b <= 0 THEN 0 ELSE greatest(0, least(1, pnl / b.b)) END) FILTER (kind IN ('noise', 'dropout')) AS re, avg((pnl > 0)::INTEGER) FILTER (kind IN ('noise', 'dropout')) AS n, avg((pnl > 0)::INTEGER) FILTER (kind = 'signal_lag') AS l, avg((pnl > 0)::INTEGER) FILTER (kind = 'execution_latency') AS e FROM r, b WHERE kind <> 'baseline'),
x AS (SELECT round(100 * ra, 2) AS consistency, round(100 * re, 2) AS noise_resilience, round(greatest(0, least(100, 100 / (1 + d / abs(m)))), 2) AS stability, 75.0 AS drawdown_control, n, l, e, ra, b.b, b.t, w.w FROM p, b, w), y AS (SELECT *, round(0.30 * consistency + 0.25 * noise_resilience + 0.25 * stability + 0.20 * drawdown_control, 2) AS score FROM x)
SELECT consistency, noise_resilience, stability, drawdown_control, score, CASE WHEN score >= 60 AND n = 1 AND e = 1 AND l >= 2.0 / 3 AND ra >= 0.6 AND b > 0 AND t >= w THEN 'POTENTIAL_ALPHA' ELSE 'OVERFIT_OR_INCONCLUSIVE' END AS verdict FROM y"""),
    "out_of_range": (out_of_range, 'SELECT \'l_discount\' AS "column", count(*) FILTER (NOT l_discount BETWEEN 0 AND 1) AS violations FROM lineitem UNION ALL SELECT \'l_tax\', count(*) FILTER (NOT l_tax BETWEEN 0 AND 1) FROM lineitem UNION ALL SELECT \'l_quantity\', count(*) FILTER (NOT l_quantity BETWEEN 0 AND 1) FROM lineitem'),
    "repricing_summary": (repricing_summary, """WITH r AS (SELECT o_orderpriority AS session, o_orderkey AS k, (o_orderkey % 7 - 3) / 100 AS b, (o_orderkey % 7 - 3) / 100 - 0.002 AS a FROM orders), e AS (SELECT *, sum(a) OVER (PARTITION BY session ORDER BY k ROWS UNBOUNDED PRECEDING) AS eq FROM r), p AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY session ORDER BY k ROWS UNBOUNDED PRECEDING)) AS pk FROM e)
SELECT session, count(*) AS n, count(*) FILTER (k % 3 = 0) AS wins, round(sum(b), 6) AS pnl_before, round(sum(a), 6) AS pnl_after, round(avg(k % 5 / 100), 6) AS mean_mfe, round(avg(-(k % 4) / 100), 6) AS mean_mae, round(avg(a), 6) AS expectancy, round(count(*) / ((max(k) - min(k)) / 3600.0), 6) AS per_hour, round(max(pk - eq), 6) AS max_drawdown, round(count(*) FILTER (k % 3 = 0) / count(*), 6) AS win_rate FROM p GROUP BY 1"""),
    "edge_trades": (edge_trades, f"""WITH {EDGES}, t AS (SELECT th AS threshold, k, o, CASE WHEN md - mk >= th THEN 'UP' WHEN mk - md >= th THEN 'DOWN' END AS side, mk FROM ed, (VALUES (0.02::DOUBLE), (0.05), (0.1)) v(th)), u AS (SELECT *, CASE WHEN side = 'UP' THEN mk ELSE 1 - mk END AS c, CASE WHEN side = 'UP' THEN o ELSE NOT o END AS win FROM t WHERE side IS NOT NULL), x AS (SELECT *, win::INTEGER - least(0.99, c + 0.01 + 0.05 * c) AS p FROM u), y AS (SELECT *, sum(p) OVER (PARTITION BY threshold ORDER BY k ROWS UNBOUNDED PRECEDING) AS eq FROM x), z AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY threshold ORDER BY k ROWS UNBOUNDED PRECEDING)) AS pk FROM y)
SELECT threshold, count(*) AS n, count(*) FILTER (win) AS wins, count(*) FILTER (side = 'UP') AS up, count(*) FILTER (side = 'DOWN') AS down, round(sum(c), 5) AS cost, round(sum(p), 5) AS pnl, round(sum(p) / sum(c), 5) AS roi, round(count(*) FILTER (win) / count(*), 5) AS win_rate, round(least(0, min(eq - pk)), 5) AS max_drawdown FROM z GROUP BY 1"""),
    "ask_trades": (ask_trades, f"WITH {EDGES}, t AS (SELECT *, CASE WHEN md - mk >= 0.05 THEN 'UP' WHEN mk - md >= 0.05 THEN 'DOWN' END AS side FROM ed), a AS (SELECT *, CASE WHEN side = 'UP' THEN CASE WHEN n % 11 > 0 THEN round((n % 97 + 2) / 100, 2) END ELSE round(1.03 - n % 97 / 100, 2) END AS ask, CASE WHEN side = 'UP' THEN o ELSE NOT o END AS w FROM t WHERE side IS NOT NULL) SELECT k, side, ask, NOT coalesce(ask > 0 AND ask < 1, false) AS skipped, CASE WHEN ask > 0 AND ask < 1 THEN w::INTEGER END AS win, CASE WHEN ask > 0 AND ask < 1 THEN round(w::INTEGER - ask, 6) END AS pnl FROM a"),
    "snapshot_rows": (snapshot_rows, 'WITH r AS (SELECT l_orderkey % 300 AS market, (l_partkey * 7 + l_linenumber) % 300 AS "left", l_orderkey * 10 + l_linenumber AS k FROM lineitem), t AS (SELECT *, row_number() OVER (PARTITION BY market, target ORDER BY abs("left" - target), k) AS i FROM r, (VALUES (240), (180), (120), (60)) v(target) WHERE abs("left" - target) <= 45) SELECT market, target, "left", k FROM t WHERE i = 1'),
    "snapshot_before": (snapshot_before, 'WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS "at", value FROM events), n AS (SELECT user_id, max("at") - user_id % 3 * 3000000 - 86400 AS t FROM e GROUP BY 1), j AS (SELECT e.*, t FROM e JOIN n USING (user_id)), b AS (SELECT user_id, max({\'a\': "at", \'v\': value}) FILTER ("at" <= t) AS x, arg_min({\'a\': "at", \'v\': value}, abs("at" - t)) AS y FROM j GROUP BY 1) SELECT user_id, coalesce(x, y).a AS "at", round(coalesce(x, y).v, 6) AS value FROM b'),
    "minute_returns": (minute_returns, 'WITH e AS (SELECT event_id, user_id % 3 AS k, epoch_us(ts) // 60000000 AS a, value FROM events), c AS (SELECT k, a // 60 AS m, max(value) AS v FROM e GROUP BY 1, 2), n AS (SELECT event_id, (SELECT arg_max(v, m) FROM c WHERE c.k = e.k AND m <= a // 60 AND m > a // 60 - 10) AS x, (SELECT arg_max(v, m) FROM c WHERE c.k = e.k AND m <= (a - 300) // 60 AND m > (a - 300) // 60 - 10) AS y FROM e) SELECT event_id, round(x / nullif(y, 0) - 1, 6) AS minute_return FROM n'),
    "close_features": (close_features, """WITH l AS (SELECT l_orderkey, l_linenumber AS i, l_extendedprice AS p, count(*) OVER (PARTITION BY l_orderkey) AS n, lag(l_extendedprice) OVER w AS q, lag(l_extendedprice, 5) OVER w AS q5, lag(l_extendedprice, 15) OVER w AS q15, row_number() OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice))
SELECT l_orderkey, round(max(p) FILTER (r = n), 6) AS price, round(max(p / q - 1) FILTER (r = n), 6) AS return_1, round(max(p / q5 - 1) FILTER (r = n), 6) AS return_5, round(max(p / q15 - 1) FILTER (r = n), 6) AS return_15, round(stddev_pop(p / q - 1), 6) AS volatility FROM l GROUP BY 1"""),
    "rotation_states": (rotation_states, "WITH o AS (SELECT o_orderkey, o_orderkey % 400 AS n, o_orderstatus = 'P' AS s FROM orders) SELECT o_orderkey, CASE WHEN s THEN 'SKIPPED' WHEN n >= 320 THEN 'CLOSED' WHEN n < 20 THEN 'DISCOVERED' WHEN 320 - n <= 30 THEN 'NEAR_EXPIRY' ELSE 'ACTIVE' END AS state FROM o"),
    "parsed_markets": (parsed_markets, """WITH k AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS s FROM part), w AS (SELECT k, s, CASE WHEN s THEN 1700000000 + k WHEN k % 11 > 0 THEN k * 300 END AS a, CASE WHEN s THEN 1700000300 + k WHEN k % 5 > 0 THEN k * 300 + 300 ELSE k * 300 + 900 END AS z FROM k),
r AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'unsupported_or_ambiguous_asset' WHEN a IS NULL OR z IS NULL THEN 'missing_window' WHEN NOT z - a BETWEEN 240 AND 360 THEN 'not_five_minute_window:' || (z - a) || 's' WHEN k % 7 = 0 AND NOT s THEN 'not_up_down_market' WHEN k % 17 = 0 AND k % 13 > 0 THEN 'missing_binary_token_mapping' WHEN k % 13 = 0 THEN 'unrecognized_outcomes' WHEN k % 19 = 0 OR k % 23 = 0 THEN 'inactive_or_closed' ELSE '' END AS reason FROM w)
SELECT k AS p_partkey, reason, a AS start, CASE WHEN reason = '' THEN 'y' || k END AS yes_token FROM r"""),
    "book_ticks": (book_ticks, """WITH e AS (SELECT event_id AS n, user_id, epoch_us(ts) AS t, event_id % 50 AS b, event_id % 4 AS k FROM events), x AS (SELECT *, CASE WHEN k = 0 OR k = 1 OR (k = 2 AND n % 3 = 2) THEN b / 100 END AS bid, CASE WHEN k = 0 THEN (b + 2) / 100 WHEN k = 1 THEN (b + 1) / 100 WHEN k = 2 AND n % 3 = 2 THEN (b + 1) / 100 END AS ask FROM e),
y AS (SELECT *, last_value(bid IGNORE NULLS) OVER w AS cb, last_value(ask IGNORE NULLS) OVER w AS ca FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t, n ROWS UNBOUNDED PRECEDING))
SELECT n AS event, 'a' || user_id AS asset_id, (['book', 'best_bid_ask', 'price_change', 'last_trade_price'])[k + 1] AS kind, round(cb, 6) AS bid, round(ca, 6) AS ask, CASE WHEN k = 3 THEN round((b + 5) / 100, 6) END AS trade, CASE WHEN k = 3 THEN (n % 9)::DOUBLE END AS size FROM y WHERE CASE WHEN k = 3 THEN cb IS NOT NULL ELSE bid IS NOT NULL END"""),
    "protocol_split": (protocol_split, """WITH o AS (SELECT date_trunc('month', o_orderdate::DATE)::DATE AS w FROM orders), d AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT w FROM o)), c AS (SELECT *, floor(n * 0.7)::BIGINT AS a, floor(n * 0.85)::BIGINT AS b FROM d), p AS (SELECT w, CASE WHEN i IN (a - 1, a, b - 1, b) THEN 'excluded' WHEN i < a THEN 'train' WHEN i < b THEN 'validation' ELSE 'holdout' END AS assignment FROM c)
SELECT assignment, min(w)::VARCHAR AS "first", max(w)::VARCHAR AS "last", count(DISTINCT w) AS windows, count(*) AS "rows" FROM o JOIN p USING (w) GROUP BY 1"""),
    "window_overlaps": (window_overlaps, "WITH r AS (SELECT o_orderkey % 997 AS s, max(o_orderkey % 997 + o_orderkey % 3) AS e FROM orders GROUP BY 1), l AS (SELECT s, e, lead(s) OVER (ORDER BY s) AS next FROM r) SELECT s, next FROM l WHERE e > next"),
}
