"""Queries over the star-schema tables: trades are lines of orders (customer = wallet, part = token, R = SELL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import metrics as M
from ..operators import stats as S
from ..operators import tables as T
from .tables import table
from .time_queries import _r


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("wallet"),
        (F.col("l_partkey") % 50).alias("token"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("decimal(20,8)").alias("size"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(20,8)").alias("price"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"),
    )


TRADES = """tr AS (SELECT o_custkey AS wallet, l_partkey % 50 AS token FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


SAMPLES = "sa AS (SELECT l_orderkey || '-' || l_linenumber AS market_id, CASE WHEN l_suppkey % 7 = 0 THEN 'mock' ELSE 'public' END AS market_source, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS outcome, CASE WHEN l_quantity > 3 THEN l_quantity END AS size, CASE WHEN l_linenumber < 7 THEN l_tax END AS tax, CASE WHEN l_linestatus = 'F' THEN '' ELSE l_returnflag END AS micro, l_suppkey AS session FROM lineitem)"


def dominant_share(spark, sf_dir):
    return M.dominant(trades(spark, sf_dir), "wallet", "token").select("wallet", "token", *_r("share"))


def consensus_vote(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return M.consensus(lines, "l_orderkey", "l_returnflag", F.col("l_quantity")).select("l_orderkey", "sides", "winner", *_r("agreement"))


def dedupe_keep_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return T.keep_first(lines, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


def best_version(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return T.best_version(lines, "l_orderkey", ["l_quantity", "l_linenumber"])


def multi_key_sort_topk(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", *_r("l_extendedprice"))


def null_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("large", F.when(F.col("l_quantity") > 25, F.col("l_quantity"))).withColumn("returned", F.when(F.col("l_returnflag") == "R", 1))
    return T.null_profile(lines, ["l_orderkey", "large", "returned"]).select("column", "rows", "nulls", *_r("completeness"))


def duplicate_rate(spark, sf_dir):
    return T.duplicate_rate(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]).select("rows", "distinct", "duplicates", *_r("rate"))


def corr_matrix(spark, sf_dir):
    return T.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 6)


CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
    for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]
)


def _samples(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("market_id"),
        F.when(F.col("l_suppkey") % 7 == 0, "mock").otherwise("public").alias("market_source"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("outcome"),
        F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("size"),
        F.when(F.col("l_linenumber") < 7, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_returnflag")).alias("micro"),
        F.col("l_suppkey").alias("session"),
    )


def quality_score(spark, sf_dir):
    q = T.quality_score(_samples(spark, sf_dir).drop("session"), ["size", "tax"], ["micro"])
    return q.select("rows", "public_rows", "mock_rows", "up", "down", "missing_values", "duplicate_rows", "duplicate_markets", F.round("imbalance", 4).alias("imbalance"), F.round("minority", 4).alias("minority"), *T.QUALITY_WEIGHTS, "score", F.array_join("failures", "; ").alias("failures"), "recommended")


def missingness(spark, sf_dir):
    return T.missingness(_samples(spark, sf_dir), ["outcome", "size", "tax"], "session").select("column", F.coalesce("session", F.lit("all")).alias("session"), "rows", "nulls", *_r("completeness"))


def dataset_summary(spark, sf_dir):
    return T.dataset_summary(_samples(spark, sf_dir), "market_source", "outcome", ["size", "tax", "outcome"])


def _scored(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = F.round(1 / (1 + F.exp(-(F.ln(1 + F.col("n_chars").cast("double")) - 6))), 3)
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), p.alias("p"), "lang", "n_chars")


SCORED = "s AS (SELECT doc_id, quality AS y, round(1 / (1 + exp(-(ln(1 + n_chars::DOUBLE) - 6))), 3) AS p, lang, n_chars FROM labels JOIN documents USING (doc_id))"
_METRICS = """count(*) AS n, round(avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, p))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, p))))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier,
round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
round((count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (y = 1), 0) + count(*) FILTER (p < 0.5 AND y = 0) / nullif(count(*) FILTER (y = 0), 0)) / 2, 6) AS balanced_accuracy,
round(count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (p >= 0.5), 0), 6) AS "precision", round(count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 6) AS recall"""
_FIGURES = ("log_loss", "brier", "accuracy", "balanced_accuracy", "precision", "recall")


def prob_metrics(spark, sf_dir):
    return M.probability_metrics(_scored(spark, sf_dir), "y", "p").select("n", *_r(*_FIGURES))


def calibration_table(spark, sf_dir):
    return M.calibration(_scored(spark, sf_dir), "y", "p").select("bin", "n", *_r("mean_p", "rate"))


def calibration_error(spark, sf_dir):
    return M.expected_calibration_error(M.calibration(_scored(spark, sf_dir), "y", "p")).select(*_r("ece"))


def auc_rank(spark, sf_dir):
    return M.auc(_scored(spark, sf_dir), "y", "p").select(*_r("auc"))


def segment_metrics(spark, sf_dir):
    segments = [("long", F.col("n_chars") > 2000), ("english", F.col("lang") == "en"), ("all", F.lit(True))]
    return M.segment_metrics(_scored(spark, sf_dir), "y", "p", segments).select("segment", "n", *_r(*_FIGURES))


def grouping_sets_segments(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return M.by_grouping_sets(lines, ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _days(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")))


DAYS = "d AS (SELECT *, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders)"


def purged_split(spark, sf_dir):
    return T.purged_split(_days(spark, sf_dir), "day", 3, 2).groupBy("part").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def dense_rank_folds(spark, sf_dir):
    return T.folds(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_orderkey", "fold")


def _by_customer(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("k"))


def wilson(spark, sf_dir):
    a, b = X.wilson_clamped("k", "n"), X.wilson_open("k", "n")
    c = _by_customer(spark, sf_dir).select("o_custkey", a["low"].alias("a_low"), a["high"].alias("a_high"), b["low"].alias("b_low"), b["high"].alias("b_high"), X.proportion_z("k", "n", F.lit(0.5)).alias("z"))
    return c.select("o_custkey", *_r("a_low", "a_high", "b_low", "b_high", "z"))


def _wilson_sql(z: str) -> str:
    return f"((k / n + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n)) {{s}} ({z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4.0 * n * n)) / (1 + {z} * {z} / n))"


def mean_ci(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count("*").alias("n"))
    c = X.mean_interval(F.col("m"), F.col("s"), F.col("n"))
    return m.select("o_custkey", F.round("m", 7).alias("mean"), F.round(c["low"], 7).alias("low"), F.round(c["high"], 7).alias("high"))


def reconcile_join(spark, sf_dir):
    mine = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status_"))
    theirs = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status_"))
    return T.reconciliation_counts(T.reconciled(mine, theirs, "o_orderkey", "status_")).select("matched", "mismatched", "missing", *_r("coverage", "agreement"))


def conflict_exclusion(spark, sf_dir):
    return T.without_conflicts(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


def semi_anti(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    with_, without = customers.join(urgent, "c_custkey", "left_semi"), customers.join(urgent, "c_custkey", "left_anti")
    return with_.select("c_custkey", F.lit("urgent").alias("kind")).union(without.select("c_custkey", F.lit("none")))


def union_first_wins(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus")
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return T.first_wins([a, b], "o_orderkey").select("o_orderkey", "o_orderstatus", "origin")


def interval_overlap(spark, sf_dir):
    o = _days(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus", "day").withColumn("end", F.col("day") + 30)
    return T.intervals_meet(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), "o_custkey", "day", "end", 30).select("o_orderkey")


COSTS = [{"scenario": "base", "cost": 0.0}, {"scenario": "stress", "cost": 0.02}, {"scenario": "ultra", "cost": 0.05}]


def _pnl(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("pnl", F.col("l_discount") - F.col("l_tax"))


def stress_grid(spark, sf_dir):
    rows = S.with_scenarios(_pnl(spark, sf_dir).select("pnl"), COSTS).withColumn("net", F.col("pnl") - F.col("cost"))
    return S.stress_summary(rows, ["scenario"], "net").select("scenario", "n", *_r("win_rate", "mean", "deviation", "low", "high"), F.round("total", 4).alias("total"))


def matched_null(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return S.matched_null(rows, "o_orderpriority", "o_orderkey", "o_totalprice", 20).select("trial", F.round("mean", 4).alias("mean"))


def top_k_share(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return M.top_share(o, "o_totalprice").select(F.round("top", 2).alias("top"), F.round("total", 2).alias("total"), *_r("share"))


def largest_group_share(spark, sf_dir):
    return M.largest_group_share(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").select(F.round("largest", 2).alias("largest"), F.round("total", 2).alias("total"), *_r("share"))


def classify_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = X.only_match("text", {"mail": r"[a-z0-9]@[a-z0-9]", "phone": r"\+[0-9]", "marked": r"[#$%&]{3}"})
    return docs.select("doc_id", kind.alias("kind"), X.price_bucket(F.pmod("doc_id", F.lit(101)) / 100).alias("bucket"))


def array_top_of_book(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    levels = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"))).alias("bids"))
    return levels.select("l_orderkey", F.round(X.best_price("bids"), 4).alias("best"), F.round(X.best_price("bids", False), 4).alias("worst"), F.round(X.depth("bids"), 4).alias("depth"), F.round(X.depth("bids", X.best_price("bids")), 4).alias("top_size"))


def cosine_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(X.cosine("embedding", "other"), 5).alias("cosine"))


def holm_bonferroni(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderkey") % 97).cast("double")).alias("m")).select(F.col("o_orderpriority").alias("test"), F.round(F.abs(F.col("m") - 48) / 20, 6).alias("p"))
    return S.holm(p, "test", "p").select("test", "p", *_r("holm", "bonferroni"), "holm_passes", "bonferroni_passes")


def logistic_irls(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("y", F.col("n_chars").cast("double").alias("n_chars"), (F.col("lang") == "en").cast("double").alias("english"))
    figures = S.preprocessing(rows, ["n_chars"])
    w = S.logistic_fit(S.standardised(rows, figures), ["n_chars", "english"], "y")
    return S.coefficients(spark, ["n_chars", "english"], w).select("feature", *_r("weight"))


def bootstrap_ci(spark, sf_dir):
    return S.bootstrap_mean(_pnl(spark, sf_dir), "l_suppkey", "pnl").select(*_r("mean", "low", "high"))


TABLES = {
    "dominant_share": (dominant_share, f"WITH {TRADES}, c AS (SELECT wallet, token, count(*) AS c FROM tr GROUP BY 1, 2) SELECT wallet, token, round(c / sum(c) OVER (PARTITION BY wallet), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY c DESC, token) = 1"),
    "consensus_vote": (consensus_vote, """WITH w AS (SELECT l_orderkey, l_returnflag AS s, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(w) OVER (PARTITION BY l_orderkey) AS top FROM w)
SELECT l_orderkey, count(*) AS sides, CASE WHEN count(*) FILTER (w = top) > 1 THEN 'TIE' ELSE max(s) FILTER (w = top) END AS winner, round(max(top) / sum(w), 6) AS agreement FROM m GROUP BY 1"""),
    "dedupe_keep_first": (dedupe_keep_first, "SELECT l_partkey, l_suppkey, arg_min(l_orderkey, l_orderkey * 100 + l_linenumber) AS l_orderkey, arg_min(l_linenumber, l_orderkey * 100 + l_linenumber) AS l_linenumber, arg_min(l_quantity, l_orderkey * 100 + l_linenumber) AS l_quantity, count(*) AS copies FROM lineitem GROUP BY 1, 2"),
    "best_version": (best_version, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC) = 1"),
    "multi_key_sort_topk": (multi_key_sort_topk, "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem ORDER BY lineitem.l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100"),
    "null_profile": (null_profile, """WITH t AS (SELECT count(*) AS r, count(*) FILTER (NOT l_quantity > 25) AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem)
SELECT c AS "column", r AS "rows", n AS nulls, round(1 - n / r, 6) AS completeness FROM (SELECT 'l_orderkey' AS c, r, 0 AS n FROM t UNION ALL SELECT 'large', r, a FROM t UNION ALL SELECT 'returned', r, b FROM t)"""),
    "duplicate_rate": (duplicate_rate, 'WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) SELECT sum(n)::BIGINT AS "rows", count(*) AS "distinct", (sum(n) - count(*))::BIGINT AS duplicates, round((sum(n) - count(*)) / sum(n), 6) AS rate FROM g'),
    "corr_matrix": (corr_matrix, CORR),
    "quality_score": (quality_score, f"""WITH {SAMPLES}, c AS (SELECT count(*) AS n, count(*) FILTER (market_source = 'public') AS p, count(*) FILTER (market_source = 'mock') AS k, count(*) FILTER (outcome = 1) AS u, count(*) FILTER (outcome = 0) AS d, count(*) FILTER (size IS NULL) + count(*) FILTER (tax IS NULL) AS f, count(*) FILTER (outcome IS NULL) AS o,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT market_id, market_source, outcome, size, tax, micro FROM sa)) AS dup, count(*) - count(DISTINCT market_id) AS dm FROM sa),
x AS (SELECT *, 100.0 * least(u, d) / (u + d) AS mi, 100.0 * dup / n AS dr FROM c), y AS (SELECT *, round(100.0 * p / n, 4) AS a, round(least(100.0, 2 * mi), 4) AS b, round(100 - 100.0 * (f + o) / (n * 5), 4) AS m, round(100 - dr, 4) AS q, round(100.0 * (2 * n - f) / (2 * n), 4) AS e FROM x),
z AS (SELECT *, round(a * 0.30 + b * 0.25 + m * 0.15 + q * 0.10 + e * 0.20, 2) AS score FROM y),
g AS (SELECT *, list_filter([CASE WHEN 100.0 * p / n < 80 THEN 'public sample ratio is below 80%' END, CASE WHEN mi < 30 THEN 'minority class share is below 30%' END, CASE WHEN 100.0 * (2 * n - f) / (2 * n) < 95 THEN 'feature completeness is below 95%' END, CASE WHEN dr > 1 THEN 'duplicate rate exceeds 1%' END, CASE WHEN score < 75 THEN 'quality score is below 75' END], lambda x: x IS NOT NULL) AS fa FROM z)
SELECT n AS "rows", p AS public_rows, k AS mock_rows, u AS up, d AS down, f + o AS missing_values, dup AS duplicate_rows, dm AS duplicate_markets, round(100.0 * abs(u - d) / (u + d), 4) AS imbalance, round(mi, 4) AS minority, a AS public_sample_ratio, b AS class_balance, m AS missing_value_control, q AS duplicate_control, e AS feature_completeness, score, array_to_string(fa, '; ') AS failures, len(fa) = 0 AS recommended FROM g"""),
    "missingness": (missingness, f"WITH {SAMPLES}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", session, {c} IS NULL AS x FROM sa" for c in ("outcome", "size", "tax")) + ") SELECT \"column\", coalesce(session::VARCHAR, 'all') AS session, count(*) AS \"rows\", count(*) FILTER (x) AS nulls, round(1 - count(*) FILTER (x) / count(*), 6) AS completeness FROM u GROUP BY GROUPING SETS ((1), (1, session))"),
    "dataset_summary": (dataset_summary, f"WITH {SAMPLES}, u AS (SELECT 'rows' AS item, 'all' AS name FROM sa UNION ALL SELECT 'group', market_source FROM sa UNION ALL SELECT 'outcome', coalesce(outcome::VARCHAR, 'none') FROM sa UNION ALL SELECT 'nulls', 'size' FROM sa WHERE size IS NULL UNION ALL SELECT 'nulls', 'tax' FROM sa WHERE tax IS NULL UNION ALL SELECT 'nulls', 'outcome' FROM sa WHERE outcome IS NULL) SELECT item, name, count(*) AS value FROM u GROUP BY 1, 2"),
    "prob_metrics": (prob_metrics, f"WITH {SCORED} SELECT {_METRICS} FROM s"),
    "calibration_table": (calibration_table, f"WITH {SCORED}, b AS (SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM s GROUP BY 1) SELECT i::INTEGER AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_p, round(r, 6) AS rate FROM range(10) t(i) LEFT JOIN b ON b.bin = i"),
    "calibration_error": (calibration_error, f"WITH {SCORED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM s GROUP BY 1) SELECT round(sum(n * abs(r - m)) / sum(n), 6) AS ece FROM b"),
    "auc_rank": (auc_rank, f"WITH {SCORED} SELECT round((count(*) FILTER (a.p > b.p) + 0.5 * count(*) FILTER (a.p = b.p)) / count(*), 6) AS auc FROM s a JOIN s b ON a.y = 1 AND b.y = 0"),
    "segment_metrics": (segment_metrics, f"WITH {SCORED}, g AS (SELECT 'long' AS segment, * FROM s WHERE n_chars > 2000 UNION ALL SELECT 'english', * FROM s WHERE lang = 'en' UNION ALL SELECT 'all', * FROM s) SELECT segment, {_METRICS} FROM g GROUP BY 1"),
    "grouping_sets_segments": (grouping_sets_segments, "SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS dimension, coalesce(l_returnflag, l_linestatus, 'all') AS value, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))"),
    "purged_split": (purged_split, f"""WITH {DAYS}, n AS (SELECT count(DISTINCT day) AS n, (count(DISTINCT day) * 0.70::DOUBLE) AS a, (count(DISTINCT day) * (0.70::DOUBLE + 0.15::DOUBLE)) AS b FROM d), r AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM d)), c AS (SELECT day, i, floor(a)::BIGINT AS a, floor(b)::BIGINT AS b FROM r, n),
p AS (SELECT day, CASE WHEN i >= b AND i < b + 2 THEN 'embargoed' WHEN i >= b - 3 AND i < b THEN 'purged' WHEN i >= a AND i < a + 2 THEN 'embargoed' WHEN i >= a - 3 AND i < a THEN 'purged' WHEN i < a THEN 'train' WHEN i < b THEN 'validation' ELSE 'test' END AS part FROM c)
SELECT part, count(*) AS n, min(d.day)::INTEGER AS first, max(d.day)::INTEGER AS last FROM d JOIN p USING (day) GROUP BY 1"""),
    "dense_rank_folds": (dense_rank_folds, """WITH f AS (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1), p AS (SELECT o_custkey, (row_number() OVER (ORDER BY f, o_custkey) - 1) * 3 // count(*) OVER () + 1 AS fold FROM f) SELECT o_orderkey, fold::INTEGER AS fold FROM orders JOIN p USING (o_custkey)"""),
    "wilson": (wilson, f"""WITH c AS (SELECT o_custkey, count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k FROM orders GROUP BY 1)
SELECT o_custkey, round(greatest(0.0, {_wilson_sql('1.96').format(s='-')}), 6) AS a_low, round(least(1.0, {_wilson_sql('1.96').format(s='+')}), 6) AS a_high, round({_wilson_sql('1.959963984540054').format(s='-')}, 6) AS b_low, round({_wilson_sql('1.959963984540054').format(s='+')}, 6) AS b_high, round((k / n - 0.5) / sqrt(0.25 / n), 6) AS z FROM c"""),
    "mean_ci": (mean_ci, "WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round(m, 7) AS mean, round(m - CASE WHEN n < 2 THEN 0 ELSE 1.96 * s / sqrt(n) END, 7) AS low, round(m + CASE WHEN n < 2 THEN 0 ELSE 1.96 * s / sqrt(n) END, 7) AS high FROM m"),
    "reconcile_join": (reconcile_join, "WITH t AS (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), j AS (SELECT o_orderstatus AS a, s AS b, t.l_orderkey AS k FROM orders LEFT JOIN t ON o_orderkey = l_orderkey), c AS (SELECT count(*) FILTER (k IS NOT NULL AND a = b) AS x, count(*) FILTER (k IS NOT NULL AND a <> b) AS y, count(*) FILTER (k IS NULL) AS z FROM j) SELECT x AS matched, y AS mismatched, z AS missing, round(100 * (x + y) / (x + y + z), 6) AS coverage, round(100 * x / (x + y), 6) AS agreement FROM c"),
    "conflict_exclusion": (conflict_exclusion, "SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) = 1"),
    "semi_anti": (semi_anti, "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'urgent' ELSE 'none' END AS kind FROM customer"),
    "union_first_wins": (union_first_wins, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS o_orderstatus, (o_orderkey % 2)::INTEGER AS origin FROM orders"),
    "interval_overlap": (interval_overlap, f"WITH {DAYS} SELECT o_orderkey FROM d a WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM d b WHERE b.o_orderstatus = 'F' AND a.o_custkey = b.o_custkey AND a.day < b.day + 30 AND a.day + 30 > b.day)"),
    "stress_grid": (stress_grid, "WITH s(scenario, cost) AS (VALUES ('base', 0.0::DOUBLE), ('stress', 0.02::DOUBLE), ('ultra', 0.05::DOUBLE)), r AS (SELECT scenario, l_discount - l_tax - cost AS net FROM lineitem, s), g AS (SELECT scenario, count(*) AS n, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS w, avg(net) AS m, stddev_samp(net) AS s, sum(net) AS t FROM r GROUP BY 1) SELECT scenario, n, round(w, 6) AS win_rate, round(m, 6) AS mean, round(s, 6) AS deviation, round(m - 1.96 * s / sqrt(n), 6) AS low, round(m + 1.96 * s / sqrt(n), 6) AS high, round(t, 4) AS total FROM g"),
    "matched_null": (matched_null, """WITH p AS (SELECT o_orderpriority AS f, o_orderkey AS k, o_totalprice AS pnl, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
a AS (SELECT trial, f, floor(('0x' || substr(sha256('1|' || trial || '|' || k), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 * n)::BIGINT AS i FROM p, range(20) t(trial))
SELECT trial::INTEGER AS trial, round(avg(pnl), 4) AS mean FROM a JOIN p USING (f, i) GROUP BY 1"""),
    "top_k_share": (top_k_share, "WITH t AS (SELECT o_totalprice AS v FROM orders WHERE o_totalprice > 0 ORDER BY 1 DESC LIMIT 10), s AS (SELECT (SELECT sum(v) FROM t) AS a, (SELECT sum(o_totalprice) FROM orders) AS b) SELECT round(a, 2) AS top, round(b, 2) AS total, round(CASE WHEN b > 0 THEN a / b END, 6) AS share FROM s"),
    "largest_group_share": (largest_group_share, "WITH g AS (SELECT sum(o_totalprice) AS v FROM orders GROUP BY o_orderpriority) SELECT round(max(v), 2) AS largest, round(sum(v), 2) AS total, round(max(v) / sum(v), 6) AS share FROM g"),
    "classify_text": (classify_text, """WITH h AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), '[a-z0-9]@[a-z0-9]') THEN 'mail' END, CASE WHEN regexp_matches(lower(text), '\\+[0-9]') THEN 'phone' END, CASE WHEN regexp_matches(lower(text), '[#$%&]{3}') THEN 'marked' END], lambda x: x IS NOT NULL) AS h, (doc_id % 101) / 100 AS p FROM documents)
SELECT doc_id, CASE WHEN len(h) = 1 THEN h[1] END AS kind, CASE WHEN p < 0.1 THEN '0.00-0.10' WHEN p < 0.25 THEN '0.10-0.25' WHEN p < 0.5 THEN '0.25-0.50' WHEN p < 0.75 THEN '0.50-0.75' WHEN p < 0.9 THEN '0.75-0.90' ELSE '0.90-1.00' END AS bucket FROM h"""),
    "array_top_of_book": (array_top_of_book, "WITH m AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) SELECT l_orderkey, round(max(b), 4) AS best, round(min(l_extendedprice), 4) AS worst, round(sum(l_quantity), 4) AS depth, round(sum(l_quantity) FILTER (l_extendedprice = b), 4) AS top_size FROM m GROUP BY 1"),
    "cosine_similarity": (cosine_similarity, "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "holm_bonferroni": (holm_bonferroni, """WITH t AS (SELECT o_orderpriority AS test, round(abs(avg((o_orderkey % 97)::DOUBLE) - 48) / 20, 6) AS p FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM t), h AS (SELECT *, max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS h FROM r)
SELECT test, p, round(h, 6) AS holm, round(least(1.0, m * p), 6) AS bonferroni, h < 0.05 AS holm_passes, least(1.0, m * p) < 0.05 AS bonferroni_passes FROM h"""),
    "logistic_irls": (logistic_irls, ""),
    "bootstrap_ci": (bootstrap_ci, ""),
}
