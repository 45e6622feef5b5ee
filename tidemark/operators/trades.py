"""Public trade pages as typed trades: flattening, market classes, keys, first-wins duplicates, limits and gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dedupe_key, plain_decimal, reasons
from ..storage import written
from .order import ordinal
from .tables import keep_first

# Fixed layout of a page of activity; a page's rows are its payload, or the payload's `value`.
ROW = "struct<title:string,slug:string,eventSlug:string,type:string,timestamp:string,asset:string,conditionId:string,side:string,price:string,size:string,usdcSize:string,outcome:string,outcomeIndex:string,transactionHash:string,proxyWallet:string>"
PAGE = "struct<wallet_id:string,user:string,profile_url:string,url:string,source_endpoint:string,source_endpoint_name:string,fetched_at:string,source_fetch_timestamp:string,retrieved_at:string>"
# Fixed patterns of assets, and words that tell of fast markets and of weather.
ASSETS = {"BTC": "(^|[^a-z])btc([^a-z]|$)|bitcoin", "ETH": "(^|[^a-z])eth([^a-z]|$)|ethereum", "SOL": "(^|[^a-z])sol([^a-z]|$)|solana"}
FAST = "updown|up or down"
WEATHER = "rain|weather|temperature|snow|hurricane"
#: Fields that a trade must have, and those of its provenance (fixed values).
REQUIRED = ("wallet_id", "activity_timestamp", "transaction_hash", "condition_id", "token_id", "side", "price", "size", "source_fetch_timestamp", "raw_payload_hash")
PROVENANCE = ("source_endpoint", "source_fetch_timestamp", "raw_payload_hash")
#: What `ingestion_gates` and the order of duplicates read of a trade.
GATED = tuple(dict.fromkeys((*REQUIRED, *PROVENANCE, "activity_time", "market_type", "market_title", "market_slug", "dedupe_key", "place")))
# Bounds of an ingestion (fixed values).
LIMITS = {"wallets": 6, "rows_each": 300, "pages_each": 3, "rows": 1800}


def market_class(title: Column, slug: Column) -> Column:
    """market_type, asset_class and up_down of a trade's market, as a struct, from its title and slug."""
    slug = F.lower(F.coalesce(slug, F.lit("")))
    text = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), slug)
    asset = reduce(lambda out, a: F.when(text.rlike(ASSETS[a]), a).otherwise(out), reversed(list(ASSETS)), F.lit("other"))
    up_down = (asset != "other") & (text.rlike(FAST) | slug.rlike("(^|-)(up|down)($|-)"))
    kind = F.when(up_down, "fast_crypto_up_down").when(asset != "other", "crypto_other").when(text.rlike(WEATHER), "weather").otherwise("other")
    return F.struct(kind.alias("market_type"), asset.alias("asset_class"), up_down.alias("up_down"))


def snapshot_class(title: Column, slug: Column) -> Column:
    """fast_crypto, weather, crypto_other or other, of a position's market."""
    text = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(slug, F.lit(""))))
    crypto = text.rlike("bitcoin|btc|ethereum|eth|solana| sol-| sol ")
    return F.when(crypto & text.rlike("up or down|updown|15m|5m|1h|hour"), "fast_crypto").when(text.rlike("weather|temperature|rain|snow"), "weather").when(crypto, "crypto_other").otherwise("other")


def exposure(title: Column, slug: Column) -> Column:
    """BTC, ETH, SOL or OTHER."""
    text = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(slug, F.lit(""))))
    return F.when(text.rlike("bitcoin|btc"), "BTC").when(text.rlike(r"ethereum|\beth\b"), "ETH").when(text.rlike(r"solana|\bsol\b"), "SOL").otherwise("OTHER")


def entry_or_exit(activity: Column, side: Column) -> Column:
    """What a row of activity may be: an entry, an exit, a resolution, a rebate, or unknown."""
    kind, way = F.upper(F.coalesce(activity, F.lit(""))), F.upper(F.coalesce(side, F.lit("")))
    return (
        F.when((kind == "TRADE") & (way == "BUY"), "entry_candidate").when((kind == "TRADE") & (way == "SELL"), "exit_candidate").when(kind == "REDEEM", "resolution_candidate").when(kind.isin("MAKER_REBATE", "TAKER_REBATE", "REWARD"), "rebate_or_other").otherwise("unknown")
    )


def timeframe(title: Column, slug: Column) -> Column:
    """15m, 5m, updown_window_unknown or other_timeframe."""
    text = F.concat_ws(" ", F.lower(F.coalesce(slug, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))))
    return F.when(text.rlike("15m|15-min"), "15m").when(text.rlike("5m|5-min"), "5m").when(text.rlike("updown|up-or-down|up or down"), "updown_window_unknown").otherwise("other_timeframe")


def pages(lines: DataFrame, column: str = "value") -> DataFrame:
    """A row for each row of each page (JSON in `column`): the page's fields, raw and its hash, and row, a struct.

    A page without rows gives one with a null row, so that pages can be counted. Rows that are no objects are left out.
    """
    return _dealt(lines.filter(F.length(F.trim(column)) > 0), column)


def _dealt(lines: DataFrame, column: str) -> DataFrame:
    """As `pages`, with a blank line as a page without rows."""
    text = F.col(column)
    listed = lambda path: F.from_json(F.get_json_object(text, path), "array<string>")
    rows = F.filter(F.coalesce(listed("$.payload.value"), listed("$.payload"), listed("$")), lambda r: F.ltrim(r).startswith("{"))
    page = F.from_json(text, PAGE)
    # What is a page's is read before its rows are dealt out: after that it would be read again for each row.
    out = lines.select(page.alias("page"), F.sha2(F.coalesce(F.get_json_object(text, "$.payload"), text), 256).alias("raw_page_hash"), rows.alias("_rows"))
    out = out.withColumn("first_wallet", F.from_json(F.try_element_at("_rows", F.lit(1)), ROW)["proxyWallet"])
    out = out.select("page", "raw_page_hash", "first_wallet", F.posexplode_outer("_rows").alias("place", "raw"))
    return out.withColumn("row", F.from_json("raw", ROW))


def normalised(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed trades from pages: the row's fields as text and decimals, notional value, market class, keys and quality.

    The wallet is the page's, else that of its first row, for all its rows, else `unknown_wallet`; a blank field counts as
    none. Without a notional of its own a trade gets price times size. Rows keep their place in the page, for
    `deduplicated`.
    """
    # Pages without rows are left out here, and blank lines with them: a filter on lines would make their text once more.
    rows = _dealt(lines, column)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = lambda *columns, otherwise: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(otherwise))
    wallet = F.lower(first("page.wallet_id", "page.user", "first_wallet", otherwise="unknown_wallet"))
    kind = first("row.type", otherwise="TRADE")
    price, size, own = (F.col(f"row.{c}").try_cast("decimal(28,12)") for c in ("price", "size", "usdcSize"))
    notional = F.coalesce(own, (price * size).cast("decimal(28,12)"))
    seconds = F.col("row.timestamp").try_cast("long")
    market = market_class(F.col("row.title"), F.col("row.slug"))
    out = rows.filter("raw is not null").select(
        wallet.alias("wallet_id"),
        text("page.profile_url").alias("profile_url"),
        first("page.url", "page.source_endpoint", otherwise="").alias("source_endpoint"),
        first("page.source_endpoint_name", otherwise="activity_primary").alias("source_endpoint_name"),
        first("page.fetched_at", "page.source_fetch_timestamp", "page.retrieved_at", otherwise="").alias("source_fetch_timestamp"),
        F.upper(kind).alias("activity_type"),
        text("row.timestamp").alias("activity_timestamp"),
        F.timestamp_seconds(seconds).alias("activity_time"),
        F.lower(text("row.transactionHash")).alias("transaction_hash"),
        F.lower(text("row.conditionId")).alias("condition_id"),
        text("row.asset").alias("token_id"),
        text("row.slug").alias("market_slug"),
        text("row.eventSlug").alias("event_slug"),
        text("row.title").alias("market_title"),
        text("row.outcome").alias("outcome"),
        F.upper(text("row.side")).alias("side"),
        price.alias("price"),
        size.alias("size"),
        notional.alias("notional"),
        F.when(own.isNotNull(), "endpoint_usdcSize").when(notional.isNotNull(), "computed_price_times_size").otherwise("unavailable").alias("notional_source"),
        market.alias("_market"),
        entry_or_exit(kind, F.col("row.side")).alias("entry_or_exit"),
        F.sha2("raw", 256).alias("raw_payload_hash"),
        "raw_page_hash",
        "place",
    )
    out = out.select("*", "_market.*").drop("_market")
    flags = reasons(
        (F.col("event_slug") == "", "missing_event_slug"),
        (F.col("notional_source") == "computed_price_times_size", "computed_notional"),
        (F.col("activity_time").isNull(), "timestamp_parse_failed"),
        (F.col("market_type") == "other", "non_crypto_or_unclassified_market"),
    )
    key = dedupe_key("wallet_id", "source_endpoint_name", "transaction_hash", "condition_id", "token_id", "activity_timestamp", "side", plain_decimal("price"), plain_decimal("size"))
    group = F.concat_ws("|", "wallet_id", "condition_id", "token_id", "outcome")
    return out.withColumns({"quality": F.coalesce(F.nullif(F.array_join(flags, ";"), F.lit("")), F.lit("none")), "dedupe_key": key, "lifecycle_group_key": group})


def deduplicated(trades: DataFrame, order: Sequence[str] = ("source_fetch_timestamp", "raw_page_hash", "place")) -> DataFrame:
    """The first trade of each dedupe_key in `order`, with its number of copies."""
    return keep_first(trades, ["dedupe_key"], order)


def limit_violations(lines: DataFrame, column: str = "value", limits: dict[str, int] = LIMITS) -> DataFrame:
    """violation, wallet (NULL for those of all): the bounds of an ingestion that its pages break."""
    rows = pages(lines, column).withColumn("wallet", F.lower(F.coalesce("page.wallet_id", "page.user", "row.proxyWallet", F.lit("unknown_wallet"))))
    each = rows.groupBy("wallet").agg(F.count("raw").alias("n"), F.countDistinct("raw_page_hash").alias("pages"))
    each = written(each, "wallets")  # read twice
    own = each.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in ((F.col("n") > limits["rows_each"], "rows_exceed_limit"), (F.col("pages") > limits["pages_each"], "pages_exceed_limit"))]))).alias("violation"), "wallet")
    total = each.agg(F.count("*").alias("w"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    whole = total.select(F.explode(reasons((F.col("w") > limits["wallets"], "wallet_count_exceeds_limit"), (F.col("n") > limits["rows"], "total_activity_rows_exceeds_limit"))).alias("violation"), F.lit(None).cast("string").alias("wallet"))
    return own.unionByName(whole)


def ingestion_gates(trades: DataFrame, removed: int, violations: int = 0) -> DataFrame:
    """gate, value, passed: coverage, duplicates, parsed times, classes and provenance of deduplicated trades.

    `removed` is how many duplicates were removed before, `violations` how many limits were broken.
    """
    n = F.count("*")
    share = lambda c, empty=0.0: F.coalesce(F.try_divide(F.count(F.when(c, 1)), n), F.lit(empty))
    present = lambda names: reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in names])
    text = F.concat_ws(" ", F.lower("market_title"), F.lower("market_slug"))
    fast = text.rlike("btc|bitcoin|eth|ethereum|sol|solana") & text.rlike(FAST)
    one = trades.agg(
        share(present(REQUIRED)).alias("required_field_coverage"),
        F.coalesce(F.try_divide(F.lit(removed), n + removed), F.lit(0.0)).alias("duplicate_rate"),
        share(F.col("activity_time").isNotNull()).alias("timestamp_parse_rate"),
        share(F.coalesce(F.col("market_type"), F.lit("unknown")) != "unknown").alias("market_classification_coverage"),
        F.coalesce(F.try_divide(F.count(F.when(fast & (F.col("market_type") == "fast_crypto_up_down"), 1)), F.count(F.when(fast, 1))), F.lit(1.0)).alias("fast_crypto_classification_coverage"),
        share(present(PROVENANCE)).alias("provenance_completeness"),
        F.lit(float(violations)).alias("bounded_scope_compliance"),
        (F.countDistinct("dedupe_key") == n).alias("_unique"),
    )
    v = F.col
    passed = {
        "required_field_coverage": v("required_field_coverage") == 1,
        "duplicate_rate": (v("duplicate_rate") <= 0.01) & v("_unique"),
        "timestamp_parse_rate": v("timestamp_parse_rate") >= 0.99,
        "market_classification_coverage": v("market_classification_coverage") >= 0.95,
        "fast_crypto_classification_coverage": v("fast_crypto_classification_coverage") == 1,
        "provenance_completeness": v("provenance_completeness") == 1,
        "bounded_scope_compliance": v("bounded_scope_compliance") == 0,
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), v(g).cast("double").alias("value"), c.alias("passed")) for g, c in passed.items()])).alias("r")).select("r.*")


def trade_summary(trades: DataFrame, dimensions: Sequence[str] = ("wallet_id", "side", "asset_class", "market_type", "entry_or_exit")) -> DataFrame:
    """dimension, value, n, notional: overall and by each dimension, in one pass."""
    pairs = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]]
    return trades.withColumn("_d", F.explode(F.array(*pairs))).groupBy("_d.dimension", "_d.value").agg(F.count("*").alias("n"), F.sum("notional").cast("double").alias("notional"))


def ordered(trades: DataFrame, name: str = "place") -> DataFrame:
    """trades numbered in their total order: position, time (what is no number comes last), then all that can tell rows apart."""
    time = F.coalesce(F.col("activity_timestamp").try_cast("long"), F.lit((1 << 63) - 1))
    rest = ("transaction_hash", "side", "price", "size", "dedupe_key", "raw_payload_hash", "source_endpoint_name", "source_fetch_timestamp")
    return ordinal(trades.drop(name).withColumn("_time", time), ["wallet_id", "condition_id", "token_id", "outcome", "_time", *rest], name).drop("_time")


def trade_identity(*fields: str) -> Column:
    """A hash of the fields that make a public trade the same one wherever it is seen."""
    return F.sha2(dedupe_key(*fields), 256)


def slug(asset: Column, start_seconds: Column, frame: str = "5m") -> Column:
    """The slug of an asset's up-or-down market that opens at a time."""
    return F.concat(F.lower(asset), F.lit(f"-updown-{frame}-"), start_seconds.cast("long").cast("string"))


def wallet_address(*texts: Column) -> Column:
    """The first address (0x and 40 hexadecimal digits) that begins one of the texts."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, "^(0x[0-9a-fA-F]{40})", 1), F.lit("")) for t in texts])


def address_candidates(payload: Column, seed: Column) -> Column:
    """All addresses in a JSON text, at any depth; those in objects that name the seed only, if there are such.

    Objects are taken as the innermost braces, so that a name and an address belong together.
    """
    address = F.lit("0x[0-9a-fA-F]{40}")
    objects = F.regexp_extract_all(payload, F.lit(r"\{[^{}]*\}"), F.lit(0))
    near = F.flatten(F.transform(F.filter(objects, lambda o: F.contains(F.lower(o), F.lower(seed))), lambda o: F.regexp_extract_all(o, address, F.lit(0))))
    found = F.regexp_extract_all(payload, address, F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.when(F.size(near) > 0, near).otherwise(found), lambda a: F.lower(a))))


def page_data(html: Column, marker: str = "__NEXT_DATA__") -> Column:
    """The JSON text in the script element of a page that has this id."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{marker}"[^>]*>(.*?)</script>', 1), F.lit(""))


def outcome_prices(names: Column, prices: Column) -> Column:
    """A map from each outcome to its price, from two JSON arrays in text; NULL if their lengths differ."""
    a, b = F.from_json(names, "array<string>"), F.transform(F.from_json(prices, "array<string>"), lambda p: p.try_cast("double"))
    return F.when(F.size(a) == F.size(b), F.map_from_arrays(a, b))


def forbidden(field: Column, terms: Sequence[str] = ("pnl", "roi", "profit", "sharpe", "alpha", "return")) -> Column:
    """Whether a field's name holds one of the terms."""
    return F.lower(field).rlike("|".join(terms))
