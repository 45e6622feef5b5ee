"""Scalar expressions for quotes, prices, probabilities, texts and times. All are built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Times


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone; a TIMESTAMP column counts in the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two columns of microseconds, with their fraction."""
    return (later - earlier) / F.lit(1e6)


def epoch_timestamp(x: ColumnOrName) -> Column:
    """Epoch seconds, or milliseconds if over 1e10, as a timestamp."""
    v = _c(x).cast("double")
    return F.timestamp_micros((F.when(v > 1e10, v * 1000).otherwise(v * 1_000_000)).cast("long"))


def iso_timestamp(x: ColumnOrName) -> Column:
    """ISO-8601 text with offset, Z or a blank between date and time; NULL if malformed."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(_c(x)), r"^(\S+) ", "$1T"))


def floored(x: Column, step: float) -> Column:
    """The multiple of `step` at or under x."""
    return F.floor(x / F.lit(step)) * F.lit(step)


def measured_delay(x: ColumnOrName) -> Column:
    """measured, invalid (negative) or unknown."""
    return F.when(_c(x).isNull(), "unknown").when(_c(x) < 0, "invalid").otherwise("measured")


# Quotes


def midpoint(bid: ColumnOrName, ask: ColumnOrName) -> Column:
    """The middle of bid and ask, or the one that there is."""
    return F.coalesce((_c(bid) + _c(ask)) / 2, _c(bid), _c(ask))


def book_imbalance(bid_size: ColumnOrName, ask_size: ColumnOrName) -> Column:
    return F.try_divide(_c(bid_size) - _c(ask_size), _c(bid_size) + _c(ask_size))


def executable_price(side: ColumnOrName, bid: ColumnOrName, ask: ColumnOrName, entry: bool = True) -> Column:
    """What a YES or NO taker pays (entry) or gets: NO trades against the other side at one minus its price."""
    yes, no = (_c(ask), 1 - _c(bid)) if entry else (_c(bid), 1 - _c(ask))
    return F.when(_c(side) == "YES", yes).when(_c(side) == "NO", no)


def quote_flags(bid: ColumnOrName, ask: ColumnOrName, wide: float = 0.05) -> Column:
    """valid, crossed, locked and wide, as a struct."""
    b, a = _c(bid), _c(ask)
    valid = F.coalesce((b > 0) & (b < 1) & (a > 0) & (a < 1), F.lit(False))
    return F.struct(valid.alias("valid"), F.coalesce(b > a, F.lit(False)).alias("crossed"), F.coalesce(b == a, F.lit(False)).alias("locked"), F.coalesce(a - b > wide, F.lit(False)).alias("wide"))


def price_bucket(p: ColumnOrName) -> Column:
    """Six half-open ranges of a price."""
    out = F.lit(None).cast("string")
    for high, name in ((1.0000001, "0.90-1.00"), (0.9, "0.75-0.90"), (0.75, "0.50-0.75"), (0.5, "0.25-0.50"), (0.25, "0.10-0.25"), (0.1, "0.00-0.10")):
        out = F.when((_c(p) < high) & (_c(p) >= 0), name).otherwise(out)
    return out


def best_price(levels: ColumnOrName, highest: bool = True) -> Column:
    """The best price of an array of (price, size) structs; null entries don't count."""
    prices = F.transform(F.filter(_c(levels), lambda x: x["price"].isNotNull()), lambda x: x["price"])
    return F.array_max(prices) if highest else F.array_min(prices)


def depth(levels: ColumnOrName, price: Column | None = None) -> Column:
    """The total size of the levels, or of those at one price."""
    chosen = _c(levels) if price is None else F.filter(_c(levels), lambda x: x["price"] == price)
    return F.aggregate(chosen, F.lit(0.0), lambda s, x: s + F.coalesce(x["size"], F.lit(0.0)))


# Probabilities and statistics


def clip(x: ColumnOrName, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def clip_probability(p: ColumnOrName) -> Column:
    return clip(p, 1e-12, 1 - 1e-12)


def sigmoid(z: ColumnOrName) -> Column:
    """Stable for large |z|."""
    e = F.exp(-F.abs(_c(z)))
    return F.when(_c(z) >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: ColumnOrName) -> Column:
    q = clip_probability(p)
    return F.ln(q / (1 - q))


def _wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    p, size = F.try_divide(k, n), F.greatest(n.cast("double"), F.lit(1e-300))
    centre = (p + z * z / (2 * size)) / (1 + z * z / size)
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / (1 + z * z / size)
    return centre - half, centre + half


def wilson_clamped(successes: ColumnOrName, trials: ColumnOrName) -> Column:
    """z = 1.96, within 0 to 1, and (0, 0) without trials."""
    low, high = _wilson(_c(successes), _c(trials), 1.96)
    none = F.coalesce(_c(trials) <= 0, F.lit(True))
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), low)).alias("low"), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), high)).alias("high"))


def wilson_open(successes: ColumnOrName, trials: ColumnOrName) -> Column:
    """z = 1.959963984540054, and (0, 1) without trials."""
    low, high = _wilson(_c(successes), _c(trials), 1.959963984540054)
    none = F.coalesce(_c(trials) <= 0, F.lit(True))
    return F.struct(F.when(none, 0.0).otherwise(low).alias("low"), F.when(none, 1.0).otherwise(high).alias("high"))


def proportion_z(successes: ColumnOrName, trials: ColumnOrName, p0: ColumnOrName) -> Column:
    """0 where p0 isn't between 0 and 1 or there are no trials."""
    p = _c(p0)
    z = F.try_divide(F.try_divide(_c(successes), _c(trials)) - p, F.sqrt(F.try_divide(p * (1 - p), _c(trials))))
    return F.when((p > 0) & (p < 1) & (_c(trials) > 0), z).otherwise(0.0)


def mean_interval(mean: Column, deviation: Column, n: Column, z: float = 1.96) -> Column:
    """Normal interval of a mean; its own value twice if n < 2."""
    half = F.when(n < 2, 0.0).otherwise(z * deviation / F.sqrt(F.greatest(n, F.lit(1))))
    return F.struct((mean - half).alias("low"), (mean + half).alias("high"))


def hash_uniform(*parts: ColumnOrName) -> Column:
    """A fixed number from 0 up to 1 for the parts: the first 16 hex digits of their SHA-256 over 2^64."""
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(_c(a), _c(a))) * F.sqrt(dot(_c(b), _c(b)))
    return F.coalesce(F.try_divide(dot(_c(a), _c(b)), F.nullif(norm, F.lit(0.0))), F.lit(0.0))


def edge_score(lag: ColumnOrName, volume: ColumnOrName, momentum: ColumnOrName, stability: ColumnOrName) -> Column:
    """Fixed weights 0.4, 0.3, 0.2, 0.1, rounded to six places."""
    return F.round(0.4 * _c(lag) + 0.3 * _c(volume) + 0.2 * _c(momentum) + 0.1 * _c(stability), 6)


# Texts and lists


def typed(x: ColumnOrName, kind: str) -> Column:
    """The cast of a text; NULL if it is blank or malformed."""
    text = F.trim(_c(x).cast("string"))
    return F.when(text != "", text).try_cast(kind)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, n) for c, n in pairs]))


def first_reason(*pairs: tuple[Column, str], otherwise: str | None = None) -> Column:
    return reduce(lambda out, p: F.when(p[0], p[1]).otherwise(out), reversed(pairs), F.lit(otherwise))


def sorted_set(x: ColumnOrName, separator: str = ";") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_c(x))), separator)


def same_text(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.lower(F.trim(_c(a))) == F.lower(F.trim(_c(b)))


def dedupe_key(*parts: ColumnOrName) -> Column:
    return F.lower(F.concat_ws("|", *[F.trim(F.coalesce(_c(p).cast("string"), F.lit(""))) for p in parts]))


def plain_decimal(x: ColumnOrName) -> Column:
    """A decimal without trailing zeros."""
    text = _c(x).cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def slug_epoch(slug: ColumnOrName) -> Column:
    """The epoch at the end of a five-minute market's slug."""
    return F.when(_c(slug).rlike(r"-5m-\d+$"), F.regexp_extract(_c(slug), r"-5m-(\d+)$", 1)).cast("long")


def only_match(text: ColumnOrName, patterns: dict[str, str]) -> Column:
    """The name of the one pattern that matches, NULL if none or several do."""
    hits = F.array_compact(F.array(*[F.when(F.lower(_c(text)).rlike(p), n) for n, p in patterns.items()]))
    return F.when(F.size(hits) == 1, F.element_at(hits, 1))


def step_score(x: ColumnOrName, steps: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """The value of the first step (least, value) that x reaches, steps from high to low."""
    return reduce(lambda out, s: F.when(_c(x) >= s[0], s[1]).otherwise(out), reversed(steps), F.lit(otherwise))


def canonical_json(*names: str) -> Column:
    """The columns as JSON with their names in order and null fields kept; no blanks."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def fixed(x: ColumnOrName, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", _c(x).cast("double"))


def epoch_iso(x: ColumnOrName) -> Column:
    """Whole epoch seconds as ISO-8601 text; NULL if they are no number. In a session whose zone is UTC."""
    return F.date_format(F.timestamp_seconds(_c(x).cast("string").try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss+00:00")


def five_minute_market(flag: ColumnOrName, slug: ColumnOrName) -> Column:
    """What the flag (text) says if there is one, else whether the slug ends as a five-minute market's."""
    given = F.nullif(F.trim(_c(flag)), F.lit(""))
    return F.when(given.isNotNull(), F.lower(given) == "true").otherwise(F.coalesce(_c(slug).rlike(r"-5m-\d+$"), F.lit(False)))


def event_age_ms(received: ColumnOrName, server_ms: ColumnOrName) -> Column:
    """Milliseconds from a server's time to that of receipt (microseconds)."""
    return _c(received) / F.lit(1000.0) - _c(server_ms)


def decision(open_side: ColumnOrName, score: ColumnOrName, reference: ColumnOrName, price: ColumnOrName, held: ColumnOrName, enter: float = 0.7, leave: float = 0.4, near: float = 0.02, timeout: int = 10) -> Column:
    """action (OPEN, HOLD or CLOSE), side and reason of a score-driven rule, as a struct.

    Without an open side a score over `enter` opens the side that the reference favours. An open one closes on a score
    under `leave`, a price within `near` of the reference, or after `timeout` steps held, whichever comes first.
    """
    s, idle = _c(score), _c(open_side).isNull()
    reason = first_reason(
        (idle & (s > enter), "edge_score_above_threshold"),
        (idle, "no_entry"),
        (s < leave, "score_below_exit"),
        (F.abs(_c(reference) - _c(price)) <= near, "convergence"),
        (_c(held) >= timeout, "timeout"),
        otherwise="position_open",
    )
    action = F.when(reason == "edge_score_above_threshold", "OPEN").when(reason.isin("no_entry", "position_open"), "HOLD").otherwise("CLOSE")
    side = F.when(action == "OPEN", F.when(_c(reference) > _c(price), "YES").otherwise("NO")).otherwise(_c(open_side))
    return F.struct(action.alias("action"), side.alias("side"), reason.alias("reason"))


def filled(stake: ColumnOrName, price: ColumnOrName, slippage: float, entry: bool = True) -> Column:
    """price and quantity of a paper fill, as a struct: slippage multiplies the price, up on entry and down on exit."""
    paid = _c(price) * (1 + slippage if entry else 1 - slippage)
    return F.struct(paid.alias("price"), F.try_divide(_c(stake), paid).alias("quantity"))
