"""Sealed chronological splits of a labelled dataset: freezing, verifying, and loading what development may see."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import ordinal
from .tables import require

#: Labels that stay out of the holdout's features, and those that are sealed (fixed values).
LABELS = ("outcome", "resolution_timestamp", "label_source")
SEALED = ("market_id", "outcome", "resolution_timestamp", "label_source")
WINDOW_SECONDS = 300
ARTIFACTS = ("train", "validation", "holdout_features", "sealed_holdout_labels", "excluded_boundary_rows", "split_assignments")


def validated(df: DataFrame) -> DataFrame:
    """df; fails unless its rows are public, authoritatively labelled, of unique ids, five minutes long, with features inside the window.

    window_start, window_end and feature_timestamp are timestamps.
    """
    missing = {"market_id", "asset", "market_source", "window_start", "window_end", "feature_timestamp", *LABELS} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    seconds = F.unix_micros("window_end") - F.unix_micros("window_start")
    require(
        df,
        {
            "public": F.col("market_source") == "public",
            "authoritative": F.col("label_source") == "polymarket_gamma_resolved",
            "feature_inside": (F.col("feature_timestamp") >= F.col("window_start")) & (F.col("feature_timestamp") < F.col("window_end")),
            "five_minutes": seconds == WINDOW_SECONDS * 1_000_000,
        },
    )
    n, ids = df.agg(F.count("*"), F.countDistinct("market_id")).first()
    if not n:
        raise ValueError("the dataset is empty")
    if n != ids:
        raise ValueError("market ids repeat")
    return df


def window_overlaps(df: DataFrame, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """start, next: windows (rows of one start) that end after the next one starts.

    Windows are numbered by range partitions and each is joined with the next number.
    """
    each = df.groupBy(start).agg(F.max(end).alias("_end"))
    placed = ordinal(each, [start], "_i")
    following = placed.select((F.col("_i") - 1).alias("_i"), F.col(start).alias("next"))
    return placed.join(following, "_i").filter(F.col("_end") > F.col("next")).select(start, "next")


def assigned(df: DataFrame, window: str = "window_start", train: float = 0.70, validation: float = 0.15, purge: int = 1, embargo: int = 1) -> DataFrame:
    """df with assignment (train, validation, holdout, excluded) and its reason, by the rank of the distinct window."""
    placed = ordinal(df.select(window).distinct(), [window], "_i")
    n = placed.count()
    need = 2 * (purge + embargo) + 3
    if n < need:
        raise ValueError(f"{n} windows; {need} at least")
    cuts = {"train_validation": int(n * train), "validation_holdout": int(n * (train + validation))}
    i = F.col("_i")
    first, second = cuts.values()
    part, reason = F.when(i < first, "train").when(i < second, "validation").otherwise("holdout"), F.lit("chronological_split")
    for name, c in cuts.items():
        near, after = (i >= c - purge) & (i < c), (i >= c) & (i < c + embargo)
        part = F.when(near | after, "excluded").otherwise(part)
        reason = F.when(near, f"{name}_purge").when(after, f"{name}_embargo").otherwise(reason)
    return df.join(placed.select(window, part.alias("assignment"), reason.alias("reason")), window)


def bounds(rows: DataFrame, window: str = "window_start") -> DataFrame:
    """assignment, first, last, windows, rows of each part."""
    return rows.groupBy("assignment").agg(F.min(window).alias("first"), F.max(window).alias("last"), F.countDistinct(window).alias("windows"), F.count("*").alias("rows"))


def digest(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A digest of a table's rows whatever their order: count, sum and exclusive or of two 64-bit hashes of each row."""
    names = sorted(columns or df.columns)
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    one = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    r = df.select(one.alias("a"), F.xxhash64(*names).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor("a"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor("b")).first()
    return ":".join(str(x) for x in r)


def freeze(df: DataFrame, path: str, **split) -> dict:
    """Write the six ARTIFACTS as Parquet under path, with a manifest of their digests, and return it.

    The holdout's labels are in a table of their own; nothing else under path has them.
    """
    spark = df.sparkSession
    overlaps = window_overlaps(validated(df)).limit(1).collect()
    if overlaps:
        raise ValueError(f"windows overlap: {overlaps[0]}")
    rows = assigned(df, **split)
    part = lambda name: rows.filter(F.col("assignment") == name)
    tables = {
        "train": part("train").drop("assignment", "reason"),
        "validation": part("validation").drop("assignment", "reason"),
        "holdout_features": part("holdout").drop("assignment", "reason", *LABELS),
        "sealed_holdout_labels": part("holdout").select(*SEALED),
        "excluded_boundary_rows": part("excluded").withColumnRenamed("reason", "assignment_reason").drop("assignment"),
        "split_assignments": rows.select("market_id", "asset", "window_start", "window_end", "assignment", "reason"),
    }
    manifest = {"source": {"digest": digest(df), "rows": df.count()}, "artifacts": {}}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
        manifest["artifacts"][name] = digest(spark.read.parquet(f"{path}/{name}"))
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def verify(df: DataFrame, path: str) -> dict:
    """The manifest of a frozen split; fails if the source, an artifact or the order of the parts isn't as frozen."""
    spark = df.sparkSession
    found = manifest(spark, path)
    if digest(df) != found["source"]["digest"]:
        raise ValueError("the source differs from the frozen one")
    for name, expected in found["artifacts"].items():
        if digest(spark.read.parquet(f"{path}/{name}")) != expected:
            raise ValueError(f"artifact differs: {name}")
    rows = spark.read.parquet(f"{path}/split_assignments")
    n, ids = rows.agg(F.count("*"), F.countDistinct("market_id")).first()
    if n != found["source"]["rows"] or n != ids:
        raise ValueError("assignments don't cover the source once")
    parts = {r.assignment: r for r in bounds(rows).collect()}  # four rows
    if set(parts) - {"train", "validation", "holdout", "excluded"}:
        raise ValueError("unknown assignment")
    order = [parts[p] for p in ("train", "validation", "holdout") if p in parts]
    if any(a["last"] >= b["first"] for a, b in zip(order[:-1], order[1:], strict=True)):
        raise ValueError("assignments aren't chronological")
    if rows.groupBy("window_start").agg(F.countDistinct("assignment").alias("k")).filter("k > 1").limit(1).count():
        raise ValueError("a window lies in two parts")
    return found


def development(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows; the holdout is not read."""
    return spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/validation")


def separate(train: DataFrame, validation: DataFrame, key: str = "market_id", window: str = "window_start") -> None:
    """Fails if the parts are empty, share a key, or training doesn't end before validation begins."""
    (a, last), (b, first) = train.agg(F.count("*"), F.max(window)).first(), validation.agg(F.count("*"), F.min(window)).first()
    if not a or not b:
        raise ValueError("training and validation rows are required")
    if train.join(validation.select(key), key, "left_semi").limit(1).count():
        raise ValueError(f"{key} is in both parts")
    if last >= first:
        raise ValueError("training must end before validation begins")
