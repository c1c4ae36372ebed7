"""Lookups between tables: by last comment, by position, by name suffix, by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of up to this many rows is broadcast in a range lookup; beyond it keys are binned.
BROADCAST_ROWS = 100_000


def last_wins(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The value of the last row of each key. ``max_by`` merges partially: no window, no sort."""
    return df.groupBy(*by).agg(F.max_by(value, order).alias(value))


def attach(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def interval_lookup(df: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, bin_width: float) -> DataFrame:
    """Rows with the intervals [lo, hi) that hold their value.

    Few intervals are broadcast; many are cut into bins of ``bin_width``, so that
    the join has an equal key.
    """
    inside = (F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))
    if intervals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(intervals), inside)
    binned = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_width), F.floor(F.col(hi) / bin_width))))
    return df.withColumn("_bin", F.floor(F.col(value) / bin_width)).join(binned, "_bin").filter(inside).drop("_bin")


def suffix_join(names: DataFrame, name: str, suffixes: DataFrame, suffix: str) -> DataFrame:
    """Names that equal a suffix or end in a dot and it. Each name is split into its
    own endings, so the join has an equal key, not a condition over all pairs."""
    parts = F.split(F.col(name), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return names.withColumn("_ending", F.explode(endings)).join(suffixes.withColumnRenamed(suffix, "_ending"), "_ending").withColumnRenamed("_ending", suffix)


def schema_diff(old: DataFrame, new: DataFrame, number: str, name: str, kind: str) -> DataFrame:
    """Fields of two versions: removed, renumbered, renamed (breaking) or of another type (risk)."""
    o = old.select(F.col(number).alias("number"), F.col(name).alias("name"), F.col(kind).alias("kind"))
    by_number = o.join(new.select(F.col(number).alias("number"), F.col(name).alias("new_name"), F.col(kind).alias("new_kind")), "number", "left")
    by_name = o.join(new.select(F.col(name).alias("name"), F.col(number).alias("new_number")), "name", "left")
    row = lambda df, change, severity, detail: df.select("number", "name", F.lit(change).alias("change"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    gone = by_name.filter("new_number IS NULL").join(new.select(F.col(number).alias("number")).distinct(), "number", "left_anti")
    return (
        row(gone, "removed", "breaking", F.lit(None))
        .unionByName(row(by_name.filter("new_number <> number"), "renumbered", "breaking", F.col("new_number")))
        .unionByName(row(by_number.filter("new_name <> name"), "renamed", "breaking", F.col("new_name")))
        .unionByName(row(by_number.filter("new_name = name AND new_kind <> kind"), "retyped", "risk", F.col("new_kind")))
    )


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: one union and one sorted pass
    over each key, not a join of all pairs."""
    from pyspark.sql import Window

    l = left.withColumn("_right", F.lit(0)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(*by, at, F.lit(1).alias("_right"), F.col(value).alias("_value"))
    both = l.unionByName(r, allowMissingColumns=True)
    seen = F.last("_value", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col(at), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, seen).filter("_right = 0").drop("_right", "_value")


def sidecars(files: DataFrame, path: str, main: str, others: list[str]) -> DataFrame:
    """Files of the main extension with the paths of those of the same stem."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    ext = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    grouped = files.groupBy(stem(F.col(path)).alias("stem")).agg(*[F.min(F.when(ext == e, F.col(path))).alias(e) for e in [main, *others]])
    return grouped.filter(F.col(main).isNotNull())


def interface_types(packets: DataFrame, interfaces: DataFrame, default: int = 1) -> DataFrame:
    """Link type of each packet's interface, Ethernet where it has none."""
    return packets.join(interfaces.select("file", "section", "interface_id", "link_type"), ["file", "section", "interface_id"], "left").withColumn("link_type", F.coalesce("link_type", F.lit(default)))


def equal_or(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))
