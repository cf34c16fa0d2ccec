"""Counters, toggles, owner-guarded changes and cascades, all derived from logs of events.

Parquet isn't changed in place: a change is a row of a log, and the state is a view of the log.
Totals per key are plain groupBy sums (summed before the shuffle, so hot keys do no harm).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(events: DataFrame, key: str, name: str = "n") -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias(name))


def saturating(events: DataFrame, key: str, order: list[str], step: str, part: str | None = None) -> DataFrame:
    """The running counter that never falls below 0: with running sums S it is S minus the
    least of 0 and the smallest S so far. Order matters, so each key is ordered in one task; with
    ``part`` (a column that cuts the order into stretches, as a day does) each stretch of a key is, and
    starts from the sum and the lowest point of those before it."""
    keys = [key, part] if part else [key]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("_s", F.sum(step).over(w)).withColumn("_m", F.min("_s").over(w))
    if not part:
        return run.withColumn("counter", F.col("_s") - F.least(F.lit(0), F.col("_m"))).drop("_s", "_m")
    stretch = run.groupBy(*keys).agg(F.sum(step).alias("_all"), F.min("_s").alias("_low"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = stretch.withColumn("_from", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    start = start.withColumn("_least", F.min(F.col("_from") + F.col("_low")).over(before)).select(*keys, "_from", "_least")
    low = F.least(F.lit(0), "_least", F.col("_from") + F.col("_m"))
    return run.join(start, keys).withColumn("counter", F.col("_from") + F.col("_s") - low).select(*events.columns, "counter")


def final_counter(events: DataFrame, key: str, order: list[str], step: str, part: str | None = None) -> DataFrame:
    """The last value of ``saturating`` for each key. With ``part`` (a column that cuts the order
    into stretches, as a day does) a hot key is summed by stretch first: a stretch is told by
    its sum s and its lowest point m, and two of them join as (s1 + s2, min(m1, s1 + m2))."""
    keys = [key, part] if part else [key]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stretch = events.withColumn("_s", F.sum(step).over(w)).groupBy(*keys).agg(F.sum(step).alias("s"), F.min("_s").alias("m"))
    if not part:
        return stretch.select(key, (F.col("s") - F.least(F.lit(0), F.col("m"))).alias("counter"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("s").over(before), F.lit(0)) + F.col("m")
    return stretch.withColumn("_low", low).groupBy(key).agg(F.sum("s").alias("s"), F.min("_low").alias("m")).select(key, (F.col("s") - F.least(F.lit(0), F.col("m"))).alias("counter"))


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each pair is on after its toggles: an odd number of them."""
    return events.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("is_on"))


def latest(log: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The last row of each key (by max_by, which is summed before the shuffle)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_row")).select(*keys, "_row.*")


def updated(table: DataFrame, changes: DataFrame, key: str, owner: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """``table`` with the columns of ``changes`` where key and owner both agree. Of several changes of
    one key by one owner the last by ``order`` counts (without an order the one with the largest values)."""
    last = F.max_by(F.struct(*columns), F.struct(*(order or columns)))
    side = changes.groupBy(key, owner).agg(last.alias("_last")).select(key, owner, "_last.*")
    side = side.select(F.col(key).alias("_k"), F.col(owner).alias("_o"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = table.join(side, (F.col(key) == F.col("_k")) & (F.col(owner) == F.col("_o")), "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def deleted(table: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` without the rows that ``tombstones`` names (key and owner)."""
    return table.join(tombstones.select(*keys), keys, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi")


def allowed(operation: str, owner: Column, user: Column, policies: dict[str, str]) -> Column:
    """A row-level policy: ``all``, ``owner`` or absent (never) for each operation."""
    rule = policies.get(operation)
    return F.lit(True) if rule == "all" else F.coalesce(owner == user, F.lit(False)) if rule == "owner" else F.lit(False)


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with valid and the names of failed rules. As a CHECK does, a null passes."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("failed", failed).withColumn("valid", F.size("failed") == 0)
