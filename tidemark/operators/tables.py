"""Upserts and relational operators on plain tables: the new table is the result, as Parquet has no rows to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], overwrite: tuple[str, ...] = (), blank_is_null: tuple[str, ...] = ()) -> DataFrame:
    """new upserted into old: a null of new keeps old's value, but for overwrite columns of rows that new has.

    Of new's rows with one key the last wins only where the caller has made it so (latest); keys that are null never
    match, so such rows are added. For columns of blank_is_null '' counts as null.
    """
    o, n = old.alias("o"), new.alias("n").withColumn("__new", F.lit(True))
    on = None
    for k in keys:
        c = F.col(f"o.{k}") == F.col(f"__n.{k}")
        on = c if on is None else on & c
    both = o.join(n.alias("__n"), on, "full_outer")

    def value(c: str) -> Column:
        was, now = F.col(f"o.{c}"), F.col(f"__n.{c}")
        if c in blank_is_null:
            now = F.nullif(now, F.lit(""))
        if c in overwrite:
            return F.when(F.col("__new"), now).otherwise(was).alias(c)
        return F.coalesce(now, was).alias(c)

    return both.select(*[value(c) for c in old.columns])


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with one key the one with the greatest order: an aggregate with map-side partials, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


#: Parts of a step that sorts or hashes the same rows several times in one task, for each of spark.sql.shuffle.partitions.
FINE = 4


def fine(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys into FINE times the shuffle partitions, a number that adaptive execution keeps: it puts parts
    together by their compressed bytes, whatever a task then makes of them."""
    return rows.repartition(FINE * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and of new one row per key that old lacks. new is dealt finely, as a task hashes and sorts its rows."""
    return old.unionByName(fine(new, *keys).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def last_rows(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order; rank limits are pushed into the sort by Spark."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def fresh(rows: DataFrame, key: str, stamp: str, as_of: Column, days: int) -> DataFrame:
    """Each key with whether its newest row is under days old."""
    return rows.groupBy(key).agg(F.max(stamp).alias("newest")).select(key, "newest", (F.datediff(as_of, "newest") < days).alias("is_fresh"))


def merge_null_never_equal(old: DataFrame, new: DataFrame, keys: list[str], order: str, coalesced: tuple[str, ...] = ()) -> DataFrame:
    """new's rows, in their order, upserted into old: the last row of a key replaces, but for coalesced columns, whose last value that isn't null stays.

    A key with a null in it equals no other, so each such row is added. Both tables have the same columns; old's rows come first.
    """
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    at = F.struct("__new", order)
    rest = [c for c in old.columns if c not in keys]
    last = [(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)) if c in coalesced else F.max_by(F.col(c), at)).alias(c) for c in rest]
    keyed = rows.filter(whole).groupBy(*keys).agg(*last)
    return keyed.select(*old.columns).unionByName(rows.filter(~whole).select(*old.columns))


def hold(held: DataFrame, alerts: DataFrame, days: int = 180) -> DataFrame:
    """held (scrip_code, alpha_score, alert_date, expires) with alerts (scrip_code, alpha_score, alert_date) upserted: a new alert replaces, and runs for days."""
    new = alerts.withColumn("expires", F.date_add("alert_date", days))
    return merge(held, new, ["scrip_code"], overwrite=("alpha_score", "alert_date", "expires"))


def removed(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose key stands in gone."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def expired(rows: DataFrame, as_of: Column, column: str = "expires") -> tuple[DataFrame, DataFrame]:
    """The rows still valid after as_of, and one row with the number of those that are not."""
    return rows.filter(F.col(column) > as_of), rows.agg(F.count_if(F.col(column) <= as_of).alias("removed"))


def marked(rows: DataFrame, done: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with flag set where the key stands in done, as it was elsewhere."""
    seen = done.select(F.col(key).alias("__k")).distinct().withColumn("__seen", F.lit(True))
    joined = rows.join(seen, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(flag, F.coalesce("__seen", flag)).drop("__k", "__seen")


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the columns of changes(key, ..) set, nulls too, where the key stands there."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, F.col(key) == F.col("__k"), "left")
    return joined.withColumns({c: F.when(F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__k", *[f"__{c}" for c in columns])
