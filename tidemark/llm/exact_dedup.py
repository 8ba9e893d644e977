"""Exact dedup: groups by a 128-bit content hash, then bytes compared within each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_az, written


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty texts are equal to
    each other. The row with the largest (or, with keep="smallest", the smallest) id stays. A null id ranks behind any
    other; rows that repeat an id and its text share their verdict, so a repeated keeper is kept each time. Other
    columns of docs, whatever their names, are not looked at. An empty table gives an empty result.

    The hash groups are formed by a partial aggregate, so a hot text costs one row per map task. Each group's rows then
    meet their keeper's text in a sort-merge join on the keeper, which adaptive execution can split, and rows that
    differ from it in any byte (a hash collision) are grouped anew by the bytes themselves.
    """
    best = F.max if keep == "largest" else F.min
    base = docs.select(F.col(id_col).alias("doc_id"), lower_az(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    base = base.withColumn("h", F.unhex(F.md5("norm")))
    groups = base.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # stored, the groups are a side of their own in the join, so that the rows of a hot text can be split
    groups = written(groups.withColumnRenamed("h", "gh"), "groups")
    held = base.join(groups, F.col("h") == F.col("gh")).select("doc_id", "keep_id", "n", "h", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("n") > 1, F.col("norm")).alias("norm"))
    held = written(held, "held")  # each text is shuffled once; only those of groups are kept for the comparison
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = ["doc_id", "keep_id", F.col("n").alias("group_size"), mine.alias("kept"), "text_sha256"]
    single, many = held.filter("n = 1").select(*out), held.filter("n > 1")
    # stored too, so that the rows of a hot group can be split in this join
    keepers = written(many.filter(mine).groupBy(F.col("h").alias("kh")).agg(F.first("norm").alias("keeper")), "keepers")
    # the rows of a hash group that aren't its keeper's bytes: none, unless two texts share all 128 bits
    other = many.join(keepers, F.col("h") == F.col("kh")).filter("norm <> keeper").select("doc_id", "h", "norm", "text_sha256")
    other = written(other, "collisions")
    if other.isEmpty():
        return single.unionByName(many.select(*out))
    anew = other.groupBy("h", "norm").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    regrouped = other.join(anew, ["h", "norm"])
    taken = other.groupBy("h").agg(F.count(F.lit(1)).alias("gone"))
    same = many.join(other.select("h", "norm"), ["h", "norm"], "left_anti").join(taken, "h", "left")
    same = same.withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
    return single.unionByName(same.select(*out)).unionByName(regrouped.select(*out))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs without the rows whose text another row repeats; all columns stay. Of rows that repeat an id and its text, any one stays.

    A null text counts as empty, a null id ranks behind any other, and an empty table gives an empty result. Texts are
    shuffled once, to meet the size of their hash group; a text alone in its group stays as it is, and only the others
    go through exact_groups.
    """
    norm = lower_az(F.coalesce(F.col(text_col), F.lit("")))
    hashed = docs.withColumn("__h", F.unhex(F.md5(norm)))
    sizes = written(hashed.groupBy(F.col("__h").alias("__g")).agg(F.count(F.lit(1)).alias("__size")), "sizes")
    marked = written(hashed.join(sizes, F.col("__h") == F.col("__g")).select(*docs.columns, "__size"), "marked", compression="zstd")
    alone, many = (marked.filter(c).drop("__size") for c in ("__size = 1", "__size > 1"))
    told = exact_groups(many, id_col, text_col, keep).groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha256"))
    told = written(told.agg(F.max("kept").alias("__kept")), "verdicts").filter("__kept")
    signed = many.withColumn("__hash", F.sha2(norm, 256))
    stay = signed.join(told, (F.col("__hash") == F.col("__sha256")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return alone.unionByName(stay.dropDuplicates([id_col, "__hash"]).drop("__hash"))
