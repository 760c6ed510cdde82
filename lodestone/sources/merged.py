"""A keyed table at rest that batches of rows are merged into, file by file.

Keys are hashed to a fixed number of parts, each a folder. A merge reads and writes only the parts that its batch
touches: of the rows of one key the one with the highest version stays, a row marked as deleted takes its key away for
all versions up to its own. Merging the same batch again, also after a run that broke off, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import written

#: The folder's column, and what a merged table keeps beside its own columns.
PART, GONE = "part", "deleted"


def _parted(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return rows.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def _latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the highest version; of equal ones the deleted one, then the greatest in all columns."""
    others = [c for c in rows.columns if c not in (*keys, version, GONE, PART)]
    best = F.max(F.struct(version, GONE, *others)).alias("_best")
    return rows.groupBy(PART, *keys).agg(best).select(*keys, PART, "_best.*")


def create_merged(rows: DataFrame, path: str, keys: list[str], version: str, parts: int = 64) -> None:
    """Writes a table's first rows, in parts of its keys."""
    held = rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False))
    first = _latest(_parted(held, keys, parts), keys, version)
    first.repartition(PART).write.partitionBy(PART).mode("overwrite").parquet(path)


def merge_batch(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], version: str, parts: int = 64) -> list[int]:
    """Merges a batch into the table at ``path``; gives the parts that were written. Only parts with a row that is new are."""
    held = batch if GONE in batch.columns else batch.withColumn(GONE, F.lit(False))
    new = written(_latest(_parted(held, keys, parts), keys, version), "merge-batch")
    there = spark.read.parquet(path)
    touched = [r[0] for r in new.select(PART).distinct().collect()]  # as many as there are parts at most
    old = there.where(F.col(PART).isin(touched)) if touched else there.limit(0)
    known = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(version).alias("_version"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    ahead = new.join(known, same & (F.col("_version") >= F.col(version)), "left_anti")
    changed = sorted(r[0] for r in ahead.select(PART).distinct().collect())
    if changed:
        both = old.where(F.col(PART).isin(changed)).select(new.columns).unionByName(ahead.where(F.col(PART).isin(changed)))
        after = written(_latest(both, keys, version), "merged")  # written aside first, as it is read from what it replaces
        after.repartition(PART).write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return changed


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The rows that are there."""
    return spark.read.parquet(path).where(~F.col(GONE)).drop(PART, GONE)
