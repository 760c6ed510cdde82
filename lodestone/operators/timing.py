"""Wall time of the named stages of a query, each under a job description of its own."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The stages, in their order.
STAGES = ["classify", "rewrite", "plan_expand", "embed", "search", "fuse", "rerank", "prune", "expand_parents", "select", "compress"]


class Stopwatch:
    """Whole milliseconds of each stage; a stage that runs twice adds up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.took = spark, dict.fromkeys(STAGES, 0)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Times what runs inside; Spark's jobs in it bear the stage's name."""
        if name not in self.took:
            raise ValueError(f"no such stage: {name}")
        before, began = self.spark.sparkContext.getLocalProperty("spark.job.description"), time.perf_counter()
        self.spark.sparkContext.setJobDescription(name)
        try:
            yield
        finally:
            self.took[name] += int(1000 * (time.perf_counter() - began))
            self.spark.sparkContext.setLocalProperty("spark.job.description", before)

    def rows(self) -> DataFrame:
        """stage, place, ms of all stages."""
        return self.spark.createDataFrame([(s, i, self.took[s]) for i, s in enumerate(STAGES)], "stage string, place int, ms long")
