"""Long work on rows with calls that should not be made twice, slice by slice.

A slice's rows are written aside and become part of the results by one entry of a commit
log. A run that stops loses at most the slice at hand, a lost executor its part of the
slice, and what is in the results is there once, also with two runs at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import CommitLog, ConflictError

#: Rows of a slice.
SLICE = 1024


class Slices:
    """Results below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    def rows(self) -> DataFrame | None:
        """Every row of all runs with entry, its slice's number; None before the first."""
        out = None
        for n, e in self.log.entries():
            part = self.spark.read.parquet(f"{self.path}/rows/{e['slice']}").withColumn("entry", F.lit(n))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def sliced(self, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], completed: Callable[[], DataFrame | None], good: str, limit: int | None = None, size: int = SLICE) -> tuple[int, int]:
        """Works on rows whose key is not among completed, each once, in the order of keys;
        (rows done, rows of them that are not good)."""
        n, failed, name, tried = 0, 0, uuid.uuid4().hex, None
        while limit is None or n < limit:
            base, left = self.log.last(), rows
            for done in (completed(), tried):
                if done is not None:
                    left = left.join(done, key, "left_anti")
            # A slice is written first: what is asked is what is committed.
            part, asked = f"{name}-{n}", f"{self.path}/asked/{name}-{n}"
            left.orderBy(key).limit(size if limit is None else min(size, limit - n)).write.parquet(asked)
            todo = self.spark.read.schema(rows.schema).parquet(asked)
            if todo.isEmpty():
                break
            work(todo.repartition(self.spark.sparkContext.defaultParallelism)).write.parquet(f"{self.path}/rows/{part}")
            part = self._committed(part, base, key, good)
            found = self.spark.read.parquet(f"{self.path}/rows/{part}").agg(F.count(F.lit(1)), F.count_if(~F.expr(good))).head()
            n, failed = n + found[0], failed + found[1]
            tried = todo.select(key) if tried is None else tried.unionByName(todo.select(key))
            if not found[0]:
                break
        return n, failed

    def _committed(self, part: str, base: int, key: str, good: str) -> str:
        """Puts a slice into the log, without rows that others have done well since base."""
        while True:
            own = self.spark.read.parquet(f"{self.path}/rows/{part}")

            def theirs(newer: list[tuple[int, dict]]) -> DataFrame:
                return self.spark.read.parquet(*[f"{self.path}/rows/{e['slice']}" for _, e in newer]).where(good).select(key)

            try:
                self.log.commit({"slice": part}, base, lambda newer: not own.join(theirs(newer), key, "left_semi").isEmpty())  # noqa: B023
                return part
            except ConflictError:
                newer = self.log.entries(base)
                fresh = f"{part}-again"
                own.join(theirs(newer), key, "left_anti").write.parquet(f"{self.path}/rows/{fresh}")
                base, part = newer[-1][0], fresh


class Downloads(Slices):
    """Downloaded files below a folder: (document_id, url, content, problem, attempts)."""

    def run(self, wanted: DataFrame, download: Callable[[DataFrame], DataFrame], size: int = SLICE) -> dict[str, int]:
        """Downloads what is not there yet; download is ``files.downloaded`` with its fetch
        function. A file that could not be had is a row with its problem and is tried again by
        the next run."""
        n, failed = self.sliced(wanted.select("document_id", "url"), "document_id", download, lambda: self.files(), "problem is null", None, size)
        return {"downloaded": n - failed, "failed": failed}

    def files(self) -> DataFrame | None:
        """(document_id) of what is there."""
        rows = self.rows()
        return None if rows is None else rows.where("problem is null").select("document_id").distinct()
