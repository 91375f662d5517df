"""Table functions for SQL (2.11, N7, N9): ranked rows of many requests cut into batches, row by row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

BATCHES = "batch_id long, part int, n long, expert_ids array<long>, gaps array<string>"


class ReasonBatches:
    """Over TABLE(batch_id, expert_id, rank, gap) PARTITION BY batch_id ORDER BY rank, and a size: a row for each batch of size candidates.

    expert_ids are in order of rank, gaps are distinct, in order of first appearance, without null and blank ones. A size below 1 makes one batch.
    One batch of a partition is held at a time.
    """

    def __init__(self) -> None:
        self.batch_id: int | None = None
        self.part, self.size = 1, 0
        self.ids: list[int] = []
        self.gaps: dict[str, None] = {}

    def _row(self) -> tuple:
        out = (self.batch_id, self.part, len(self.ids), self.ids, list(self.gaps))
        self.part, self.ids, self.gaps = self.part + 1, [], {}
        return out

    def eval(self, row: Row, size: int) -> Iterator[tuple]:
        self.batch_id, self.size = row["batch_id"], size
        self.ids.append(row["expert_id"])
        gap = " ".join((row["gap"] or "").split())
        if gap:
            self.gaps[gap] = None
        if 0 < size <= len(self.ids):
            yield self._row()

    def terminate(self) -> Iterator[tuple]:
        if self.ids:
            yield self._row()


def register_tables(spark: SparkSession) -> None:
    """reason_batches for this session's SQL."""
    spark.udtf.register("reason_batches", udtf(ReasonBatches, returnType=BATCHES))
