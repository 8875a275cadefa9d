"""A work queue that several workers share: claims and results are committed as versions.

A version names a base table and the changes since.  A worker reads the newest version, picks the next items, writes their
new state (as many rows as it takes) and commits.  If another worker was faster, the commit is refused, nothing of it is visible, and the
worker picks again from the newer version, so no two workers hold the same item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog, new_folder
from ..sources.schemas import QUEUE
from .queue import next_items, settle
from .ranking import first_by

CHANGED = ("status", "attempts", "error_message", "processed_at")
MOST_CHANGES = 20  # changes of a version before they are folded into a new base


@dataclass(frozen=True)
class Proposal:
    """Changed rows, written aside, on top of a version."""

    version: int
    folder: str


@dataclass(frozen=True)
class QueueTable:
    spark: SparkSession
    root: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.root)

    @classmethod
    def create(cls, rows: DataFrame, root: str) -> QueueTable:
        """Version 0 from a table of items."""
        table = cls(rows.sparkSession, root)
        if not table.log.commit(0, {"base": table._written(rows, "base"), "changes": []}):
            raise ValueError(f"a queue is there already: {root}")
        return table

    def _written(self, rows: DataFrame, kind: str) -> str:
        folder = new_folder(self.root, kind)
        rows.write.parquet(folder)
        return folder

    def read(self, version: int | None = None) -> DataFrame:
        """Items of a version: the base, with the newest change of each changed item."""
        state = self.log.read(self.log.latest() if version is None else version)
        base = self.spark.read.schema(QUEUE).parquet(state["base"])
        if not state["changes"]:
            return base
        changes = None
        for number, folder in enumerate(state["changes"]):
            part = self.spark.read.schema(QUEUE).parquet(folder).select("id", *CHANGED).withColumn("_no", F.lit(number))
            changes = part if changes is None else changes.unionByName(part)
        newest = first_by(changes, ["id"], [F.col("_no").desc()])
        newest = newest.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in CHANGED])
        hit = F.col("_id").isNotNull()
        rows = base.join(newest, F.col("id") == F.col("_id"), "left")
        return rows.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in CHANGED}).select(*base.columns)

    def propose_claim(self, n: int = 5) -> Proposal:
        """The next ``n`` pending items as processing, each with its own attempt counted; not visible to anyone yet."""
        version = self.log.latest()
        taken = next_items(self.read(version), n).withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})
        return Proposal(version, self._written(taken, "change"))

    def propose_settle(self, outcomes: DataFrame, as_of: str) -> Proposal:
        """State of the items after their outcomes (``id, ok, message``)."""
        version = self.log.latest()
        rows = self.read(version).join(outcomes.select("id"), "id", "left_semi")
        return Proposal(version, self._written(settle(rows, outcomes, as_of), "change"))

    def commit(self, proposal: Proposal) -> bool:
        """Make a proposal the next version; False if the version it was made from is no longer the newest."""
        state = self.log.read(proposal.version)
        return self.log.commit(proposal.version + 1, state | {"changes": [*state["changes"], proposal.folder]})

    def claim(self, n: int = 5) -> DataFrame:
        """Take the next ``n`` items; repeats until a commit is accepted."""
        while True:
            proposal = self.propose_claim(n)
            if self.commit(proposal):
                self.compact()
                return self.spark.read.schema(QUEUE).parquet(proposal.folder)

    def settle(self, outcomes: DataFrame, as_of: str) -> None:
        while not self.commit(self.propose_settle(outcomes, as_of)):
            pass
        self.compact()

    def compact(self, most: int = MOST_CHANGES) -> bool:
        """Fold the changes into a new base once there are more than ``most``; gives way to any other commit."""
        version = self.log.latest()
        if len(self.log.read(version)["changes"]) <= most:
            return False
        return self.log.commit(version + 1, {"base": self._written(self.read(version), "base"), "changes": []})
