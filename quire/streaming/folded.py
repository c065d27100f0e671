"""Tables kept up to date by small batches.

A batch adds the partial aggregates of its own rows and reads nothing else. Partials merge in any order, so the
table is the merge of all of them, taken when it is read. Every ``every`` batches the partials so far become one
snapshot, and the folders that it stands for go. Rows that are settled may leave the
snapshot then, into an archive that is not written again with it, so the snapshot follows the number of rows still
changing and not that of all rows ever.

Below the table's folder: ``batch/n`` the partials of batch n, ``snapshot/n`` all up to batch n, ``settled/n`` what
left with that snapshot, ``archive/n`` all that left up to it. Each is written whole by one job or not at all, which
its ``_SUCCESS`` file tells, and counts from when its snapshot is there; a batch that runs again writes
the same again. The snapshot before the last one stays for readers that began with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 32


class Folded:
    """A table of partials at ``uri``.

    ``merge`` turns partials into one row a key and gives the columns it takes. ``settled`` tells of a merged row that it
    may leave, given the merged table's newest value of ``clock``; unless ``keep``, such rows are dropped.
    """

    def __init__(
        self,
        spark: SparkSession,
        uri: str,
        schema: str,
        merge: Callable[[DataFrame], DataFrame],
        every: int = EVERY,
        clock: str | None = None,
        settled: Callable[[Column], Column] | None = None,
        keep: bool = True,
    ):
        self.spark, self.uri, self.schema, self.merge = spark, uri.rstrip("/"), schema, merge
        self.every, self.clock, self.settled, self.keep = every, clock, settled, keep

    def _done(self, part: str) -> list[int]:
        """Numbers of the finished folders of a part: at most a few more than ``every``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{part}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        names = [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()]
        found = [int(n) for n in names if n.isdigit()]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in found if store.exists(mark(f"{self.uri}/{part}/{n}/_SUCCESS")))

    def _drop(self, part: str, numbers: list[int]) -> None:
        for n in numbers:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{part}/{n}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _rows(self, part: str, numbers: list[int]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return reader.parquet(*[f"{self.uri}/{part}/{n}" for n in numbers])

    def _write(self, rows: DataFrame, part: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.uri}/{part}/{number}")

    def add(self, partials: DataFrame, batch: int) -> None:
        """Add the partials of a batch; batches are numbered from 0 and come in order, some perhaps again."""
        snapshots = self._done("snapshot")
        if snapshots and snapshots[-1] >= batch:
            return  # came before and is in a snapshot
        self._write(partials, "batch", batch)
        if (batch + 1) % self.every == 0:
            self._fold(batch, snapshots)

    def _left(self, base: list[int]) -> tuple[list[int], list[int]]:
        """The archive that holds with a snapshot, and what left after it."""
        archive = [n for n in self._done("archive") if base and n <= base[0]][-1:]
        since = [n for n in self._done("settled") if base and n <= base[0] and (not archive or n > archive[0])]
        return archive, since

    def _fold(self, batch: int, snapshots: list[int]) -> None:
        base = snapshots[-1:]
        since = [n for n in self._done("batch") if not base or n > base[0]]
        merged = self.merge(self._rows("snapshot", base).unionByName(self._rows("batch", since)))
        if self.settled is not None:
            # Read several times, so it is written first.
            self._write(merged, "merged", batch)
            merged = self._rows("merged", [batch])
            newest = merged.agg(F.max(self.clock)).first()[0]
            leaves = F.coalesce(self.settled(F.lit(newest)), F.lit(False))
            if self.keep:
                self._write(merged.where(leaves), "settled", batch)
                archive, left = self._left(base)
                if len(left) + 1 >= self.every:
                    gone = self._rows("archive", archive).unionByName(self._rows("settled", [*left, batch]))
                    self._write(self.merge(gone), "archive", batch)
            merged = merged.where(~leaves)
        self._write(merged, "snapshot", batch)
        # Readers now start from the new snapshot; what the one before it has replaced may go.
        archive, _ = self._left(base)
        self._drop("batch", [n for n in self._done("batch") if base and n <= base[0]])
        self._drop("settled", [n for n in self._done("settled") if archive and n <= archive[0]])
        self._drop("archive", [n for n in self._done("archive") if archive and n < archive[0]])
        self._drop("snapshot", snapshots[:-1])
        self._drop("merged", self._done("merged"))

    def read(self, settled: bool = True) -> DataFrame:
        """One merged row a key; without ``settled``, only of those still in the snapshot or newer."""
        base = self._done("snapshot")[-1:]
        since = [n for n in self._done("batch") if not base or n > base[0]]
        rows = self._rows("snapshot", base).unionByName(self._rows("batch", since))
        if settled:
            archive, left = self._left(base)
            rows = rows.unionByName(self._rows("archive", archive)).unionByName(self._rows("settled", left))
        return self.merge(rows)
