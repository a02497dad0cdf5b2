"""Tables kept as generations with a commit pointer, for jobs that write several tables at once.

A commit writes what it changes into folders of its own and then, as its last act, one small file that
names the folders of every table. Readers go by that file alone: a job that dies before it leaves
nothing behind that anyone reads, and a commit that is done again overwrites its own folders and file.

A generation holds only the rows that changed. When a table has ``most_folders`` of them, the commit writes
the table whole instead, so reading it never takes more folders, however many commits there were.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class SnapshotStore:
    """``schemas`` names the tables; rows of a table in ``keys`` replace earlier ones of the same key, others add up."""

    spark: SparkSession
    root: str
    schemas: dict[str, str]
    keys: dict[str, list[str]] = field(default_factory=dict)
    most_folders: int = 8

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commits(self) -> list[int]:
        """Numbers of all commits, ascending."""
        files, folder = self._path("_commits")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def folders(self, before: int | None = None) -> dict[str, list[str]]:
        """The folders of each table, oldest first, as of the newest commit (with a smaller number than ``before``)."""
        done = [c for c in self.commits() if before is None or c < before]
        if not done:
            return {name: [] for name in self.schemas}
        _, path = self._path(f"_commits/{done[-1]}.json")
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()["value"])

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """The table as of the newest commit (before another one)."""
        return self._merged(table, self.folders(before)[table])

    def _merged(self, table: str, folders: list[str]) -> DataFrame:
        schema = self.schemas[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        if table not in self.keys:
            return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{f}").withColumn("_age", F.lit(n)) for n, f in enumerate(folders)]
        rows, columns = parts[0], [c for c in parts[0].columns if c != "_age"]
        if len(parts) == 1:
            return rows.drop("_age")
        for part in parts[1:]:
            rows = rows.unionByName(part)
        newest = rows.groupBy(*self.keys[table]).agg(F.max_by(F.struct(*columns), "_age").alias("_row"))
        return newest.select("_row.*")

    def commit(self, number: int, changes: dict[str, DataFrame]) -> None:
        """Write the changed rows of some tables and make them visible together."""
        now = self.folders(before=number)
        for table, rows in changes.items():
            own = f"{table}/{number}"
            declared = [F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self.schemas[table]).schema]
            rows.select(*declared).write.mode("overwrite").parquet(f"{self.root}/{own}")
            if len(now[table]) + 1 < self.most_folders:
                now[table] = [*now[table], own]
            else:
                self._merged(table, [*now[table], own]).write.mode("overwrite").parquet(f"{self.root}/{table}/{number}-whole")
                now[table] = [f"{table}/{number}-whole"]
        self._publish(number, json.dumps(now))

    def _publish(self, number: int, text: str) -> None:
        files, draft = self._path(f"_commits/{number}.draft")
        _, final = self._path(f"_commits/{number}.json")
        stream = files.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if files.exists(final):  # done again after a failure
            files.delete(final, False)
        if not files.rename(draft, final):
            raise OSError(f"commit {number} could not be published")

    def expire(self, keep: int = 2) -> None:
        """Delete the folders that none of the newest ``keep`` commits names, and older commits."""
        done = self.commits()
        if len(done) <= keep:
            return
        used = {f for number in done[-keep:] for table in self.folders(number + 1).values() for f in table}
        for number in done[:-keep]:
            old = [f for table in self.folders(number + 1).values() for f in table]
            for name in [f"_commits/{number}.json", *[f for f in old if f not in used]]:
                files, path = self._path(name)
                files.delete(path, True)
