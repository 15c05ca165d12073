"""Written tables that cut lineage, in the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch of whole texts.
TEXTS = 1000


class Scratch:
    """A folder of Parquet tables for one operator call; if `tidy`, tables are packed tighter and the shuffle files of a
    table are deleted once it is written."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.base = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str = "t", batch: int | None = None) -> str:
        """Write df; while it is planned, Arrow batches hold at most `batch` rows (of texts, so that few MB are in flight)."""
        self.made += 1
        path = f"{self.base}/{name}{self.made}"
        before, kept = int(self.spark.conf.get(_ROWS)), self.spark.conf.get(_TIDY)
        try:
            if batch and not 0 < before <= batch:
                self.spark.conf.set(_ROWS, str(batch))
            if self.tidy:
                self.spark.conf.set(_TIDY, "true")
            df.write.options(**({"compression": "zstd"} if self.tidy else {})).parquet(path)
        finally:
            self.spark.conf.set(_ROWS, str(before))
            self.spark.conf.set(_TIDY, kept)
        self.paths.append(path)
        return path

    def keep(self, df: DataFrame, name: str = "t", batch: int | None = None) -> DataFrame:
        """Write df and read it again: a table that survives a lost executor."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name, batch))

    def bytes(self, path: str) -> int:
        """The size of a written table's files: measured, where the planner's estimate of a table that is not read from
        files, or of a join, may be anything."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()

    def _folders(self, frames: tuple[DataFrame, ...]) -> set[str]:
        name = f"/{self.base.rsplit('/', 1)[1]}/"
        return {f.split(name, 1)[1].split("/", 1)[0] for df in frames for f in df.inputFiles() if name in f}

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths = [p for p in self.paths if p not in set(paths)]

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made by keep() which nothing will read again."""
        gone = self._folders(frames)
        self._delete([p for p in self.paths if p.rsplit("/", 1)[1] in gone])

    def sweep(self, result: DataFrame) -> DataFrame:
        """Delete every table that the result does not read, and give the result back."""
        used = self._folders((result,))
        self._delete([p for p in self.paths if p.rsplit("/", 1)[1] not in used])
        return result


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
