"""Where documents' bytes are kept: adapters of one interface, chosen by configuration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.sources import intake

#: The session setting that names the adapter, and the one that says where it keeps things.
KIND, ROOT = "spark.ledgerfold.storage", "spark.ledgerfold.storage.root"


class Storage(Protocol):
    def store(self, blobs: DataFrame) -> DataFrame:
        """Keeps (path, content), a path that is there gets the new content; path and where it is kept."""

    def load(self, paths: DataFrame | None = None) -> DataFrame:
        """path and content of all blobs, or of these paths."""


class TableStorage:
    """Blobs as rows of a table: what is stored again is a later row. Suits many small documents."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def store(self, blobs: DataFrame) -> DataFrame:
        intake.store_blobs(blobs, self.root)
        return blobs.select("path", F.concat(F.lit(f"{self.root}#"), "path").alias("kept_at"))

    def load(self, paths: DataFrame | None = None) -> DataFrame:
        found = intake.load_blobs(self.spark, self.root)
        return found if paths is None else found.join(paths.select("path").distinct(), "path", "left_semi")


class FileStorage:
    """A file for each blob, below a folder that Arrow opens by its address; other programs can read them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def store(self, blobs: DataFrame) -> DataFrame:
        """Writes once, now. A path that leaves the folder is refused, before anything is written in its task."""
        from ledgerfold.sources.scratch import written

        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, folder = arrow_fs.FileSystem.from_uri(root) if ":/" in root else (arrow_fs.LocalFileSystem(), root)
            for batch in batches:
                names = batch["path"].to_pylist()
                for name in names:
                    if name is None or name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"not a path below the folder: {name}")
                for name, content in zip(names, batch["content"], strict=True):
                    at = f"{folder}/{name}"
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    with fs.open_output_stream(at) as f:
                        f.write(content.as_py() or b"")
                yield pa.RecordBatch.from_arrays([batch["path"], pa.array([f"{root}/{n}" for n in names], pa.string())], names=["path", "kept_at"])

        # of a path that is there twice one content is kept, the same one whenever a task is repeated
        once = blobs.groupBy("path").agg(F.max("content").alias("content"))
        return written(once.mapInArrow(run, "path string, kept_at string"), "stored")

    def load(self, paths: DataFrame | None = None) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        found = files.select(F.regexp_replace(F.substring_index("path", f"{self.root.rpartition(':')[2].lstrip('/')}/", -1), "^/+", "").alias("path"), "content")
        if paths is None:
            return found
        # Spark's file source passes over empty files: an asked path that was stored empty has no row
        return found.join(paths.select("path").distinct(), "path", "left_semi")


ADAPTERS: dict[str, Callable[[SparkSession, str], Storage]] = {"table": TableStorage, "files": FileStorage}


def storage(spark: SparkSession) -> Storage:
    """The adapter that the session's settings name; a table, if they name none."""
    root = spark.conf.get(ROOT, None)
    if not root:
        raise ValueError(f"{ROOT} must say where documents are kept")
    return ADAPTERS[spark.conf.get(KIND, "table")](spark, root)
