"""Tables that are changed in place for their readers: numbered manifests over files that are never touched again.

A manifest names the parts of a table and the folders that hold them. A change writes new folders for the parts that it
touches and then puts up the next manifest, in one rename that fails if another writer was first. A reader takes the
last manifest when it starts, so it sees the table before or after a change, never between; a change that fails leaves
files that no manifest names. Manifests also carry tags, the last batch of a stream for one, so a batch that runs again
after a crash finds that it has been applied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has put up a manifest since this one read the last."""


@dataclass
class Manifest:
    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    tags: dict[str, int] = field(default_factory=dict)


class Snapshots:
    """The manifests of one folder, through the file system that Spark knows for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(name))) if self.exists(name) else []

    def drop(self, name: str) -> None:
        """Delete what no manifest names."""
        self._files.delete(self._path(name), True)

    def last(self, version: int | None = None) -> Manifest:
        """The manifest of a version, or the last one; an empty one where there is none."""
        known = [int(n) for n in self.names("manifests") if n.isdigit()]
        if not known:
            return Manifest()
        stream = self._files.open(self._path(f"manifests/{max(known) if version is None else version}"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def publish(self, before: Manifest, parts: dict[str, str], tags: dict[str, int]) -> Manifest:
        after = Manifest(before.version + 1, parts, before.tags | tags)
        draft = self._path(f"manifests/draft-{uuid.uuid4()}")
        stream = self._files.create(draft)
        try:
            stream.write(bytearray(json.dumps(after.__dict__).encode()))
        finally:
            stream.close()
        plain = self.spark._sc._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(draft, self._path(f"manifests/{after.version}"), plain)  # fails if the name is taken
        except Exception as e:
            self._files.delete(draft, False)
            if self.exists(f"manifests/{after.version}"):
                raise Conflict(f"{self.folder}: version {after.version} is there already") from e
            raise
        return after

    def clean(self, keep: int = 2) -> None:
        """Delete what the last ``keep`` manifests do not name. Readers of older ones must have ended."""
        known = sorted(int(n) for n in self.names("manifests") if n.isdigit())
        used = {p for n in known[-keep:] for p in self.last(n).parts.values()}
        for top in self.names("data"):
            held = [p for p in used if p == f"data/{top}" or p.startswith(f"data/{top}/")]
            if not held:
                self._files.delete(self._path(f"data/{top}"), True)
            elif f"data/{top}" not in held:
                for part in self.names(f"data/{top}"):
                    if f"data/{top}/{part}" not in held:
                        self._files.delete(self._path(f"data/{top}/{part}"), True)
        for n in known[:-keep]:
            self._files.delete(self._path(f"manifests/{n}"), False)


class BucketTable:
    """A table dealt into buckets by a hash of its key; a change reads and rewrites the buckets that it touches only.

    The key and the number of buckets belong to the folder and must not change. Rows whose key is null have a bucket
    like any other. A large bucket is written by several tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: list[str], buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.snapshots = Snapshots(spark, folder)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys that stand in a table: no more than there are buckets."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        return self._of(self.snapshots.last(version), buckets)

    def _of(self, manifest: Manifest, buckets: list[int] | None) -> DataFrame:
        paths = [p for b, p in manifest.parts.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.snapshots.folder}/{p}" for p in paths])

    def change(self, rows: DataFrame, step: Callable[[DataFrame], DataFrame], tag: tuple[str, int] | None = None) -> bool:
        """Replace the buckets of the keys in ``rows`` by what ``step`` makes of their rows.

        With a tag (name, number) nothing is done if that number or a later one has been applied; says whether it was done.
        """
        before = self.snapshots.last()
        if tag is not None and before.tags.get(tag[0], -1) >= tag[1]:
            return False
        mine, made = self.touched(rows), f"data/{before.version + 1}-{uuid.uuid4()}"
        new = step(self._of(before, mine)).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        dealt = new.withColumn("__bucket", self._bucket()).hint("rebalance", "__bucket")
        dealt.write.partitionBy("__bucket").parquet(f"{self.snapshots.folder}/{made}")
        written = {n.partition("=")[2] for n in self.snapshots.names(made) if n.startswith("__bucket=")}
        if stray := written - {str(b) for b in mine}:
            raise ValueError(f"a change of buckets {mine} made rows of buckets {sorted(stray)}")
        parts = {b: p for b, p in before.parts.items() if int(b) not in mine} | {b: f"{made}/__bucket={b}" for b in written}
        self.snapshots.publish(before, parts, {} if tag is None else {tag[0]: tag[1]})
        return True
