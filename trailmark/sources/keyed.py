"""Tables of one row per key that micro-batches change.

Rows lie in buckets of their key's hash. A batch reads and rewrites only the buckets its keys fall in, as new folders,
and then commits one small manifest that names the folder of every bucket of every table. The manifest is one Parquet
file, so a reader sees a version whole or not at all, and several tables change together. The manifest also keeps the
last batch of each writer: a batch that comes again changes nothing. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.session import remove_folder

Fold = Callable[[DataFrame], DataFrame]
MANIFEST = "version bigint, name string, bucket int, folder string, batch bigint"
BUCKETS = 64


@dataclass(frozen=True)
class Keyed:
    """A table's columns and key; `buckets` should grow with the table, to some hundred megabytes each."""

    columns: str
    keys: list[str]
    buckets: int = BUCKETS

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


@dataclass
class Version:
    number: int = 0
    folders: dict[tuple[str, int], str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    """Keyed tables under one path, changed together."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Keyed]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def version(self) -> Version:
        """The last committed version; its size is that of the buckets, not of the tables."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
            number = rows.agg(F.max("version")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            number = None
        if number is None:
            return Version()
        now = rows.where(F.col("version") == number).collect()
        return Version(number, {(r.name, r.bucket): r.folder for r in now if r.folder is not None},
                       {r.name: r.batch for r in now if r.folder is None and r.batch is not None})

    def is_applied(self, writer: str, batch_id: int) -> bool:
        return self.version().batches.get(writer, -1) >= batch_id

    def read(self, name: str, buckets: Iterable[int] | None = None, version: Version | None = None) -> DataFrame:
        """A table as of a version (by default the last), or only some of its buckets."""
        folders, table = (version or self.version()).folders, self.tables[name]
        wanted = sorted(b for n, b in folders if n == name) if buckets is None else [b for b in buckets if (name, b) in folders]
        paths = [f"{folders[name, b]}/_bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*paths)

    @contextmanager
    def staged(self, *frames: DataFrame) -> Iterator[list[DataFrame]]:
        """The frames, written once beside the tables and read back while a batch is worked on."""
        folder = f"{self.path}/staged/{uuid.uuid4().hex}"
        try:
            for k, frame in enumerate(frames):
                frame.write.parquet(f"{folder}/{k}")
            yield [self.spark.read.schema(frame.schema).parquet(f"{folder}/{k}") for k, frame in enumerate(frames)]
        finally:
            remove_folder(self.spark, folder)

    def buckets_of(self, name: str, keyed: DataFrame) -> list[int]:
        """The buckets that the keys of `keyed` fall in."""
        return sorted(r[0] for r in keyed.select(self.tables[name].bucket()).distinct().collect())

    def upsert(self, changes: dict[str, tuple[DataFrame, Fold]], writer: str, batch_id: int) -> bool:
        """Folds each table's changes into its rows of the same keys; False where the batch was applied before.

        A fold takes rows of the table's columns and gives one row per key; it must not matter how often its own
        results are folded again. Rows that a fold leaves out are gone.
        """
        before = self.version()
        if before.batches.get(writer, -1) >= batch_id:
            return False
        after = Version(before.number + 1, dict(before.folders), {**before.batches, writer: batch_id})
        for name, (rows, fold) in changes.items():
            table = self.tables[name]
            rows = rows.select(*table.schema.names)
            touched = self.buckets_of(name, rows)
            folder = f"{self.path}/{name}/{after.number}-{uuid.uuid4().hex}"
            merged = fold(self.read(name, touched, before).unionByName(rows)).select(*table.schema.names)
            merged.withColumn("_bucket", table.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            made = self.spark.read.schema(T.StructType([*table.schema, T.StructField("_bucket", T.IntegerType())])).parquet(folder)
            filled = {r[0] for r in made.select("_bucket").distinct().collect()} if touched else set()
            for bucket in touched:
                after.folders.pop((name, bucket), None)
            after.folders.update({(name, b): folder for b in filled})
        self._commit(after)
        return True

    def _commit(self, version: Version) -> None:
        rows = [(version.number, n, b, folder, None) for (n, b), folder in version.folders.items()]
        rows += [(version.number, writer, None, None, batch) for writer, batch in version.batches.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def keyed_writer(store: KeyedStore, name: str, fold: Fold, prepare: Fold | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that upserts a batch's rows into one table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert({name: (prepare(batch) if prepare else batch, fold)}, f"stream:{name}", batch_id)

    return write
