"""A written table of rows by key that streams merge into: key buckets, and a manifest that is put in place last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.session import deleted

#: Old states of a table that vacuum keeps, so that readers of them can end.
KEPT_VERSIONS = 2


class Manifest(NamedTuple):
    """A state of a table: its version, the folders of each bucket's rows, and the last batch that each stream has merged."""

    version: int
    folders: dict[int, str]
    batches: dict[str, int]


class ConflictError(RuntimeError):
    """Another writer has put the next version in place; the merge is to be done again."""


class KeyedTable:
    """Rows by key below a folder that driver and executors share.

    Rows lie in buckets by the hash of their key, so that a merge reads and writes only the buckets that it touches. Nothing that is there is overwritten: a merge writes new
    folders and then a manifest that names them, by a rename that fails where the version is there already. A merge that is killed leaves folders that no manifest
    names, and the table as it was. Each stream's last batch is in the manifest, so that a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    # The manifest.

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._hadoop(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest state, or a named one."""
        if version is None:
            found = self.versions()
            if not found:
                return Manifest(0, {}, {})
            version = found[-1]
        text = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0]
        read = json.loads(text)
        return Manifest(version, {int(k): v for k, v in read["folders"].items()}, read["batches"])

    def _put(self, manifest: Manifest) -> None:
        """Writes a manifest beside its place and renames it, which one writer of a version can do."""
        text = json.dumps({"folders": manifest.folders, "batches": manifest.batches})
        draft, fs = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        place, _ = self._hadoop(f"{self.path}/manifests/{manifest.version:012d}.json")
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(place), none)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(place):
                raise ConflictError(f"version {manifest.version} of {self.path} is there already") from error
            raise

    # Rows.

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest state, or of a named one."""
        return self._rows(self.manifest(version).folders)

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(set(folders.values()))])

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], stream: str = "", batch: int = -1) -> bool:
        """Puts merged(rows that are there, changes) in the place of the rows of the buckets that changes touch; False where the stream's batch was merged before.

        merged gets whole buckets and keeps the key; a key that it leaves out is deleted. Changes without a key are left out.
        """
        before = self.manifest()
        if stream and before.batches.get(stream, -1) >= batch:
            return False
        changes = changes.filter(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())  # buckets at most
        folders = dict(before.folders)
        if touched:
            rows = self._rows({b: before.folders[b] for b in touched if b in before.folders})
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
            new = merged(rows, changes).select(*columns).withColumn("_bucket", self.bucket())
            name = f"data/{uuid.uuid4().hex}"
            new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
            there = {int(n.removeprefix("_bucket=")) for n in self._names(f"{self.path}/{name}") if n.startswith("_bucket=")}
            if not there <= set(touched):
                raise PySparkRuntimeError("a merge may not make keys of buckets that its changes don't touch")
            folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{name}/_bucket={b}" for b in there}
        self._put(Manifest(before.version + 1, folders, before.batches | ({stream: batch} if stream else {})))
        return True

    def replace(self, rows: DataFrame) -> None:
        """A new state of these rows alone, in all buckets."""
        before = self.manifest()
        name = f"data/{uuid.uuid4().hex}"
        rows.filter(F.col(self.key).isNotNull()).select(*self.schema.names).withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        there = [n for n in self._names(f"{self.path}/{name}") if n.startswith("_bucket=")]
        self._put(Manifest(before.version + 1, {int(n.removeprefix("_bucket=")): f"{name}/{n}" for n in there}, before.batches))

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Deletes manifests but the newest ones, and folders of rows that none of these names. No merge may be going on."""
        versions = self.versions()
        used = {f.split("/")[1] for v in versions[-max(1, keep) :] for f in self.manifest(v).folders.values()}
        for v in versions[: -max(1, keep)]:
            deleted(self.spark, f"{self.path}/manifests/{v:012d}.json")
        for name in self._names(f"{self.path}/data"):
            if name not in used:
                deleted(self.spark, f"{self.path}/data/{name}")


def last_change(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of several changes of a key the last by order, whole rows."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def overwrite(table: KeyedTable, changes: DataFrame, order: list[str], stream: str = "", batch: int = -1, deleted_if: str | None = None) -> bool:
    """Rows take the place of those of their keys, the last of each key by order; where deleted_if holds for it, the key goes."""

    def merged(rows: DataFrame, new: DataFrame) -> DataFrame:
        last = last_change(new, table.key, order)
        kept = last if deleted_if is None else last.filter(~F.coalesce(F.expr(deleted_if), F.lit(False)))
        names = table.schema.names
        return rows.join(last.select(table.key), table.key, "left_anti").select(*names).unionByName(kept.select(*names))

    return table.merge(changes, merged, stream, batch)
