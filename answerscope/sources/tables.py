"""Tables with versions: a rewrite is staged beside the old files and becomes visible by one atomic step.

A table is a folder of segments (Parquet folders) and of manifests, one a
version, each a small file that lists the segments. A commit writes its new
segments, then creates the next manifest; it fails if that version exists, so
that of two writers of one version one wins. A reader sees whole versions only,
and a job that dies leaves the table as it was. Manifests carry a note, by
which a repeated step knows that it is done.

Works on every file system that Spark writes to and that creates or renames
without overwriting (HDFS and local disks; object stores need a committer).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflictError(Exception):
    """Another writer has made the version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).makeQualified(self._files.getUri(), self._files.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The latest version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"segments": [], "note": {}, "schema": None}
        stream = self._files.open(self._path(self._manifest(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def notes(self, since: int = 0) -> list[dict]:
        return [self.manifest(v)["note"] for v in self.versions() if v > since]

    def read(self, version: int | None = None, segments: Sequence[str] | None = None) -> DataFrame:
        held = self.manifest(version)
        paths = [f"{self.path}/{s}" for s in (held["segments"] if segments is None else segments)]
        schema = self._schema(held["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _schema(text: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(text))

    def stage(self, rows: DataFrame) -> str:
        """Writes a segment that no version names yet."""
        name = f"segment-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, expected: int, add: Sequence[str] = (), remove: Sequence[str] = (), note: Mapping | None = None, schema=None) -> int:
        """Makes version ``expected`` + 1 of the version before it; raises VersionConflictError if someone else has."""
        before = self.manifest(expected)
        after = {"segments": [s for s in before["segments"] if s not in set(remove)] + list(add), "note": dict(note or {}), "schema": schema or before["schema"]}
        staged, final = self._path(f"{self.path}/_staged/{uuid.uuid4().hex}.json"), self._path(self._manifest(expected + 1))
        self._files.mkdirs(final.getParent())
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        jvm, option = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        try:
            self._context.rename(staged, final, options)
        except Exception as e:
            if self._files.exists(final):
                raise VersionConflictError(f"{self.path} has a version {expected + 1}") from e
            raise
        return expected + 1

    def create(self, rows: DataFrame, note: Mapping | None = None, segments: int = 1, by: str | None = None) -> VersionedTable:
        """Version 1, cut into segments by a key's hash, so that later rewrites touch only those that change."""
        if segments == 1 or by is None:
            names = [self.stage(rows)]
        else:
            names = [self.stage(rows.where(F.pmod(F.xxhash64(by), F.lit(segments)) == i)) for i in range(segments)]
        self.commit(0, names, note=note, schema=rows.schema.json())
        return self

    def append(self, rows: DataFrame, note: Mapping | None = None) -> int:
        name = self.stage(rows.select(*self.read().columns))
        while True:
            try:
                return self.commit(self.version(), [name], note=note)
            except VersionConflictError:  # an append fits on any version
                continue

    def vacuum(self, keep: int = 1) -> int:
        """Deletes segments that none of the last ``keep`` versions names; their number."""
        named = {s for v in self.versions()[-keep:] for s in self.manifest(v)["segments"]}
        old = [s.getPath() for s in self._files.listStatus(self._path(self.path)) if s.getPath().getName().startswith("segment-") and s.getPath().getName() not in named]
        for path in old:
            self._files.delete(path, True)
        return len(old)


def rewrite(table: VersionedTable, job: str, doomed: Column | DataFrame, key: str | None = None, keep: Column | None = None, stop_after: int | None = None) -> int:
    """Deletes or changes rows segment by segment, one commit each; a job of the same name goes on where it stopped.

    ``doomed``: a condition, or a frame of keys whose rows go. ``keep``: instead of deleting, a struct of new columns.
    Returns the rows that the whole job has touched; ``stop_after`` commits it gives up, for tests."""
    notes = [n for n in table.notes() if n.get("job") == job]
    done, commits = {n["segment"] for n in notes} | {n["made"] for n in notes}, 0
    for segment in [s for s in table.manifest()["segments"] if s not in done]:
        if stop_after is not None and commits >= stop_after:
            raise InterruptedError(f"{job} stopped after {commits} commits")
        rows = table.read(segments=[segment])
        hit = F.coalesce(doomed, F.lit(False)) if isinstance(doomed, Column) else F.lit(True)
        met = rows.where(hit) if isinstance(doomed, Column) else rows.join(doomed.select(key).distinct(), key, "left_semi")
        n = met.count()
        made = segment
        if n:
            if keep is not None:
                new = rows.withColumn("_new", F.when(hit, keep))
                rest = new.select(*[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in _fields(new) else F.col(c) for c in rows.columns])
            else:
                rest = rows.where(~hit) if isinstance(doomed, Column) else rows.join(doomed.select(key).distinct(), key, "left_anti").select(*rows.columns)
            made = table.stage(rest)
        while True:
            try:
                table.commit(table.version(), [made] if n else [], [segment] if n else [], {"job": job, "segment": segment, "made": made, "rows": n})
                break
            except VersionConflictError:
                if segment not in table.manifest()["segments"]:
                    raise  # another job has rewritten this segment: what was staged is out of date
        commits += 1
    return sum(n["rows"] for n in table.notes() if n.get("job") == job)


def _fields(df: DataFrame) -> set[str]:
    return set(df.schema["_new"].dataType.names)


def insert_once(table: VersionedTable, rows: DataFrame, key: Sequence[str], job: str) -> int:
    """Appends the rows whose key is not there yet, each key once (the least row); a repeated job adds nothing. Returns the number added."""
    once = rows.groupBy(*key).agg(F.min(F.struct(*[c for c in rows.columns if c not in key])).alias("r")).select(*key, "r.*")
    while True:
        at = table.version()
        if done := [n for n in table.notes() if n.get("job") == job]:
            return done[0]["rows"]
        name = table.stage(once.join(table.read(at).select(*key), list(key), "left_anti").select(*table.read(at).columns))
        n = table.read(at, [name]).count()
        try:
            table.commit(at, [name], note={"job": job, "segment": name, "made": name, "rows": n})
            return n
        except VersionConflictError:  # someone else may have added the same keys: look again
            continue


def cascade(tables: Mapping[str, VersionedTable], parents: Mapping[str, tuple[str, str, str]], doomed: DataFrame, root: str, key: str, job: str, stop_after: int | None = None) -> dict:
    """Deletes the rows of ``doomed`` keys and all that hang on them, children first, and returns the receipt.

    ``parents``: table -> (parent, own column, parent's column), parents first. The keys to delete are fixed first, in a
    table beside the root's, so that a job that goes on after a stop deletes the same rows."""
    spark, keys = tables[root].spark, {}
    for name in [root, *parents]:
        fixed = VersionedTable(spark, f"{tables[name].path}-{job}-keys")
        if fixed.version() == 0:
            if name == root:
                rows = tables[root].read().join(doomed.select(key).distinct(), key, "left_semi")
            else:
                parent, own, theirs = parents[name]
                above = keys[parent].read().select(F.col(theirs).alias(own)).distinct()
                rows = tables[name].read().join(above, own, "left_semi")
            try:
                fixed.create(rows.distinct())
            except VersionConflictError:
                pass
        keys[name] = fixed
    deleted = {}
    for name in [*reversed(parents), root]:
        own = key if name == root else parents[name][1]
        deleted[name] = rewrite(tables[name], job, keys[name].read().select(own), own, stop_after=stop_after)
    receipt = {"request_id": job, "deleted_counts": deleted}
    return receipt | {"receipt_hash": hashlib.sha256(json.dumps(receipt, sort_keys=True, ensure_ascii=False).encode()).hexdigest()}


def retained(days: Mapping[str, int], tenant: str, ts: str, as_of: Column) -> Column:
    """Which rows are past their tenant's retention."""
    cases = [(F.col(tenant) == t) & (F.col(ts) < as_of - F.make_interval(days=F.lit(n))) for t, n in days.items()]
    return reduce(lambda a, b: a | b, cases, F.lit(False))
