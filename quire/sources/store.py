"""Tables that are committed together: staged files, a manifest for each version, and builds of what changed only.

A table's rows lie in buckets, by a hash of the document's key.  A change writes the buckets that it touches to a new folder and
then publishes a manifest, which names the folder of every bucket of every table; until then readers see the version before,
and files of a writer that died are named nowhere.  A manifest is published by a rename that fails if its name exists, so of
two writers one wins; the other publishes on top of the winner if they touched different buckets, and fails with Conflict otherwise.
The file system must rename without replacing (HDFS and local ones do).

Buckets are dealt with a rebalance, which splits large ones, so no task writes a hot document's rows alone.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.text import fingerprint, strip


class Conflict(RuntimeError):
    """Another writer changed the same buckets since the version that was read."""


class Violation(ValueError):
    """The rows to commit break a rule."""


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; with a local master and none named, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        named = tempfile.mkdtemp(prefix="quire-")
    return f"{named.rstrip('/')}/store-{uuid.uuid4().hex}"


def parked(rows: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, for a job that reads them more than once."""
    return Store(rows.sparkSession, scratch_folder(rows.sparkSession)).park(rows)


@dataclass
class Manifest:
    """A version: by table its schema and the folder of each bucket that has rows."""

    version: int
    tables: dict[str, dict]

    def folders(self, table: str) -> dict[str, str]:
        return self.tables.get(table, {}).get("folders", {})


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: str = "doc_id"):
        """`buckets` and `key` must be those with which the store was begun."""
        self.spark, self.path, self.buckets, self.key = spark, path.rstrip("/"), buckets, key
        self.jvm = spark.sparkContext._jvm

    # --- files

    def _file(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._file(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, place = self._fs(), self._file(folder)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """A version; by default the last. Version 0 has no tables."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Manifest(0, {})
        stream = self._fs().open(self._file(f"{self.path}/versions/{version:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(version, json.loads(text)["tables"])

    def _publish(self, manifest: Manifest) -> bool:
        """False if the version exists already."""
        part = self._file(f"{self.path}/versions/.{uuid.uuid4().hex}.new")
        out = self._fs().create(part)
        out.write(bytearray(json.dumps({"version": manifest.version, "tables": manifest.tables}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(kinds, 1)
        never[0] = kinds.NONE
        try:
            context.rename(part, self._file(f"{self.path}/versions/{manifest.version:012d}.json"), never)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            self._fs().delete(part, False)
            return False

    # --- reading

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, table: str, version: int | Manifest | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as of a version (by default the last), or only some of its buckets; None if there is no such table."""
        manifest = version if isinstance(version, Manifest) else self.manifest(version)
        if table not in manifest.tables:
            return None
        schema = StructType.fromDDL(manifest.tables[table]["schema"])
        folders = [f for b, f in manifest.folders(table).items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- writing

    def park(self, rows: DataFrame) -> DataFrame:
        """Rows written once beside the tables, for a change that reads them more than once."""
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(place)
        return self.spark.read.schema(rows.schema).parquet(place)

    def _stage(self, rows: DataFrame) -> dict[str, str]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def commit(self, base: Manifest, changes: dict[str, tuple[DataFrame, list[int]]], guards: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = ()) -> int:
        """The new version, in which the given buckets of tables hold the given rows and no others.

        `guards` are pairs of a table and of what finds the rows of its changed buckets that break a rule; they see the
        staged files, and any such row stops the change."""
        staged = {}
        for table, (rows, buckets) in changes.items():
            folders = self._stage(rows)
            strange = [b for b in folders if int(b) not in buckets]
            if strange:
                raise Violation(f"{table}: rows outside the buckets of the change: {strange[:5]}")
            staged[table] = (rows.schema.simpleString(), folders, {str(b) for b in buckets})
        for table, find in guards:
            schema, folders, _ = staged[table]
            if folders:
                wrong = find(self.spark.read.schema(StructType.fromDDL(schema)).parquet(*folders.values())).limit(5).collect()
                if wrong:
                    raise Violation(f"{table}: {[r.asDict() for r in wrong]}")
        while True:
            now = self.manifest()
            for table, (_, _, buckets) in staged.items():
                was, here = base.folders(table), now.folders(table)
                if any(was.get(b) != here.get(b) for b in buckets):
                    raise Conflict(f"{table} has changed since version {base.version}")
            tables = dict(now.tables)
            for table, (schema, folders, buckets) in staged.items():
                kept = {b: f for b, f in now.folders(table).items() if b not in buckets}
                if kept and tables[table]["schema"] != schema:
                    raise Violation(f"{table}: another schema than its other buckets have")
                tables[table] = {"schema": schema, "folders": kept | folders}
            if self._publish(Manifest(now.version + 1, tables)):
                return now.version + 1

    def put(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """A table as a whole, in place of what it held."""
        base = self.manifest()
        return self.commit(base, {table: (rows, list(range(self.buckets)))}, ((table, repeated(keys)),))

    def update(self, table: str, updates: DataFrame, keys: list[str], fields: list[str] | None = None, must_exist: bool = False, base: Manifest | None = None, guards: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> int:
        """Rows with the keys of `updates` take its values, or only those of `fields`; all other values and rows stay.

        Keys that the table does not have are added, or stop the change if they must exist.  The document's key is one of the
        keys.  Without updates the version stays."""
        base = base or self.manifest()
        updates = self.park(updates)
        buckets = self.touched(updates)
        if not buckets:
            return base.version
        old = self.read(table, base, buckets)
        old = self.spark.createDataFrame([], updates.schema) if old is None else old
        if must_exist:
            lost = updates.join(old, keys, "left_anti").select(*keys).limit(5).collect()
            if lost:
                raise Violation(f"{table}: unknown {[r.asDict() for r in lost]}")
        values = [c for c in old.columns if c not in keys]
        taken = values if fields is None else fields
        new = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in taken), F.lit(True).alias("_updated"))
        both = old.withColumn("_had", F.lit(True)).join(new, keys, "full")
        rows = both.select(*(F.col(c) if c in keys or c not in taken else F.when(F.col("_updated"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns))
        return self.commit(base, {table: (rows, buckets)}, ((table, repeated(keys)), *((table, g) for g in guards)))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the last `keep`, and folders that those do not name; returns the folders deleted.

        No writer may be at work meanwhile: what it has staged is named nowhere yet."""
        known = self.versions()
        fs, last = self._fs(), known[-keep:]
        used = {f.rsplit("/", 2)[1] for v in last for t in self.manifest(v).tables.values() for f in t["folders"].values()}
        for v in known[: len(known) - len(last)]:
            fs.delete(self._file(f"{self.path}/versions/{v:012d}.json"), False)
        gone = [n for n in self._names(f"{self.path}/data") if n not in used]
        for n in gone:
            fs.delete(self._file(f"{self.path}/data/{n}"), True)
        return len(gone)


def repeated(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """What finds keys that occur more than once."""
    return lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unready(docs: DataFrame, languages: list[str]) -> F.Column:
    """Why a document cannot be built: no text, no language, or one that is not known; else null."""
    lang = F.lower(strip(F.col("lang")))
    blank = lambda c: F.coalesce(F.length(strip(c)) == 0, F.lit(True))
    return F.when(blank(F.col("text")), "missing_raw_text").when(blank(lang), "missing_language").when(~lang.isin(languages), F.concat(F.lit("unsupported_language:"), lang))


def refresh(store: Store, docs: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], failure: F.Column | None = None, settings: str = "", force: bool = False) -> dict[str, int]:
    """Builds the documents (doc_id, text, ...) that are new or whose text or `settings` changed, and drops those that are gone; returns
    how many were built, failed, dropped, and the buckets that were written.

    `build` makes tables with the store's key out of documents.  Where `failure` tells a reason, a document is not built: what
    the store has of it stays, and the reason is kept in `failures` until the document changes or is built by force.  The
    fingerprints of what was built are in `built`.  If nothing changed, no version is made."""
    key = store.key
    base = store.manifest()
    now = docs.withColumn("_fingerprint", F.concat(fingerprint(F.coalesce("text", F.lit(""))), F.lit(settings)))
    empty = store.spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, _fingerprint string, reason string")
    built, failures = store.read("built", base), store.read("failures", base)
    built, failures = empty.drop("reason") if built is None else built, empty if failures is None else failures
    reason = F.lit(None).cast("string") if failure is None else failure
    known = built.select(key, "_fingerprint").unionByName(failures.select(key, "_fingerprint"))
    fresh = now if force else now.join(known, [key, "_fingerprint"], "left_anti")
    changed = store.park(fresh.select(key, "_fingerprint", reason.alias("reason")))
    wrong = repeated([key])(changed).limit(5).collect()
    if wrong:
        raise Violation(f"documents that occur more than once: {[r[key] for r in wrong]}")
    good, bad = changed.where("reason is null"), changed.where("reason is not null")
    gone = store.park(known.select(key).distinct().join(now.select(key), key, "left_anti"))
    buckets = store.touched(changed.select(key).union(gone.select(key)))
    counts = {"built": good.count(), "failed": bad.count(), "dropped": gone.count(), "buckets": len(buckets)}
    if not buckets:
        return counts
    replaced = good.select(key).union(gone.select(key))
    changes = {}

    def change(table: str, rows: DataFrame, out: DataFrame) -> None:
        old = store.read(table, base, buckets)
        changes[table] = (rows if old is None else old.join(out, key, "left_anti").unionByName(rows), buckets)

    for table, rows in build(docs.join(good.select(key), key, "left_semi")).items():
        change(table, rows, replaced)
    change("built", good.select(key, "_fingerprint"), replaced)
    change("failures", bad.select(key, "_fingerprint", "reason"), changed.select(key).union(gone.select(key)))
    store.commit(base, changes, (("built", repeated([key])),))
    return counts
