"""Versioned tables: copy-on-write buckets, a manifest for each version, a log whose last entry is the table.

A key's bucket is its hash, so a change rewrites only the buckets of its keys. Versions are never altered.
The log has a file for each step, put there by a rename that fails if another writer was first; reading,
rolling back and comparing versions start from it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_MANIFEST = "bucket int, version long, n_rows long, digest string"


class VersionedTable:
    """A table of unique ``keys`` under ``folder``, a path that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets

    # the log

    def log(self) -> list[dict]:
        """Entries in order: version, schema, batch (of a stream, or none), note."""
        fs, root = self._fs(f"{self.folder}/log")
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().endswith(".json"))
        return [json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/log/{n}").collect())) for n in names]

    def version(self) -> int:
        """Number of the version that the table is, -1 before it was made."""
        log = self.log()
        return log[-1]["version"] if log else -1

    def _fs(self, path: str):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _append(self, place: int, entry: dict) -> None:
        """Put ``entry`` into the log as number ``place``; an error where that number is taken."""
        jvm = self.spark._jvm
        fs, _ = self._fs(self.folder)
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/{place:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer was first to step {place} of {self.folder}")

    # reading

    def manifest(self, version: int | None = None) -> dict[int, tuple[int, int, str]]:
        """(version whose files hold it, rows, digest) of each bucket that has rows; at most ``buckets`` of them."""
        version = self.version() if version is None else version
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifests/{version}").collect()
        return {r["bucket"]: (r["version"], r["n_rows"], r["digest"]) for r in rows}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the present one if none is given."""
        version = self.version() if version is None else version
        return self._buckets(version, self.manifest(version))

    def _schema(self, version: int) -> StructType:
        entry = next((e for e in self.log() if e["version"] == version), None)
        if entry is None:
            raise ValueError(f"{self.folder} has no version {version}")
        return StructType.fromJson(entry["schema"])

    def _buckets(self, version: int, some: dict[int, tuple[int, int, str]]) -> DataFrame:
        schema = self._schema(version)
        paths = [f"{self.folder}/data/{at}/bucket={b}" for b, (at, n, _) in sorted(some.items()) if n]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame, note: str = "created") -> int:
        """Version 0, of ``rows`` with unique keys."""
        return self._commit(rows, {}, 0, note, None, set(range(self.buckets)))

    def upsert(self, changes: DataFrame, deletes: DataFrame | None = None, batch: int | None = None, note: str = "upsert") -> int:
        """A version in which ``changes`` replace or join the rows of their keys, and keys of ``deletes`` are gone.

        Changes must have the table's columns; of several for a key the greatest row counts. A ``batch``
        that is in the log already changes nothing: its version is returned.
        """
        return self.fold(lambda now, _: (changes, deletes), changes if deletes is None else changes.select(*self.keys).unionByName(deletes.select(*self.keys)), batch, note)

    def fold(self, change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]], touched: DataFrame, batch: int | None = None, note: str = "fold") -> int:
        """Like ``upsert``, with changes and deletes worked out by ``change`` from the present rows of the buckets that hold
        keys of ``touched``, and ``touched`` itself. They may not leave those buckets."""
        log = self.log()
        if batch is not None:
            done = [e["version"] for e in log if e["batch"] == batch]
            if done:
                return done[-1]
        version = log[-1]["version"]
        held = self.manifest(version)
        marked = {r["bucket"] for r in touched.select(self._bucket().alias("bucket")).distinct().collect()}  # at most ``buckets``
        now = self._buckets(version, {b: held[b] for b in marked & set(held)})
        changes, deletes = change(now, touched)
        rest = [c for c in now.columns if c not in self.keys]
        fresh = changes.select(*now.columns).groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("row")).select(*self.keys, "row.*").select(*now.columns)
        gone = fresh.select(*self.keys) if deletes is None else fresh.select(*self.keys).unionByName(deletes.select(*self.keys)).distinct()
        kept = now.join(gone, self.keys, "left_anti")
        if deletes is not None:
            fresh = fresh.join(deletes.select(*self.keys).distinct(), self.keys, "left_anti")
        return self._commit(kept.unionByName(fresh), {b: x for b, x in held.items() if b not in marked}, len(log), note, batch, marked)

    def _commit(self, rows: DataFrame, untouched: dict, place: int, note: str, batch: int | None, marked: set[int]) -> int:
        version = max((e["version"] for e in self.log()), default=-1) + 1
        path, columns = f"{self.folder}/data/{version}", rows.columns
        tagged = rows.withColumn("bucket", self._bucket())
        # a bucket's rows come together by key, so each is a file or a few
        tagged.repartition("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(path)
        stored = self.spark.read.schema(StructType([*rows.schema.fields]).add("bucket", "integer")).parquet(path)
        h = F.xxhash64(*columns)
        sums = stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", F.hex(F.bit_xor(h)), F.sum(h.cast("decimal(38,0)")).cast("string")).alias("digest"))
        new = [(r["bucket"], version, r["n_rows"], r["digest"]) for r in sums.collect()]  # at most ``buckets``
        all_rows = new + [(b, *x) for b, x in untouched.items()]
        self.spark.createDataFrame(all_rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{version}")
        self._append(place, {"version": version, "schema": rows.schema.jsonValue(), "batch": batch, "note": note, "rewritten": len(marked)})
        return version

    def rollback(self, version: int) -> int:
        """Make an earlier version the present one: a log entry, no data is written."""
        log, schema = self.log(), self._schema(version).jsonValue()
        self._append(len(log), {"version": version, "schema": schema, "batch": None, "note": f"rolled back to {version}", "rewritten": 0})
        return version

    # comparing

    def unlike(self, old: int, new: int) -> set[int]:
        """Buckets whose rows differ between two versions, by their digests."""
        a, b = self.manifest(old), self.manifest(new)
        return {k for k in set(a) | set(b) if a.get(k, (0, 0, ""))[1:] != b.get(k, (0, 0, ""))[1:]}

    def diff(self, old: int, new: int) -> DataFrame:
        """(keys, change, fields) of rows ADDED, REMOVED or CHANGED; only buckets of unlike digests are read.

        ``fields`` lists the columns that differ, joined by ``|``, of changed rows.
        """
        some = self.unlike(old, new)
        sides = [self._buckets(v, {k: x for k, x in self.manifest(v).items() if k in some}) for v in (old, new)]
        rest = [c for c in sides[1].columns if c not in self.keys]
        a, b = (df.select(*self.keys, F.struct(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in rest]).alias(name)) for df, name in zip(sides, ("was", "is")))
        both = a.join(b, self.keys, "full")
        fields = F.array_compact(F.array(*[F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"is.{c}")), F.lit(c)) for c in rest]))
        change = F.when(F.col("was").isNull(), "ADDED").when(F.col("is").isNull(), "REMOVED").when(F.size(fields) > 0, "CHANGED")
        rows = both.select(*self.keys, change.alias("change"), F.when(change == "CHANGED", F.array_join(fields, "|")).alias("fields"))
        return rows.filter("change is not null")
