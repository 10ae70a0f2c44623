"""Sharding: size-tiered compaction of immutable Parquet shards, with DataFrame operations only.

An arrival is appended as a run of small shards.  Runs of similar size (one tier: sizes within a factor of TIER) are merged,
MERGE_AT at a time, into shards of about TARGET_BYTES; the merged run belongs to a higher tier.  Shards of that size are
sealed and not rewritten.  Every change, whatever number of runs it adds or replaces, is one new version of the manifest,
written aside and renamed to a name that must not exist.  A writer that comes second makes its change anew on the version that
won: an append adds its runs to it, a merge is given up if one of its runs is gone.  Readers of older versions keep their
files, and files that no manifest names are never read, so a writer that fails leaves nothing to be seen.
"""

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.scratch import every, free_name, shared_dir

TARGET_BYTES = 64 << 20
TIER_BASE = 1 << 20
TIER = 4
MERGE_AT = 4
SEALED = 0.75
#: Since Spark 4.1 a union of single partitions is one partition; here each has to become a file.
UNION_KEEPS = "spark.sql.unionOutputPartitioning"
#: The query's arrivals: one per so many bytes of text, and at least so many.
ARRIVAL_BYTES = 256 << 20
LEAST_ARRIVALS = 20


class ShardStore:
    """Shards and manifests below one folder of any Hadoop file system.

    A manifest: {"version", "schema", "runs": [{"run", "tier", "shards": [{"path", "bytes"}]}]}.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target_bytes
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    # -- manifests

    def versions(self) -> list[int]:
        at = self._hadoop.Path(f"{self.path}/_manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/_manifests/v{found[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, change: Callable[[list[dict]], list[dict] | None], schema: str) -> dict:
        """One new version whose runs are ``change`` of the newest version's runs; no version if that is None."""
        while True:
            before = self.manifest()
            runs = change(before["runs"])
            if runs is None:
                return before
            after = {"version": before["version"] + 1, "schema": schema, "runs": runs}
            if self._published(after):
                return after

    def _published(self, after: dict) -> bool:
        """Whether this was the first writer of that version."""
        aside = self._hadoop.Path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        to = self._hadoop.Path(f"{self.path}/_manifests/v{after['version']:08d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        # rename without overwriting is the commit
        never = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        never[0] = self._hadoop.Options.Rename.NONE
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(aside, to, never)
        except Py4JJavaError as lost:
            if not lost.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            self._fs.delete(aside, False)
            return False
        return True

    # -- runs

    def _shards(self, folder: str) -> list[dict]:
        files = self._fs.listStatus(self._hadoop.Path(folder))
        found = [{"path": x.getPath().toString(), "bytes": x.getLen()} for x in files if x.getPath().getName().startswith("part-")]
        return sorted(found, key=lambda x: x["path"])

    @staticmethod
    def _tier(n_bytes: int) -> int:
        tier = 0
        while n_bytes >= TIER_BASE * TIER ** (tier + 1):
            tier += 1
        return tier

    def _run(self, name: str, shards: list[dict]) -> dict:
        return {"run": name, "tier": self._tier(sum(s["bytes"] for s in shards)), "shards": shards}

    def append(self, arrivals: DataFrame, by: str | None = None) -> dict:
        """One run per value of column ``by``, which is not kept (one run without it), all of them in one version.

        Without any row there are no runs, but a version with the schema.
        """
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        kept = arrivals.drop(by) if by else arrivals
        writer = arrivals.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        folders = [folder]
        if by:
            folders = sorted(x.getPath().toString() for x in self._fs.listStatus(self._hadoop.Path(folder)) if x.isDirectory())
        runs = [self._run(one.rpartition("/data/")[2], shards) for one in folders if (shards := self._shards(one))]
        return self._commit(lambda now: now + runs, kept.schema.json())

    def _bins(self, loose: list[dict]) -> list[list[str]]:
        """Loose shards dealt into files of SEALED to twice that of the target; what remains goes to the last one."""
        bins, size = [[]], 0
        for shard in loose:
            if size >= SEALED * self.target:
                bins, size = [*bins, []], 0
            bins[-1].append(shard["path"])
            size += shard["bytes"]
        if len(bins) > 1 and size < SEALED * self.target / 2:
            bins[-2:] = [bins[-2] + bins[-1]]
        return bins

    def _merge(self, now: dict, runs: list[dict]) -> dict:
        merging = {r["run"] for r in runs}
        every = [s for r in runs for s in r["shards"]]
        sealed = [s for s in every if s["bytes"] >= SEALED * self.target]
        loose = [s for s in every if s["bytes"] < SEALED * self.target]
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        made = []
        if loose:
            schema = self._schema(now)
            files = [self.spark.read.schema(schema).parquet(*paths).coalesce(1) for paths in self._bins(loose)]
            was = self.spark.conf.get(UNION_KEEPS, None)
            self.spark.conf.set(UNION_KEEPS, "false")
            try:
                reduce(DataFrame.union, files).write.option("compression", "zstd").parquet(folder)
            finally:
                self.spark.conf.unset(UNION_KEEPS) if was is None else self.spark.conf.set(UNION_KEEPS, was)
            made = self._shards(folder)
        merged = self._run(folder.rpartition("/data/")[2], sealed + made)
        merged["tier"] = max(merged["tier"], max(r["tier"] for r in runs) + 1)

        def replaced(held: list[dict]) -> list[dict] | None:
            left = [r for r in held if r["run"] not in merging]
            return [*left, merged] if len(held) - len(left) == len(merging) else None

        return self._commit(replaced, now["schema"])

    def _unsealed(self, run: dict) -> bool:
        return any(s["bytes"] < SEALED * self.target for s in run["shards"])

    def compact(self, full: bool = False) -> dict:
        """Merge the oldest MERGE_AT runs of the lowest tier that has so many with shards to merge, until none has; a version each.

        Merged runs fill the next tier, so merges cascade.  ``full``: then also merge what is still loose, in whatever tier.
        """
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in now["runs"]:
                if len(run["shards"]) > 1 or self._unsealed(run):
                    tiers.setdefault(run["tier"], []).append(run)
            ready = [runs for _, runs in sorted(tiers.items()) if len(runs) >= MERGE_AT]
            if not ready:
                break
            self._merge(now, ready[0][:MERGE_AT])
        loose = [r for r in now["runs"] if self._unsealed(r)]
        if full and sum(len(r["shards"]) for r in loose) > 1:
            return self._merge(now, loose)
        return now

    def vacuum(self) -> int:
        """Delete data files that the newest manifest does not name; returns how many. For use when no older reader is left."""
        named = {s["path"] for r in self.manifest()["runs"] for s in r["shards"]}
        found, gone = self._fs.listFiles(self._hadoop.Path(f"{self.path}/data"), True), 0
        while found.hasNext():
            at = found.next().getPath()
            if at.getName().startswith("part-") and at.toString() not in named:
                gone += bool(self._fs.delete(at, False))
        return gone

    def _schema(self, manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest), with Spark's hidden ``_metadata`` of the shard a row lies in."""
        now = self.manifest(version)
        paths = [s["path"] for r in now["runs"] for s in r["shards"]]
        if now["schema"] is None:
            raise ValueError("no version has been committed")
        if not paths:  # a folder without files, so that the hidden column is there, too
            paths = [f"{self.path}/_none"]
            self._fs.mkdirs(self._hadoop.Path(paths[0]))
        return self.spark.read.schema(self._schema(now)).parquet(*paths)


def arrive(store: ShardStore, docs: DataFrame) -> None:
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    wanted = max(LEAST_ARRIVALS, -(-n_bytes // ARRIVAL_BYTES))
    tasks = max(1, docs.rdd.getNumPartitions())
    together, apart = max(1, tasks // wanted), -(-wanted // tasks)
    arrival = F.floor(F.spark_partition_id() / together) * apart + F.pmod(F.xxhash64("doc_id"), F.lit(apart))
    by = free_name("arrival", docs.columns)
    store.append(docs.select(*every(docs), arrival.alias(by)), by=by)
    store.compact(full=True)


def arrivals_compacted(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Documents appended in arrivals whose number grows with the input, compacted on the way and at the end, and read back.

    A row per document: doc_id, text_crc32 and n_bytes of the text read back (null: null), shard, shard_bytes and run (the
    names in the committed manifest).  Repeated rows and nulls are kept as they are; an empty table gives no rows.  All columns
    of ``docs`` are stored, whatever their names.  An arrival holds the rows of some neighbouring
    partitions, so that a task writes one file, or of few partitions a part by a hash of doc_id.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, shared_dir(spark), target_bytes)
    arrive(store, docs)
    return store.read().select(
        "doc_id",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.col("_metadata.file_name").alias("shard"),
        F.col("_metadata.file_size").alias("shard_bytes"),
        F.regexp_extract("_metadata.file_path", "/data/(.*)/[^/]*$", 1).alias("run"),
    )
