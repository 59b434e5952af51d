"""Sharding by size-tiered compaction, in DataFrame operations only.

Arrivals are appended as immutable runs of small shards. When ``FAN_IN`` runs have similar sizes (the same power of
FAN_IN times the least run) they are merged into one run of files of about the target size, and so on upwards. Each
change is a new version of the manifest, a small file. A writer first claims the version by creating a file that must not
exist yet, then writes the manifest aside and renames it into place; readers see whole versions only. Runs are deleted
once no version of the last ``GRACE_SECONDS`` names them, so neither a reader of an older version nor a writer that has
written a run and not yet committed it loses files.

Scale: appending and merging are scans and writes without a shuffle, since runs are split by size and never by key, so
no key can be hot. The driver holds file names and sizes alone. A row is rewritten once for each tier it climbs.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.plans.materialize import new_path

FAN_IN = 4
TARGET_BYTES = 128 << 20
LEAST_RUN_BYTES = 1 << 20
GRACE_SECONDS = 24 * 3600


class ShardStore:
    """Runs of Parquet shards under ``path`` (any file system that Spark opens) and the manifest's versions."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, least_run_bytes: int = LEAST_RUN_BYTES) -> None:
        if fan_in < 2 or target_bytes < 1 or least_run_bytes < 1:
            raise ValueError("fan_in is 2 or more, sizes are positive")
        self.spark, self.path, self.target, self.fan_in, self.least = spark, path.rstrip("/"), target_bytes, fan_in, least_run_bytes
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    # --- manifest ---------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        if not self._fs.exists(self._at("manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """One version: ``{version, schema, runs: [{name, tier, bytes, shards: [[file, bytes], ...]}]}``."""
        have = self.versions()
        version = have[-1] if version is None and have else version
        if version is None:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._at(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict) -> int:
        """Writes the next version; raises if another writer has claimed it."""
        version = manifest["version"] + 1
        text = json.dumps({**manifest, "version": version})
        aside, place, claim = self._at(f"manifest/.{uuid.uuid4().hex}"), self._at(f"manifest/v{version:08d}.json"), self._at(f"manifest/v{version:08d}.claim")
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"version {version} was claimed by another writer") from e
        if self._fs.exists(place):
            raise RuntimeError(f"version {version} was committed by another writer")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(aside, place):
            raise RuntimeError(f"version {version} could not be put in place")
        return version

    # --- runs -------------------------------------------------------------------------------------------------------

    def _run(self, name: str, merges: int) -> dict:
        files = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._at(name))]
        shards = sorted([f"{name}/{n}", size] for n, size in files if n.endswith(".parquet"))
        return {"name": name, "merges": merges, "bytes": sum(s for _, s in shards), "shards": shards}

    def _write(self, df: DataFrame, merges: int) -> dict:
        """A run on disk, not yet in any manifest. An arrival comes of no merge; its tier follows from the size."""
        name = f"runs/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self._run(name, merges)

    def stage(self, df: DataFrame, part: str) -> list[dict]:
        """Runs on disk for the values of ``part``, in their order, written in one pass and not yet in any manifest."""
        group = f"runs/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(part).parquet(f"{self.path}/{group}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(group)) if s.isDirectory() and "=" in s.getPath().getName()]
        return [self._run(f"{group}/{n}", 0) for n in sorted(names, key=lambda n: int(n.split("=")[1]))]

    def tier(self, run: dict) -> int:
        """0 for runs up to the least size, and one more for every factor of ``fan_in``."""
        return max(0, math.ceil(math.log(max(run["bytes"], 1) / self.least, self.fan_in) - 1e-9))

    def append(self, df: DataFrame) -> int:
        """Adds an arrival as a run of small shards, one for each of its partitions, and commits."""
        return self.add(self._write(df, 0), df.schema)

    def add(self, run: dict, schema: StructType) -> int:
        """Commits a run that is on disk."""
        now, columns = self.manifest(), json.loads(schema.json())
        if now["schema"] not in (None, columns):
            raise ValueError("an arrival has the columns of the store")
        return self.commit({**now, "schema": columns, "runs": [*now["runs"], run]})

    def _frame(self, manifest: dict, runs: list[dict]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{f}" for run in runs for f, _ in run["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> int:
        """Merges runs of one tier, least tier first, until no tier has ``fan_in`` of them; the version after that."""
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in now["runs"]:
                tiers.setdefault(self.tier(run), []).append(run)
            full = [t for t, runs in tiers.items() if len(runs) >= self.fan_in]
            if not full:
                return now["version"]
            runs = tiers[min(full)]
            files = max(1, math.ceil(sum(r["bytes"] for r in runs) / self.target))
            merged = self._write(self._frame(now, runs).coalesce(files), 1 + max(r["merges"] for r in runs))
            gone = {r["name"] for r in runs}
            self.commit({**now, "runs": [r for r in now["runs"] if r["name"] not in gone] + [merged]})

    def vacuum(self, keep: int = 1, grace_seconds: float = GRACE_SECONDS, spare: set[str] = frozenset()) -> None:
        """Deletes versions and runs that nobody can still need.

        The last ``keep`` versions stay, and any that was the newest within the last ``grace_seconds``. A run goes if no
        version that stays names it and it was written before that time (one not yet committed may be younger). Runs
        in ``spare`` stay. Only the one writer of a store that has no readers yet may give a grace of 0.
        """
        have, before = self.versions(), (time.time() - grace_seconds) * 1000
        made = {v: self._fs.getFileStatus(self._at(f"manifest/v{v:08d}.json")).getModificationTime() for v in have}
        stay = {v for v, after in zip(have, [*have[1:], None], strict=True) if after is None or made[after] > before} | set(have[-keep:])
        named = {r["name"] for v in stay for r in self.manifest(v)["runs"]} | spare
        for v in have:
            if v not in stay:
                self._fs.delete(self._at(f"manifest/v{v:08d}.json"), False)
                self._fs.delete(self._at(f"manifest/v{v:08d}.claim"), False)
        last = have[-1] if have else 0
        for v in (last + 1,):  # a writer that died between its claim and its commit
            claim = self._at(f"manifest/v{v:08d}.claim")
            if self._fs.exists(claim) and self._fs.getFileStatus(claim).getModificationTime() < before:
                self._fs.delete(claim, False)
        if not self._fs.exists(self._at("runs")):
            return
        for s in self._fs.listStatus(self._at("runs")):
            name = f"runs/{s.getPath().getName()}"
            inside = [n for n in named if n == name or n.startswith(f"{name}/")]
            if not inside and s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), True)
            elif inside and name not in inside:  # some of the runs that were staged together
                for part in self._fs.listStatus(s.getPath()):
                    if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in named and part.getModificationTime() <= before:
                        self._fs.delete(part.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one), exactly as appended."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing was appended yet")
        return self._frame(now, now["runs"])


def shard_documents(docs: DataFrame, arrivals: int, path: str, **settings) -> ShardStore:
    """A new store at ``path`` to which ``docs`` came in ``arrivals`` parts (by the remainder of doc_id; rows without one
    come first), compacted and cleared up after each. The input is read once. All rows and columns are kept as they
    are: nulls, repeated ids and repeated rows too; an empty table gives an empty store."""
    store = ShardStore(docs.sparkSession, path, **settings)
    part = F.coalesce(F.pmod("doc_id", F.lit(arrivals)), F.lit(0)).cast("int")
    runs = store.stage(docs.withColumn("__arrival", part), "__arrival")
    waiting = {r["name"] for r in runs}
    for run in runs:
        store.add(run, docs.schema)
        waiting.discard(run["name"])
        store.compact()
        store.vacuum(grace_seconds=0, spare=waiting)
    if not runs:
        store.append(docs.limit(0))
    return store


ARRIVALS = 8


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from the last version, with the arrival it came in, its size and a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shard_documents(docs, ARRIVALS, new_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", F.pmod("doc_id", F.lit(ARRIVALS)).alias("arrival"), "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES = {
    "op5_sharding": f"""
    SELECT doc_id, doc_id % {ARRIVALS} AS arrival, lang, source, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
           sha256(coalesce(text, '')) AS text_sha256 FROM documents
    """
}
