"""A store of sessions' quasi-identifier records that is changed bucket by bucket.

Records are dealt over buckets by a hash of the session.  A change reads and
writes the buckets that it touches and no others, each as a new version in a
folder of its own; a manifest then names the version of every bucket.  The
manifest of the highest number is the state, and it appears by one rename, so a
job that dies before that leaves the state as it was, and readers of an older
manifest keep their files until ``vacuum``.  Two writers that started from the
same state can't both win: the second one's manifest is there already, and it
gets an error.

Categories are stored encrypted only (``qi.encrypt_category``).  The driver
holds a manifest (one short entry a bucket) and nothing of the records.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qi as Q

SCHEMA = "session_hash string, qi_type string, category_enc binary, created_at double"


class StoreConflict(RuntimeError):
    """Another writer has changed the store meanwhile."""


class SessionStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifests")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> tuple[int, dict[int, str]]:
        """(number, folder of each bucket that holds something) of the present state."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        fs, at = self._fs(f"{self.path}/manifests/{numbers[-1]}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        state = json.loads(text)
        if state["buckets"] != self.buckets:
            raise ValueError(f"the store has {state['buckets']} buckets")
        return numbers[-1], {int(k): v for k, v in state["folders"].items()}

    def _commit(self, number: int, folders: dict[int, str]) -> None:
        fs, target = self._fs(f"{self.path}/manifests/{number}.json")
        _, draft = self._fs(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps({"buckets": self.buckets, "folders": folders}).encode())
        stream.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise StoreConflict("the store was changed by another writer")

    def _bucket(self, session: Column) -> Column:
        return F.pmod(F.xxhash64(session), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[int, str], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{v}" for k, v in folders.items() if only is None or k in only]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        """(session_hash, qi_type, category_enc, created_at) of the present state."""
        return self._read(self.manifest()[1])

    def _rewrite(self, start: tuple[int, dict[int, str]], touched: list[int], rows: DataFrame) -> list[int]:
        number, folders = start
        version = f"data/{number + 1:010d}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket(F.col("session_hash"))).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        fs, at = self._fs(f"{self.path}/{version}")
        filled = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.isDirectory() and "=" in f.getPath().getName()}
        left = {k: v for k, v in folders.items() if k not in touched}
        self._commit(number + 1, left | {k: f"{version}/bucket={k}" for k in sorted(filled)})
        return touched

    def upsert(self, turn: DataFrame) -> list[int]:
        """Adds records (SCHEMA); of a session and type the later one stays.  Gives the buckets that were written."""
        start = self.manifest()
        touched = sorted(r["bucket"] for r in turn.select(self._bucket(F.col("session_hash")).alias("bucket")).distinct().collect())
        if not touched:
            return []
        return self._rewrite(start, touched, Q.upsert(self._read(start[1], touched), turn.select("session_hash", "qi_type", "category_enc", F.col("created_at").cast("double").alias("created_at"))))

    def expire(self, now: float, ttl: float) -> list[int]:
        """Drops records older than ``now - ttl``; buckets without any stay as they are."""
        start = self.manifest()
        rows = self._read(start[1])
        old = rows.where(F.col("created_at") < now - ttl).select(self._bucket(F.col("session_hash")).alias("bucket")).distinct()
        touched = sorted(r["bucket"] for r in old.collect())
        if not touched:
            return []
        return self._rewrite(start, touched, Q.expire(self._read(start[1], touched), F.lit(now), ttl))

    def seen(self, sessions: DataFrame, now: Column, ttl: float) -> DataFrame:
        """(session_hash, seen) of the asked sessions: their types that are alive."""
        alive = Q.expire(self.read(), now, ttl).join(sessions.select("session_hash").distinct(), "session_hash", "left_semi")
        return alive.groupBy("session_hash").agg(F.array_sort(F.collect_set("qi_type")).alias("seen"))

    def audit(self, key: bytes) -> DataFrame:
        """(session_hash, qi_type, created_at, category) with categories in clear text."""
        return Q.audit(self.read(), key)

    def vacuum(self) -> int:
        """Deletes versions that the present state doesn't name, and older manifests; how many versions went."""
        number, folders = self.manifest()
        used = {v.rsplit("/", 1)[0] for v in folders.values()}
        fs, at = self._fs(f"{self.path}/data")
        gone = 0
        for f in fs.listStatus(at) if fs.exists(at) else []:
            if f"data/{f.getPath().getName()}" not in used:
                fs.delete(f.getPath(), True)
                gone += 1
        for n in self._numbers():
            if n < number:
                fs.delete(self._fs(f"{self.path}/manifests/{n}.json")[1], False)
        return gone
