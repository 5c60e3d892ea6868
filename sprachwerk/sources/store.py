"""Tables of documents, chunks and entities as Parquet: idempotent upserts, stable pseudonyms."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranges of first uses in which values are numbered by themselves, and the seed of the sample that fixes them.
RANGES, SEED = 100, 7


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    by = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def merge(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with rows of new in place of those of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pseudonyms(entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(type, text, n, pseudonym) over a corpus, numbered per type by first use (doc_id, start).

    `known`, an earlier result, keeps its numbers; new values go on from the largest. Values are numbered
    by range: each range by itself, then moved by what comes before it.
    """
    first = entities.groupBy("type", "text").agg(F.min(F.struct("doc_id", "start")).alias("at"))
    base = None
    if known is not None:
        first = first.join(known.select("type", "text"), ["type", "text"], "left_anti")
        base = known.groupBy("type").agg(F.max("n").alias("base"))
    # ranges of first uses, fixed by a sample that is taken once: whatever is computed again falls into the same
    n = first.count()
    edges = [r["at"] for r in first.select("at").sample(min(1.0, RANGES / max(n, 1)), SEED).limit(4 * RANGES).collect()]
    own_type = first.schema["at"].dataType
    bounds = F.array(*[F.struct(F.lit(e["doc_id"]).alias("doc_id"), F.lit(e["start"]).alias("start")).cast(own_type) for e in edges])
    part = F.size(F.filter(bounds, lambda e: e <= F.col("at"))) if edges else F.lit(0)
    parts = first.withColumn("_p", part)
    sizes = parts.groupBy("type", "_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("type", "_p", (F.sum("_n").over(W.partitionBy("type").orderBy("_p")) - F.col("_n")).alias("_start"))
    own = parts.withColumn("_r", F.row_number().over(W.partitionBy("type", "_p").orderBy("at", "text")))
    rows = own.join(starts, ["type", "_p"])
    rows = rows.join(base, "type", "left") if base is not None else rows.withColumn("base", F.lit(0))
    n = (F.coalesce("base", F.lit(0)) + F.col("_start") + F.col("_r")).cast("long")
    digits = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    out = rows.select("type", "text", n.alias("n"), F.concat("type", F.lit("_"), digits).alias("pseudonym"))
    return out if known is None else known.select("type", "text", "n", "pseudonym").unionByName(out)


class Store:
    """documents, chunks and entities under one folder, each in BUCKETS parts by a hash of its key.

    An upsert rewrites the parts that its rows fall into, to a new place, and then names the new state in
    a manifest that lists each part's place. A writer that dies leaves the last manifest as it was; what
    neither of the last two manifests names is deleted by the next writer. One writer a table at a time.
    """

    KEYS = {"documents": ["doc_id"], "chunks": ["chunk_id"], "entities": ["doc_id", "type", "start", "end"]}
    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _versions(self, table: str) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names(table) if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, table: str, version: int) -> dict[int, str]:
        text = self.spark.read.text(f"{self.root}/{table}/v{version}.json").agg(F.max("value")).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def _name(self, table: str, version: int, parts: dict[int, str]) -> None:
        fs, draft = self._fs(), self._path(f"{table}/.v{version}.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"{table}/v{version}.json")):
            raise RuntimeError(f"another writer has named version {version} of {table}")

    def read(self, table: str) -> DataFrame | None:
        """The table as the last upsert left it; None if there is none."""
        found = self._versions(table)
        return self._read(table, list(self._manifest(table, found[-1]).values())) if found else None

    def _read(self, table: str, parts: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{table}/{p}" for p in parts])

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows of one key replace earlier ones; of equal keys within `rows` the one stays that is last in the order of its text form."""
        key, found = self.KEYS[table], self._versions(table)
        parts = self._manifest(table, found[-1]) if found else {}
        bucket = F.pmod(F.xxhash64(*key), F.lit(self.BUCKETS)).cast("int")
        form = F.to_json(F.struct(*rows.columns))
        last = rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(form)))).where("_r = 1").drop("_r").withColumn("_bucket", bucket)
        touched = [r["_bucket"] for r in last.select("_bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        old = [parts[b] for b in touched if b in parts]
        merged = merge(self._read(table, old).withColumn("_bucket", bucket), last, key) if old else last
        place = f"data/{uuid.uuid4().hex}"
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{table}/{place}")
        now = parts | {b: f"{place}/_bucket={b}" for b in touched}
        self._name(table, (found[-1] if found else 0) + 1, now)
        self._sweep(table, [now, parts])

    def _sweep(self, table: str, states: list[dict[int, str]]) -> None:
        """Delete what no state in use names, and all manifests but the last two."""
        used = {p for s in states for p in s.values()}
        fs = self._fs()
        for folder in self._names(f"{table}/data"):
            own = [f"data/{folder}/{n}" for n in self._names(f"{table}/data/{folder}") if n.startswith("_bucket=")]
            for part in own:
                if part not in used:
                    fs.delete(self._path(f"{table}/{part}"), True)
            if not used.intersection(own):
                fs.delete(self._path(f"{table}/data/{folder}"), True)
        for version in self._versions(table)[:-2]:
            fs.delete(self._path(f"{table}/v{version}.json"), False)

    def drop(self) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)
