"""What the operators of this folder share: scratch tables, reading, numbering, joins on hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on this machine alone, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: A key is hot if more than one in so many rows has it, so there are never more hot keys than this.
HOT_SHARE = 1000
#: Below so many rows a key is never hot.
HOT_ROWS = 10_000
#: Equal rows that travel as one.
CHUNK = 4096

_SCRATCH: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. On a cluster it has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh place for an intermediate table in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/sprachwerk/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _SCRATCH.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sprachwerk_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_sprachwerk_path", None)
        if path in _SCRATCH:
            _SCRATCH.remove(path)
            remove_path(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[list[str]]:
    """Delete at its end the scratch tables that operators wrote inside, whose results are lazy readers of them.

    Use results inside. Paths put into the list that is given stay.
    """
    before, kept = len(_SCRATCH), list(keep)
    try:
        yield kept
    finally:
        for path in _SCRATCH[before:]:
            if path not in kept:
                _SCRATCH.remove(path)
                remove_path(spark, path)


def release(spark: SparkSession) -> int:
    """Delete every scratch table of this process; call it when no result is needed any more. Returns how many."""
    n = len(_SCRATCH)
    while _SCRATCH:
        remove_path(spark, _SCRATCH.pop())
    return n


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(names: list[str]) -> list[Column]:
    return [named(n) for n in names]


def carried(names: list[str]) -> list[Column]:
    """Columns under names that every operator takes; a kernel's schema gives them their own back."""
    return [named(n).alias(f"_sw_{i}") for i, n in enumerate(names)]


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def chunked(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each different row of df with `_c`, 0 at first, and `_n`, how often it comes: at most `chunk` times a row of the result.

    Equal rows are counted before anything is shuffled, so a row that a third of all rows repeat is no
    load, and what is dealt by a hash of the row and _c has no hot key.
    """
    counted = df.groupBy(*columns(df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    return parts.withColumn("_n", F.least(F.lit(chunk), F.col("_n") - F.col("_c") * chunk).cast("long"))


def gapless(df: DataFrame, within: list[str], order: list[str], out: str, rows_per_bucket: int = 4096) -> DataFrame:
    """Number rows 0, 1, 2 … inside each value of `within` without gathering a value in one task.

    Equal rows are numbered as one, in chunks, and told apart again at the end. Chunks are dealt into hash
    buckets of about rows_per_bucket, each bucket is numbered by itself in the order given, and bucket
    sizes are summed up into starts. The numbers depend only on the rows; equal rows are exchangeable.
    """
    keep = df.columns
    spread = max(1, -(-df.count() // rows_per_bucket))
    keyed = chunked(df).withColumn("_b", F.pmod(F.xxhash64(*columns(keep), "_c"), F.lit(spread)).cast("int"))
    sizes = keyed.groupBy(*within, "_b").agg(F.sum("_n").alias("_size"))
    starts = sizes.select(*within, "_b", (F.sum("_size").over(W.partitionBy(*within).orderBy("_b")) - F.col("_size")).alias("_start"))
    by = W.partitionBy(*within, "_b").orderBy(*order, *[c for c in keep if c not in order and c not in within], "_c")
    upto = keyed.withColumn("_r", F.sum("_n").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    first = upto.join(starts, [*within, "_b"]).withColumn("_first", F.col("_start") + F.col("_r"))
    each = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))
    return first.select(*columns(keep), each.alias(out))


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined to one, which has a single row a key, where a few keys may hold most of many.

    The HOT_SHARE most frequent keys beyond HOT_ROWS rows are looked for first: their rows of `one` are
    broadcast, and rows of `many` that have them stay where they are. All others meet by a shuffle, in
    which no key holds more than a thousandth of all rows. Null keys equal each other. `how` is inner,
    left or left_semi. `many` is read twice, so it should be a table.
    """
    same = F.xxhash64(*columns(keys))
    counts = many.groupBy(same.alias("_hot")).agg(F.count(F.lit(1)).alias("_hot_n")).where(F.col("_hot_n") > HOT_ROWS)
    hot = [r["_hot"] for r in counts.orderBy(F.desc("_hot_n")).limit(HOT_SHARE).collect()]
    renamed = [f"_hot_{i}" for i in range(len(keys))]
    right = one.select(*[F.col(k).cast(many.schema[k].dataType).alias(r) for k, r in zip(keys, renamed, strict=True)], *columns([c for c in one.columns if c not in keys]))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        on = reduce(lambda x, y: x & y, [named(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed, strict=True)])
        return a.join(b, on, how).drop(*renamed)

    if not hot:
        return met(many, right)
    few = F.broadcast(right.where(F.xxhash64(*renamed).isin(hot)))  # one row for each of HOT_SHARE keys at most
    return met(many.where(~same.isin(hot)), right).unionByName(met(many.where(same.isin(hot)), few))
