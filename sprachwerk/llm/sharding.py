"""Sharding by a K-d tree over document metadata, with DataFrame functions alone.

The rows of the tree are groups of equal texts, each as heavy as its documents together. A node is cut
at the weighted median along its widest dimension. The median is found by radix descent: a histogram
over sixteen bits of the key, then over the next sixteen inside the bin that holds the median, for all
nodes of a level together. Keys end in bits of the text's hash, so one value that a third of all rows
share is cut as finely as any other. Nodes, bins and thresholds stay in tables: the driver learns only
how many nodes are still open, so a tree of a hundred thousand leaves is planned like one of sixteen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sprachwerk.llm.common import columns, discard, gapless, join_hot, table, written

SHARDS = 16
#: Bytes of a shard if neither their number nor their size is asked for.
TARGET_BYTES = 1 << 30
#: Bits of a key: a metadata value, then the text's hash.
VALUE_BITS, HASH_BITS, STEP_BITS = 20, 40, 16
DIMENSIONS = ("m1", "m2", "m3", "m4")
#: A level of at most so many nodes is broadcast, a few MB; of more, none is hot, and it is joined by a shuffle.
FEW_NODES = 1 << 16
#: A median is near enough when its bin holds this share of the node.
NEAR = 1e-4


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _text_key(text: Column) -> Column:
    return F.xxhash64(text.isNull(), text)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the text's key h and the four dimensions of each row."""
    own = docs.columns
    # the first three bytes, so that every language tag fits the key
    lang = F.conv(F.hex(F.substring(F.col("lang").cast("string").cast("binary"), 1, 3)), 16, 10).cast("double") if "lang" in own else F.lit(0.0)
    source = F.crc32(F.col("source").cast("string").cast("binary")).cast("double") if "source" in own else F.lit(0.0)
    text = F.col("text")
    return docs.select(
        "doc_id", _size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _text_key(text).alias("h"), lang.alias("m1"), source.alias("m2"), F.log2(_size(text).cast("double")).alias("m3"), F.col("doc_id").cast("double").alias("m4")
    )


def _groups(rows: DataFrame) -> DataFrame:
    """Equal texts as one row: key h, weight w and the dimensions as keys of 60 bits."""
    own = written(rows.groupBy("h").agg(F.sum("size").alias("w"), F.min("m1").alias("m1"), F.min("m2").alias("m2"), F.max("m3").alias("m3"), F.min("m4").alias("m4")), "shard-groups")
    edge = own.agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max)]).first()
    tail = F.expr(f"h & {(1 << HASH_BITS) - 1}L")
    keys = []
    for c in DIMENSIONS:
        low, high = edge[f"min_{c}"] or 0.0, edge[f"max_{c}"] or 0.0
        value = F.floor((F.coalesce(F.col(c).cast("double"), F.lit(low)) - low) * (((1 << VALUE_BITS) - 1) / (high - low))) if high > low else F.lit(0)
        keys.append(F.shiftleft(value.cast("long"), HASH_BITS).bitwiseOR(tail))
    out = written(own.select("h", "w", F.array(*keys).alias("keys")), "shard-keys")
    discard(own)
    return out


def _cuts(nodes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, dim, threshold) for each of at most `most` nodes that has more than one leaf, and the tables behind it."""
    total_bits = VALUE_BITS + HASH_BITS
    value = lambda d: F.shiftright(F.col("keys")[d], HASH_BITS)
    edges = [f(value(d)).alias(f"{f.__name__}{d}") for d in range(len(DIMENSIONS)) for f in (F.min, F.max)]
    stats = nodes.where("leaves > 1").groupBy("node", "leaves").agg(F.sum("w").alias("weight"), *edges)
    widest = F.array_max(F.array(*[F.struct((F.col(f"max{d}") - F.col(f"min{d}")).alias("width"), F.lit(-d).alias("dim")) for d in range(len(DIMENSIONS))]))
    left = F.col("weight") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    open_ = stats.select("node", (-widest["dim"]).alias("dim"), left.alias("want"), "weight", F.lit(0).cast("long").alias("prefix"))
    held, done, bits, left_open = [], [], 0, 1
    while bits < total_bits and left_open:
        step = min(STEP_BITS, total_bits - bits)
        key = F.element_at("keys", F.col("dim") + 1)
        met = nodes.select("node", "w", "keys").join(F.broadcast(open_) if most <= FEW_NODES else open_, "node")
        if bits:
            met = met.where(F.shiftright(key, total_bits - bits) == F.col("prefix"))
        bits += step
        bins = met.groupBy("node", "dim", "want", "weight", F.shiftright(key, total_bits - bits).alias("bin")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("w").over(W.partitionBy("node").orderBy("bin"))  # a row a bin, 65,536 at most
        hit = bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("w")).where((F.col("upto") >= F.col("want")) & (F.col("before") < F.col("want")))
        near = (F.col("n") == 1) | (F.col("w") <= NEAR * F.col("weight")) | F.lit(bits == total_bits)
        seen = Observation()
        told = written(hit.withColumn("near", near).observe(seen, F.count_if(~F.col("near")).alias("open")), "shard-bins")
        left_open = seen.get["open"]
        held.append(told)
        over = (F.col("upto") - F.col("want") < F.col("want") - F.col("before")).cast("long")  # the bin's far edge is the nearer one
        done.append(told.where("near").select("node", "dim", F.shiftleft(F.col("bin") + over, total_bits - bits).alias("threshold")))
        open_ = told.where("NOT near").select("node", "dim", (F.col("want") - F.col("before")).alias("want"), "weight", F.col("bin").alias("prefix"))
    return reduce(DataFrame.union, done), held


def place(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(h, shard) for each different text of rows(h, size, m1 … m4)."""
    groups = _groups(rows)
    if shards is None:
        total = groups.agg(F.sum("w")).first()[0] or 0
        shards = max(1, -(-total // (target_bytes or TARGET_BYTES)))
    nodes = groups.withColumns({"node": F.lit(1).cast("long"), "leaves": F.lit(shards).cast("long"), "first": F.lit(0).cast("long")})
    behind = groups
    for level in range((shards - 1).bit_length()):
        cuts, held = _cuts(nodes, 1 << level)
        right = F.coalesce(F.element_at("keys", F.col("dim") + 1) >= F.col("threshold"), F.lit(False))
        half = F.floor(F.col("leaves") / 2)
        met = nodes.join(F.broadcast(cuts) if 1 << level <= FEW_NODES else cuts, "node", "left").withColumn("right", right)
        many = F.col("leaves") > 1
        leaves = F.when(many & F.col("right"), F.col("leaves") - half).when(many, half).otherwise(F.col("leaves"))
        first = F.when(many & F.col("right"), F.col("first") + half).otherwise(F.col("first"))
        cut = written(met.select("h", "w", "keys", (F.col("node") * 2 + F.col("right").cast("long")).alias("node"), leaves.alias("leaves"), first.alias("first")), "shard-level")
        discard(behind, *held)
        nodes = behind = cut
    return nodes.select("h", F.col("first").cast("int").alias("shard"))


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Each row's shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Give the number of shards, or the bytes that a shard should have. The law is `bytes`: shards are
    near equal in bytes, and rows of equal text share a shard, as do all rows of null text, which has
    no checksum and size 1. lang, source and n_chars steer the cuts where docs has them; nulls in them
    count as least, and any text may stand in them. Ties on a dimension go by the text's hash. Repeated
    rows each get a slot; slots are gapless from 0 in each shard. Other columns are left out. An empty
    table gives no rows. A text that outweighs a shard makes that shard larger, and others may stay empty.
    """
    rows = written(_rows(docs), "shard-rows")
    placed = join_hot(rows.select("doc_id", "size", "text_crc32", "h"), place(rows, shards, target_bytes), ["h"]).drop("h")
    out = gapless(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None) -> None:
    """docs as Parquet folders shard=0, shard=1, …, every row exactly once, whatever its id.

    Rows find their shard by their text, as in `assign`; all columns are written but one that is called
    `shard`, which the folders stand for. A shard is as many files as its size asks for. A rerun
    overwrites whole.
    """
    rows = written(_rows(docs), "shard-rows")
    placed = place(rows, shards, target_bytes).select(F.col("h").alias("_sw_h"), F.col("shard").alias("_sw_shard"))
    keyed = docs.select(*columns([c for c in docs.columns if c.lower() != "shard"]), _text_key(F.col("text")).alias("_sw_h"))
    out = join_hot(keyed, placed, ["_sw_h"]).drop("_sw_h").withColumnRenamed("_sw_shard", "shard")
    out.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    discard(rows)


def op1_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in one of sixteen shards, over the whole table; edge cases as in `assign`."""
    return assign(table(spark, sf_dir, "documents"), SHARDS)
