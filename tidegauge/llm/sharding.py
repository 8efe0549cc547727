"""Extendible hashing: shards are hash prefixes, and only a shard over its byte limit is split on another bit.

The directory is found top-down on sums by prefix, never on the documents themselves: documents are summed once by a
prefix deep enough for most shards, the levels above are rolled up from these sums, and a shard is the shortest prefix
that fits. What still does not fit goes on with the next bits. One key that alone is over the limit stays a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import cut_lineage, fresh_names, table

SHARD_BYTES = 1 << 20
#: Bits of hash in all, and how many a round looks at most.
HASH_BITS = 56
ROUND_BITS = 20


def hash_bits(doc_id: Column) -> Column:
    """The first HASH_BITS bits of the md5 of the doc_id as text (null as an empty text)."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _prefix(h: Column, bits: int, depth: Column) -> Column:
    """The first depth of a number's bits."""
    return F.call_function("shiftrightunsigned", h, (F.lit(bits) - depth).cast("int"))


def directory(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(depth, prefix, n_docs, n_bytes) of each shard; prefix holds the first depth bits as a number."""
    keys = docs.select(hash_bits(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    sums = keys.groupBy("h").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
    sums = cut_lineage(sums)
    total = sums.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return sums.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "n_docs", "n_bytes").limit(0)
    found, low = None, 0
    while True:
        # A few bits more than even hashing needs; the last round takes whatever is left.
        want = math.ceil(math.log2(max(1, total / shard_bytes))) + 3
        high = min(HASH_BITS, low + max(1, min(ROUND_BITS, want - low if low == 0 else 8)))
        cells = sums.groupBy(_prefix(F.col("h"), HASH_BITS, F.lit(high)).alias("cell")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
        levels = cells.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "cell", "n_docs", "n_bytes")
        at = _prefix(F.col("cell"), high, F.col("depth"))
        tree = levels.groupBy("depth", at.alias("prefix")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
        tree = cut_lineage(tree)
        over = tree.filter((F.col("n_bytes") > shard_bytes) & (F.col("depth") < HASH_BITS)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = tree.filter((F.col("n_bytes") <= shard_bytes) | (F.col("depth") == HASH_BITS))
        # A prefix is a shard if it fits and what it was split from does not.
        child = fits.filter(F.col("depth") > low).withColumn("parent", F.shiftright("prefix", 1))
        leaves = child.join(over, ["depth", "parent"], "left_semi").select("depth", "prefix", "n_docs", "n_bytes")
        if low == 0:
            leaves = leaves.unionByName(fits.filter("depth = 0").select("depth", "prefix", "n_docs", "n_bytes"))
        found = leaves if found is None else found.unionByName(leaves)
        open_cells = over.filter(F.col("depth") == high + 1).select(F.col("parent").alias("cell"))
        if high == HASH_BITS or open_cells.isEmpty():
            return found
        sums = cut_lineage(sums.join(open_cells, _prefix(F.col("h"), HASH_BITS, F.lit(high)) == F.col("cell"), "left_semi"))
        low = high


def assign(docs: DataFrame, shards: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs with depth and shard, the shard's bits as text ('' for the only one); names that columns hold
    already get underscores after. Each document meets the depths that the directory has (at most HASH_BITS) and finds
    the one prefix that is a shard. Rows with one doc_id share a shard."""
    names = fresh_names(columns, "depth", "shard")
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())
    hashed, depth, prefix = fresh_names(docs.columns, "__h", "__depth", "__prefix")
    rows = docs.withColumn(hashed, hash_bits(F.col("doc_id")))
    tries = rows.withColumn(depth, F.explode(F.array(*[F.lit(d) for d in depths] or [F.lit(0)])))
    tries = tries.withColumn(prefix, _prefix(F.col(hashed), HASH_BITS, F.col(depth)))
    own = shards.select(F.col("depth").alias(depth), F.col("prefix").alias(prefix))
    bits = F.when(F.col(depth) == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col(prefix).cast("string"), 10, 2), F.col(depth), F.lit("0")))
    return tries.join(own, [depth, prefix]).select(*columns, F.col(depth).alias(names[0]), bits.alias(names[1]))


def write_shards(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """One folder of Parquet a shard, dealt by shard so that each is written by one task. The folders' column is shard,
    with underscores after where docs has one of that name; all columns of docs are kept."""
    depth, shard = fresh_names(docs.columns, "depth", "shard")
    placed = assign(docs, directory(docs, shard_bytes), docs.columns)
    placed.drop(depth).repartition(shard).write.partitionBy(shard).parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, with the bytes of its text and of its shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return assign(sized, directory(docs), ["doc_id", "n_bytes"])


#: Levels by brute force: every prefix of every document, and for each document the shortest that fits.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}) AS BIGINT) AS h
  FROM documents),
levels AS (SELECT doc_id, n_bytes, h, depth, h >> ({HASH_BITS} - depth) AS prefix
           FROM d, (SELECT unnest(generate_series(0, {HASH_BITS})) AS depth)),
sums AS (SELECT depth, prefix, sum(n_bytes) AS total FROM levels GROUP BY ALL),
best AS (SELECT doc_id, n_bytes, h, min(depth) AS depth
         FROM levels JOIN sums USING (depth, prefix)
         WHERE total <= {SHARD_BYTES} OR depth = {HASH_BITS} GROUP BY ALL)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth,
       CASE WHEN depth = 0 THEN '' ELSE lpad(to_base(h >> ({HASH_BITS} - depth), 2), CAST(depth AS INTEGER), '0') END AS shard
FROM best
"""
