"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters whole records into buckets that fit in memory, by a seeded
hash of the record; Spark's exchange holds the buckets on disk.  Pass two takes
one bucket at a time, brings it into a fixed order, shuffles it by Fisher-Yates
with a generator seeded by the bucket, and hands it on.  Bucket after bucket is
then one random order of all records, cut into shards whose counts differ by
one at most.  The same seed gives the same shards whatever the partitioning,
also when tasks run again.

Identical records are interchangeable.  Where a hash range holds more than its
share, its equal records are counted and dealt out anew by a number each, so
that a record repeated in a third of all rows spreads over all buckets.

Defined cases: nulls hash like values; an empty table gives no rows; columns
named ``shard`` or ``slot`` in the input are replaced, other names don't
matter; a text of any length is one record, and a bucket holds one at least.
Records with maps, which can't be compared, keep their first hash.  From
``bucket_bytes * 2**20`` bytes (24 TB) on buckets grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches


#: Raw bytes of text a bucket holds on average.
BUCKET_BYTES = 24 << 20

#: Copies of a record that one row stands for on the way to the tasks that make them.
COPIES = 1024

_HASH, _BUCKET = "__shuffle_hash", "__shuffle_bucket"


def _fine(hashed: DataFrame, bits: int, size: str) -> list:
    """Rows and bytes by the hash's leading bits: at most ``2**bits`` rows come back, whatever the input."""
    return hashed.groupBy(F.shiftrightunsigned(_HASH, 64 - bits).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(size), F.lit(0)) + 64).alias("bytes")).collect()


def _dealt(hashed: DataFrame, bits: int, full: list[int], names: list[str]) -> DataFrame:
    """``hashed`` with new hashes for the rows of the ranges ``full``: equal rows are counted, and each copy gets a hash of its own."""
    ranges = F.broadcast(hashed.sparkSession.createDataFrame([(b,) for b in full], "__range long"))  # 2**bits rows at most
    mine = F.shiftrightunsigned(_HASH, 64 - bits) == F.col("__range")
    one = hashed.join(ranges, mine, "left_semi").groupBy(_HASH, *(F.col(f"`{c}`") for c in names)).agg(F.count(F.lit(1)).alias("__copies"))
    packs = one.withColumn("__pack", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / COPIES)))).repartition(_HASH, "__pack")
    last = F.least(F.col("__copies"), (F.col("__pack") + 1) * COPIES) - 1
    each = packs.withColumn("__copy", F.explode(F.sequence(F.col("__pack") * COPIES, last)))
    again = each.select(*(F.col(f"`{c}`") for c in names), F.xxhash64(_HASH, "__copy").alias(_HASH))
    return hashed.join(ranges, mine, "left_anti").unionByName(again)


def shuffle(df: DataFrame, shards: int = 8, seed: int = 17, size: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0), in shuffled order within buckets.

    ``size`` names the column that dominates a record's size.  Runs one
    counting job over the table before it returns.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    small_batches(df.sparkSession)
    df = df.drop("shard", "slot")
    keys = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    hashed = df.withColumn(_HASH, F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in keys)))
    bits = 10
    while True:
        rows = _fine(hashed, bits, size)
        total_bytes = sum(r.bytes for r in rows)
        need = max(1, -(-total_bytes // bucket_bytes))
        if need <= 1 << bits or bits >= 20:
            break
        bits = min(20, max(bits + 1, int(need - 1).bit_length()))
    if need > 1 and len(keys) == len(df.columns):
        full = [r.b for r in rows if r.bytes > max(bucket_bytes / 2, 2 * total_bytes / (1 << bits))]
        if full:
            hashed = _dealt(hashed, bits, full, df.columns)
            rows = _fine(hashed, bits, size)
    buckets = min(need, 1 << bits)
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[(r.b * buckets) >> bits] += r.n
    total = int(counts.sum())
    offsets = df.sparkSession.sparkContext.broadcast(np.concatenate([[0], counts.cumsum()]))
    bucket = F.shiftright(F.shiftrightunsigned(_HASH, 64 - bits) * buckets, bits).cast("int")
    scattered = hashed.withColumn(_BUCKET, bucket).repartitionById(buckets, F.col(_BUCKET))
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(_BUCKET).to_numpy()
            for b in np.unique(ids):
                held.setdefault(int(b), []).append(batch if (ids == b).all() else batch.filter(pa.array(ids == b)))
        for b in sorted(held):
            whole = pa.Table.from_batches(held.pop(b))
            order = np.argsort(whole.column(_HASH).to_numpy(), kind="stable")
            np.random.Generator(np.random.PCG64([seed, b])).shuffle(order)  # Fisher-Yates
            rank = offsets.value[b] + np.arange(len(order))
            shard = rank * shards // max(1, total)
            slot = rank - -(-shard * total // shards)
            step = max(1, len(order) * (8 << 20) // max(1, whole.nbytes))
            for i in range(0, len(order), step):
                part = whole.take(pa.array(order[i : i + step])).select(names)
                part = part.append_column("shard", pa.array(shard[i : i + step], pa.int32())).append_column("slot", pa.array(slot[i : i + step], pa.int64()))
                yield from part.combine_chunks().to_batches()

    return scattered.mapInArrow(run, schema)


def write_shards(df: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Shuffles ``df`` and writes folders ``shard=K``, whose files in name order hold the slots in order."""
    done = shuffle(df, shards, **options)
    done.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


