"""Two-pass external shuffle into shards of equal row counts, with DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets that fit a task's
memory and counts each bucket. Pass two permutes every bucket (``shuffle`` is
a Fisher-Yates permutation) and numbers its records after those of the
buckets before it. The shards are even cuts of that global order. Records that
are equal in all columns would share a bucket; those that occur very often are
counted first and dealt out copy by copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import byte_size, free_name, materialize

LAW = "rows"


def record_bytes(text_col: str):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")


def task_memory(spark: SparkSession) -> int:
    """Bytes of heap that one task of an executor (of the driver, for a local master) can count on, from the settings."""
    conf, master = spark.sparkContext.getConf(), spark.sparkContext.master
    local = master.startswith("local") and not master.startswith("local-cluster")
    memory = byte_size(conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g"))
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "0"))
    if master.startswith("local-cluster"):
        cores = int(master[master.index("[") + 1:].split(",")[1])
    return memory // max(1, cores or 4)


def bucket_size(spark: SparkSession) -> int:
    """A sixteenth of a task's memory, 16 MiB to 512 MiB: a bucket is gathered, sorted, permuted and written."""
    return max(16 << 20, min(512 << 20, task_memory(spark) // 16))


COPY_ROWS = 1_000  # equal records from which on they are dealt out one by one


def _records(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(record, h): each record and the hash that its bucket and its place before the permutation depend on.

    A first pass over hashes finds the records with ``COPY_ROWS`` and more equal rows
    (no more than rows / ``COPY_ROWS``). Those are counted and copied back in
    parts of ``COPY_ROWS``, so that no task makes or gets all copies.
    """
    record = F.struct(*docs.columns)
    row_hash = F.xxhash64(*docs.columns)
    own = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    hot = materialize(docs.select(row_hash.alias("hot_hash")).groupBy("hot_hash").agg(F.count(F.lit(1)).alias("n"))
                      .where(F.col("n") >= COPY_ROWS).select("hot_hash"), "hot-records")
    rows = docs.select(record.alias("record"), own.alias("h"), row_hash.alias("row_hash"))
    if hot.isEmpty():
        return rows.select("record", "h")
    marked = rows.join(hot, F.col("row_hash") == F.col("hot_hash"), "left")
    # copies are folded inside the tasks: equal rows cross the shuffle once per task
    counted = marked.where("hot_hash is not null").groupBy("record", "h").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPY_ROWS))))
    parts = parts.repartition("h", "part")
    last = F.least(F.lit(COPY_ROWS).cast("long"), F.col("n") - F.col("part") * COPY_ROWS) - 1
    copies = parts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    copies = copies.select("record", F.xxhash64("h", F.col("part") * COPY_ROWS + F.col("copy")).alias("h"))
    return marked.where("hot_hash is null").select("record", "h").unionByName(copies)


def shard_records(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                  seed: int = 42, bucket_bytes: int | None = None) -> DataFrame:
    """``docs`` in random order, cut into ``shards`` of row counts at most one apart.

    Returns a struct column ``record`` (all columns of ``docs``, so no name
    can clash), ``shard`` (int) and ``slot`` (long, gapless from 0 per
    shard). Buckets are chosen so that one holds about ``bucket_bytes``
    (``bucket_size`` if none is given); a task permutes one bucket at a time. The bucket depends on the seed and the
    record's id and text, so copies under different ids spread evenly and a
    lost task, run again, finds the same records.

    Null and empty texts and null ids are records like others; repeated rows
    are each placed (a record that is repeated ``COPY_ROWS`` times is spread
    over the buckets); fewer rows than shards leave some shards empty; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(record_bytes(text_col))).first()[0] or 0
    n_buckets = max(1, -(-total // (bucket_bytes or bucket_size(spark))))
    records = _records(docs, seed, id_col, text_col)
    numbered = records.withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("int"))
    placed = numbered.select("bucket", F.struct("h", "record").alias("r"))
    # one bucket is one partition: hashing the numbers again would put several into one task
    dealt = placed.repartitionById(n_buckets, "bucket")

    sizes = numbered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket: the running sum sees bucket counts, never records.
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select("bucket", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start")),
                         "bucket-starts")
    rows = starts.agg(F.sum("n")).first()[0] or 0

    permuted = dealt.groupBy("bucket").agg(F.collect_list("r").alias("rs")).sortWithinPartitions("bucket").select(
        "bucket", F.posexplode(F.shuffle(F.array_sort("rs"), seed)).alias("pos", "r"))
    out = permuted.join(starts, "bucket").select(
        F.col("r.record").alias("record"), (F.col("start") + F.col("pos")).alias("place"))
    small, extra = divmod(rows, shards)  # the first `extra` shards hold one record more
    wide = extra * (small + 1)
    late = F.lit(extra) + F.floor((F.col("place") - wide) / max(1, small))
    shard = F.when(F.col("place") < wide, F.floor(F.col("place") / (small + 1))).otherwise(late).cast("int")
    first = F.when(F.col("shard") <= extra, F.col("shard") * (small + 1)).otherwise(
        F.lit(wide) + (F.col("shard") - extra) * small)
    out = out.withColumn("shard", shard)
    return out.select("record", "shard", (F.col("place") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                 seed: int = 42, bucket_bytes: int | None = None) -> DataFrame:
    """Write the shuffled records as Parquet under ``path``/shard=N and read them back.

    The files hold the columns of ``docs`` and ``slot``, the record's place
    in its shard (a longer name if ``docs`` has such a column; the same holds
    for ``shard``). See ``shard_records`` for the order and the edge cases.
    """
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    placed = shard_records(docs, shards, id_col, text_col, seed, bucket_bytes)
    flat = placed.select(*(F.col("record").getField(c).alias(c) for c in docs.columns),
                         F.col("slot").alias(slot), F.col("shard").alias(shard))
    flat.write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(flat.schema).parquet(path)


def shard_manifest(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   seed: int = 42, bucket_bytes: int | None = None) -> DataFrame:
    """Write the shards, then describe each stored record from the files.

    Columns: id, size, text_crc32 (of the UTF-8 text; null: of no bytes),
    law, shard, slot, grown_shard (null: under the ``rows`` law a further
    shard moves rows everywhere).
    """
    stored = write_shards(docs, path, shards, id_col, text_col, seed, bucket_bytes)
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return stored.select(F.col(id_col), record_bytes(text_col).alias("size"), crc.alias("text_crc32"),
                         F.lit(LAW).alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
