"""Reading tables, cutting lineage and ranking rows without gathering a group in one task."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's own checkpoint folder. There has to be one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame) -> DataFrame:
    """`_row`, all columns of docs, and `_at`, the place of each row in its file: the same however often docs is read. What does not come from files is written first."""

    def placed(df: DataFrame) -> DataFrame:
        file = df.metadataColumn("_metadata")
        return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), F.struct(F.xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("row")).alias("_at"))

    try:
        return placed(docs)
    except AnalysisException:
        return placed(written(docs, "rows"))


def chunk_count(spark: SparkSession, docs: DataFrame, text: str = "text", chunk_bytes: int = 16 << 20) -> int:
    """How many chunks of about chunk_bytes of text the documents make."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // chunk_bytes))


def crc32_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of doc_id as decimal text, modulo n (null: as the empty text)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)) % n


def ranked(df: DataFrame, keys: list[str], shard: Column, order: list[Column], rank: str, size: Column | None = None) -> DataFrame:
    """Adds to each row the sum of `size` (1: its rank from 0) over the rows before it in its group of equal keys.

    Rows are ordered by shard, then order. Each shard's rows are summed up first, sums of shards
    are added along the shards, and only the rows of one shard of one group meet in a window:
    however large a group is, it is spread over its shards.
    """
    size = F.lit(1).cast("long") if size is None else size.cast("long")
    df = df.withColumn("_shard", shard).withColumn("_size", size)
    sums = df.groupBy(*keys, "_shard").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_own", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    on = [own[k].eqNullSafe(starts[k]) for k in [*keys, "_shard"]]
    joined = own.join(starts, on, "left")
    return joined.select(*[own[c] for c in df.columns if c not in ("_shard", "_size")], (own["_own"] + starts["_start"]).alias(rank))
