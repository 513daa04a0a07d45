"""A landing table: rows arrive in batches, each key once, and a repeated landing changes nothing.

``root/data/batch=<name>`` holds the rows of a batch, ``root/manifest/batch=<name>`` one row about
it, written when the data is complete. Readers see the batches that the manifest lists, so a
landing that broke off half-way is invisible. A batch is named after its content (an order-free
digest of its rows): landing the same rows again writes over what the broken run left. The
manifest's date ranges and ticker bitmaps say which batches can hold an incoming key; the anti
join reads the key columns of those alone.

Of several incoming rows of a key the last counts (``ord``, or any where rows are equal). Rows
with a null key column never land. An empty landing writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import latest

#: Places of a batch's ticker bitmap.
PLACES = 1 << 15


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _place():
    return F.pmod(F.xxhash64("ticker"), F.lit(PLACES))


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per complete batch: batch, rows, first and last date, tickers (a bitmap); None before the first."""
    path = f"{root}/manifest"
    return spark.read.parquet(path) if _exists(spark, path) else None


def landed(spark: SparkSession, root: str, schema, batches: list[str] | None = None) -> DataFrame:
    """Rows of all complete batches, or of those named."""
    if batches is None:
        listed = manifest(spark, root)
        batches = [r["batch"] for r in listed.select("batch").collect()] if listed is not None else []
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/batch={b}" for b in sorted(batches)])


def touched(incoming: DataFrame, root: str) -> list[str]:
    """Names of the batches that may hold a key of ``incoming``, by dates and ticker bitmaps."""
    spark = incoming.sparkSession
    listed = manifest(spark, root)
    if listed is None:
        return []
    bounds = incoming.agg(F.min("date").alias("lo"), F.max("date").alias("hi"),
                          F.bitmap_construct_agg(F.bitmap_bit_position(_place())).alias("seen"))
    near = listed.join(F.broadcast(bounds), (F.col("first") <= F.col("hi")) & (F.col("last") >= F.col("lo")))  # one row
    # Two bitmaps of 4 KB share a bit if some byte of one and the other does.
    rows = near.select("batch", "tickers", "seen").collect()
    return [r["batch"] for r in rows
            if int.from_bytes(r["tickers"], "little") & int.from_bytes(r["seen"], "little")]


def land(incoming: DataFrame, root: str) -> DataFrame:
    """Append the rows whose (ticker, date) has not landed; the table after it."""
    spark = incoming.sparkSession
    rows = latest(incoming.dropna(subset=["ticker", "date"]), ["ticker", "date"], "ord" not in incoming.columns, "landing")
    rows = rows.drop("ord")
    if "ord" not in incoming.columns:
        rows = rows.dropDuplicates(["ticker", "date"])
    before = landed(spark, root, rows.schema, touched(rows, root))
    fresh = rows.join(before.select("ticker", "date"), ["ticker", "date"], "left_anti").select(*rows.columns)
    about = fresh.agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.sum(F.xxhash64(*fresh.columns).cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64(*fresh.columns[::-1])).alias("mix"),
        F.bitmap_construct_agg(F.bitmap_bit_position(_place())).alias("tickers"))
    about = about.withColumn("batch", F.substring(F.sha2(F.concat_ws(":", "rows", "sum", "mix"), 256), 1, 20))
    told = about.first()
    if told["rows"]:
        fresh.write.mode("overwrite").parquet(f"{root}/data/batch={told['batch']}")
        kept = spark.createDataFrame([(told["rows"], told["first"], told["last"], bytes(told["tickers"]))],
                                     "rows long, first date, last date, tickers binary")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch={told['batch']}")
    return landed(spark, root, rows.schema)
