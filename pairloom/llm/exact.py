"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Each step counts rows by a key that the step before left open, so a text is hashed in full only
if another one has its length and its first ``PREFIX`` characters:

1. bytes of the text;
2. bytes and a hash of the prefix, for rows whose length occurs twice;
3. bytes and SHA-256 of the whole text, for rows whose pair of step 2 occurs twice.

What a step found goes to the next scan as a bitmap of ``BITS`` hash places (native bitmap
aggregates, a fixed 2 MB whatever the input), so the texts are never shuffled to find out; a
false hit only costs one more hash. Counts combine before the shuffle, so a group with a third
of all rows is one row per task. Rows that drop out of the refinement are not joined at all.

Null text counts as empty. Of equal texts the row with the largest doc_id stays (null is the
smallest); of repeated rows with that doc_id exactly one stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import common

PREFIX = 64
BITS = 1 << 24
#: Keys over which a group's rows are dealt for a join.
SALTS = 8


def bitmap(keys: DataFrame, place: Column) -> DataFrame:
    """Rows (_bucket, _bits) with one bit set for each place in [0, BITS); at most 512 rows."""
    at = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_at"))
    return at.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def with_hit(rows: DataFrame, place: Column, bits: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean: is the row's place set in the bitmap? Rows keep their order."""
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_bucket"), "left")
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(name))


def _place(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS))


def refine(rows: DataFrame) -> DataFrame:
    """``rows`` (with _text) and _sha: the full hash where the refinement needs it, else null."""
    rows = rows.withColumn("_bytes", F.octet_length("_text"))
    by_length = rows.groupBy("_bytes").agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = with_hit(rows, _place(F.col("_bytes")), bitmap(by_length, _place(F.col("_bytes"))), "_same_length")
    prefix = F.xxhash64(F.substring("_text", 1, PREFIX))
    by_prefix = (rows.filter("_same_length").select("_bytes", prefix.alias("_prefix"))
                 .groupBy("_bytes", "_prefix").agg(F.count("*").alias("_n")).filter("_n > 1"))
    place = _place(F.col("_bytes"), F.when(F.col("_same_length"), prefix))
    found = bitmap(by_prefix, _place(F.col("_bytes"), F.col("_prefix")))
    rows = with_hit(rows, place, found, "_open")
    return rows.withColumn("_sha", F.when(F.col("_open"), F.sha2(F.col("_text"), 256)))


def join_salted(rows: DataFrame, groups: DataFrame, keys: list[str], by: Column,
                how: str = "inner") -> DataFrame:
    """Rows with their group's columns; a hot group's rows are dealt over ``SALTS`` keys, and
    adaptive execution can split those further.
    """
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how)


def decide(keys: DataFrame) -> DataFrame:
    """Decisions on staged rows (doc_id, _uid, _bytes, _sha): keep_id, group_size, kept."""
    alone = keys.filter(F.col("_sha").isNull()).select(
        *keys.columns, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    several = keys.filter(F.col("_sha").isNotNull())
    groups = several.groupBy("_bytes", "_sha").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "_uid")).alias("_keep"))
    held = join_salted(several, groups, ["_bytes", "_sha"], F.col("_uid")).select(
        *keys.columns, F.col("_keep.doc_id").alias("keep_id"), "group_size",
        (F.col("_uid") == F.col("_keep._uid")).alias("kept"))
    return alone.unionByName(held)


def duplicates(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One narrow row per row of ``docs``: doc_id, keep_id, group_size, kept.

    ``digest`` adds text_sha256 for every row, computed in the same scan.
    """
    rows = refine(docs.select("doc_id", common.text_or_empty().alias("_text")))
    extra = [F.sha2(F.col("_text"), 256).alias("text_sha256")] if digest else []
    keys = common.stage(rows.select(
        "doc_id", F.monotonically_increasing_id().alias("_uid"), "_bytes", "_sha", *extra), "exact-keys")
    return decide(keys).select("doc_id", "keep_id", "group_size", "kept", *(["text_sha256"] if digest else []))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the duplicates, its columns unchanged.

    Rows that no other row can equal pass without a shuffle; only the others are joined.
    """
    rows = refine(docs.select(common.pack_row(docs), F.col("doc_id"), common.text_or_empty().alias("_text")))
    single = rows.filter(F.col("_sha").isNull()).select("_row.*")
    several = rows.filter(F.col("_sha").isNotNull())
    groups = several.groupBy("_bytes", "_sha").agg(F.max("doc_id").alias("_keep"))
    mine = join_salted(several, groups, ["_bytes", "_sha"], F.xxhash64("doc_id")).filter(
        F.col("doc_id").eqNullSafe(F.col("_keep")))
    # Repeated rows of the doc_id that stays: one of them, picked with partial aggregates.
    one = mine.groupBy("_bytes", "_sha").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(one)


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(common.read_table(spark, sf_dir, "documents"), digest=True)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
