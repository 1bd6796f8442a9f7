"""Weighted rendezvous hashing: a record's shard follows from its key and the shards alone.

Every shard draws ``u = hash(shard, key)`` in (0, 1) and bids ``weight / -ln(u)``; the highest bid has the record.
A shard's share is its weight's share of all. A bid never depends on the other shards, so a new shard takes
records only into itself and a removed one gives away only its own: no other record moves. The assignment is a
column expression: no shuffle, no table of keys, nothing to keep in step between runs.

:func:`shard_slots` numbers the records of each shard without a gap. Rows (key, size, checksum) are counted first
(partly before their exchange), so a key that holds a third of all rows is one row with a count; counts over
:data:`COPIES` are cut into runs. A run falls into one of 4,096 buckets of its shard by a hash of its content, each
bucket numbers its own runs, and the counts of the buckets before it (a table of at most 4,096 rows a shard) are
added. So no task holds a whole shard, and the slots do not depend on partitions or order.

Defined cases: a null key is the empty key text; a null text has size 1 and checksum 0; rows with an equal key go to one
shard (the law ``key``), equal texts with other keys need not; equal rows take neighbouring slots, which of them has
which does not show; an empty table gives an empty table; other columns are ignored by the slots and kept by
:func:`assign_shards`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.columns import fresh
from patchloom.storage import materialize

#: Copies of a row that one run holds at most.
COPIES = 4096


def _text(key: str | Column) -> Column:
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))


def bid(key: Column, shard: Column, weight: Column) -> Column:
    """What ``shard`` bids for a key: 52 bits of the MD5 of ``shard:key`` as u, then weight / -ln(u)."""
    draw = F.conv(F.substring(F.md5(F.concat(shard.cast("string"), F.lit(":"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return weight / -F.log((draw + 0.5) / float(1 << 52))


def best_bid(key: Column, weights: Sequence[float]) -> Column:
    """Struct ``bid, other`` of the winning shard, ``other`` being minus its number; equal bids go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, at least one")
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.array_max(F.transform(shards, lambda s: F.struct(bid(key, s["i"], s["w"]).alias("bid"), (-s["i"]).alias("other"))))


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 8, name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row, an int from 0."""
    return df.withColumn(name, -best_bid(_text(key), weights)["other"])


def shard_slots(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, new_weight: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1; ``slot`` counts from 0 inside the shard; ``grown_shard`` is the shard
    once there is one more, of weight ``new_weight``."""
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.cast("long").alias("text_crc32"))
    counted = materialize(own.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "shard-rows")
    key, last = _text("doc_id"), F.lit(len(weights))
    placed = counted.withColumn("best", best_bid(key, weights)).withColumn("shard", -F.col("best.other"))
    placed = placed.withColumn("grown_shard", F.when(bid(key, last, F.lit(float(new_weight))) > F.col("best.bid"), last).otherwise(F.col("shard")))
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    runs = runs.withColumn("length", F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("run") * COPIES))
    runs = runs.withColumn("bucket", F.substring(F.md5(F.concat_ws(":", F.lit("slot"), key, "size", "text_crc32", "run").cast("binary")), 1, 3)).drop("best", "copies")
    totals = runs.groupBy(F.col("shard").alias("s"), F.col("bucket").alias("b")).agg(F.sum("length").alias("rows"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("s", "b", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "run").rowsBetween(Window.unboundedPreceding, -1)
    numbered = runs.join(offsets, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    numbered = numbered.withColumn("start", F.col("offset") + F.coalesce(F.sum("length").over(inside), F.lit(0)))
    slots = numbered.withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 8, files: int = 16) -> None:
    """Writes ``docs`` as Parquet under ``path/shard=0, 1, ...``, each shard in about ``files`` files.

    Rows are dealt by shard and a hash of the whole row, so the rows of one key share no task unless they are equal."""
    shard, = fresh(docs, "shard")
    placed = assign_shards(docs, key, weights, shard)
    dealt = placed.repartition(len(weights) * files, F.col(shard), F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    dealt.write.partitionBy(shard).parquet(path)


def moved(df: DataFrame, old: Sequence[float], new: Sequence[float], key: str = "doc_id") -> DataFrame:
    """``old_shard, new_shard, rows`` of the rows whose shard differs between two lists of weights."""
    both = df.select((-best_bid(_text(key), old)["other"]).alias("old_shard"), (-best_bid(_text(key), new)["other"]).alias("new_shard"))
    return both.where("old_shard <> new_shard").groupBy("old_shard", "new_shard").agg(F.count("*").alias("rows"))


def crc32_sql() -> str:
    """A CTE with the 256 remainders of CRC-32, made from its polynomial, for :func:`crc32_of`."""
    return """crc_table AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""


def crc32_of(text: str) -> str:
    """DuckDB expression over ``crc_table``: the unsigned CRC-32 of a text's UTF-8 bytes."""
    as_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {as_bytes}), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295::BIGINT)"


def oracle() -> str:
    draw = "(('0x' || substr(md5(i || ':' || k), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
    return f"""
WITH {crc32_sql()},
own AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(octet_length(encode(text)), 0) + 1 AS size, {crc32_of("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) AS copy FROM own),
bids AS (SELECT k, i, 1.0 / -ln({draw}) AS bid FROM (SELECT DISTINCT k FROM own), range(9) r(i)),
best AS (SELECT k, arg_max(i, bid) FILTER (i < 8) AS shard, arg_max(i, bid) AS grown_shard FROM bids GROUP BY k),
rows AS (SELECT n.*, shard, grown_shard, copy // 4096 AS run, substr(md5('slot:' || n.k || ':' || size || ':' || text_crc32 || ':' || (copy // 4096)), 1, 3) AS bucket FROM numbered n JOIN best b ON n.k = b.k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32, run, copy) - 1 AS slot, grown_shard::INT AS grown_shard
FROM rows"""
