"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash of each row. All rows start in one bucket (no bits). While buckets
hold more bytes than the limit, and only for those buckets, rows are told apart by further bits; a bucket stops at the
first bit count at which it fits. Each round looks BITS bits ahead with one aggregation over the hashes of oversized
buckets, so a directory of depth d takes d / BITS rounds, and a hot bucket never delays the others. The directory is small (its size is
checked before it is broadcast), and a row's hash is a function of the row, so texts are looked up where they are and never shuffled.

The first 64 bits are those of the MD5 hash of id and text. Rows that are equal in both fill a bucket that these can't split: if it is too
large, its rows alone are written with a number each, whose hash gives 64 more bits; a third of the table being one row splits like anything else.
A bucket that holds one row stops, whatever its size: a document is never cut. Defined results: a null text has 0 bytes and a null id is
the empty string; an empty table gives no shard; repeated rows are separate rows. ``shards`` keeps the input's columns, whatever their names, and adds
shard (its bits; '' is a directory of one bucket), shard_depth and shard_bytes; input columns of those names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, own

BITS = 8
WORD_BITS = 64
#: Bytes of text in a shard at most
LIMIT = 1 << 20
#: Directory entries of one round (under 100 bytes each) that are sent to all executors
SENT = 200_000
ADDED = ("shard", "shard_depth", "shard_bytes")
ENTRY = "struct<bits:string,depth:int,size:long>"


def _hash(*parts: Column) -> Column:
    """16 hex digits."""
    return F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, WORD_BITS // 4)


def _leading(h: str, n: int) -> Column:
    """The first n bits of one or two words of hex digits."""
    word = lambda first: F.lpad(F.conv(F.substring(F.col(h), first, WORD_BITS // 4), 16, 2), WORD_BITS, "0")
    return F.substring(word(1) if n <= WORD_BITS else F.concat(word(1), word(1 + WORD_BITS // 4)), 1, n)


def _levels(rows: DataFrame, limit: int, first: int, words: int, scratch: Scratch) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """Rounds from bit first * BITS on: their depth and closed entries (_at, _entry); and the hashes (_h) that all bits leave too large.

    rows: _h and _bytes. With two words no bucket is left: the last bit count takes what comes."""
    open_ = scratch.put(f"open{words}.{first}", rows.groupBy("_h").agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n")))
    levels = []
    for k in range(first, words * WORD_BITS // BITS):
        deepest = BITS * (k + 1)
        at = open_.groupBy(_leading("_h", deepest).alias("_at")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        entry = F.lit(None).cast(ENTRY)
        for d in range(deepest, BITS * k - (k == 0), -1):  # from the deepest up, so that the shallowest bucket that fits wins
            w = Window.partitionBy(F.substring("_at", 1, d))  # at most 2 ** BITS rows
            at = at.withColumn(f"_b{d}", F.sum("b").over(w)).withColumn(f"_n{d}", F.sum("n").over(w))
            fits = (F.col(f"_b{d}") <= limit) | (F.col(f"_n{d}") == 1) | F.lit(d == 2 * WORD_BITS)
            entry = F.when(fits, F.struct(F.substring("_at", 1, d).alias("bits"), F.lit(d).alias("depth"), F.col(f"_b{d}").alias("size")).cast(ENTRY)).otherwise(entry)
        at = scratch.put(f"directory{words}.{k}", at.select("_at", entry.alias("_entry")))
        levels.append((deepest, at.where("_entry is not null")))
        rest = at.where("_entry is null").select("_at")
        if rest.isEmpty():
            return levels, None
        open_ = scratch.put(f"open{words}.{k + 1}", open_.withColumn("_at", _leading("_h", deepest)).join(rest, "_at", "left_semi").drop("_at"))
    return levels, open_.select("_h")


def _looked_up(rows: DataFrame, h: str, entry: str, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows with the entry of their hash; a join for each round, by broadcast if the round's entries are few."""
    columns, found = own(rows), []
    for deepest, at in levels:
        at_name, one = f"{entry}_at{deepest}", f"{entry}_{deepest}"
        at = at.select(F.col("_at").alias(at_name), F.col("_entry").alias(one))
        at = F.broadcast(at) if at.count() <= SENT else at
        rows = rows.join(at, _leading(h, deepest) == F.col(at_name), "left")
        found.append(F.col(one))
    return rows.select(*columns, F.coalesce(*found).alias(entry))


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the shard of each row."""
    scratch, docs = Scratch(docs.sparkSession), docs.drop(*ADDED)
    h, entry = fresh("_h", docs.columns), fresh("_entry", docs.columns)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(h, _hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))
    levels, equal = _levels(rows.select(F.col(h).alias("_h"), F.octet_length(text).cast("long").alias("_bytes")), limit, 0, 1, scratch)
    add = lambda df: df.select(*own(docs), F.col(f"{entry}.bits").alias("shard"), F.col(f"{entry}.depth").alias("shard_depth"), F.col(f"{entry}.size").alias("shard_bytes"))
    if equal is None:
        return add(_looked_up(rows, h, entry, levels))
    equal = equal.withColumnRenamed("_h", h)
    equal = F.broadcast(equal) if equal.count() <= SENT else equal
    number = fresh("_row", rows.columns)
    alike = scratch.put("alike", scratch.numbered_once(rows.join(equal, h, "left_semi"), number))
    alike = alike.withColumn(h, F.concat(F.col(h), _hash(F.col(number).cast("string"))))
    finer, _ = _levels(alike.select(F.col(h).alias("_h"), F.octet_length(text).cast("long").alias("_bytes")), limit, WORD_BITS // BITS, 2, scratch)
    return add(_looked_up(rows.join(equal, h, "left_anti"), h, entry, levels)).unionByName(add(_looked_up(alike.drop(number), h, entry, finer)))


def assignment(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes and ADDED, without the text."""
    placed = shards(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), limit, "_id", "_text")
    return placed.select(F.col("_id").alias(id_col), F.octet_length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_bytes"), *ADDED)
