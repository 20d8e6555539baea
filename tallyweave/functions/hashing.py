"""Hash columns in exact arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis of the 64-bit FNV-1a hash in two halves, and its prime 2**40 + 435.
FNV_HIGH, FNV_LOW, FNV_PRIME_LOW = 3421674724, 2216829733, 435
# A multiplicative hash whose top three bits choose the fold.
FOLD_FACTOR, FOLD_SHIFT = 11400714819323198485, 61
MASK = (1 << 32) - 1


def fnv1a64_mod(s: Column, m: int) -> Column:
    """fnv1a64(s) % m for ASCII text, kept in two 32-bit halves."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)
    start = F.struct(F.lit(FNV_HIGH).cast("long").alias("hi"), F.lit(FNV_LOW).cast("long").alias("lo"))

    def step(a: Column, b: Column) -> Column:
        x = a["lo"].bitwiseXOR(b.cast("long"))
        y = x * FNV_PRIME_LOW
        return F.struct((a["hi"] * FNV_PRIME_LOW + F.shiftleft(x, 8) + F.shiftright(y, 32)).bitwiseAND(F.lit(MASK)).alias("hi"), y.bitwiseAND(F.lit(MASK)).alias("lo"))

    return F.aggregate(codes, start, step, lambda a: ((a["hi"] % m) * ((1 << 32) % m) + a["lo"] % m) % m)


def id_key(entity_id: Column) -> Column:
    """Number and source of an id such as S2-637: number * 4 + source."""
    return F.substring(entity_id, 4, 20).cast("long") * 4 + F.substring(entity_id, 2, 1).cast("int")


def fold_of(key: Column) -> Column:
    """One of five folds; only eight hash values exist, so folds 0-2 take a quarter and 3-4 an eighth each."""
    dec = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    top = (key.cast("decimal(10,0)") * dec(FOLD_FACTOR)) % dec(1 << 64)
    return (F.floor(top / dec(1 << FOLD_SHIFT)) % 5).cast("int")
