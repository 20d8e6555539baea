"""Removal of long repeated substrings: suffix arrays over shards, each built by induced sorting.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus (the same document included).
Shorter repeated strings, of ``passage`` bytes, are reported by the same search and not removed.

Strings of both sizes are searched alike, each with windows of its own size:

1. Owners. Every window of ``size`` bytes is owned by the lowest hash of ``gram`` bytes inside it (the first of equal ones). Equal windows own equal
   grams at equal places. Neighbouring windows with one owner make a run, cut where the gram's place in the window passes a multiple of
   a width, so that all windows of a run hold a common core: the bytes around the gram that every such window has. Runs whose cores
   (by hash) differ have no equal windows. A run's context is the bytes of its windows.
2. Cores that occur once end here. Equal contexts (by hash and extent) are repeated as a whole. Where a core has two or more different
   contexts, one of each is sent to the shard of the core.
3. A shard lays its contexts out as one string and builds its suffix array and permuted common prefixes; starts that share ``size`` bytes
   with another start are repeated.
4. A core with more than HOT_BYTES of different contexts (a passage within a third of all documents, differing in what surrounds it) would
   not fit one task: its runs are cut to the next of WIDTHS, which makes cores longer, and dealt anew. At width 1 a context is one window.
5. Documents of ``length`` bytes or more with an equal text elsewhere go whole; one of each class stays in the search as a partner. The repeated byte
   ranges of the others are merged and cut out.

Defined results: a null or empty text has 0 bytes, nothing removed, and the hash of the empty string; ``n_spans`` counts maximal removed
runs; repeated rows are copies of each other; offsets are UTF-8 bytes, so what is left need not be
valid UTF-8 (``cleaned`` drops broken characters at the cuts); very long texts are scanned SEGMENT bytes at a time; extra columns are not
read by ``report`` and kept by ``cleaned``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import Scratch, fresh, map_batches, own
from .suffixes import common_prefixes, repeated, suffix_array

LENGTH, PASSAGE, GRAM = 400, 256, 24
#: Bytes of the different contexts of one core that a task takes at most (a suffix array needs about a hundred times that)
HOT_BYTES = 1_000_000
SHARD_BYTES = 250_000
#: Places of the gram in its window that a run's windows may span, as parts of all places, until single windows
WIDTHS = (2, 16)
#: Window starts that are worked on at once
SEGMENT = 1 << 19

U = np.uint64
#: The low bits of a hash give way to places, so that the first of equal hashes is the least
PLACES = 1 << 20


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    y = np.concatenate([x, np.full((-n) % w, np.iinfo(U).max, U)]).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _runs_of(sums: np.ndarray, h: np.ndarray, size: int, gram: int, width: int) -> tuple[np.ndarray, ...]:
    w = size - gram + 1
    up, down = tv.powers(len(sums))
    with np.errstate(over="ignore"):
        low = U(PLACES - 1)
        place = (_slide_min((h & ~low) | np.arange(len(h), dtype=U), w) & low).astype(np.int64)
        block = (place - np.arange(len(place))) // width
        cut = np.flatnonzero((place[1:] != place[:-1]) | (block[1:] != block[:-1])) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(place) - 1]])
        pos, block = place[first], block[first]
        core = pos - block * width  # the latest start of such a window, and the end of the earliest
        core_end = pos - np.minimum((block + 1) * width - 1, w - 1) + size
        end = last + size
        key = tv.mix((sums[core_end] - sums[core]) * down[core] + (block * PLACES + width).astype(U) + U(size) * U(0x85EBCA77C2B2AE63))
        ctx = tv.mix((sums[end] - sums[first]) * down[first] + (pos - first).astype(U) * U(0x9E3779B1) + (last - first).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return key, ctx, first, last


def runs_of(data: np.ndarray, kinds: list[tuple[bool, int, int]], gram: int) -> tuple[np.ndarray, ...]:
    """Of each run: core, context, first and last window start, kind. kinds: (kind, size of its windows, width)."""
    parts = [(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for s in range(0, len(data) - min(size for _, size, _ in kinds) + 1, SEGMENT):
        x = data[s : s + SEGMENT - 1 + max(size for _, size, _ in kinds)]
        up, down = tv.powers(len(x) + 1)
        sums = np.zeros(len(x) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((x.astype(U) + U(1)) * up[: len(x)], out=sums[1:])
            h = tv.mix((sums[gram:] - sums[:-gram]) * down[: len(x) - gram + 1])
        for kind, size, width in kinds:
            n = min(len(x), SEGMENT - 1 + size)  # windows that start behind the segment are the next one's
            if n >= size:
                key, ctx, first, last = _runs_of(sums[: n + 1], h[: n - gram + 1], size, gram, width)
                parts.append((key, ctx, first + s, last + s, np.full(len(key), kind)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


RUN = "key:long,ctx:long,a:int,z:int,long:boolean"
ITEM = pa.struct([("key", pa.int64()), ("ctx", pa.int64()), ("a", pa.int32()), ("z", pa.int32()), ("long", pa.bool_())])


def _kinds(sizes: dict[bool, int], gram: int, level: int) -> list[tuple[bool, int, int]]:
    """Kind, size and width of the windows searched, at a level of cutting."""
    return [(kind, size, max(1, -(-(size - gram + 1) // WIDTHS[level])) if level < len(WIDTHS) else 1) for kind, size in sizes.items()]


def scanned(docs: DataFrame, sizes: dict[bool, int], gram: int) -> DataFrame:
    """Size, content hash and runs of each document (_row, _id, _text)."""
    kinds = _kinds(sizes, gram, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = tv.text_buffers(b.column(2))
            c1, c2, sha, parts, count = [], [], [], [runs_of(data[:0], kinds, gram)], [0]
            for r in range(len(b)):
                d = data[offs[r] : offs[r + 1]]
                digest = hashlib.sha256(d)
                sha.append(digest.digest())
                c1.append(int.from_bytes(digest.digest()[:8], "big", signed=True))
                c2.append(int.from_bytes(digest.digest()[8:16], "big", signed=True))
                parts.append(runs_of(d, kinds, gram))
                count.append(count[-1] + len(parts[-1][0]))
            key, ctx, a, z, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
            values = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(kind)], fields=list(ITEM))
            found = pa.ListArray.from_arrays(pa.array(count, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(np.diff(offs)), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sha, pa.binary()), found], names=["_id", "_row", "n_bytes", "c1", "c2", "sha", "runs"])

    return map_batches(docs.select("_row", "_id", "_text"), run, f"_id {docs.schema['_id'].dataType.simpleString()}, _row long, n_bytes long, c1 long, c2 long, sha binary, runs array<struct<{RUN}>>")


#: Words of 64 row numbers (about 50 bytes each) that are sent to all executors
WORDS_SENT = 1_000_000


def _among(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs whose _row is among those of rows (a bit each, sent to all executors), or all docs if these are too many to be sent."""
    word, bit = F.shiftright("_row", 6), F.col("_row").bitwiseAND(F.lit(63)).cast("int")
    words = rows.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    if words.count() > WORDS_SENT:
        return docs
    asked = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return docs.withColumn("_word", word).join(F.broadcast(words), "_word").where(asked).drop("_word", "_bits")


def _asked(docs: DataFrame, ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts with ranges asked of them: _row, _text, _ranges. ranges: one row for each _row. rows: a table with the same values of _row.
    Texts that nothing is asked of are left out before the others are brought to their ranges."""
    return _among(docs.select("_row", "_text"), rows).join(ranges, "_row").select("_row", "_text", "_ranges")


def _stretches(flags: np.ndarray) -> np.ndarray:
    """First and end of each run of true flags, as rows."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).reshape(-1, 2)


FOUND = "_row long, long boolean, a int, b int"


def _shard(sizes: dict[bool, int]):
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("long")[0].as_py()  # one for the shard
        size = sizes[kind]
        texts = t.column("bytes").to_pylist()
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        ends = np.cumsum(np.array([len(x) for x in texts]) + 1)
        at = np.concatenate([[0], ends[:-1]])
        row, first = (t.column(c).to_numpy() for c in ("_row", "a"))
        order = suffix_array(data)
        starts = np.zeros(len(data) + 1, np.int32)
        starts[at] = 1
        starts[ends - size] = -1  # behind the last window of a context, so that stretches stay inside
        found = _stretches(repeated(order, common_prefixes(data, order), np.cumsum(starts[:-1]) > 0, size))
        k = np.searchsorted(at, found[:, 0], side="right") - 1
        shift = first[k].astype(np.int64) - at[k]
        return pa.table({"_row": row[k], "long": pa.array(np.full(len(k), kind), pa.bool_()), "a": (found[:, 0] + shift).astype(np.int32), "b": (found[:, 1] - 1 + shift + size).astype(np.int32)})

    return run


def _of_texts(docs: DataFrame, wanted: DataFrame, make, columns: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """What make(text, run) yields (tuples of values) of the wanted runs, after _row."""
    ranges = wanted.groupBy("_row").agg(F.collect_list(F.struct("key", "a", "z", "long", "whole")).alias("_ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tv.text_buffers(batch.column(1))
            for r, ranges in enumerate(batch.column(2).to_pylist()):
                d = data[offs[r] : offs[r + 1]]
                rows = [v for x in ranges for v in make(d, x)]
                row = pa.array([batch.column(0)[r].as_py()] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([row, *(pa.array([v[i] for v in rows], kind) for i, (_, kind) in enumerate(columns))], names=["_row", *(c for c, _ in columns)])

    return map_batches(_asked(docs, ranges, wanted), run, f"_row long, {ddl}")


def _contexts(docs: DataFrame, wanted: DataFrame, sizes: dict[bool, int]) -> DataFrame:
    def make(d: np.ndarray, x: dict):
        yield x["key"], x["long"], x["a"], d[x["a"] : x["z"] + sizes[x["long"]]].tobytes()

    return _of_texts(docs, wanted, make, [("key", pa.int64()), ("long", pa.bool_()), ("a", pa.int32()), ("bytes", pa.binary())], "key long, long boolean, a int, bytes binary")


def _finer(docs: DataFrame, wanted: DataFrame, sizes: dict[bool, int], gram: int, level: int) -> DataFrame:
    """The wanted runs cut to the width of a level."""
    kinds = {k[0]: k for k in _kinds(sizes, gram, level)}

    def make(d: np.ndarray, x: dict):
        key, ctx, a, z, _ = runs_of(d[x["a"] : x["z"] + sizes[x["long"]]], [kinds[x["long"]]], gram)
        yield from ((*v, x["long"], x["whole"]) for v in zip(key.view(np.int64).tolist(), ctx.view(np.int64).tolist(), (a + x["a"]).tolist(), (z + x["a"]).tolist(), strict=True))

    return _of_texts(docs, wanted, make, [*((f.name, f.type) for f in ITEM), ("whole", pa.bool_())], "key long, ctx long, a int, z int, long boolean, whole boolean")


def ranges(docs: DataFrame, found: DataFrame, sizes: dict[bool, int], gram: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """_row, _ranges (long, a, b; not merged) of documents that are not copies as a whole; and the classes (c1, c2) of those that are."""
    length = sizes[True]
    copied = found.where(F.col("n_bytes") >= length).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.min("_row").alias("_kept")).where("m > 1")
    copied = scratch.put("copied", copied.select("c1", "c2", "_kept"))
    whole = found.where(F.col("n_bytes") >= length).select("_row", "c1", "c2").join(copied, ["c1", "c2"]).select("_row", (F.col("_row") == F.col("_kept")).alias("kept"))
    runs = found.select("_row", F.explode("runs").alias("o")).select("_row", "o.*")
    shared = runs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    occ = runs.join(shared, "key").join(whole, "_row", "left").where("kept is null or kept").withColumn("whole", F.col("kept").isNotNull()).drop("kept")
    occ = scratch.put("runs0", occ)
    scratch.drop("scanned")  # the most bytes of all tables
    size = F.when(F.col("long"), F.lit(length)).otherwise(F.lit(sizes.get(False, length)))
    extent = F.col("z") - F.col("a") + size
    out, level = [], 0
    while True:
        per = scratch.put(f"per{level}", occ.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("c"), *(F.first(c).alias(c) for c in ("_row", "a", "z", "long", "whole"))))
        equal = occ.join(per.where("c > 1").select("key", "ctx"), ["key", "ctx"]).where("not whole")
        out.append(equal.select("_row", "long", "a", (F.col("z") + size).alias("b")))
        groups = per.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.sum(extent).alias("size")).where("d > 1")
        wanted = scratch.put(f"wanted{level}", per.join(groups, "key").select("key", "_row", "a", "z", "long", "whole", (F.col("size") > HOT_BYTES).alias("hot")))
        if level == len(WIDTHS):  # contexts are single windows, and no core has two
            break
        cool = wanted.where("not hot")
        shards = max(1, (cool.agg(F.sum(extent)).first()[0] or 0) // SHARD_BYTES)
        shard = F.pmod(F.xxhash64("key"), F.lit(shards))
        out.append(_contexts(docs, cool, sizes).select(shard.alias("shard"), "long", "_row", "a", "bytes").groupBy("shard", "long").applyInArrow(_shard(sizes), FOUND))
        if wanted.where("hot").isEmpty():
            break
        level += 1
        occ = scratch.put(f"runs{level}", _finer(docs, wanted.where("hot"), sizes, gram, level))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return scratch.put("ranges", every.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("long", "a", "b"))).alias("_ranges"))), copied


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in ranges:
        if out and x["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["b"]))
        else:
            out.append((x["a"], x["b"]))
    return out


def _covered(ranges) -> F.Column:
    """Bytes that sorted ranges cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    more = lambda acc, x: F.struct((acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))
    return F.aggregate(ranges, start, more, lambda acc: acc["n"]).cast("long")


def _found(rows: DataFrame, scratch: Scratch, sizes: dict[bool, int], gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = scratch.put("scanned", scanned(rows, sizes, gram))
    known = scratch.put("known", found.drop("runs"))
    cut, copied = ranges(rows, found, sizes, gram, scratch)
    return known, cut, copied.select("c1", "c2", F.lit(True).alias("copied"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, n_passage (bytes in strings of ``passage`` bytes that also start elsewhere)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")))
    found, cut, copied = _found(rows, scratch, {True: length, False: passage}, gram)
    is_long = F.filter("_ranges", lambda x: x["long"])
    long = cut.select("_row", is_long.alias("_ranges")).where(F.size("_ranges") > 0)
    texts = _asked(rows, long, long)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = tv.text_buffers(b.column(1))
            removed, spans, sha = [], [], []
            for r, x in enumerate(b.column(2).to_pylist()):
                runs, digest, at = _merged(x), hashlib.sha256(), int(offs[r])
                for s, e in runs:
                    digest.update(data[at : offs[r] + s])
                    at = int(offs[r]) + e
                digest.update(data[at : offs[r + 1]])
                removed.append(sum(e - s for s, e in runs))
                spans.append(len(runs))
                sha.append(digest.digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.binary())], names=["_row", "removed", "spans", "kept"])

    part = map_batches(texts, run, "_row long, removed long, spans long, kept binary")
    short = cut.select("_row", _covered(F.filter("_ranges", lambda x: ~x["long"])).alias("covered"))
    whole = found.join(copied, ["c1", "c2"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length))
    zero = F.lit(0).cast("long")
    return whole.join(short, "_row", "left").join(part, "_row", "left").select(
        F.col("_id").alias(id_col), "n_bytes", F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(F.col("copied"), F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(F.col("copied"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("covered", zero)).alias("n_passage"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated bytes cut out of their texts; characters broken by a cut are dropped."""
    scratch, row, cuts = Scratch(docs.sparkSession), fresh("_row", docs.columns), fresh("_ranges", docs.columns)
    kept = scratch.numbered(docs, row)
    rows = kept.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found, cut, copied = _found(rows, scratch, {True: length}, gram)
    gone = found.join(copied, ["c1", "c2"]).where(F.col("n_bytes") >= length).select("_row", F.expr("array(struct(true as long, 0 as a, cast(n_bytes as int) as b))").alias("_ranges"))
    cut = cut.join(gone, "_row", "left_anti").unionByName(gone).select(F.col("_row").alias(row), F.filter("_ranges", lambda x: x["long"]).alias(cuts))
    marked = kept.join(cut, row, "left").select(*own(docs), cuts)
    col = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, x in zip(b.column(col), b.column(b.num_columns - 1).to_pylist(), strict=True):
                text = t.as_py()
                if x and text is not None:
                    raw, at, parts = text.encode(), 0, []
                    for s, e in _merged(x):
                        parts.append(raw[at:s])
                        at = e
                    text = b"".join([*parts, raw[at:]]).decode(errors="ignore")
                texts.append(text)
            columns = list(b.columns[:-1])
            columns[col] = pa.array(texts, b.schema.field(col).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return map_batches(marked, run, docs.schema)
