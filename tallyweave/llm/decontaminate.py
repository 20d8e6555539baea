"""Benchmark decontamination.

The normalised n-grams of all test items become a sorted table of 64-bit hashes that is broadcast to the scan; every
window of every document is probed, each hit is verified against the item's words, and covered words are counted.
The table's size is checked: items are dealt into blocks of at most ``max_windows`` windows by a hash of their text,
and each block is one more map over the documents which ORs its hits into a bitmap column. There is no shuffle of
documents, and no limit to the number of items.

An item of fewer than ``n`` words is one window of its own length; an item without words has none. Defined results: a
null text has no words, no hits and is not contaminated; a null item id counts as the empty string; repeated items and
ids count once in ``n_items``. Other columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from . import textvec as tv
from .scratch import Scratch, fresh, map_batches

#: Maps, each with a process and a table of its own, that run in one stage
CHAINED = 2


class Table:
    """Windows of one block of items in flat arrays: about 30 bytes a window and 20 a word, beside the text.

    ``data`` holds the items' words, lower-cased, each followed by a space, so that a window's text is one range of bytes. By window length there are
    distinct windows in hash order (hash, first word), and the items of each: those between two entries of ``at`` in ``item``."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.ids: list[str] = []
        data, size, hashes, firsts, owners = [], [], {}, {}, {}
        words = 0
        for w in tv.words(pa.array([t for _, t in items], pa.string()), tv.ALNUM):
            count = np.diff(w.at)
            some = np.flatnonzero(count)
            number = np.zeros(len(count), np.int64)
            number[some] = len(self.ids) + np.arange(len(some))
            self.ids += [items[w.first + r][0] for r in some]
            for length in np.unique(np.minimum(count[some], n)).tolist():
                i, h = tv.windows(w, length)
                if length < n:  # only items of that many words
                    i, h = (x[count[w.row[i]] == length] for x in (i, h))
                for to, x in ((hashes, h), (firsts, i + words), (owners, number[w.row[i]])):
                    to.setdefault(length, []).append(x)
            data += [w.text(0, len(w.hash))] if len(w.hash) else []
            size.append(w.end - w.start)
            words += len(w.hash)
        self.data = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        size = np.concatenate([np.zeros(0, np.int64), *size])
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.by_size = {length: self._windows(length, *(np.concatenate(x[length]) for x in (hashes, firsts, owners))) for length in hashes}

    def text(self, first: int, n: int) -> bytes:
        return self.data[self.start[first] : self.end[first + n - 1]].tobytes()

    def _windows(self, n: int, h: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((owner, first, h))
        h, first, owner = h[order], first[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        for k in np.flatnonzero(~new).tolist():  # equal hashes: of equal words, but for a collision
            new[k] = self.text(first[k], n) != self.text(first[k - 1], n)
        at = np.flatnonzero(new)
        return h[at], first[at], np.append(at, len(h)), owner

    def found(self, n: int, h: np.ndarray) -> np.ndarray:
        """Which hashes are those of a window."""
        known = self.by_size[n][0]
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h

    def items(self, n: int, h: int, text: bytes) -> np.ndarray:
        """Numbers of the items that hold the window; none if its words differ."""
        known, first, at, owner = self.by_size[n]
        k = int(np.searchsorted(known, h))
        while k < len(known) and known[k] == h:
            if self.text(first[k], n) == text:
                return owner[at[k] : at[k + 1]]
            k += 1
        return owner[:0]


def scan(w: tv.Words, table: Table) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and the ids of the items that each row holds a window of."""
    cover = np.zeros(len(w.hash) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(w.last - w.first)]
    for size in table.by_size:
        i, h = tv.windows(w, size)
        hit = np.flatnonzero(table.found(size, h))
        for s, x in zip(i[hit].tolist(), h[hit], strict=True):
            true = table.items(size, x, w.text(s, size))
            if len(true):
                cover[s] += 1
                cover[s + size] -= 1
                items[w.row[s]].update(table.ids[k] for k in true.tolist())
    return np.cumsum(cover[:-1]) > 0, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_windows: int) -> tuple[int, Callable[[int], list[tuple[str, str]]]]:
    """How many blocks of about max_windows windows the items make, and a function that reads one; the driver holds one at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // (2 * max_windows)))  # a window takes two bytes of text at least
    return count, lambda k: [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).collect()]


#: What a map has found of a row: which words are hit, and the ids of the items
Found = tuple[np.ndarray, set[str]]


def _scan_all(docs: DataFrame, text_col: str, benchmark: DataFrame, n: int, max_windows: int, item_cols: tuple[str, str], finish: Callable, schema) -> DataFrame:
    """finish(batch, runs of words with what was found in each row) of all batches. Each block of items is a map; all but the last add _hits and _items."""
    scratch, names = Scratch(docs.sparkSession), [fresh("_hits", docs.columns), fresh("_items", docs.columns)]
    sc = docs.sparkSession.sparkContext
    state = StructType([*docs.schema, StructField(names[0], BinaryType()), StructField(names[1], ArrayType(StringType()))])
    col = docs.columns.index(text_col)
    count, block = _blocks(benchmark, *item_cols, max_windows)
    for k in range(count):
        if k and k % CHAINED == 0:
            docs = scratch.put(f"after{k}", docs)
        shared = sc.broadcast(Table(block(k), n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, later=k > 0, last=k == count - 1) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for b in batches:
                had = (b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()) if later else None
                rest = pa.RecordBatch.from_arrays(b.columns[:-2], names=b.schema.names[:-2]) if later else b
                out: list[tuple[tv.Words, list[Found]]] = []
                for w in tv.words(b.column(col), tv.ALNUM):
                    flags, items = scan(w, table)
                    found = [(flags[w.at[r] : w.at[r + 1]], items[r]) for r in range(w.last - w.first)]
                    for r, (hit, ids) in enumerate(found if had else ()):
                        hit |= np.unpackbits(np.frombuffer(had[0][w.first + r], np.uint8), count=len(hit)).astype(bool)
                        ids.update(had[1][w.first + r])
                    out.append((w, found))
                if last:
                    yield finish(rest, out)
                else:
                    bits = [np.packbits(hit).tobytes() for _, found in out for hit, _ in found]
                    ids = [sorted(x) for _, found in out for _, x in found]
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(bits, pa.binary()), pa.array(ids, pa.list_(pa.string()))], names=[*rest.schema.names, *names])

        docs = map_batches(docs, run, schema if k == count - 1 else state)
    return docs


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _is_dirty(hit: np.ndarray, percent: int) -> bool:
    return bool(hit.any()) and 100 * int(hit.sum()) >= percent * len(hit)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_windows: int = 500_000) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 100 * n_hit >= percent * n_words)."""
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def finish(b: pa.RecordBatch, out: list[tuple[tv.Words, list[Found]]]) -> pa.RecordBatch:
        rows = [(len(hit), int(hit.sum()), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), _is_dirty(hit, percent)) for _, found in out for hit, ids in found]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    schema = f"_id {chosen.schema['_id'].dataType.simpleString()}, {RESULT}"
    return _scan_all(chosen, "_text", benchmark, n, max_windows, (item_id_col, item_text_col), finish, schema).withColumnRenamed("_id", id_col)


def _without(w: tv.Words, r: int, hit: np.ndarray) -> str:
    first, at, parts = int(w.at[r]), int(w.offsets[r]), []
    for s, t in np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2):
        parts.append(w.data[at : w.start[first + s]].tobytes())
        at = int(w.end[first + t - 1])
    return b"".join([*parts, w.data[at : w.offsets[r + 1]].tobytes()]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", spans: bool = False, max_windows: int = 500_000) -> DataFrame:
    """docs without its contaminated rows; with ``spans``, all rows, and the hit words of contaminated ones cut out of the text."""
    col = docs.columns.index(text_col)

    def finish(b: pa.RecordBatch, out: list[tuple[tv.Words, list[Found]]]) -> pa.RecordBatch:
        if not spans:
            return b.filter(pa.array([not _is_dirty(hit, percent) for _, found in out for hit, _ in found], pa.bool_()))
        texts = b.column(col).to_pylist()
        for w, found in out:
            for r, (hit, _) in enumerate(found):
                if _is_dirty(hit, percent):
                    texts[w.first + r] = _without(w, r, hit)
        columns = list(b.columns)
        columns[col] = pa.array(texts, b.schema.field(col).type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return _scan_all(docs, text_col, benchmark, n, max_windows, (item_id_col, item_text_col), finish, docs.schema)
