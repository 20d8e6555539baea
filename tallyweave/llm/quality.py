"""Quality rules with compression bands.

Per document: word counts, symbols, repeated lines and repeated three-word windows (the base rules), and Zstandard
ratios (raw bytes / compressed bytes) of the whole text and of fixed chunks. A ratio band belongs to a length class:
text above its upper limit is repetitive, text below its lower limit is incompressible. Chunks cover whole texts: the last one
ends with the text. The limits are those that ``fit`` takes from the labels of sf0.1: the extremes of a bounded sample of clean documents
with a margin. Classes with too few clean documents (very short and very long texts) keep the wide limits of ``WIDE``.

Defined results: a null or empty text has no words, all counts 0, ``base_failed`` true and ``kept`` false. Whole texts
are read; nothing is cut. Rows are independent: repeated rows and repeated ids get equal verdicts, other columns of
the input are ignored by ``measure`` and passed through by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil, floor, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import map_batches

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


#: (shortest length in bytes, lowest ratio, highest ratio) where no labels are known
WIDE = ((0, 0.0, 99.0), (128, 0.9, 3.0), (256, 1.05, 3.2), (512, 1.15, 3.4), (1024, 1.25, 3.6), (4096, 1.35, 4.2), (16384, 1.4, 5.0), (65536, 1.45, 6.0))
#: Length classes of half an octave, as the ratio of clean text grows with its length
STARTS = (0, 128, 256, 362, 512, 724, 1024, 1448, 2048, 2896, 4096, 5792, 8192, 11585, 16384, 65536)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    chunk: int = 2048
    #: (shortest length in bytes, lowest ratio, highest ratio) of a whole text
    bands: tuple = (
        (0, 0.0, 99.0), (128, 0.9, 3.0), (256, 1.37, 1.673), (362, 1.371, 1.894), (512, 1.423, 1.924), (724, 1.543, 2.033), (1024, 1.674, 2.098), (1448, 1.788, 2.213),
        (2048, 1.862, 2.222), (2896, 1.939, 2.279), (4096, 2.059, 2.358), (5792, 2.082, 2.411), (8192, 2.151, 2.45), (11585, 2.197, 2.48), (16384, 2.267, 2.555), (65536, 1.45, 6.0),
    )
    chunk_band: tuple = (1.834, 2.207)
    #: Share of a text's chunks that may lie outside chunk_band
    odd_chunks: float = 0.5


MEASURES = pa.schema(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
     ("zstd_ratio", pa.float64()), ("odd_chunk_share", pa.float64()), ("base_failed", pa.bool_()), ("band_failed", pa.bool_()), ("kept", pa.bool_())]
)
MEASURES_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, odd_chunk_share double, base_failed boolean, band_failed boolean, kept boolean"


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeat_words(w: tv.Words, n_rows: int) -> np.ndarray:
    """Words of each row inside three-word windows that the row holds twice or more."""
    i, h = tv.windows(w, 3)
    with np.errstate(over="ignore"):
        key = tv.mix(h + w.row[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = i[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 3, -1)
    return np.bincount(w.row[np.cumsum(cover[:-1]) > 0], minlength=n_rows)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _ratios(b: bytes, squeeze, chunk: int) -> tuple[float, list[float]]:
    """The ratio of a text and those of its chunks, the last of which ends with the text."""
    starts = list(range(0, len(b) - chunk + 1, chunk))
    if starts and len(b) % chunk:
        starts.append(len(b) - chunk)
    return len(b) / len(squeeze.compress(b)), [chunk / len(squeeze.compress(b[s : s + chunk])) for s in starts]


def measure_texts(texts: pa.Array, rules: Rules) -> pa.RecordBatch:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=rules.level)
    starts = np.array([b[0] for b in rules.bands])
    low, high = np.array([b[1] for b in rules.bands]), np.array([b[2] for b in rules.bands])
    out: list[list] = [[] for _ in MEASURES]
    for w in tv.words(texts, tv.SPACED, lower=False):
        n = w.last - w.first
        n_words = np.diff(w.at)
        lead = (w.data & 0xC0) != 0x80
        chars = _sums(lead & tv.SPACED[w.data], w.offsets)
        symbols = _sums(SYMBOLS[w.data], w.offsets)
        repeat = _repeat_words(w, n)
        dup, ratio, odd = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        size = np.diff(w.offsets)
        raw = w.data.tobytes()
        for r in range(n):
            if size[r]:
                b = raw[w.offsets[r] : w.offsets[r + 1]]
                dup[r] = _dup_lines(b)
                ratio[r], got = _ratios(b, squeeze, rules.chunk)
                if got:
                    odd[r] = sum(not rules.chunk_band[0] <= x <= rules.chunk_band[1] for x in got) / len(got)
        base = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
        band = np.searchsorted(starts, size, side="right") - 1
        failed = (size > 0) & ((ratio < low[band]) | (ratio > high[band]) | (odd > rules.odd_chunks))
        for k, x in enumerate((n_words, chars, symbols, dup, repeat, ratio, odd, base, failed, ~base & ~failed)):
            out[k].append(x)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip(out, MEASURES, strict=True)], schema=MEASURES)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per document: its id and MEASURES. Map-only; a batch of Arrow rows is worked through in runs of about 1 MB."""
    chosen = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure_texts(b.column(1), rules)
            yield pa.RecordBatch.from_arrays([b.column(0), *m.columns], names=["_id", *m.schema.names])

    kind = chosen.schema["_id"].dataType.simpleString()
    return map_batches(chosen, run, f"_id {kind}, {MEASURES_DDL}").withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that pass, with all their columns and no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure_texts(b.column(b.schema.get_field_index(text_col)), rules)
            yield b.filter(m.column(m.schema.get_field_index("kept")))

    return map_batches(docs, run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), sample: int = 2400, margin: float = 1.03, least: int = 10) -> Rules:  # noqa: B008
    """``rules`` with the limits of the first ``sample`` different clean texts (quality 1, base rules passed) in hash order, widened by ``margin``.

    Only four numbers of each reach the driver. A length class with fewer than ``least`` of them keeps its limits of ``WIDE``.
    """
    clean = labels.where("quality = 1").select(F.col(id_col)).distinct()
    text = F.col(text_col).cast("string")
    some = docs.join(clean, id_col, "left_semi").select(text.alias("t"), F.xxhash64(text).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=rules.level)
        for b in batches:
            failed = measure_texts(b.column(0), rules).column(MEASURES.get_field_index("base_failed")).to_pylist()
            out: list[list] = [[] for _ in range(5)]
            for t, h, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), failed, strict=True):
                if not bad:
                    ratio, got = _ratios(raw := t.encode(), squeeze, rules.chunk)
                    for x, v in zip(out, (h, len(raw), ratio, min(got, default=None), max(got, default=None)), strict=True):
                        x.append(v)
            types = [pa.int64()] * 2 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["h", "size", "ratio", "low", "high"])

    rows = map_batches(some, run, "h long, size long, ratio double, low double, high double").dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    limits = lambda lows, highs: (floor(min(lows) / margin * 1000) / 1000, ceil(max(highs) * margin * 1000) / 1000)
    bands = []
    for start, end in zip(STARTS, (*STARTS[1:], inf), strict=True):
        got = [r.ratio for r in rows if start <= r.size < end]
        bands.append((start, *limits(got, got)) if len(got) >= least else (start, *[w for w in WIDE if w[0] <= start][-1][1:]))
    chunks = [r for r in rows if r.low is not None]
    return replace(rules, bands=tuple(bands), chunk_band=limits([r.low for r in chunks], [r.high for r in chunks]) if len(chunks) >= least else rules.chunk_band)
