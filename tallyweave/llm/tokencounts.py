"""Edit-aware token counts.

A document is split into pre-tokens by the tokenizer's pattern; byte-pair merges never cross them, so its count is the sum over
pre-tokens. Runs of pre-tokens are the leaves of a segment tree that holds subtree sums of characters and tokens. An edit finds
its leaf by characters, splits text anew from the last pre-token that ends before the edit and its look-ahead, goes on until a new
boundary falls on an old one behind the edit (from there on the pattern sees the same text), encodes only what lies between, and
updates the sums on the paths of the touched leaves. Counts after any edits equal those of encoding the edited text anew.

The tokenizer's file is a parameter: it is read on the driver and its ranks, a fixed table, are broadcast. Defined results: a null or empty
text has 0 tokens and no edits; repeated rows get equal results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import map_batches

LEAF = 64
#: Characters that the pattern looks at behind a pre-token's end
LOOK = 2
#: Distinct pre-tokens whose counts a worker remembers
MEMO = 200_000

Edit = tuple[int, int, str]


class Counter:
    """Tokens of one pre-token, and the pre-tokens of a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = n
        return n

    def total(self, text: str) -> int:
        memo, count = self.memo, self.count
        return sum(memo[p] if p in memo else count(p) for p in self.pattern.findall(text))


class Tree:
    """A segment tree over leaves of (characters, tokens); each leaf has its pre-tokens' lengths and counts."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = [(len(p), counter.count(p)) for p in counter.pattern.findall(text)]
        self._build([pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]])

    def _build(self, leaves: list[list[tuple[int, int]]]) -> None:
        self.leaves, self.width = leaves, 1
        while self.width < len(leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * 2 * self.width, [0] * 2 * self.width
        for i, leaf in enumerate(leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(n for n, _ in leaf), sum(t for _, t in leaf)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (or the last) and its first character."""
        i, first = 1, 0
        while i < self.width:
            i *= 2
            if at >= first + self.chars[i] and self.chars[i + 1]:
                first += self.chars[i]
                i += 1
        return i - self.width, first

    def _put(self, k: int, leaf: list[tuple[int, int]]) -> None:
        self.leaves[k] = leaf
        i = self.width + k
        self.chars[i], self.tokens[i] = sum(n for n, _ in leaf), sum(t for _, t in leaf)
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start..end-1 by ``new``."""
        old, shift = self.text, len(new) - (end - start)
        text = old[:start] + new + old[end:]
        # the last pre-token whose end and look-ahead lie before the edit stays
        k, first = self._leaf(max(0, start - LOOK - 1))
        j, at = 0, first
        while j < len(self.leaves[k]) and at + self.leaves[k][j][0] + LOOK <= start:
            at += self.leaves[k][j][0]
            j += 1
        head, made, pos = self.leaves[k][:j], [], at
        ok, oj, oat = k, j, at  # the old boundary that the new one is compared with
        for m in self.counter.pattern.finditer(text, at):
            piece = m[0]
            made.append((len(piece), self.counter.count(piece)))
            pos = m.end()
            while ok < len(self.leaves) and oat + shift < pos:
                if oj < len(self.leaves[ok]):
                    oat += self.leaves[ok][oj][0]
                    oj += 1
                else:
                    ok, oj = ok + 1, 0
            if oat >= end and oat + shift == pos:
                break
        else:
            ok, oj = len(self.leaves) - 1, len(self.leaves[-1])
        if ok >= len(self.leaves):
            ok, oj = len(self.leaves) - 1, len(self.leaves[-1])
        self.encoded += len(made)
        tail = self.leaves[ok][oj:]
        self.text = text
        leaf = head + made + tail
        if len(leaf) > 4 * LEAF:
            parts = [leaf[i : i + LEAF] for i in range(0, len(leaf), LEAF)]
            self._build(self.leaves[:k] + parts + self.leaves[ok + 1 :])
            return
        for i in range(k + 1, ok + 1):
            self._put(i, [])
        self._put(k, leaf)


def edited(text: str, counter: Counter, edits: Iterable[Edit]) -> tuple[int, int, int, int]:
    """Tokens before, edits, tokens after, pre-tokens encoded for the edits. Offsets are those of the text as it came."""
    todo = sorted(edits, reverse=True)  # from the back, so that offsets stay
    if not todo:
        n = counter.total(text)
        return n, 0, n, 0
    tree = Tree(text, counter)
    before = tree.total
    for s, e, new in todo:
        tree.edit(s, e, new)
    return before, len(todo), tree.total, tree.encoded


def masks(text: str) -> list[Edit]:
    """The edits of the registered query: runs of ten digits or more, and words with an @, give way to a placeholder."""
    import re

    if "@" not in text and not any(c in text for c in "0123456789"):
        return []
    return [(*m.span(), "<number>" if m[1] else "<address>") for m in re.finditer(r"([0-9]{10,})|[^\s@]+@[^\s@]+", text)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


#: Fixed value: the usual pre-token pattern of byte-level vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", edits: Callable[[str], list[Edit]] = masks, pattern: str = PATTERN) -> DataFrame:
    """Per document: n_tokens, n_edits, n_tokens_after, n_encoded (pre-tokens encoded again because of the edits)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, pattern)
        for b in batches:
            got = [edited(t, counter, edits(t)) for t in (x.as_py() or "" for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], pa.int64()) for i in range(4))], names=["_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"])

    return map_batches(chosen, run, f"_id {chosen.schema['_id'].dataType.simpleString()}, n_tokens long, n_edits long, n_tokens_after long, n_encoded long").withColumnRenamed("_id", id_col)
