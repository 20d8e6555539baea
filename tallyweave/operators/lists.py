"""Scores of pairs, and the pairs in each S1 record's lists, added up over posting lists in NumPy.

Targets are cut into parts of one country, or of several small ones. The posting lists of some parts go to every task of S1 records, which adds
up one part after the other: no pair is shuffled or written before the lists are cut. Scores have nine decimals; places are in the order of ids.
All pairs come part by part and by their scores, so that columns of a written result are runs of equal scores and numbers in small dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast

from ..params import BlockParams

GROUPS = ["g0", "g1", "g2", "g3"]
#: Parts of a task's scores whose greatest values bound a list, at least
BUCKETS = 64
#: More than rounding to nine decimals moves a key, and less than the least key that is not rounded to nothing
SLACK, LEAST = 1e-8, 4e-10
#: Pairs that are returned at once, about
BATCH = 50_000


@dataclass
class Part:
    """Posting lists of targets: of tokens (rising), each list from its start to the next one's: places in the part (rising), and weights."""

    first: int
    size: int
    tokens: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    w: np.ndarray


@dataclass
class Round:
    """Parts that are sent together, their numbers by country, and all targets by place."""

    parts: list[Part]
    of: dict[str, list[int]]
    n: np.ndarray
    ids: pa.Array
    has_addr: np.ndarray


def part(first: int, numbers: np.ndarray, postings: pa.Table) -> Part:
    """numbers: those of the part's targets, rising. postings: n, t, w."""
    at, t, w = np.searchsorted(numbers, postings["n"].to_numpy()), postings["t"].to_numpy(), postings["w"].to_numpy()
    order = np.lexsort((at, t))
    at, t, w = at[order], t[order], w[order]
    if len(t):  # a token that a target has twice
        new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (at[1:] != at[:-1])))
        at, t, w = at[new], t[new], np.add.reduceat(w, new)
    tokens, starts = np.unique(t, return_index=True)
    return Part(first, len(numbers), tokens, np.append(starts, len(t)), at.astype(np.int32), w)


def nine(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5) / 1e9


def rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """x to nine decimals, and then to these."""
    x = nine(x)
    return x if decimals == 9 else np.floor(x * 10.0**decimals + 0.5) / 10.0**decimals


def total(g: np.ndarray) -> np.ndarray:
    return nine(g[0] + g[1] + g[2] + g[3])


def _key(i: int, g: np.ndarray, has_addr: np.ndarray) -> np.ndarray:
    """The key of list i (blocking.rankings)."""
    if i == 0:
        return total(g)
    if i == 1:
        return np.minimum(nine(0.5 * (g[0] + g[1] + g[2])), g[3])
    return np.where(has_addr, 0.0, nine(g[0] + g[1] + g[2])) if i == 2 else g[i - 3]


def sizes(p: BlockParams) -> list[int]:
    return [p.k, p.k_both, p.k_noaddr, *p.k_group]


def _reach(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values after rounding, and of some more: all from a lower bound of the k-th greatest on, as k buckets reach it."""
    buckets = max(BUCKETS, 4 * k)
    each, bound = len(x) // buckets, 0.0
    if each:
        bound = np.partition(x[: buckets * each].reshape(buckets, each).max(axis=1), buckets - k)[buckets - k]
    return np.flatnonzero(x >= max(bound - SLACK, LEAST))


def _best(key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest positive keys; of equal ones the first."""
    at = np.flatnonzero(key > 0)
    if len(at) <= k:
        return at
    found = key[at]
    least = np.partition(found, len(at) - k)[len(at) - k]
    above = at[found > least]
    return np.append(above, at[found == least][: k - len(above)])


def _add_up(x: Part, t: np.ndarray, g: np.ndarray, qw: np.ndarray, sums: np.ndarray) -> bool:
    """sums by group and place; whether there are any."""
    i = np.minimum(np.searchsorted(x.tokens, t), len(x.tokens) - 1)
    known = np.flatnonzero(x.tokens[i] == t) if len(x.tokens) else i[:0]
    if not len(known):
        return False
    sums[:] = 0
    i = i[known]
    for a, b, group, weight in zip(x.starts[i].tolist(), x.starts[i + 1].tolist(), g[known].tolist(), qw[known].tolist(), strict=True):
        sums[group][x.at[a:b]] += x.w[a:b] * weight
    return True


def _listed(sums: np.ndarray, has_addr: np.ndarray, ks: list[int]) -> np.ndarray:
    """Places in a list of the part."""
    name, found = sums[0] + sums[1] + sums[2], []
    for i, k in enumerate(ks):
        if not k:
            continue
        if i == 2:
            bare = np.flatnonzero(~has_addr)
            at = bare[_reach(name[bare], k)]
        else:
            at = _reach(name + sums[3] if i == 0 else np.minimum(0.5 * name, sums[3]) if i == 1 else sums[i - 3], k)
        if len(at):
            found.append(at[_best(_key(i, nine(sums[:, at]), has_addr[at]), k)])
    return np.unique(np.concatenate(found)) if found else np.empty(0, int)


Terms = tuple[np.ndarray, np.ndarray, np.ndarray]
Found = Iterator[tuple[int, np.ndarray, np.ndarray]]


def _of_record(r: Round, sums: np.ndarray, country: str, terms: Terms, ks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the targets in an S1 record's lists, by rank, and their rounded scores."""
    places, scores = [], []
    for k in r.of.get(country, []):
        x = r.parts[k]
        s = sums[:, : x.size]
        if not _add_up(x, *terms, s):
            continue
        at = _listed(s, r.has_addr[x.first : x.first + x.size], ks)
        places.append(x.first + at)
        scores.append(nine(s[:, at]))
    if not places:
        return
    at, g = np.concatenate(places), np.concatenate(scores, axis=1)
    if len(places) > 1:
        order = np.argsort(r.n[at])
        at, g = at[order], g[:, order]
        kept = np.unique(np.concatenate([_best(_key(i, g, r.has_addr[at]), k) for i, k in enumerate(ks) if k]))
        at, g = at[kept], g[:, kept]
    order = np.lexsort((r.n[at], -total(g)))
    yield at[order], g[:, order]


def _by_scores(g: np.ndarray, decimals: int) -> np.ndarray:
    """An order in which equal scores stand together: by g0, g1, g2, g3."""
    whole = np.rint(g * 10.0**decimals).astype(np.int64)
    key, values = whole[0], int(whole[0].max(initial=0)) + 1
    for x in whole[1:]:
        most = int(x.max(initial=0)) + 1
        if (values := values * most) >= 2**63:  # too many for one number
            return np.lexsort(g[::-1])
        key = key * most + x
    return np.argsort(key)


def _all(r: Round, sums: np.ndarray, countries: list[str], terms: list[Terms], decimals: int) -> Found:
    """For each part and each S1 record of a country in it: the record's row, the places of all its targets there, by score, and their rounded scores."""
    rows: dict[int, list[int]] = {}
    for row, country in enumerate(countries):
        for k in r.of.get(country, []):
            rows.setdefault(k, []).append(row)
    for k in sorted(rows):
        x = r.parts[k]
        s = sums[:, : x.size]
        for row in rows[k]:
            if _add_up(x, *terms[row], s):
                at = np.flatnonzero(s.any(axis=0))
                g = rounded(s[:, at], decimals)
                order = _by_scores(g, decimals)
                yield row, x.first + at[order], g[:, order]


SCHEMA = "s1_id string, cand_id string, g0 double, g1 double, g2 double, g3 double, has_addr boolean, total double, rank int"
#: Of all pairs
PAIRS = "s1_id string, cand_id string, g0 double, g1 double, g2 double, g3 double"
#: What this Python worker used last
_last: list[Broadcast] = []


def _value(sent: Broadcast) -> Round:
    """A worker that gets the tasks of several rounds holds one of them."""
    if _last and _last[0] is not sent:
        _last[0].__dict__.pop("_value", None)
    _last[:] = [sent]
    return sent.value


def pairs_of(sent: Broadcast, ks: list[int] | None, decimals: int = 9):
    """For mapInArrow over S1 records (id, country, t, g, qw): their pairs in SCHEMA. sent: a broadcast Round. ks: the lists' lengths (0: no such list);
    None: all pairs, in PAIRS, with scores of these decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _value(sent)
        for x in r.parts:
            x.at = x.at.astype(np.intp, copy=False)
        sums = np.zeros((4, max((x.size for x in r.parts), default=0)))
        for batch in batches:
            ids, countries = batch["id"], batch["country"].to_pylist()
            columns = [batch[c].flatten().to_numpy() for c in ("t", "g", "qw")]
            ends = np.append(0, np.cumsum(batch["t"].value_lengths().to_numpy()))
            terms = [tuple(c[ends[row] : ends[row + 1]] for c in columns) for row in range(len(countries))]
            if ks is None:
                found = _all(r, sums, countries, terms, decimals)
            else:
                found = ((row, *x) for row, country in enumerate(countries) for x in _of_record(r, sums, country, terms[row], ks))
            held, count = [], 0
            for x in found:
                held.append(x)
                count += len(x[1])
                if count >= BATCH:
                    yield _batch(r, ids, held, ks is not None)
                    held, count = [], 0
            if held:
                yield _batch(r, ids, held, ks is not None)

    return run


def _batch(r: Round, ids: pa.Array, held: list[tuple[int, np.ndarray, np.ndarray]], listed: bool) -> pa.RecordBatch:
    lengths = [len(at) for _, at, _ in held]
    rows, at, g = np.repeat([row for row, _, _ in held], lengths), np.concatenate([at for _, at, _ in held]), np.concatenate([g for _, _, g in held], axis=1)
    columns, names = [ids.take(pa.array(rows)), r.ids.take(pa.array(at)), *g], ["s1_id", "cand_id", *GROUPS]
    if listed:
        rank = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        columns, names = [*columns, r.has_addr[at], total(g), rank], [*names, "has_addr", "total", "rank"]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
