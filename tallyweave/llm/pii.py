"""Personal data by patterns and a skip-chain conditional random field.

Base spans are found by patterns (email, ip, card, phone; leftmost, non-overlapping per kind; a match that fails its check is
dropped without a retry). Then the document's tokens with a digit or an @ form a graph: neighbours in the text are joined by chain
potentials, and tokens with the same digits or letters, however far apart, by skip potentials. Tokens inside base spans are
observed; loopy belief propagation gives the others' label distributions, so that an entity found once is labelled consistently
where it is repeated in a form that no pattern knows (a phone number without its prefix). Tokens whose label is
certain to at least ``min_prob`` become further spans, of the kind that they repeat.

The field's weights are fitted by pseudo-likelihood (a multinomial regression of each token's label on its shape, its neighbours'
labels and its skip neighbours' labels) on a bounded sample, ``sample`` documents in hash order that may hold a base span, of at most ``most``
tokens with a digit or an @; the labels are the patterns' own. Repeats that no pattern knows count as unlabelled there, and each observed token is
shown once more as a repeat with its label hidden, so that the fit learns to carry labels along skips. Everything else runs over whole texts of all documents. Memory is linear in the text: equal tokens are linked in a row and
to the latest observed one (the first if none lies before), not in pairs. Messages go round until they settle.

Defined results: a null or empty text has no spans; offsets are code points; repeated rows get equal results; extra columns are not
read by ``report``; an empty table gives an empty result (the weights are then 0).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # within a run of digits a later start can't succeed
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "()[]{}<>,;:!?\"'|."

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = list(emails(text)) if "@" in text else []
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@dataclass
class Graph:
    """Tokens with a digit or an @ (trimmed), their shape features, base labels, neighbours and skip edges."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    label: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    group: np.ndarray  # number of a token's key: tokens with the same digits or letters


N_SHAPE, PLUS = 16, 15


def shape(word: str) -> list[float]:
    n = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    dots, dashes = word.count("."), word.count("-")
    return [1.0, n == 0, 0 < n <= 2, n == 3, n == 4, 5 <= n <= 7, 8 <= n <= 11, 12 <= n <= 15, n >= 16, letters > 0, "@" in word, dots == 1, dots == 3, dots > 3 or dots == 2, dashes > 0, word[:1] == "+"]


def graph(text: str, spans: list[Span]) -> Graph | None:
    start, end, shapes, keys, at = [], [], [], [], []
    for k, m in enumerate(TOKEN.finditer(text)):
        w = m[0]
        if "@" in w or any("0" <= c <= "9" for c in w):
            left = len(w) - len(w.lstrip(EDGE))
            w = w.strip(EDGE)
            if w:
                start.append(m.start() + left)
                end.append(m.start() + left + len(w))
                shapes.append(shape(w))
                digits = "".join(c for c in w if "0" <= c <= "9")
                keys.append(digits if len(digits) >= 3 and "@" not in w else w.lower())
                at.append(k)
    if not start:
        return None
    s, e = np.array(start), np.array(end)
    label = np.zeros(len(s), np.int64)
    for kind, a, b in spans:
        label[(s < b) & (e > a)] = LABELS.index(kind)
    at_ = np.array(at)
    chain = np.flatnonzero(np.diff(at_) == 1)
    last: dict[str, int] = {}
    number: dict[str, int] = {}
    skip = []
    for i, key in enumerate(keys):
        if key in last and at[i] - at[last[key]] > 1:
            skip.append((last[key], i))
        last[key] = i
    seen = {key: i for i, key in reversed(list(enumerate(keys))) if label[i]}  # the first observed one of each key, then the latest so far
    row = set(skip)
    for i, key in enumerate(keys):
        if label[i]:
            seen[key] = i
        elif key in seen and abs(at[i] - at[o := seen[key]]) > 1 and (edge := (min(i, o), max(i, o))) not in row:
            skip.append(edge)
    return Graph(s, e, np.array(shapes, float), label, np.stack([chain, chain + 1], 1), np.array(skip, np.int64).reshape(-1, 2), np.array([number.setdefault(key, len(number)) for key in keys]))


@dataclass
class Field:
    unary: np.ndarray  # N_SHAPE x labels
    chain: np.ndarray  # labels x labels, log potential of (left, right)
    skip: np.ndarray  # labels x labels, symmetric


def fit(graphs: list[Graph], steps: int = 200, l2: float = 1e-3) -> Field:
    """Pseudo-likelihood by gradient ascent: each label given its token's shape and the labels around it; repeats are learned from hidden labels."""
    k = len(LABELS)
    w, one = np.zeros((N_SHAPE + 3 * k, k)), np.eye(k)
    rows, labels = [], []
    for g in graphs:
        y = one[g.label]
        seen = g.label > 0
        known = seen | ~np.isin(g.group, g.group[seen])  # the label of a repeat that no pattern knows is not
        left, right, far = np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
        left[g.chain[:, 1]] = y[g.chain[:, 0]]
        right[g.chain[:, 0]] = y[g.chain[:, 1]]
        np.add.at(far, g.skip[:, 0], y[g.skip[:, 1]])
        np.add.at(far, g.skip[:, 1], y[g.skip[:, 0]])
        rows.append(np.concatenate([g.shape, left, right, far], 1)[known])
        labels.append(y[known])
        # each observed token once more as a repeat whose own label is hidden: alone, without a plus sign, linked to itself
        plain = g.shape[seen].copy()
        plain[:, PLUS] = 0
        none = np.zeros_like(y[seen])
        rows.append(np.concatenate([plain, none, none, y[seen]], 1))
        labels.append(y[seen])
    if rows:
        x, y = np.concatenate(rows), np.concatenate(labels)
        speed = np.zeros_like(w)
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed + x.T @ (y - p) / len(x) - l2 * w
            w += 0.5 * speed
    a, b, c = (w[N_SHAPE + i * k : N_SHAPE + (i + 1) * k] for i in range(3))
    return Field(w[:N_SHAPE], (a + b.T) / 2, (c + c.T) / 2)


def propagate(g: Graph, f: Field, settled: float = 1e-3, observed: float = 30.0) -> np.ndarray:
    """Marginals by loopy sum-product; tokens in base spans are held at their label. Messages go along all edges at once, until none changes
    by ``settled`` (of a log potential). On loops they may swing for ever: the rounds end at four for each token of the longest row of repeats."""
    n, k = len(g.label), len(LABELS)
    unary = g.shape @ f.unary
    unary[g.label > 0] = -observed
    unary[g.label > 0, g.label[g.label > 0]] = observed
    edges = np.concatenate([g.chain, g.skip])
    pot = np.concatenate([np.broadcast_to(f.chain, (len(g.chain), k, k)), np.broadcast_to(f.skip, (len(g.skip), k, k))])
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
    m, back = np.zeros((len(src), k)), np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    belief = unary.copy()
    rounds = 100 + 4 * int(np.bincount(g.group).max())
    for _ in range(rounds if len(edges) else 0):
        out = (belief[src] - m[back])[:, :, None] + pot
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        change = np.abs(new - m).max()
        m = 0.5 * m + 0.5 * new
        belief = unary.copy()
        np.add.at(belief, dst, m)
        if change < settled:
            break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field, min_prob: float) -> list[Span]:
    """Unobserved tokens that repeat an observed one, however many repeats lie between, with a certain label."""
    if not base:
        return []  # nothing is observed that could be repeated
    g = graph(text, base)
    if g is None or not (len(g.skip) and (g.label > 0).any() and (g.label == 0).any()):
        return []
    p = propagate(g, field)
    best = p.argmax(1)
    kin = np.isin(g.group, g.group[g.label > 0])
    hit = np.flatnonzero((g.label == 0) & (best > 0) & (p.max(1) >= min_prob) & kin)
    return [(LABELS[best[i]], int(g.start[i]), int(g.end[i])) for i in hit]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


CANDIDATE = r"[0-9]{4}|@|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"


def train(docs: DataFrame, text_col: str = "text", sample: int = 500, seed: int = 11, most: int = 2000) -> Field:
    """Weights from the first ``sample`` different texts in hash order that may hold a base span. Only their tokens' graphs reach the driver."""
    text = F.col(text_col).cast("string")
    some = docs.select(text.alias("t"), F.xxhash64(text, F.lit(seed)).alias("h"))
    last = some.where(F.col("t").rlike(CANDIDATE)).select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    # the second pass hashes texts and looks into few
    found = some.where(F.col("h") <= F.lit(last)).where(F.col("t").rlike(CANDIDATE)).dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for b in batches:
            got = [(h, graph(t, base_spans(t))) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            got = [(h, pickle.dumps(g)) for h, g in got if g is not None and len(g.label) <= most]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.int64()), pa.array([g for _, g in got], pa.binary())], names=["h", "g"])

    import pickle

    rows = map_batches(found.select("t", "h"), run, "h long, g binary").collect()
    return fit([pickle.loads(r.g) for r in sorted(rows, key=lambda r: r.h)])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, min_prob: float = 0.9) -> DataFrame:
    """Per document: counts by kind, base_sha256, spans (kind:start:end, by kind and start), n_added and n_spans (all)."""
    model = field if field is not None else train(docs, text_col)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, model, min_prob) if base else []
                kinds = [s[0] for s in base]
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest() if base else none, joined(base + more), len(more), len(base) + len(more)]
                for x, v in zip(out, row, strict=True):
                    x.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return map_batches(chosen, run, f"_id {chosen.schema['_id'].dataType.simpleString()}, {RESULT}").withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, text_col: str = "text", field: Field | None = None, min_prob: float = 0.9) -> DataFrame:
    """docs with every span replaced by its kind in brackets; a null text stays null."""
    model = field if field is not None else train(docs, text_col)
    col = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b.column(col):
                text = t.as_py()
                if text:
                    base = base_spans(text)
                    parts, at = [], 0
                    for kind, s, e in sorted(base + added_spans(text, base, model, min_prob), key=lambda x: x[1:]):
                        if e > at:  # spans of two kinds may overlap
                            parts += [text[at:s], f"[{kind}]"] if s >= at else []
                            at = e
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            columns = list(b.columns)
            columns[col] = pa.array(texts, b.schema.field(col).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_batches(docs, run, docs.schema)
