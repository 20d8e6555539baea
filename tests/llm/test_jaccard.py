import random

import brute
import numpy as np
import pytest

from tallyweave.llm import jaccard
from tallyweave.llm.components import components
from tallyweave.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def planted(seed=3):
    """Copies, chains of edits, boundary cases of 75 percent, shared passages, odd rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    docs, base = [], [r.choices(vocab, k=60 + 30 * i) for i in range(8)]
    passage = r.choices(vocab, k=40)
    for b in base:
        docs.append(list(b))
        docs.append(list(b))
        step = list(b)
        for _ in range(6):
            step = list(step)
            for _ in range(max(1, len(step) // 55)):
                step[r.randrange(len(step))] = r.choice(vocab)
            docs.append(step)
        for cut in (0.7, 0.74, 0.75, 0.76, 0.8):
            docs.append(b[: int(len(b) * cut)])
        docs.append(passage + r.choices(vocab, k=60))
        docs.append(r.choices(vocab, k=30) + passage)
    docs += [b[:k] for b in base[:3] for k in (1, 2, 4, 5, 6, 7)]
    texts = [" ".join(d) for d in docs] + ["A b C", "a  B\tc", "", None, " \n", "x"] + ["same words over and over " * 50] * 2
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [(None, "A b C"), (rows[0][0], rows[0][1])]


def check(df, rows):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())
    assert got == sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in brute.jaccard(rows))


@pytest.mark.parametrize("leaf", [2_000_000, 300])
def test_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "SLICE", leaf // 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    rows = planted()
    docs = spark.createDataFrame([(d, t, i, "s") for i, (d, t) in enumerate(rows)], "doc_id long, text string, n long, _row string").repartition(4)
    check(jaccard.join(docs), rows)
    if leaf > 300:
        kept = jaccard.distinct(docs)
        want = {r["component_id"] for r in brute.jaccard(rows) if r["n_shingles"]}
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect() if (r.text or "").split()} == want


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(jaccard.join(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.join(docs.limit(0)).count() == 0


def test_leaf_against_all_pairs():
    r = random.Random(5)
    for trial in range(60):
        sets = []
        for _ in range(r.randrange(2, 25)):
            s = set(r.sample(range(10**6), 30)) if not sets or r.random() < 0.3 else set(r.choice(sets))
            for _ in range(r.randrange(8)):
                s.add(r.randrange(10**6)) if r.random() < 0.5 else s.discard(r.choice(sorted(s)))
            sets.append(s)
        offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        links = jaccard.join_leaf(np.arange(len(sets)), np.concatenate([sorted(s) for s in sets]), offs, 75)
        assert groups(links, len(sets)) == groups([(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], len(sets))
        assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)


def groups(links, n):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [x if v == y else v for v in root]
    by = {}
    for i, v in enumerate(root):
        by.setdefault(v, []).append(i)
    return sorted(by.values())


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(300)] + [(r.randrange(3000, 3400), r.randrange(3000, 3400)) for _ in range(150)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    want = {}
    for g in groups(edges, 3400):
        want |= dict.fromkeys(g, g[0]) if len(g) > 1 else {}
    assert got == want
