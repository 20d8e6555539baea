import random

import brute
import pytest

from tallyweave.llm import repeats, scratch


def corpus(seed=2):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [text(k) for k in (45, 60, 70, 120, 300)]
    docs = []
    for i in range(60):
        parts = [text(r.randrange(0, 90)) for _ in range(3)]
        parts.insert(1, r.choice(passages)[r.randrange(4) : None if r.random() < 0.5 else -r.randrange(1, 9)])
        docs.append((i, "".join(parts)))
    docs += [(100 + i, docs[i][1]) for i in range(4)] + [(200, "x" * 500), (201, "x" * 49 + "y"), (202, "ab" * 200), (203, "short"), (204, "short"), (205, None), (206, ""), (207, passages[2] * 3), (None, docs[7][1]), (208, text(50)), (209, docs[3][1][:50])]
    return docs


@pytest.mark.parametrize(("hot", "segment"), [(1_000_000, 1 << 19), (300, 37)])
def test_against_brute_force(spark, monkeypatch, hot, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", i, 7) for i, (d, t) in enumerate(rows)], "doc_id long, text string, bytes string, _row int, _ranges int")
    got = sorted((r.asDict() for r in repeats.report(docs, length=50, passage=32, gram=8).collect()), key=str)
    assert got == sorted(brute.repeats(rows, 50, 32), key=str)
    if hot > 300:
        out = repeats.cleaned(docs, length=50, gram=8)
        assert out.columns == docs.columns
        kept = {r._row: r.text for r in out.collect() if r._ranges == 7 and r.bytes == "x"}
        want = list(brute.repeats(rows, 50))
        assert all(len((kept[i] or "").encode()) <= w["n_bytes"] - w["n_removed"] <= len((kept[i] or "").encode()) + 2 * w["n_spans"] for i, w in enumerate(want))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.asDict() for r in repeats.report(docs).collect()), key=str)
    assert got == sorted(brute.repeats([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert any(r["n_spans"] for r in got)
    assert repeats.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_texts_without_ranges_are_left_out(spark, monkeypatch, sent):
    monkeypatch.setattr(repeats, "WORDS_SENT", sent)
    numbers = [0, 1, 63, 64, 130, (5 << 36) + 63, (5 << 36) + 64]
    docs = spark.createDataFrame([(n, f"text {n}") for n in numbers], "_row long, _text string")
    wanted = docs.where("_row in (0, 63, 64, 343597383743)").select("_row")
    got = sorted(r._row for r in repeats._among(docs, wanted.unionByName(wanted)).collect())
    assert got == ([0, 63, 64, (5 << 36) + 63] if sent else numbers)
    assert repeats._among(docs, wanted.limit(0)).count() == 0


def test_runs_are_not_kept(spark, tmp_path, monkeypatch):
    """The table of all runs is given up once the shared ones are written."""
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    repeats.report(spark.createDataFrame(corpus(), "doc_id long, text string"), length=50, passage=32, gram=8).count()
    assert list(tmp_path.glob("*/known")) and not list(tmp_path.glob("*/scanned"))
