import random

import brute
import pytest

from tallyweave.llm import licences, pii, secrets, tokencounts

SF = "/root/testdata/sf0.01"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (3, "ü" * 50_000 + "@"), (8, "1" * 30_000), (9, "one two\n" * 5000)]


def odd(spark, more=()):
    return spark.createDataFrame([(d, t, "x", 1, "s") for d, t in [*ODD, *more]], "doc_id long, text string, label string, hits long, source string")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same(got, df, f):
    want = sorted(({"doc_id": r.doc_id} | f(r.text) for r in df.select("doc_id", "text").collect()), key=str)
    keys = list(want[0])
    assert sorted(({k: r[k] for k in keys} for r in got), key=str) == want


def noise(seed, parts, n=300):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(n)]


def test_licences(spark):
    texts = noise(1, ["cc ", "by ", "CC-BY ", "General ", "public ", "LICENSE. ", "all rights ", "reserved\n", "é "])
    df = odd(spark, [(100 + i, t) for i, t in enumerate(texts)])
    for d in (df, docs_of(spark)):
        same(licences.report(d).collect(), d, brute.licences)
    words = licences.TEMPLATES[9][1].split()
    words[8:8] = ["oddly", "enough"]
    text = spark.createDataFrame([(1, "x " * 50 + " ".join(words) + " y" * 40), (2, "Foo. Licensed under the Apache License, Version 2.0."), (3, "the gnu under the terms"), (4, "Released under the MIT License. " * 300)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.report(text).collect()}
    assert got[1].labels == "gpl" and got[1].score > 0.6
    assert got[2].labels == "apache-2.0" and got[2].score == 1.0
    assert got[3].labels == "" and got[3].score == 0.0
    assert got[4].labels == "mit"
    assert licences.report(df.limit(0)).count() == 0


def test_secrets(spark):
    texts = noise(2, ["password", "TOKEN", "api_key", "=", ": ", '"', "'", "abcd1234", "AKIA", "ABCD1234EFGH", "0123456789abcdef", " ", "é", "😀", "\n", "secret"])
    df = odd(spark, [(100 + i, t) for i, t in enumerate(texts)])
    for d in (df, docs_of(spark)):
        got = secrets.report(d).collect()
        same(got, d, lambda t: brute.secrets(t)[0])
        base = {r.text: brute.secrets(r.text)[1] for r in d.collect()}
        assert sorted(map(sorted, base.values())) and all(set(brute.secrets(t)[1]) <= {s for r in got if r.doc_id == i for s in r.spans.split(",")} for i, t in [(r.doc_id, r.text) for r in d.collect()][:60])
    url = "see https://bob:hunter2hunter2@db.example.com/x"
    rows = [(i, f"{i} {url}", f"repo{i}") for i in range(5)] + [(9, url.replace("hunter2hunter2", "0nly-mine-7"), "repo9")]
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].spans == "" and got[0].n_example == 1
    assert got[9].spans == f"url:4:{rows[-1][1].index('@') + 1}" and got[9].n_live == 1
    assert secrets.report(df.limit(0)).count() == 0


def test_secrets_of_any_length_are_whole(spark):
    key = "aB3" * 70
    texts = [f"key {key}{i}{'xY7' * 30}{i} end" for i in range(4)] + ["see https://" + "u" * 100 + ":" + "p" * 300 + "@db.example.com/x"]
    rows = [(i, t, f"repo{i}") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i].spans for i in range(4)] == ["mixed:4:306"] * 4 and all(got[i].n_live == 1 for i in range(4))
    assert f"url:4:{texts[4].index('@') + 1}" in got[4].spans.split(",")


def test_pii(spark):
    texts = noise(3, ["a@b.c", "x.y", "@", ".", "-", " ", "+1", "(555)", "123", "10.0.0.1", "4111 1111 1111 1111", "256.1.1.1", "5500000000000004", "ü", "\n", "99"], 500)
    df = odd(spark, [(100 + i, t) for i, t in enumerate(texts)])
    for d in (df, docs_of(spark)):
        got = pii.report(d).collect()
        same(got, d, lambda t: brute.pii(t)[0])
    phone = "Call +1 (243) 555-5526 now. " + "word " * 300 + "His (243) 555-5526 again, and 12 apples."
    docs = docs_of(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + i, phone) for i in range(3)], "doc_id long, text string"))
    got = [r for r in pii.report(docs).collect() if r.doc_id >= 5000]
    assert all(r.n_phone == 1 and set(r.spans.split(",")) >= {"phone:5:22"} for r in got)
    assert not any(r.n_added and not (r.n_email + r.n_ip + r.n_card + r.n_phone) for r in got)
    assert pii.redact(docs.where("doc_id >= 5000")).first().text.startswith("Call [phone] now.")
    assert pii.report(df.limit(0)).count() == 0


def test_propagation_makes_repeated_tokens_agree():
    text = "Call +1 (243) 555-5526 now. " + "word " * 30 + "His 555-5526 again and 777-1234 once."
    field = pii.Field(*(pii.np.zeros((pii.N_SHAPE, 5)), pii.np.zeros((5, 5)), 4 * pii.np.eye(5)))
    base = pii.base_spans(text)
    assert [text[a:b] for _, a, b in pii.added_spans(text, base, field, 0.9)] == ["555-5526"]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_propagation_reaches_every_repeat(spark, n):
    text = ("His 555-5526 early. " + "word " * 30) * (n > 1) + "Call +1 (243) 555-5526 now. " + ("word " * 30 + "His 555-5526 again and 777-1234 ") * n
    field = pii.Field(*(pii.np.zeros((pii.N_SHAPE, 5)), pii.np.zeros((5, 5)), 4 * pii.np.eye(5)))
    added = pii.added_spans(text, pii.base_spans(text), field, 0.9)
    assert [text[a:b] for _, a, b in added] == ["555-5526"] * (n + (n > 1)) and {k for k, *_ in added} == {"phone"}
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), field=field).first().text
    assert "5526" not in out and out.count("777-1234") == n


def test_repeats_with_fitted_weights(spark):
    field = pii.train(docs_of(spark))
    text = "Call +1 (243) 555-5526 now. " + ("word " * 30 + "His (243) 555-5526 again ") * 5
    assert len(pii.added_spans(text, pii.base_spans(text), field, 0.9)) == 10


def test_token_counts(spark):
    df = odd(spark)
    for d in (df, docs_of(spark).limit(300)):
        rows = {(r.doc_id, r.text) for r in d.collect()}
        counter = tokencounts.Counter(tokencounts.read_ranks(RANKS), tokencounts.PATTERN)
        want = []
        for i, t in [(r.doc_id, r.text or "") for r in d.collect()]:
            out = t
            for s, e, new in sorted(tokencounts.masks(t), reverse=True):
                out = out[:s] + new + out[e:]
            want.append((i, counter.total(t), counter.total(out)))
        assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_after) for r in tokencounts.counts(d, RANKS).collect()), key=str) == sorted(want, key=str) and rows
    assert tokencounts.counts(df.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_edits_equal_counting_anew(seed, monkeypatch):
    monkeypatch.setattr(tokencounts, "LEAF", 4)
    r = random.Random(seed)
    counter = tokencounts.Counter(tokencounts.read_ranks(RANKS), tokencounts.PATTERN)
    parts = ["word", " ", "  ", "\n", "'", "ll", "l", "s", "'re", "é", "12", "!?", "x1", " the", "　", ""]
    text = "".join(r.choice(parts) for _ in range(400))
    tree = tokencounts.Tree(text, counter)
    for _ in range(150):
        a = r.randrange(len(text) + 1)
        b = min(len(text), a + r.choice([0, 0, 1, 2, 5, 40]))
        new = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 1, 3, 12])))
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
        assert tree.text == text and tree.total == counter.total(text) and tree.chars[1] == len(text)
