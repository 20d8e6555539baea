import random

import numpy as np
import pytest

from tallyweave.llm import suffixes


def _strings(r):
    for _ in range(300):
        n, k = r.randrange(1, 120), r.choice([1, 2, 3, 26])
        t = [r.randrange(k) for _ in range(n)]
        yield (t[: max(1, n // 5)] * 6)[:n] if r.random() < 0.4 else t


@pytest.mark.parametrize("bucket", [1, 8, 10_000])
def test_suffix_array(monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    for t in _strings(random.Random(bucket)):
        got = suffixes.suffix_array(np.array(t, np.int64)).tolist()
        assert got == sorted(range(len(t)), key=lambda i: t[i:])


def test_common_prefixes():
    for t in _strings(random.Random(3)):
        data = np.array(t, np.uint8)
        order = suffixes.suffix_array(data)
        want = [0]
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            want.append(k)
        assert suffixes.common_prefixes(data, order).tolist() == want


def test_repeated():
    r = random.Random(4)
    for length in (8, 13, 20):
        for _ in range(60):
            parts = [[r.choice(b"ab") for _ in range(r.randrange(length, 60))] for _ in range(4)]
            parts.append(list(parts[0][3:]) if len(parts[0]) >= length + 3 else list(parts[0]))
            data, flags = [], []
            for p in parts:
                data += [*p, 0]
                flags += [i + length <= len(p) for i in range(len(p) + 1)]
            data = np.array(data, np.uint8)
            order = suffixes.suffix_array(data)
            got = suffixes.repeated(order, suffixes.common_prefixes(data, order), np.array(flags), length)
            win = {i: tuple(data[i : i + length]) for i, f in enumerate(flags) if f}
            count = {}
            for w in win.values():
                count[w] = count.get(w, 0) + 1
            assert set(np.flatnonzero(got).tolist()) == {i for i, w in win.items() if count[w] > 1}
