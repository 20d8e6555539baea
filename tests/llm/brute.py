"""Plain Python versions of the results that the queries must give."""

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": n < 50 or 100 * len(hit) > 50 * n}


def decontamination(docs, items, n=13):
    wins = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in wins}
    for doc_id, text in docs:
        w, hit, found = ALNUM.findall((text or "").translate(LOW)), set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if tuple(w[i : i + s]) in wins:
                    hit.update(range(i, i + s))
                    found |= wins[tuple(w[i : i + s])]
        yield {"doc_id": doc_id, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit) and 20 * len(hit) >= len(w)}


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """sizes: words by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        got = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = {s for s in rest if got[s] > most * sizes[s]}
        if not over:
            return got | {s: most * sizes[s] for s in full}
        full |= over


def jaccard(docs, percent=75, n=5):
    sets = []
    for _, text in docs:
        w = SPACED.findall((text or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for h in s:
            by.setdefault(h, []).append(i)
    pairs = Counter((a, b) for x in by.values() if len(x) < 400 for k, a in enumerate(x) for b in x[:k])
    for (a, b), both in pairs.items():
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [{"doc_id": d, "n_shingles": len(sets[i]), "component_id": least.get(find(i))} for i, (d, _) in enumerate(docs)]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def licences(text):
    w, phrases = ALNUM.findall((text or "").translate(LOW)), {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    at = sorted((i, x) for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return {"n_words": len(w), "n_base": len(at), "first_word": at[0][0] if at else None, "last_word": at[-1][0] if at else None, "base_labels": ",".join(sorted({x for _, x in at}))}


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out.sort()
    return {f"n_{k}": sum(o[3] == k for o in out) for k in ("assign", "access", "hex")} | {"base_sha256": sha((k, a, b) for a, _, b, k in out)}, [f"{k}:{a}:{b}" for a, _, b, k in out]


def pii(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    out.sort(key=lambda s: (kinds.index(s[0]), s[1]))
    return {f"n_{k}": sum(s[0] == k for s in out) for k in kinds} | {"base_sha256": sha(out)}, [f"{k}:{a}:{b}" for k, a, b in out]


def _covered(raw, length):
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield gone


def repeats(docs, length=400, passage=256):
    raw = [(t or "").encode() for _, t in docs]
    for (d, _), b, gone, short in zip(docs, raw, _covered(raw, length), _covered(raw, passage), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield {"doc_id": d, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": len(re.findall(b"\x01+", bytes(gone))), "kept_sha256": hashlib.sha256(kept).hexdigest(), "n_passage": sum(short)}
