"""Plain-Python versions of the contracts."""

import hashlib
import re

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def components(ids, edges):
    p = {i: i for i in ids}

    def find(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def secrets(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    spans.sort()
    n = [sum(k == s[2] for s in spans) for k in ("assign", "access", "hex")]
    return (*n, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)))


def secrets_of_corpus(docs, owners_of_example=3):
    """doc_id -> (spans, n_live, n_example) of {doc_id: (text, owner)}."""
    from math import log2

    def bits(s):
        return -sum(n / len(s) * log2(n / len(s)) for n in (s.count(c) for c in set(s)))

    found, owners = {}, {}
    for d, (text, owner) in docs.items():
        text, own = text or "", []
        for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            if len(m[2]) >= 12:
                own.append((m.start(), 0, "assign", m.end(), m[2]))
        own += [(m.start(), 1, "access", m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        own += [(m.start(), 2, "hex", m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        base = list(own)
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            s = m[0]
            classes = (re.search(x, s) for x in ("[0-9]", "[a-z]", "[A-Z]"))
            if len(s) >= 24 and all(classes) and bits(s) >= 3.5 and not any(a < m.end() and m.start() < b for a, _, _, b, _ in base):
                own.append((m.start(), 3, "wide", m.end(), s))
        found[d] = sorted(own)
        for *_, value in own:
            owners.setdefault(value, set()).add(owner)
    out = {}
    for d, own in found.items():
        live = [len(owners[x[4]]) < owners_of_example for x in own]
        shown = [x for x, y in zip(own, live) if y or x[1] < 3]
        out[d] = (",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in shown), sum(live), sum(len(owners[x[4]]) >= owners_of_example for x in shown))
    return out


def lines(docs, least=40, docs_needed=5):
    key = lambda s: s.encode().strip(SPACE).lower().decode()
    holds = {}
    for d, t in docs.items():
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                holds.setdefault(key(s), set()).add(d)
    out = {}
    for d, t in docs.items():
        every = (t or "").split("\n")
        kept = [s for s in every if len(holds.get(key(s), ())) < docs_needed or max(holds[key(s)]) == d]
        out[d] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


def word_windows(docs, w=13):
    least = {}
    split = {d: (t or "").encode().split() for d, t in docs.items()}
    for d in sorted(split):
        for i in range(len(split[d]) - w + 1):
            least.setdefault(tuple(split[d][i : i + w]), d)
    out = {}
    for d, ws in split.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if least[tuple(ws[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        out[d] = (len(ws), sum(gone), sha(b" ".join(x for x, g in zip(ws, gone) if not g)))
    return out


def byte_windows(docs, w=100):
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            x = b[i : i + w]
            if x in seen:
                gone[i : i + w] = b"\1" * w
            seen.add(x)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(docs, k=4, percent=80):
    s = {d: shingles(t, k) for d, t in docs.items()}
    edges = [(a, b) for a in s for b in s if a < b and (n := len(s[a] & s[b])) and 100 * n >= percent * len(s[a] | s[b])]
    c = components(s, edges)
    return {d: (len(s[d]), c[d], c[d] == d) for d in s}


def vectors(rows, least=0.95):
    good = {i: np.array(v, float) for i, v in rows.items() if v and None not in v and np.isfinite(v).all() and np.any(v)}
    edges, n = [], dict.fromkeys(rows, 0)
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y) and float(x @ y) / float(np.sqrt((x @ x)) * np.sqrt(y @ y)) >= least:
                n[a] += 1
                edges.append((a, b))
    c = components(rows, edges)
    return {i: (n[i], c[i], c[i] == i) for i in rows}


def leaks(docs, items, least=0.8, k=5):
    """(doc, item) -> (start, words, similarity) over all item-sized windows at every start."""
    from collections import Counter

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = {}
    for item, text in items.items():
        w = words(text)
        n = min(k, len(w))
        if not n:
            continue
        own = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        size = sum(own.values())
        for d, t in docs.items():
            every = words(t)
            runs = [tuple(every[i : i + n]) for i in range(len(every) - n + 1)]
            if own.keys().isdisjoint(runs):
                continue
            best = None
            for start in range(max(1, len(runs) - size + 1)):
                window = Counter(runs[start : start + size])
                both = sum((own & window).values())
                if both:
                    s = both / (size + sum(window.values()) - both)
                    if s >= least and (best is None or s > best[2]):
                        best = (start, size + n - 1, s)
            if best:
                out[d, item] = best
    return out
