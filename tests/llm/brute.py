"""Slow, plain versions of the operators' contracts, to test against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WHITE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def quality(text):
    t = text or ""
    w = re.findall(WHITE, t)
    n = len(w)
    lines, seen, dup = [x for x in t.split("\n") if re.search(WHITE, x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    count = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    mark = set()
    for i in range(n - 7):
        if count[tuple(w[i : i + 8])] > 1:
            mark.update(range(i, i + 8))
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": dup,
        "n_repeat_words": len(mark),
        "base_failed": n < 20 or 100 * len(mark) > 30 * n,
    }


def fingerprint(text, k=4, seed=42):
    w = re.findall(WHITE, lower(text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def simhash(rows):
    fps = {i: fingerprint(t) for i, t in rows}
    by = defaultdict(list)
    for i, f in fps.items():
        by[f].append(i)
    comp = components(by, lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(lambda: float("inf"))
    for f, ids in by.items():
        least[comp[f]] = min(least[comp[f]], *ids)
    return {i: (f"{f:016x}", least[comp[f]]) for i, f in fps.items()}


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))


def repeats_removed(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha of what is left)}, rows in doc_id order."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    """[(kind, start, end)] of the base kinds."""
    t, out = text or "", []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    found = [(i, label) for p, label in PHRASES.items() for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))
