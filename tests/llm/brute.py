"""Plain Python versions of the contracts, to test the operators against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

KINDS = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def base_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def simhash_components(rows):
    """(doc_id, fingerprint hex, component) of (doc_id, text)."""
    prints = [(d, fingerprint(t)) for d, t in rows]
    groups, distinct = Groups(), sorted({f for _, f in prints})
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                groups.join(a, b)
    least = {}
    for d, f in prints:
        if d is not None:
            r = groups.find(f)
            least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least.get(groups.find(f))) for d, f in prints]


def passages(rows, window=50):
    """(doc_id, words, removed, digest of what is kept) of (doc_id, text)."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def line_dedup(rows, ratio, least):
    """(key, kept text) of (key, host, text)."""
    pages, holds = defaultdict(int), defaultdict(int)
    for _, host, text in rows:
        pages[host] += 1
        for bare in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""} if text is not None else ():
            holds[host, bare] += 1
    bad = {k for k, n in holds.items() if n >= least and n > ratio * pages[k[0]]}
    return [(k, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\r")) not in bad)) for k, h, t in rows]


def near_groups(rows, words=5, similarity=0.8):
    """doc_id -> least doc_id of its group."""
    sets, groups = {}, Groups()
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                groups.join(a, b)
    least = {}
    for d in ids:
        least.setdefault(groups.find(d), d)
    return {d: least[groups.find(d)] for d in ids}
