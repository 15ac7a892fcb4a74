"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(docs: list[tuple[int, str | None]], threshold: int = 100) -> dict[int, tuple]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256); ids are unique."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - threshold + 1):
            piece = data[p : p + threshold]
            if piece in seen:
                gone[p : p + threshold] = True
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()) if len(data) else 0
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text: str | None) -> int:
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text: str | None, n: int = 5) -> set[str]:
    """Word shingles of a lower-cased text; fewer words are one shingle."""
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def near_pairs(texts: list[str | None], similarity: float = 0.8) -> list[tuple[int, int]]:
    """Pairs of texts with equal or similar shingle sets, found through the shingles they share."""
    sets = [frozenset(shingles(t)) for t in texts]
    shared: dict[tuple[int, int], int] = {}
    where: dict[str, list[int]] = {}
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    for i, s in enumerate(sets):
        for shingle in s if first[s] == i else ():
            for j in where.setdefault(shingle, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            where[shingle].append(i)
    near = [(j, i) for (j, i), n in shared.items() if n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
    return near + [(first[s], i) for i, s in enumerate(sets) if first[s] != i]


def smallest_reachable(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def targets(sizes: dict, weights=(1, 2, 3), most: int = 3) -> dict:
    """Target words per source by resharing round after round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        found = {s: most * sizes[s] if s in capped else left * weight[s] / total for s in order}
        above = {s for s in order if found[s] > most * sizes[s]}
        if not above:
            return found
        capped |= above


def need(n: int, share: float = 0.8) -> int:
    return math.ceil(share * n - 1e-9)
