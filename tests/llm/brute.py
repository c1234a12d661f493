"""Plain single-process versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text: str | None) -> int:
    words = BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict[int, int], distance: int = 4) -> dict[int, int]:
    """doc_id -> smallest reachable doc_id, from doc_id -> fingerprint."""
    up = {d: d for d in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def without_repeats(texts: list[bytes], length: int = 200) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 per text."""
    places = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            places[hash(t[i:i + length])] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if places[hash(t[i:i + length])] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def edited(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, str, str]]:
    """doc_id -> n_chars, edited text, next text, for distinct ids."""
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        k = len(t) // 3
        out[d] = (len(t), t[:len(t) - k] + following[:k], following)
    return out


def lthash(text: str) -> list[int]:
    """The fingerprint by the rule in fingerprint.py: paragraph hashes, clause bit counts, clauses."""
    import regex

    def h(k, s):
        return xxhash.xxh64_intdigest(s.encode(), seed=xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed=42))

    lanes = [sum(h(k, p) % 2**60 for p in text.split("\n")) % 2**60 for k in range(4)]
    parts = [c for c in regex.split(r"[^\p{L}\p{N} \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*", text) if c]
    for k in range(2):
        hashes = [h(4 + k, c) for c in parts]
        bit = [sum(x >> b & 1 for x in hashes) % 2**20 for b in range(63)]
        lanes += [bit[s] | bit[s + 21] << 21 | bit[s + 42] << 42 for s in range(21)]
    return lanes + [len(parts)]


def mix_targets(sizes: dict[str | None, int], weights=(5, 2, 1), share=1.5, most=2.0) -> dict[str | None, float]:
    """Targets by sharing out and resharing the excess until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    total = share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > most * sizes[s]]
        if not over:
            return fixed | shares
        fixed |= {s: most * sizes[s] for s in over}


def held_out(doc_id: int, divisor: int, rest: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % divisor == rest


def top(vectors: list[tuple[int, list[float]]], k: int = 10, every: int = 100) -> list[tuple[int, int, int, int]]:
    """(query_id, rank, vec_id, score) of every row whose id is divisible by `every` against all rows of other ids."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for j, w in whole if j == q for i, v in whole if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out
