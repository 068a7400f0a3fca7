"""Plain versions of the operators' results, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

KINDS = ("email", "ip", "card", "phone")
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pii(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def secrets(text: str) -> list[tuple[str, int, int]]:
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def simhash(text: str, words: int) -> int:
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text: str, words: int) -> set[bytes]:
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or ({b" ".join(w)} if w else set())


def components(ids: list[int], linked) -> dict[int, int]:
    """The smallest id reachable from each id; ``linked`` takes two places."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(ids))}


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(items: list[tuple[object, str]], text: str, size: int) -> tuple[int, set[int], set[object]]:
    known: dict[tuple, set] = {}
    for i, t in items:
        w = WORD.findall(t.encode().lower())
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add(i)
    words = WORD.findall(text.encode().lower())
    hit, found = set(), set()
    for n in {len(k) for k in known}:
        for k in range(len(words) - n + 1):
            if got := known.get(tuple(words[k : k + n])):
                found |= got
                hit.update(range(k, k + n))
    return len(words), hit, found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
