"""Plain versions of the contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def entity(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def personal(text: str) -> tuple[list[int], str]:
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(BASE[kind], text) if entity(kind, m[0])]
    found.sort()
    return [sum(k == i for _, k, _ in found) for i in range(4)], ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def shingles(text: str, width: int) -> set[tuple[str, ...]]:
    w = WORD.findall(lower(text))
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_components(texts: dict[int, str], width: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    index = defaultdict(list)
    for i, own in sets.items():
        common = Counter(j for s in own for j in index[s])
        for s in own:
            index[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, held = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(3.0 * sizes[s] for s in held)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in held else share[s] for s in names}
        held |= over


def base_scores(texts: dict[int, str]) -> tuple[dict[int, float], dict[int, int], int]:
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    counts = Counter(w for i, ts in tokens.items() if crc32(str(i).encode()) % 7 != 2 for w in ts)
    n, v = sum(counts.values()), len(counts)
    return {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts) for i, ts in tokens.items()}, {i: sum(counts[w] > 0 for w in ts) for i, ts in tokens.items()}, n


def edits(texts: dict[int, str]) -> dict[int, str]:
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    out = {}
    for i in order:
        cut = len(texts[i]) // 3
        out[i] = texts[i][: len(texts[i]) - cut] + texts[following[i]][:cut]
    return out
