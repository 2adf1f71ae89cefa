"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

WS = re.compile(r"[\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = [w for w in WS.split(lower(text or "")) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_groups(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), from all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def license_places(text: str | None, phrases: list[tuple[str, str]]) -> tuple[int, list[tuple[int, str]]]:
    words = LICENSE_WORD.findall(lower(text or ""))
    out = []
    for phrase, label in phrases:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(out)
