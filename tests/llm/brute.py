"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return WORD.findall(lower_ascii(text) if lower else text)


def shingle_set(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i: i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def jaccard_components(rows: list[tuple], width: int = 4, similar: tuple[int, int] = (85, 100)) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, every pair compared."""
    sets = [shingle_set(t, width) for _, t in rows]
    label = list(range(len(rows)))
    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    near = set()
    for held in holders.values():
        near.update((a, b) for x, a in enumerate(held) for b in held[x + 1:])
    for a, b in near:
        both = len(sets[a] & sets[b])
        if similar[1] * both >= similar[0] * len(sets[a] | sets[b]) and label[a] != label[b]:
            label = [label[a] if v == label[b] else v for v in label]
    low: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and (low.get(label[i]) is None or doc < low[label[i]]):
            low[label[i]] = doc
    return sorted(((d, len(sets[i]), low.get(label[i])) for i, (d, _) in enumerate(rows)), key=str)
