"""Slow, independent versions of operators for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, k: int) -> set:
    w = WORD.findall(ascii_lower(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def repeats(rows: list[tuple[int, list[str]]], n: int) -> list[dict[int, int]]:
    """For each run of n words in two or more texts: doc_id to its first place."""
    at: dict[tuple, dict[int, int]] = defaultdict(dict)
    for d, w in rows:
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].setdefault(d, i)
    return [m for m in at.values() if len(m) > 1]


def near_duplicate_components(rows: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, component), by all pairs that share a shingle."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = set()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                        x, y = sorted((top(a), top(b)))
                        parent[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def leaks(rows: list[tuple[int, str | None]], items: list[tuple[int, str]]) -> dict[tuple[int, int], tuple[int, float]]:
    """(doc_id, item_id) to the best passage's first word and its score."""
    from math import log
    from string import punctuation

    def words(text):
        return [w.strip(punctuation) or w for w in WORD.findall(text.lower())]

    def shingled(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    def in_order(answer, w):
        best = [0] * (len(w) + 1)
        for a in answer:
            new = [0]
            for j, x in enumerate(w):
                new.append(max(new[j], best[j + 1], best[j] + 1 if x == a else 0))
            best = new
        return best[-1] / len(answer)

    classes = defaultdict(list)
    for i, t in items:
        step = 64
        while step < len(words(t)):
            step *= 2
        classes[step].append((i, t))
    out: dict = {}
    for step, own in classes.items():
        texts = {i: words(t) for i, t in own}
        df, mean = defaultdict(int), sum(map(len, texts.values())) / len(texts)
        for w in texts.values():
            for x in set(w):
                df[x] += 1
        weight = {}
        for i, w in texts.items():
            raw = {x: log(1 + (len(own) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
            weight[i] = {x: v / sum(raw.values()) for x, v in raw.items()}
        for d, text in rows:
            w = words(text or "")
            for p in range(0, len(w), step):
                passage = w[p : p + 2 * step]
                have = set(passage)
                for i, t in own:
                    score = sum(v for x, v in weight[i].items() if x in have)
                    if score < 0.5 - 1e-9:
                        continue
                    cut = list(re.finditer(r"[.?!:]\s+(?=\S)|\n+(?=\S)", t.rstrip()))
                    q, a = (words(t[: cut[-1].end()]), words(t[cut[-1].end() :])) if cut else (words(t), [])
                    share = []
                    for part in (q, a, texts[i]):
                        k = max(1, min(5, len(part)))
                        there = shingled(part, k)
                        share.append(len(there & shingled(passage, k)) / len(there) if there else 1.0)
                    if max(share[0], share[2]) >= 0.8 > share[1] and a:
                        k = max(1, min(5, len(q)))
                        grams = [tuple(passage[j : j + k]) for j in range(len(passage) - k + 1)]
                        at = [j for j in range(len(q) - k + 1) if tuple(q[j : j + k]) in set(grams)]
                        if at:
                            left = len(q) - k - at[-1] + 2 * len(a) + 8
                            ends = [p + j + k for j, g in enumerate(grams) if g == tuple(q[at[-1] : at[-1] + k])]
                            share[1] = max([share[1], *(in_order(a, w[e : e + left]) for e in ends)])
                    if max(share[0], share[2]) >= 0.8 and share[1] >= 0.8 and out.get((d, i), (0, -1.0))[1] < round(score, 6):
                        out[d, i] = (p, round(score, 6))
    return out
