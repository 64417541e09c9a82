"""Plain restatements of what the operators have to return, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_components(docs: list[tuple[int, str | None]], percent: int = 85) -> list[tuple[int, int, int, bool]]:
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UP))
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = {d: d for d, _ in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    index: dict = {}
    for i, s in enumerate(sets):
        shared: Counter = Counter()
        for g in s:
            shared.update(index.get(g, ()))
            index.setdefault(g, []).append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(docs[i][0]), find(docs[j][0])))
                root[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(docs, sets))


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], share: float = 0.8) -> set[tuple[int, int]]:
    """(doc_id, item_id) where a window as long as the item (or a shorter one at the end) is similar enough."""
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    short = [(i, words(t)) for i, t in items if 0 < len(words(t)) < 5]
    bench = [(i, len(words(t)), Counter(grams(words(t)))) for i, t in items if len(words(t)) >= 5]
    having: dict = {}
    for x in bench:
        for g in x[2]:
            having.setdefault(g, []).append(x)
    out = set()
    for d, text in docs:
        w = words(text)
        g = grams(w)
        out |= {(d, i) for i, item in short if any(w[p : p + len(item)] == item for p in range(len(w)))}
        for x in {id(x): x for y in set(g) for x in having.get(y, ())}.values():
            item, n, want = x
            for p in range(len(g)):
                got = Counter(g[p : p + n - 4])
                if sum((got & want).values()) >= share * sum((got | want).values()) - 1e-12:
                    out.add((d, item))
                    break
    return out


def licenses(docs: list[tuple[int, str | None]], base: tuple) -> dict[int, tuple]:
    out = {}
    for d, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UP))
        at = [(i, label) for phrase, label in base for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        out[d] = (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    return out


def license_labels(text: str | None, base: tuple, templates: tuple, slack: int, cover: float) -> tuple[str, float]:
    """Labels and score: base phrases exactly, templates by the pairs of words found near one place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UP))
    labels = {x for p, x in base if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
    score = float(bool(labels))
    for phrase, label in templates:
        t = phrase.split()
        for d in range(-len(t), len(w)):
            seen = {o for o in range(len(t) - 1) for e in range(slack + 1) if o + d + e >= 0 and w[o + d + e : o + d + e + 2] == t[o : o + 2]}
            if len(seen) / (len(t) - 1) >= cover:
                labels.add(label)
                score = max(score, len(seen) / (len(t) - 1))
    return ",".join(sorted(labels)), score


def shard_of(key: object, shards: int, size: int) -> tuple[int, int]:
    """Slot and shard by simulating the turns from the definition."""
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    prefers = [[(number(f"shard-{i}|offset") % size + j * (1 + number(f"shard-{i}|skip") % (size - 1))) % size for j in range(size)] for i in range(shards)]
    owner: dict[int, int] = {}
    turn = 0
    while len(owner) < size:
        owner[next(s for s in prefers[turn % shards] if s not in owner)] = turn % shards
        turn += 1
    slot = number("" if key is None else str(key)) % size
    return slot, owner[slot]


def nearest(rows: list[tuple[int, list | None]], k: int, every: int) -> list[tuple[int, int, int, float]]:
    fine = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None for c in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, x in fine:
        if q % every:
            continue
        scored = []
        for i, y in fine:
            if i != q and len(x) == len(y):
                s = 0.0
                for a, b in zip(x.tolist(), y.tolist()):
                    s += a * b
                scored.append((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def kept_lines(docs: list[tuple[int, str | None]], min_words: int = 5) -> dict[int, str | None]:
    """Texts less every line that repeats an earlier one: within one word, or, under so many words, exactly."""
    lines = [(d, n, x, x.translate(_UP).split()) for d, t in sorted(docs, key=lambda x: x[0]) if t for n, x in enumerate(t.split("\n"))]
    seen, gone = [], set()
    for d, n, _, w in lines:
        if not w:
            continue
        if any(_within_one(w, v) if min(len(w), len(v)) >= min_words else w == v for v in seen):
            gone.add((d, n))
        seen.append(w)
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) if t else t for d, t in docs}


def _within_one(a: list, b: list) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
