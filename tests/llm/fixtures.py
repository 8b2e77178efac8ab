"""Small corpora with every awkward case, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

SMALL = "/root/testdata/sf0.001"
#: doc_id, text and columns whose names the operators use themselves.
SCHEMA = (
    "doc_id long, text string, part int, score double, cluster long, kept boolean, n_tokens long, `offset` long, "
    "dropped_id long, own_sha string, kept_id long, kept_sha string"
)
WORD = re.compile("[^\x20\x09-\x0d]+")


def rows(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    return [(i, t, 1, 0.5, 7, None, 3, 4, i, "x", i, "y") for i, t in texts]


def corpus(seed: int, count: int = 60) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, repeated words, empty and null texts; ids not in order."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ñ"[:7]) for _ in range(rng.randint(1, 6))).replace(" ", "x") for _ in range(300)]

    def prose(n: int) -> list[str]:
        return [rng.choice(words) for _ in range(n)]

    passage, out = prose(60), []
    for _ in range(count):
        kind = rng.random()
        if out and kind < 0.15:
            text = rng.choice(out)
        elif out and kind < 0.4:
            parts = (rng.choice(out) or "").split(" ")
            for _ in range(rng.randint(1, 3)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        elif kind < 0.55:
            cut = rng.randint(0, 40)
            text = " ".join(prose(rng.randint(0, 80)) + passage[cut : cut + rng.randint(5, 60)] + prose(rng.randint(0, 80)))
        elif kind < 0.6:
            text = " ".join([rng.choice(words)] * rng.randint(1, 60))
        else:
            text = " ".join(prose(rng.randint(1, 200)))
        if rng.random() < 0.2:
            text = text.replace(" ", rng.choice(["\n", "  ", "\t \r\n"]), 3)
        out.append(text)
    texts: list[tuple[int | None, str | None]] = list(zip(rng.sample(range(10 * count), count), out, strict=True))
    return [*texts, (100_000, None), (100_001, ""), (100_002, " \n\t"), (100_003, "one"), (100_004, "Two WORDS"), (100_005, "a b c"), (100_006, "a B c")]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def near_components(texts, percent: int, n: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of its set, smallest doc_id of its component), comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets.items():
        for b, t in sets.items():
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def kept_words(texts, window: int) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda r: r[0]):
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        left = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def kept_bytes(texts, length: int) -> dict[int, tuple[int, int, int, str]]:
    first: dict[bytes, int] = {}
    out = {}
    for i, t in sorted(texts, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k : k + length], i) < i:
                gone[k : k + length] = b"\x01" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def exact_groups(texts) -> dict[int, tuple]:
    groups = defaultdict(list)
    plain = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in texts}
    for i, t in plain.items():
        groups[t].append(i)
    return {
        i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for i, t in plain.items()
    }


def edit_distance_within(pattern: bytes, text: bytes) -> int:
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


