"""Plain re-statements of the contracts, a text at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def secrets(text):
    text = text or ""
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [[m.span() for m in assign.finditer(text) if len(m[2]) >= 8], [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16], [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]]
    spans = sorted((s, k, e) for k, found in enumerate(kinds) for s, e in found)
    return (*map(len, kinds), sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)))


def luhn(digits):
    return sum(d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for n, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }
    return (*(len(x) for x in kinds.values()), sha(",".join(f"{k}:{s}:{e}" for k, found in kinds.items() for s, e in found)))


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def mix_targets(sizes: dict, weights=(5, 2, 1)):
    """Water filling in rounds: cut what is above, reshare the excess by weight."""
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, cut = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in cut)
        free = sum(w[s] for s in names if s not in cut)
        target = {s: 3.0 * sizes[s] if s in cut else left * w[s] / free for s in names}
        more = {s for s in names if s not in cut and target[s] > 3 * sizes[s]}
        if not more:
            return target
        cut |= more


def removed(rows: list[tuple[int, bytes]], length: int = 100):
    """doc id -> (n_removed, n_spans, kept sha) from the first place of every string."""
    seen, out = set(), {}
    for doc, raw in sorted(rows):
        mask = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        out[doc] = (sum(mask), len(re.findall(b"\1+", bytes(mask))), sha(kept))
    return out


def shingles(text, width=5):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else Counter()


def classes(ids, links):
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids}


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def mix(rows, weights=(5, 2, 1)):
    """rows (doc_id, source, text) of different ids -> doc id -> training positions of its copies."""
    sizes, total = {i: len(WORD.findall(t or "")) for i, _, t in rows}, defaultdict(int)
    for i, s, _ in rows:
        total[s] += sizes[i]
    target, names = mix_targets(total, weights), sorted(x for x in total if x is not None) + [None] * (None in total)
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    out = {}
    for n, s in enumerate(names):
        tilt, start = 0.5 if n % 2 == 0 else -0.5, 0
        order = sorted((number(f"{'' if i is None else i}:{digest(t)}"), i, sizes[i]) for i, x, t in rows if x == s)
        for _, i, size in sorted(order, key=lambda x: (x[0] % 4096, x[0])):
            taken = [start + k * total[s] for k in range(3) if size and start + k * total[s] + size / 2 < target[s]]
            out[i] = [((1 + tilt) - ((1 + tilt) ** 2 - 4 * tilt * min(1, w / target[s])) ** 0.5) / (2 * tilt) for w in taken]
            start += size
    return out
