"""Plain versions of the contracts, over small tables in memory."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def suffix_rows(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(s)
        n_spans = len(re.findall(b"\x01+", bytes(gone)))
        out[doc] = (len(raw), sum(gone), n_spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def contamination_rows(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    by_len: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            by_len.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n, known in by_len.items():
            for i in range(len(w) - n + 1):
                if own := known.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def _luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """start, kind, end."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(d := digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


KINDS = ("email", "ip", "card", "phone")


def personal_row(text: str | None) -> tuple:
    spans = base_spans(text)
    n = Counter(k for _, k, _ in spans)
    return (*(n[k] for k in range(4)), sha(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)))


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """Class (smallest id) and number of different sets at 0.8 or more, of each id."""
    sets: dict[frozenset, list[int]] = {}
    alone = {}
    for doc, text in docs:
        s = shingles(text)
        if s:
            sets.setdefault(s, []).append(doc)
        else:
            alone[doc] = (doc, 0)
    keys = list(sets)
    root, links = list(range(len(keys))), [0] * len(keys)

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(keys):
        for j in range(i):
            both = len(a & keys[j])
            if 5 * both >= 4 * (len(a) + len(keys[j]) - both):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, k in enumerate(keys):
        least[top(i)] = min(least.get(top(i), min(sets[k])), *sets[k])
    return alone | {doc: (least[top(i)], links[i]) for i, k in enumerate(keys) for doc in sets[k]}


def fold(doc: int | None, n: int) -> bool:
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % n == 1


def lm_tokens(text: str | None) -> list[str | None]:
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER)), None]


def base_scores(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    c: Counter = Counter()
    for doc, text in docs:
        if not fold(doc, 5):
            c.update(lm_tokens(text))
    total, v = sum(c.values()), len(c)
    out = {}
    for doc, text in docs:
        t = lm_tokens(text)
        out[doc] = (fold(doc, 5), len(t), sum(c[x] > 0 for x in t), total, sum(np.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in t))
    return out


def nearest(vectors: dict[int, np.ndarray], k: int = 20) -> dict[int, list[tuple[int, float]]]:
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()])
    out = {}
    for q in ids[ids % 20 == 0].tolist():
        s = (x * vectors[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def merkle_rows(docs: list[tuple]) -> list[tuple]:
    """Rows of (doc_id, source, lang, n_chars, text): leaf, subroot, root, proof, folded root, verified of each."""
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    hashed = lambda row: sha("".join(map(part, row)))

    def levels(leaves: list[str]) -> list[list[str]]:
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
        out = []
        for level in tree[:-1]:
            a = i // 8 * 8
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
            i //= 8
        return out

    groups: dict = {}
    for row in docs:
        groups.setdefault(row[2], []).append(row)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda row: (row[0] is not None, row[0] or 0, hashed(row)))
    trees = {k: levels([hashed(row) for row in groups[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, row in enumerate(groups[k]):
            own = hashed(row)
            steps = path(trees[k], i) + path(top, n)
            tampers = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            d = hashed((*row[:4], row[4].translate(_LOWER))) if tampers else own
            for a, b in steps:
                d = sha(a + d + b)
            out.append((row[0], own, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), d, d == top[-1][0]))
    return out


def hard_negatives(rows: list[tuple]) -> list[tuple]:
    """Rows of (vec_id, embedding, label), by scoring all pairs in whole numbers."""
    own: dict = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            own[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * x)) for x in v)] = True
    out = []
    for a, la, va in own:
        if a % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label == la) for i, label, v in own if i != a)
            for sp, p, _ in [s for s in scored if s[2]][:5]:
                fits = [s for s in scored if not s[2] and 30 * -sp <= 100 * -s[0] <= 90 * -sp][:10]
                out.extend((a, p, rank, i, -sp, -s) for rank, (s, i, _) in enumerate(fits, 1))
    return sorted(out)
