"""Plain versions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

A_Z = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(A_Z))


def passages(documents, benchmark, window=10):
    items = defaultdict(set)
    for item, text in benchmark:
        found = words(text)
        if not found:
            continue
        size = min(window, len(found))
        for i in range(len(found) - size + 1):
            items[tuple(found[i : i + size])] |= {str(item)} - {"None"}
    sizes = sorted({len(k) for k in items})
    rows = []
    for doc, text in documents:
        found, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                window_words = tuple(found[i : i + size])
                if window_words in items:
                    hit |= set(range(i, i + size))
                    names |= items[window_words]
        rows.append((doc, len(found), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return rows


def lines(documents, min_chars=20, min_documents=3):
    return [
        (doc, n_lines, n_lines - len(kept), sha("\n".join(kept)))
        for doc, n_lines, kept in kept_lines(documents, min_chars, min_documents)
    ]


def kept_lines(documents, min_chars=20, min_documents=3):
    """For each document: id, lines before, the lines that stay."""
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(A_Z)

    holders = defaultdict(set)
    for doc, text in documents:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    order = lambda doc: (doc is not None, doc or 0)
    rows = []
    for doc, text in documents:
        kept = []
        all_lines = (text or "").split("\n")
        for line in all_lines:
            k = key(line)
            common = len(k) >= min_chars and len(holders[k]) >= min_documents
            if not common or max(holders[k], key=order) == doc:
                kept.append(line)
        rows.append((doc, len(all_lines), kept))
    return rows


def licences(documents, names):
    rows = []
    for doc, text in documents:
        found, places, labels = words(text), [], set()
        for label, name in names.items():
            phrase = name.split()
            for i in range(len(found) - len(phrase) + 1):
                if found[i : i + len(phrase)] == phrase:
                    places.append(i)
                    labels.add(label)
        rows.append((doc, len(found), len(places), min(places, default=None), max(places, default=None),
                     ",".join(sorted(labels))))
    return rows


def passages_removed(documents, length=400):
    """Documents as (id, bytes of all windows) would have it: every window looked up in all others."""
    from collections import Counter

    texts = [(doc, (text or "").encode()) for doc, text in documents]
    seen = Counter(hash(t[i : i + length]) for _, t in texts for i in range(len(t) - length + 1))
    rows = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        rows.append((doc, len(t), sum(gone), runs, sha(rest)))
    return rows


def roots(n, pairs):
    """Smallest member of each one's component."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            if root[i] != low or root[j] != low:
                root[i] = root[j] = low
                changed = True
    return root


def simhash(text, size=3):
    import xxhash

    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(documents, bits=3):
    prints = [simhash(text) for _, text in documents]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    root = roots(len(prints), near)
    least = {}
    for (doc, _), r in zip(documents, root, strict=True):
        known = least.setdefault(r, doc)
        least[r] = known if doc is None else doc if known is None else min(known, doc)
    return [(doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(documents, prints, root, strict=True)]


def near_vectors(rows, limit=0.9):
    import math

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        big = max(abs(x) for x in v)
        v = [x / big for x in v]
        size = math.sqrt(math.fsum(x * x for x in v))
        return [x / size for x in v]

    units = [unit(v) for _, v in rows]
    near = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if units[i] and units[j] and len(units[i]) == len(units[j])
        and math.fsum(x * y for x, y in zip(units[i], units[j], strict=True)) >= limit
    ]
    root = roots(len(rows), near)
    links = [sum(i in pair for pair in near) for i in range(len(rows))]
    least = {}
    for (vec, _), r in zip(rows, root, strict=True):
        if vec is not None:
            least[r] = min(vec, least.get(r, vec))
    return [(vec, n, least.get(r), least.get(r) == vec) for (vec, _), n, r in zip(rows, links, root, strict=True)]


def ranked(documents, items, top=10):
    """Rows (item, rank, document, score): every document scored for every item."""
    import math
    from collections import Counter

    held = [(doc, Counter(words(text))) for doc, text in documents]
    held = [(doc, terms) for doc, terms in held if terms]
    n_docs, total = len(held), sum(sum(t.values()) for _, t in held)
    df = Counter(term for _, terms in held for term in terms)
    rows = []
    for item, text in items:
        found = []
        for doc, terms in held:
            m = 100 - 90 + (90 * sum(terms.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * terms[t]) // (1000 * terms[t] + 8 * m))
                for t in set(words(text)) if t in terms
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        rows += [(item, i, None if null else doc, -score) for i, (score, null, doc) in enumerate(sorted(found)[:top], 1)]
    return rows


def mix_targets(sizes, weights=(1, 2, 3), cap=3):
    """Targets by source as fractions: one source is capped at a time, the fullest first."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        open_sources = [s for s in order if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[o] for o in open_sources) for s in open_sources}
        above = [s for s in open_sources if share[s] > cap * sizes[s]]
        if not above:
            return share | {s: Fraction(cap * sizes[s]) for s in full}
        full.add(max(above, key=lambda s: Fraction(share[s], max(1, sizes[s])) if sizes[s] else Fraction(10**30)))


def tilts(sizes, target, cap=3):
    """Rates min(cap, exp(l * size)) whose words meet the target, by bisection."""
    import math

    rate = lambda l, s: min(float(cap), math.exp(min(l * s, 50.0)))
    low, high = -1000.0, 1000.0
    for _ in range(300):
        middle = (low + high) / 2
        if math.fsum(s * rate(middle, s) for s in sizes) < target:
            low = middle
        else:
            high = middle
    return {s: rate(low, s) for s in sizes}
