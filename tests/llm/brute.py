"""Plain versions of the operators, for small tables."""

import hashlib
import re


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, length=5):
    w = words(text)
    return {tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))} if w else set()


def smallest_reachable(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_documents(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = smallest_reachable(ids, links)
    return {(i, len(sets[i]), label[i], label[i] == i) for i in ids}


def near_vectors(rows, least=0.98):
    def good(v):
        return v is not None and all(x is not None and abs(x) < float("inf") for x in v) and any(v)

    ok = [(i, v, l) for i, v, l in rows if good(v) and l is not None]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    links = [(a, b) for a, v, l in ok for b, w, m in ok if a < b and l == m and len(v) == len(w) and sum(x * y for x, y in zip(v, w)) / (norm(v) * norm(w)) >= least]
    label = smallest_reachable([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {(i, count[i], label[i], label[i] == i) for i in label}


def repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) for rows with distinct ids."""
    seen, out = set(), set()
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = [False] * (len(raw) + 1)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (gone[p - 1] if p else False) for p, g in enumerate(gone))
        out.add((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
