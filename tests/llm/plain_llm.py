"""Brute-force versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def bare_words(text):
    return [re.sub(r"^\W+|\W+$", "", w).lower() or w for w in (text or "").split()]


def aligned(a, b):
    """Words in the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(a, b):
    return aligned(a, b) / max(len(a), len(b)) if a or b else 1.0


def near_classes(rows, threshold=0.8):
    """rows of (doc_id, text) -> {text: least doc_id of its class}; all pairs are aligned that have enough words in common."""
    texts = sorted({t or "" for _, t in rows})
    words = [bare_words(t) for t in texts]
    bags = [Counter(w) for w in words]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            need = threshold * max(len(words[i]), len(words[j])) - 1e-9
            if words[i] and words[j] and min(len(words[i]), len(words[j])) >= need and find(parent, i) != find(parent, j):
                if sum((bags[i] & bags[j]).values()) >= need and similarity(words[i], words[j]) >= threshold - 1e-9:
                    parent[find(parent, i)] = find(parent, j)
    least = {}
    for d, t in rows:
        c = find(parent, texts.index(t or ""))
        least[c] = min(d, least.get(c, d))
    return {t: least[find(parent, i)] for i, t in enumerate(texts)}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, width=10):
    """n_words, hit word count, sorted items."""
    w = bench_words(text)
    hit, found = set(), set()
    for item_id, body in items:
        b = bench_words(body)
        for k in range(max(1, len(b) - width + 1)) if b else ():
            g = b[k : k + width]
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def repeats(rows, window=50):
    """rows of (doc_id, text) -> list of (doc_id, n_words, n_removed, kept_sha256)."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[i : i + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)
