"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def dedup_lines(docs, min_chars=20, min_docs=3):
    """{doc: (n_lines, n_dropped, text)} of {doc: text}."""
    key = lambda line: lower(line.strip(BLANK))
    holders = {}
    for doc, text in docs.items():
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in docs.items():
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != doc for x in lines]
        out[doc] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(docs, size, similar):
    """{doc: (set size, component)} of {doc: text}, all pairs compared."""
    sets = {d: shingles(t, size) for d, t in docs.items()}
    label = {d: d for d in docs}
    changed = True
    links = [
        (a, b) for a in docs for b in docs
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in docs}


def cut_repeats(docs, length):
    """{doc: (n_removed, n_spans, bytes)} of {doc: text}."""
    seen, out = set(), {}
    for doc in sorted(docs):
        data = (docs[doc] or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = [True] * length
            seen.add(piece)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (sum(gone), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g))
    return out


def sha1(data):
    return hashlib.sha1(data).hexdigest()


def rows(df, *columns):
    return Counter(tuple(bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in columns) for r in df.collect())
