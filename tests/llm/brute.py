"""Plain versions of the operators' contracts, one text or one list of texts at a time."""

from __future__ import annotations

import collections
import hashlib
import re

import xxhash

WHITE = re.compile("[\x20\x09-\x0D]+")
WORDS = re.compile("[^\x20\x09-\x0D]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def license_base(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words))
             if words[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in found}))


def run_labels(text, templates, threshold, short):
    """Labels and best containment of templates in runs of a text that are no longer than them."""
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    labels, best = set(), 0.0
    for sentence, label, must, never in templates:
        wanted, must, never = set(sentence.split()), set(must.split()), set(never.split())
        share = threshold if len(wanted) >= short else 1.0
        if len(wanted & set(words)) < share * len(wanted) - 1e-9:
            continue
        most = len(sentence.split())
        for first in range(len(words)):
            for end in range(first + 1, min(len(words), first + most) + 1):
                run = set(words[first:end])
                held = len(run & wanted) / len(wanted)
                if held >= share - 1e-9 and run >= must and not run & never:
                    labels.add(label)
                    best = max(best, held)
    return labels, best


def fingerprint(text):
    words = WORDS.findall(ascii_lower(text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    """doc_id to (fingerprint, component)."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            smallest[root(k)] = min(i, smallest.get(root(k), i))
    return [(i, f"{f:016x}", smallest.get(root(k))) for k, (i, f) in enumerate(prints)]


def exact(rows):
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[WHITE.sub(" ", t or "")].append(i)
    out = []
    for i, t in rows:
        norm = WHITE.sub(" ", t or "")
        ids = [x for x in texts[norm] if x is not None]
        out.append((i, min(ids, default=None), len(texts[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out


def counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return base, base[0] < 50 or 100 * base[4] > 50 * base[0]


def secrets(text):
    text = text or ""
    kinds = [("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
             ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    found = []
    for k, (name, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m[2]) >= 8 if name == "assign" else len(m[0]) >= (16 if name == "access" else 32):
                found.append((m.start(), k, m.end()))
    shown = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found)]
    return (*[sum(k == n for _, k, _ in found) for n in range(3)],
            hashlib.sha256(",".join(shown).encode()).hexdigest()), shown


def substrings(rows, window=35):
    split = [WORDS.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out
