"""Plain single-process versions of the operators, to hold their results against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def components(n, links):
    at = list(range(n))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def simhash(text):
    import xxhash
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(prints, radius=4):
    links = [(i, j) for i in range(len(prints)) for j in range(i)
             if (prints[i] ^ prints[j]).bit_count() <= radius]
    return components(len(prints), links)


def without_repeats(raws, width):
    """Remaining bytes and removed runs of each raw text, in order."""
    seen, out = set(), []
    for t in raws:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            w = t[p:p + width]
            if w in seen:
                gone[p:p + width] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone]), runs))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def parse(lines, alike):
    """Templates of one leaf's token lists, one after the other."""
    templates, out = [], []
    for i, line in enumerate(lines):
        score = [sum(a == b != "<*>" for a, b in zip(t, line)) for _, t in templates]
        best = max(range(len(score)), key=lambda k: (score[k], -k), default=None)
        if best is not None and score[best] >= alike * len(line):
            first, t = templates[best]
            templates[best] = (first, [a if a == b != "<*>" else "<*>" for a, b in zip(t, line)])
        else:
            first = i
            templates.append((i, list(line)))
        out.append(first)
    return out


def parse_masks(lines, alike):
    """As parse, but fields that both lines have masked agree."""
    templates, out = [], []
    for i, line in enumerate(lines):
        score = [sum(a == b for a, b in zip(t, line)) for _, t in templates]
        best = max(range(len(score)), key=lambda k: (score[k], -k), default=None)
        if best is not None and score[best] >= alike * len(line):
            first, t = templates[best]
            templates[best] = (first, [a if a == b else None for a, b in zip(t, line)])
        else:
            first = i
            templates.append((i, list(line)))
        out.append(first)
    return out


def template_lines(rows, min_documents, order, depth=3, least=6, alike=0.8):
    """rows: (key, text) with distinct keys; order: sort key of a line's tokens within its leaf."""
    leaves = defaultdict(list)
    for key, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in line.split()]
            if len(tokens) >= least:
                leaves[len(tokens), tuple(tokens[:depth])].append((key, no, tuple(tokens)))
    gone = defaultdict(set)
    for found in leaves.values():
        different = sorted({t for _, _, t in found}, key=order)
        template = dict(zip(different, parse([list(t) for t in different], alike)))
        by = defaultdict(list)
        for key, no, t in found:
            by[template[t]].append((key, no))
        for places in by.values():
            if len({k for k, _ in places}) >= min_documents:
                for k, no in sorted(places)[1:]:
                    gone[k].add(no)
    return {k: t if t is None or not gone[k] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])
            for k, t in rows}
