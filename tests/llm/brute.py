"""Plain versions of what the operators compute, over small lists."""

import collections
import math
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def held_out(doc_id, of, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == rest


class Groups:
    def __init__(self):
        self.above = {}

    def root(self, x):
        self.above.setdefault(x, x)
        while self.above[x] != x:
            x = self.above[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)


def fingerprint(text):
    w = words(text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows):
    """Component by id of ``(id, text)`` rows with an id."""
    groups, marked = Groups(), [(i, fingerprint(t)) for i, t in rows if i is not None]
    for i, a in marked:
        for j, b in marked:
            if (a ^ b).bit_count() <= 2:
                groups.join(i, j)
    return {i: groups.root(i) for i, _ in marked}


def vector_links(rows, least):
    """Links and component of ``(id, vector, label)`` rows."""

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    made = [(i, unit(v) if i is not None and lab is not None else None, lab) for i, v, lab in rows]
    links, groups = [0] * len(made), Groups()
    for a, (i, u, lab) in enumerate(made):
        for b, (j, v, other) in enumerate(made):
            if a != b and u is not None and v is not None and lab == other and len(u) == len(v):
                if float(u @ v) >= least:
                    links[a] += 1
                    groups.join(i, j)
    return [(i, n, None if i is None else groups.root(i)) for (i, _, _), n in zip(made, links)]


def tree_scores(training, texts, depth, min_count, min_divergence):
    """Scores by a suffix tree kept in dictionaries."""
    after = collections.defaultdict(collections.Counter)

    def tokens(text):
        return words(text) + [None]

    for text in training:
        t = tokens(text)
        for i, word in enumerate(t):
            for k in range(min(depth, i) + 1):
                after[tuple(t[i - k : i])][word] += 1
    kept = {()}
    for context in sorted(after, key=len, reverse=True):
        counts, total = after[context], sum(after[context].values())
        if context and total >= min_count:
            up = after[context[1:]]
            ups = sum(up.values())
            kl = sum(c / total * math.log((c / total) / (up[w] / ups)) for w, c in counts.items())
            if kl - (len(counts) - 1) / (2 * total) >= min_divergence:
                kept |= {context[k:] for k in range(len(context) + 1)}

    def p(context, word):
        counts = after[context]
        total, kinds = sum(counts.values()), len(counts)
        if not context:
            return (counts[word] + 0.5) / (total + 0.5 * (kinds + 1))
        return (counts[word] + kinds * p(context[1:], word)) / (total + kinds)

    out = []
    for text in texts:
        t, score = tokens(text), 0.0
        for i, word in enumerate(t):
            k = max(k for k in range(min(depth, i) + 1) if tuple(t[i - k : i]) in kept)
            score += math.log10(p(tuple(t[i - k : i]), word))
        out.append(score)
    return out, kept
