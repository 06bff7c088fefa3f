"""Plain Python versions of the operators, for small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(docs, window=20):
    """{place: (n_words, n_removed, kept words)} for [(doc_id, text)]."""
    texts = [(i, WORD.findall(t or "")) for i, t in docs]
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, ws in texts:
        for s in range(len(ws) - window + 1):
            g = tuple(ws[s : s + window])
            first[g] = min(first.get(g, (key(i), s)), (key(i), s))
    out = []
    for i, ws in texts:
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] < (key(i), s):
                gone.update(range(s, s + window))
        out.append((i, len(ws), len(gone), " ".join(x for k, x in enumerate(ws) if k not in gone)))
    return out


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """[(doc_id, fp)] to {place: smallest doc_id reachable}."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(fps))]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stretch_distance(item, text):
    """Least edit distance of the item to any stretch of the text."""
    cost = np.zeros(len(text) + 1, int)
    along = np.arange(len(text) + 1)
    text = np.array(text, object)
    for row, word in enumerate(item):
        new = np.minimum(np.concatenate([[row + 1], cost[:-1] + (text != word)]), cost + 1)
        cost = np.minimum.accumulate(new - along) + along
    return int(cost.min())


def mix(docs, hash_of, weights=(5, 2, 1), share=1.5, cap=2.0):
    """[(doc_id, source, size)] to [(doc_id, size, source_size, target, taken)]."""
    total = defaultdict(int)
    for _, s, n in docs:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    capped, each = set(), 0.0
    while len(capped) < len(order):
        left = share * sum(total.values()) - cap * sum(total[s] for s in capped)
        each = left / (sum(weight.values()) - sum(weight[s] for s in capped))
        now = {s for s in order if cap * total[s] <= each * weight[s]}
        if now == capped:
            break
        capped = now
    target = {s: min(cap * total[s], each * weight[s]) for s in order}
    out = []
    for i, s, n in docs:
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        upto = sum(m for j, r, m in docs if r == s and hash_of(j) <= hash_of(i))
        out.append((i, n, total[s], target[s], n * (whole + (upto <= target[s] - whole * total[s]))))
    return out


def best_split(run, count, total, longest=20):
    """All splits tried."""
    if not run:
        return 0.0, ()
    options = []
    for k in range(1, min(longest, len(run)) + 1):
        n = count.get(run[:k])
        cost = math.log(n / total) if n else -math.log(total) - k * math.log(10)
        rest, words = best_split(run[k:], count, total, longest)
        options.append((cost + rest, (run[:k], *words)))
    return max(options)


def spread(docs):
    """Distinct sites per trimmed line of [(text, site)]."""
    sites = defaultdict(set)
    for text, site in docs:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r"):
                sites[line.strip(" \t\r")].add(site)
    return Counter({line: len(s) for line, s in sites.items()})


def align(text, first, second):
    """Groups [(ids of the first, ids of the second)] and links [(id, id)] of one text; `first` and `second` give [(id, bytes)]."""
    whole = (" " + text).encode() if text else b""
    a, b = (f(text) if text else [] for f in (first, second))
    if not text or any(b"".join(x for _, x in found) != whole for found in (a, b)):
        return [], []
    spans = []
    for found in (a, b):
        at, listed = 0, []
        for i, raw in found:
            listed.append((i, at, at + len(raw)))
            at += len(raw)
        spans.append(listed)
    both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, begin = [], 0
    for end in both:
        groups.append(tuple([i for i, s, e in listed if s >= begin and e <= end] for listed in spans))
        begin = end
    links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if max(s, t) < min(e, f)]
    return groups, links


def cheapest_labels(cost, edges):
    """The cost of the cheapest of all labellings: of nodes labelled False their positive cost, of others their negative one."""
    best = None
    for bits in range(1 << len(cost)):
        on = [bits >> k & 1 for k in range(len(cost))]
        total = sum(c if not x else 0 for c, x in zip(cost, on) if c > 0) + sum(-c if x else 0 for c, x in zip(cost, on) if c < 0)
        total += sum(c for a, b, c in edges if on[a] != on[b])
        best = total if best is None else min(best, total)
    return best
