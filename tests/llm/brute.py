"""Plain Python versions of the operators, each over all rows at once."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from lignum.llm import outliers, simhash


def order_hash(key, salt):
    return int(hashlib.md5((salt + ("null" if key is None else str(key))).encode()).hexdigest()[:15], 16)


def tokens(text):
    return len(re.findall(r"[^ \t\r\n]+", text or ""))


def near_duplicates(rows, radius=40):
    """{removed doc_id: kept doc_id} of (doc_id, text), by comparing all pairs."""
    rows = sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: r[0])
    fp, has = simhash.fingerprints([t for _, t in rows])
    ids = [i for i, _ in rows]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]).sum(1) <= radius) + a + 1:
            if has[a] and has[b]:
                x, y = find(a), find(int(b))
                root[max(x, y)] = min(x, y)
    return {ids[k]: ids[find(k)] for k in range(len(ids)) if find(k) != k}


def _fit(x, weights=None):
    mean = x.mean(0)
    return mean, (x[:, :, None] * x[:, None, :]).mean(0) - np.outer(mean, mean)


def _estimate(x, steps=4):
    """The reweighted MCD of one group's vectors."""
    p, floor = outliers.P, np.diag(outliers.FLOOR**2)
    ordered = np.sort(x, 0)
    at = lambda q: ordered[max(0, int(np.ceil(q * len(x))) - 1)]
    spread = np.maximum((at(0.75) - at(0.25)) / 1.349, outliers.FLOOR)
    starts = [(at(0.5), np.diag(spread**2) + floor), (lambda m: (m[0], m[1] + floor))(_fit(x))]

    def distances(mean, cov):
        c = x - mean
        return np.maximum(np.einsum("ni,ij,nj->n", c, np.linalg.inv(cov), c), 0)

    def refit(state, cut=None):
        bucket = np.floor(8 * np.log2(distances(*state) + 1e-3)).astype(int)
        counts = Counter(bucket.tolist())
        seen, keep = 0, set()
        for b in sorted(counts):
            if (seen < np.ceil(outliers.ALPHA * len(x))) if cut is None else (b <= outliers.bucket_of(cut) or not seen):
                keep.add(b)
            seen += counts[b]
        inside = np.isin(bucket, list(keep))
        mean, cov = _fit(x[inside])
        share = np.clip(inside.mean(), outliers.ALPHA if cut is None else 0.975, 0.999)
        return mean, cov * outliers.consistency(share) + floor

    for _ in range(steps):
        starts = [refit(s) for s in starts]
    best = min(starts, key=lambda s: np.linalg.slogdet(s[1])[1])
    return refit(best, outliers.chi2_quantile(0.975, p))


def squared_distances(rows, min_group=40):
    """d2 of each (lang, source, text) row; None without a vector or an estimate."""
    x = outliers.vectors([t for _, _, t in rows])
    ok = ~np.isnan(x[:, 0])
    groups = defaultdict(list)
    for k, (lang, source, _) in enumerate(rows):
        for key in (("g", lang, source), ("l", lang), ("t",)):
            if ok[k]:
                groups[key].append(k)
    fits = {key: _estimate(x[members]) for key, members in groups.items() if len(members) >= min_group}
    out = []
    for k, (lang, source, _) in enumerate(rows):
        fit = next((fits[key] for key in (("g", lang, source), ("l", lang), ("t",)) if key in fits), None)
        if not ok[k] or fit is None:
            out.append(None)
            continue
        c = x[k] - fit[0]
        out.append(max(0.0, float(c @ np.linalg.inv(fit[1]) @ c)))
    return x, out


def outlier(has_vector, d2, quantile=0.999, slack=1.1):
    return not has_vector or (d2 is not None and d2 > outliers.cut(quantile, slack))


def mixture(rows, weights=None, budgets=(25, 50, 100)):
    """{index of the row: smallest budget that takes it} of (doc_id, source, text)."""
    by = defaultdict(lambda: defaultdict(list))
    for k, (i, source, _) in enumerate(rows):
        by[source][order_hash(i, "mix")].append(k)
    weight = lambda s: 1 if weights is None else weights.get(s, 0)
    total = {s: sum(tokens(rows[k][2]) for ks in h.values() for k in ks) for s, h in by.items() if weight(s) > 0}
    units = [t // weight(s) for s, t in total.items() if t > 0]
    taken = {}
    for s in total if units else ():
        used = 0
        for h in sorted(by[s]):
            used += sum(tokens(rows[k][2]) for k in by[s][h])
            fits = [p for p in budgets if used <= min(units) * weight(s) * p // 100]
            if not fits:
                break
            taken |= {k: min(fits) for k in by[s][h]}
    return taken


def packing(rows, weights=None, window=8192, piece=1024):
    """Windows as lists of (doc_id, source, start, count), by deficit round-robin in rounds over (doc_id, source, text)."""
    queues = defaultdict(list)
    first = lambda v: (v is not None, v)
    for i, source, text in rows:
        if n := tokens(text):
            queues[source].append((order_hash(i, "pack"), first(i), n, i))
    mine = {s: sum(q[2] for q in queue) for s, queue in queues.items()} if weights is None else {s: weights.get(s, 0) for s in queues}
    mine = {s: w for s, w in mine.items() if w > 0}
    quantum = {s: max(1, int(window * (w / sum(mine.values())))) for s, w in mine.items()}
    pieces = {s: [(q[3], k, min(piece, q[2] - k)) for q in sorted(queues[s]) for k in range(0, q[2], piece)] for s in mine}
    out, deficit = [], dict.fromkeys(mine, 0)
    while any(pieces.values()):
        for s in sorted(mine, key=first):
            deficit[s] += quantum[s]
            while pieces[s] and pieces[s][0][2] <= deficit[s]:
                i, start, n = pieces[s].pop(0)
                deficit[s] -= n
                out.append((i, s, start, n))
    windows, room = [], 0
    for i, s, start, n in out:
        while n:
            if not room:
                windows.append([])
                room = window
            part = min(n, room)
            windows[-1].append((i, s, start, part))
            start, n, room = start + part, n - part, room - part
    return windows
