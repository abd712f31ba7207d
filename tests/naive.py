"""Independent, deliberately simple reference models used only by the tests."""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque

import numpy as np


def components(n_ids, edges):
    parent = {v: v for v in n_ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    groups = defaultdict(list)
    for v in n_ids:
        groups[find(v)].append(v)
    return {v: min(g) for g in groups.values() for v in g}


def dbscan(X, eps, min_samples):
    """Sequential DBSCAN in index order (the classic algorithm)."""
    n = len(X)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = [np.flatnonzero(d[i] <= eps) for i in range(n)]
    core = np.array([len(x) >= min_samples for x in nb])
    labels = np.full(n, -1)
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = c
        stack = [i]
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nb[p]:
                if labels[q] == -1:
                    labels[q] = c
                    stack.append(q)
        c += 1
    return labels


def kruskal_weight(n, weighted_edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    total, used = 0.0, 0
    for w, a, b in sorted(weighted_edges):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            total += w
            used += 1
    return total, used


def ward(X, threshold=None, k=None):
    clusters = {i: [i] for i in range(len(X))}
    cent = {i: X[i].astype(float).copy() for i in range(len(X))}
    heights = []
    while len(clusters) > 1:
        if k is not None and len(clusters) <= k:
            break
        best = None
        keys = sorted(clusters)
        for ai in range(len(keys)):
            for bi in range(ai + 1, len(keys)):
                a, b = keys[ai], keys[bi]
                na, nb = len(clusters[a]), len(clusters[b])
                dd = math.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(cent[a] - cent[b])
                if best is None or dd < best[0]:
                    best = (dd, a, b)
        dd, a, b = best
        if threshold is not None and dd >= threshold:
            break
        na, nb = len(clusters[a]), len(clusters[b])
        cent[a] = (cent[a] * na + cent[b] * nb) / (na + nb)
        clusters[a] += clusters.pop(b)
        cent.pop(b)
        heights.append(dd)
    return {m: min(mem) for mem in clusters.values() for m in mem}, heights


def partition(labels: dict):
    g = defaultdict(set)
    for i, l in labels.items():
        g[l].add(i)
    return sorted(sorted(s) for s in g.values())


def metrics(t, p):
    """Classic definitions, computed directly."""
    n = len(t)
    cont = Counter(zip(t, p))
    a = Counter(t)
    b = Counter(p)
    mi = sum(v / n * math.log(n * v / (a[x] * b[y])) for (x, y), v in cont.items())
    if len(a) == 1 or len(b) == 1:
        mi = 0.0
    ht = -sum(v / n * math.log(v / n) for v in a.values())
    hp = -sum(v / n * math.log(v / n) for v in b.values())
    emi = 0.0
    for ai in a.values():
        for bj in b.values():
            for nij in range(max(1, ai + bj - n), min(ai, bj) + 1):
                lg = (math.lgamma(ai + 1) + math.lgamma(bj + 1) + math.lgamma(n - ai + 1) + math.lgamma(n - bj + 1)
                      - math.lgamma(nij + 1) - math.lgamma(n + 1) - math.lgamma(ai - nij + 1)
                      - math.lgamma(bj - nij + 1) - math.lgamma(n - ai - bj + nij + 1))
                emi += nij / n * math.log(n * nij / (ai * bj)) * math.exp(lg)
    if len(a) == len(b) == 1:
        ami = 1.0
    else:
        den = (ht + hp) / 2 - emi
        den = min(den, -2.220446049250313e-16) if den < 0 else max(den, 2.220446049250313e-16)
        ami = (mi - emi) / den
    hom = mi / ht if ht else 1.0
    com = mi / hp if hp else 1.0
    v = 0.0 if hom + com == 0 else 2 * hom * com / (hom + com)
    sn2 = sum(v_ * v_ for v_ in cont.values())
    sa2 = sum(v_ * v_ for v_ in a.values())
    sb2 = sum(v_ * v_ for v_ in b.values())
    tp, fp, fn = sn2 - n, sb2 - sn2, sa2 - sn2
    tn = n * n - fp - fn - sn2
    ari = 1.0 if fn == 0 and fp == 0 else 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    fmi = math.sqrt(tp / (sb2 - n)) * math.sqrt(tp / (sa2 - n)) if tp else 0.0
    pur = sum(max(v_ for (x, y), v_ in cont.items() if y == yy) for yy in b) / n
    return dict(purity=pur, mi=mi, ami=ami, homogeneity=hom, completeness=com, v_measure=v, ari=ari, fmi=fmi)


def average_linkage(X, threshold=None, k=None):
    clusters = {i: [i] for i in range(len(X))}
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    while len(clusters) > 1:
        if k is not None and len(clusters) <= k:
            break
        keys = sorted(clusters)
        best = None
        for ai in range(len(keys)):
            for bi in range(ai + 1, len(keys)):
                a, b = keys[ai], keys[bi]
                dd = d[np.ix_(clusters[a], clusters[b])].mean()
                if best is None or dd < best[0]:
                    best = (dd, a, b)
        dd, a, b = best
        if threshold is not None and dd >= threshold:
            break
        clusters[a] += clusters.pop(b)
    return {m: min(mem) for mem in clusters.values() for m in mem}


def _lam(d):
    """1 / distance in steps of 2 ** -24, at most 2 ** 36: sums are exact integers."""
    return 2 ** 60 if d <= 2.0 ** -36 else round(2.0 ** 24 / d)


def tree_labels(ids, edges, min_cluster_size: int,
                cluster_selection_epsilon: float = 0.0, allow_single_cluster: bool = False):
    """Labels (cluster = smallest member id of the selected cluster, -1 noise)
    for one connected component given its spanning tree edges."""
    n = len(ids)
    if n == 1:
        return np.array([-1 if not allow_single_cluster else ids[0]])
    pos = {int(v): k for k, v in enumerate(ids)}
    e = edges.assign(a=np.minimum(edges.i, edges.j), b=np.maximum(edges.i, edges.j)) \
             .sort_values(["dist", "a", "b"], kind="stable")
    # single-linkage hierarchy (union-find)
    parent = list(range(2 * n - 1))
    left = [-1] * (2 * n - 1); right = [-1] * (2 * n - 1)
    dist = [0.0] * (2 * n - 1); size = [1] * n + [0] * (n - 1)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    nxt = n
    for a, b, d in zip(e.a.to_numpy(), e.b.to_numpy(), e.dist.to_numpy()):
        ra, rb = find(pos[int(a)]), find(pos[int(b)])
        left[nxt], right[nxt], dist[nxt] = ra, rb, float(d)
        size[nxt] = size[ra] + size[rb]
        parent[ra] = parent[rb] = nxt
        nxt += 1
    root = 2 * n - 2

    def leaves(node):
        out, st = [], [node]
        while st:
            x = st.pop()
            if x < n:
                out.append(x)
            else:
                st.extend((left[x], right[x]))
        return out

    # condense (top-down)
    relabel = {root: n}
    nxt_label = n + 1
    rows = []  # (parent, child, lambda, size)
    dist_of = {}
    q = deque([root])
    while q:
        node = q.popleft()
        if node < n:
            continue
        lam = _lam(dist[node])
        l, r = left[node], right[node]
        lc, rc = size[l], size[r]
        pl = relabel[node]
        if lc >= min_cluster_size and rc >= min_cluster_size:
            for c, cnt in ((l, lc), (r, rc)):
                relabel[c] = nxt_label
                dist_of[nxt_label] = dist[node]
                rows.append((pl, nxt_label, lam, cnt))
                nxt_label += 1
                q.append(c)
        elif lc < min_cluster_size and rc < min_cluster_size:
            for c in (l, r):
                for leaf in leaves(c):
                    rows.append((pl, leaf, lam, 1))
        else:
            small, big = (l, r) if lc < min_cluster_size else (r, l)
            for leaf in leaves(small):
                rows.append((pl, leaf, lam, 1))
            relabel[big] = pl
            q.append(big)
    clusters = sorted({r[0] for r in rows})
    birth = {n: 0}
    birth_dist = {}
    for p_, c, lam, _s in rows:
        if c >= n:
            birth[c] = lam
            birth_dist[c] = dist_of[c]
    stab = {c: 0 for c in clusters}
    for p_, c, lam, s in rows:
        stab[p_] += (lam - birth[p_]) * s
    children = {c: [] for c in clusters}
    for p_, c, _l, _s in rows:
        if c >= n:
            children[p_].append(c)
    # excess of mass, bottom-up (larger labels are deeper)
    is_cluster = {c: True for c in clusters}
    if not allow_single_cluster:
        is_cluster[n] = False
    nodes = sorted(clusters, reverse=True)
    if not allow_single_cluster:
        nodes = [c for c in nodes if c != n]
    stability = dict(stab)

    def descendants(c):
        out, st = [], list(children.get(c, []))
        while st:
            x = st.pop()
            out.append(x)
            st.extend(children.get(x, []))
        return out
    for node in nodes:
        sub = sum(stability[c] for c in children.get(node, []))
        if sub > stability[node]:
            is_cluster[node] = False
            stability[node] = sub
        else:
            for d_ in descendants(node):
                is_cluster[d_] = False
    selected = {c for c, v in is_cluster.items() if v}
    if cluster_selection_epsilon > 0 and len(rows):
        par = {c: p_ for p_, c, _l, _s in rows if c >= n}
        if not (len(selected) == 1 and n in selected):
            chosen, processed = set(), set()
            for leaf in sorted(selected):
                eps_leaf = birth_dist[leaf]
                if eps_leaf < cluster_selection_epsilon:
                    if leaf in processed:
                        continue
                    node = leaf
                    while True:
                        p_ = par[node]
                        if p_ == n:
                            node = p_ if allow_single_cluster else node
                            break
                        if birth_dist[p_] > cluster_selection_epsilon:
                            node = p_
                            break
                        node = p_
                    chosen.add(node)
                    processed.update(descendants(node))
                else:
                    chosen.add(leaf)
            selected = chosen
    # labelling: climb from each point until a selected cluster (or the root)
    up = {c: p_ for p_, c, _l, _s in rows}
    out = np.full(n, -1, dtype=np.int64)
    members: dict[int, list[int]] = {}
    for k in range(n):
        x = up.get(k)
        while x is not None and x not in selected and x != n:
            x = up.get(x)
        if x is not None and x in selected and (x != n or allow_single_cluster):
            members.setdefault(x, []).append(k)
    for c, mem in members.items():
        rep = int(min(ids[m] for m in mem))
        for m in mem:
            out[m] = rep
    return out
