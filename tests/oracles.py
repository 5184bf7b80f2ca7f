"""Serial implementations to hold results against."""

from collections import defaultdict


def bfs(n, edges, source=0):
    out = defaultdict(list)
    for s, d, *_ in edges:
        out[s].append(d)
    level, frontier = {source: 0}, [source]
    while frontier:
        new = []
        for v in frontier:
            for w in out[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    new.append(w)
        frontier = new
    return [level.get(v) for v in range(n)]


def sssp(n, edges, source=0, unit=False):
    best = {source: 0}
    for _ in range(n):
        for s, d, w in edges:
            cost = 1 if unit or w is None else w
            if s in best and best[s] + cost < best.get(d, float("inf")):
                best[d] = best[s] + cost
    return [best.get(v) for v in range(n)]


def pagerank(n, edges, passes=None, damping=0.85, epsilon=1e-7):
    degree = defaultdict(int)
    for s, *_ in edges:
        degree[s] += 1
    rank, done = [1 / n] * n, 0
    while passes is None or done < passes:
        acc = [0.0] * n
        for s, d, *_ in edges:
            acc[d] += rank[s] / degree[s]
        new = [damping * a + (1 - damping) / n for a in acc]
        error, rank, done = sum(abs(a - b) for a, b in zip(new, rank)), new, done + 1
        if passes is None and error < epsilon:
            break
    return rank, done


def reach_max(n, edges, value):
    value = list(value)
    changed = True
    while changed:
        changed = False
        for s, d, *_ in edges:
            if value[s] > value[d]:
                value[d], changed = value[s], True
    return value
