"""Graph and topology kernels against hand-computed fixtures and brute force."""

import itertools
import math

import numpy as np
import pytest

from tidegraph.operators import changepoint, curvature, detectors, graphs, homology, series, topology, validation


def graph(*edges):
    a, b, w = zip(*edges)
    return graphs.Graph(a, b, w)


def diagram_of(g, how="norm_similarity"):
    d, near = topology.densified(g, how)
    return homology.diagram(d, near)


def test_path():
    found = diagram_of(graph(("a", "b", 1), ("b", "c", 1), ("c", "d", 1)))
    assert np.allclose(found[0][:, 1], 1 / 3) and len(found[0]) == 3 and not len(found[1])


def test_cycles():
    c4 = diagram_of(graph(("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 1)))
    assert np.allclose(c4[0][:, 1], 0.5) and np.allclose(c4[1], [[0.5, 1.0]])
    names = "abcdef"
    c6 = diagram_of(graph(*((min(x, y), max(x, y), 1) for x, y in zip(names, names[1:] + names[:1]))))
    assert np.allclose(c6[0][:, 1], 1 / 3) and np.allclose(c6[1], [[1 / 3, 2 / 3]])


def test_complete_and_disconnected():
    k4 = diagram_of(graph(*((x, y, 1) for x, y in itertools.combinations("abcd", 2))))
    assert np.allclose(k4[0][:, 1], 1) and not len(k4[1])
    two = diagram_of(graph(("a", "b", 1), ("c", "d", 1)))
    assert np.allclose(sorted(two[0][:, 1]), [0.5, 0.5, 1.0])


def test_lengths():
    assert np.allclose(topology.distances_of(np.array([5.0, 5.0])), 1)
    assert np.allclose(topology.distances_of(np.array([1.0, 10.0])), [1.0, 0.1])
    with pytest.raises(ValueError):
        topology.distances_of(np.ones(2), "other")


def reduction(d):
    """All finite and endless loops by reducing the full boundary matrix."""
    n = len(d)
    simplices = [(0.0, (i,)) for i in range(n)]
    for k in (2, 3):
        for s in itertools.combinations(range(n), k):
            v = max(d[a, b] for a, b in itertools.combinations(s, 2))
            if np.isfinite(v):
                simplices.append((v, s))
    simplices.sort(key=lambda s: (s[0], len(s[1]), s[1]))
    at = {s: i for i, (_, s) in enumerate(simplices)}
    low, columns, positive, negative, points = {}, {}, set(), set(), []
    for i, (v, s) in enumerate(simplices):
        column = {at[f] for f in itertools.combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while column and max(column) in low:
            column ^= columns[low[max(column)]]
        if column:
            p = max(column)
            low[p], columns[i] = i, column
            negative.add(p)
            if len(simplices[p][1]) == 2 and v > simplices[p][0]:
                points.append((simplices[p][0], v))
        else:
            positive.add(i)
    return sorted(points + [(simplices[i][0], math.inf) for i in positive - negative if len(simplices[i][1]) == 2])


@pytest.mark.parametrize("seed", range(25))
def test_loops_against_reduction(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 10))
    d = np.triu(rng.integers(1, 6, (n, n)).astype(float), 1)
    d = d + d.T
    if seed % 3 == 0:
        gone = np.triu(rng.random((n, n)) < 0.4, 1)
        d = np.where(gone | gone.T, np.inf, d)
        np.fill_diagonal(d, 0)
    assert [tuple(p) for p in homology.loops(d).tolist()] == reduction(d)


@pytest.mark.parametrize("n", [60, 90])
def test_loops_of_larger_metrics(n):
    """Both kinds of ties: shortest paths of a sparse graph, and a point cloud."""
    rng = np.random.default_rng(n)
    edges = {tuple(sorted(rng.choice(n, 2, replace=False))) for _ in range(2 * n)}
    g = graph(*((f"n{a:02d}", f"n{b:02d}", float(rng.integers(1, 4))) for a, b in edges))
    d, _ = topology.densified(g)
    x = rng.normal(size=(24, 2))
    cloud = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert [tuple(p) for p in homology.loops(cloud).tolist()] == reduction(cloud)
    d = d[:26, :26]
    assert [tuple(p) for p in homology.loops(d).tolist()] == reduction(d)


@pytest.mark.parametrize("seed", range(6))
def test_loops_that_live_long(seed):
    """Rings, whose loops outlive the first reach of a chain, with near copies and outliers."""
    rng = np.random.default_rng(seed)
    turn = np.sort(rng.random(16)) * 2 * np.pi
    x = np.concatenate([np.stack([np.cos(turn), np.sin(turn)], axis=1), rng.normal(scale=0.01, size=(6, 2)) + [1, 0], rng.normal(scale=3, size=(4, 2))])
    if seed % 2:
        x = np.round(x, 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert [tuple(p) for p in homology.loops(d).tolist()] == reduction(d)
    assert (homology.loops(d, homology.spanning_forest(d)[0]) == homology.loops(d)).all()


def test_carried_on_chains():
    """A chain that is carried on is the sum that a chain of the whole reach is."""
    x = np.random.default_rng(2).normal(size=(40, 3))
    flag = homology.Flag(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))
    last = flag.size - 1

    def build(limit):
        one, two = homology.Chain(flag, 400, limit, most=20), homology.Chain(flag, 300, limit, most=20)
        for e in (410, 415, 420, 415, 405):
            one.add_edge(e)
        for c in (one, one, one):
            two.add_chain(c)
        two.add_edge(350)
        return two

    whole, short = build(last), build(420)
    assert short.pivot() == whole.pivot()
    short.reach(600)
    short.reach(last)
    assert (short.gather() == whole.gather()).all() and len(whole.gather())
    assert (homology.odd([flag.column(e, last) for e in (300, 350, 400, 405, 410, 420)]) == whole.gather()).all()


def test_loops_of_many_points():
    """Before, columns held all triangles over an edge and chains were sorted again and again."""
    import time

    x = np.random.default_rng(7).normal(size=(700, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    square = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    d = np.maximum(d, d.T)
    np.fill_diagonal(d, 0)
    began = time.monotonic()
    found = homology.loops(d)
    assert time.monotonic() - began < 25 and len(found) > 2000 and (found[:, 1] > found[:, 0]).all() and np.isfinite(found).all()


def clouds_of_all_kinds():
    rng = np.random.default_rng(11)
    turn = np.sort(rng.random(14)) * 2 * np.pi
    ring = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    yield from (rng.normal(size=(n, k)) for n, k in ((1, 3), (2, 3), (3, 2), (22, 2), (26, 5), (26, 64)))
    yield np.concatenate([ring, ring[:4], ring + 0.01 * rng.normal(size=ring.shape)])
    yield np.concatenate([ring, 3 * ring[:8] + [9, 0]])
    yield np.array(list(itertools.product(range(3), repeat=3)), float)
    yield np.zeros((6, 2))
    yield np.concatenate([rng.normal(scale=1e-3, size=(14, 8)), rng.normal(size=(14, 8))])


@pytest.mark.parametrize("x", list(clouds_of_all_kinds()), ids=lambda x: "x".join(map(str, x.shape)))
def test_clouds_by_rows(x):
    """Diagrams from rows of distances are those of the whole matrix."""
    from tidegraph.operators.clouds import cloud_diagram

    d = topology.scaled(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))
    found = cloud_diagram(x)
    loops = np.array(reduction(d)).reshape(-1, 2)
    assert found[1].shape == loops.shape and np.allclose(found[1], loops)
    assert np.allclose(found[0][:, 1], np.sort(homology.spanning_forest(d)[1])) and len(found[0]) == len(x) - 1


def test_clouds_of_many_points_in_little_memory():
    """Before, several matrices of all pairs and a list of all edges were held at once."""
    import tracemalloc

    from tidegraph.operators.clouds import cloud_diagram

    n = 4000
    x = np.random.default_rng(3).random((n, 2))
    tracemalloc.start()
    found = cloud_diagram(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == n - 1 and len(found[1]) > 500
    assert peak < n * n * 8  # one matrix of distances


@pytest.mark.parametrize("seed", range(15))
def test_blocks_give_the_whole(seed):
    """Loops of a graph metric are those of its biconnected blocks."""
    rng = np.random.default_rng(seed)
    edges = {tuple(sorted(rng.choice(11, 2, replace=False))) for _ in range(15)}
    g = graph(*((f"n{a:02d}", f"n{b:02d}", float(rng.integers(1, 9))) for a, b in edges))
    d, near = topology.densified(g)
    whole, parts = homology.loops(d), homology.diagram(d, near)[1]
    assert np.allclose(whole, parts)


def brute_distance(a, b, total, ground, diagonal):
    best = math.inf
    n, m = len(a), len(b)
    for order in itertools.permutations(range(n + m)):
        costs = [ground(a[i], b[p]) if i < n and p < m else diagonal(a[i]) if i < n else diagonal(b[p]) if p < m else 0 for i, p in enumerate(order)]
        best = min(best, total(costs) if costs else 0)
    return best


@pytest.mark.parametrize("seed", range(30))
def test_diagram_distances(seed):
    rng = np.random.default_rng(seed)
    a, b = (np.sort(rng.random((int(k), 2)), axis=1) for k in rng.integers(0, 4, 2))
    if seed % 2:
        a[:, 0] = b[:, 0] = 0
    assert homology.wasserstein(a, b) == pytest.approx(brute_distance(a, b, sum, math.dist, lambda p: (p[1] - p[0]) / math.sqrt(2)))
    assert homology.bottleneck(a, b) == pytest.approx(brute_distance(a, b, max, lambda p, q: np.abs(p - q).max(), lambda p: (p[1] - p[0]) / 2))
    assert homology.wasserstein(a, a) == pytest.approx(0) and homology.wasserstein(a, b) == pytest.approx(homology.wasserstein(b, a))


def test_distance_to_placeholder():
    assert homology.wasserstein(np.array([[0.0, 1.0]]), np.array([[0.0, 0.0]])) == pytest.approx(1 / math.sqrt(2))


@pytest.mark.parametrize("seed", range(20))
def test_transport_against_assignment(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 5, 2)
    a, b = rng.multinomial(12, np.ones(n) / n), rng.multinomial(12, np.ones(m) / m)
    cost = rng.random((n, m))
    units = cost[np.ix_(np.repeat(np.arange(n), a), np.repeat(np.arange(m), b))]
    assert homology.transport(cost, a / 12, b / 12) == pytest.approx(homology.assignment(units)[1] / 12)


def test_curvature_signs():
    triangle = graph(("a", "b", 1), ("b", "c", 1), ("a", "c", 1))
    assert (curvature.edge_curvature(triangle, np.ones(3)) > 0).all()
    tree = graph(*((x, y, 1) for x, y in (("a", "b"), ("c", "b"), ("d", "b"), ("b", "e"), ("e", "f"), ("e", "g"), ("e", "h"))))
    kappa = curvature.edge_curvature(tree, np.ones(7))
    bridge = [i for i, (u, v) in enumerate(zip(tree.u, tree.v)) if {tree.names[u], tree.names[v]} == {"b", "e"}][0]
    assert kappa[bridge] == kappa.min() < 0


def test_communities_of_two_cliques():
    edges = [(x, y, 1.0) for side in ("abcde", "vwxyz") for x, y in itertools.combinations(side, 2)] + [("a", "v", 1.0)]
    g = graph(*edges)
    flowed = curvature.ricci_flow(g, np.ones(len(g.w)), 3)
    bridge = [i for i, (u, v) in enumerate(zip(g.u, g.v)) if {g.names[u], g.names[v]} == {"a", "v"}][0]
    assert flowed.argmax() == bridge and flowed.sum() == pytest.approx(len(g.w))
    _, label = curvature.cut(g, np.where(np.arange(len(g.w)) == bridge, 3.0, 1.0))
    sides = [{label[i] for i, n in enumerate(g.names) if n in side} for side in ("abcde", "vwxyz")]
    assert all(len(s) == 1 for s in sides) and sides[0] != sides[1]


def test_centralities():
    star = graph(*(("hub", f"leaf{i}", 1.0) for i in range(4)))
    hub = list(star.names).index("hub")
    for name in ("page_rank", "degree", "strength", "betweenness", "hits_hub", "eigenvector"):
        assert graphs.CENTRALITIES[name](star).argmax() == hub, name
    assert graphs.page_rank(star).sum() == pytest.approx(1)
    assert graphs.betweenness(star)[hub] == pytest.approx(1) and set(graphs.k_core(star)) == {1.0}
    clique = graph(*((x, y, 2.0) for x, y in itertools.combinations("abcd", 2)))
    assert np.allclose(graphs.clustering(clique), 1) and np.allclose(graphs.k_core(clique), 3)
    apart = graph(("a", "b", 10), ("c", "d", 5))
    with pytest.raises(ValueError):
        graphs.eigenvector(apart)
    with pytest.raises(ValueError, match="known"):
        graphs.centrality("nothing")


def plain_esd(x, most, bound, least):
    """The farthest from the mean of what is left, by definition; how many go is told by ``bound``."""
    left, out, kept = list(range(len(x))), [], 0
    while len(out) < most and len(left) >= 3 and x[left].std(ddof=1) >= least:
        far = np.abs(x[left] - x[left].mean()) / x[left].std(ddof=1)
        at = int(np.argmax(np.round(far, 12)))
        out.append(left.pop(at))
        kept = bound(len(out), far[at], kept)
    return sorted(out[:kept])


@pytest.mark.parametrize("seed", range(20))
def test_esd_against_its_definition(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=60), 1)
    x[rng.integers(0, 60, 5)] += rng.choice([-6, 6, 9], 5)
    n = len(x)

    def rosner(k, r, kept):
        t = detectors.t_quantile(1 - 0.05 / (2 * (n - k + 1)), n - k - 1)
        return k if kept == k - 1 and r > (n - k) * t / math.sqrt((n - k - 1 + t * t) * (n - k + 1)) else kept

    def grubbs(k, r, kept):
        m = n - k + 1
        t = detectors.t_quantile(1 - 0.05 / (2 * m), m - 2)
        return k if r > (m - 1) / math.sqrt(m) * math.sqrt(t * t / (m - 2 + t * t)) else kept

    assert detectors.generalized_esd(x) == plain_esd(x, 6, rosner, 1e-10)
    assert detectors.masking_robust_esd(x, 0.2) == plain_esd(x, 12, grubbs, 1e-12)


@pytest.mark.parametrize("seed", range(10))
def test_modularity_along_the_filtration(seed):
    rng = np.random.default_rng(seed)
    edges = {tuple(sorted(rng.choice(15, 2))) for _ in range(30)}
    g = graph(*((f"n{a:02d}", f"n{b:02d}", 1.0) for a, b in edges))
    w = np.round(rng.random(len(g.w)) + 0.1, 1)
    cutoffs = np.linspace(w.min(), w.max(), 12)
    for q, limit in zip(curvature.filtration_modularity(g, w, cutoffs), cutoffs):
        part = graphs.Graph.__new__(graphs.Graph)
        keep = w <= limit
        part.n, part.u, part.v = g.n, g.u[keep], g.v[keep]
        assert q == pytest.approx(curvature.modularity(part, curvature.components_of(g.n, part.u, part.v), w[keep]))


def test_esd_variants():
    x = np.r_[np.tile([1.0, 1.2, 0.8, 1.1, 0.9], 4)[:18], 30.0, 30.0]
    assert detectors.masking_robust_esd(x, 0.2) == [18, 19]
    assert detectors.generalized_esd(np.ones(20)) == []
    assert detectors.generalized_esd(np.r_[np.tile([1.0, 1.2, 0.8], 10), 9.0]) == [30]


def test_outlier_scores():
    x = np.r_[np.linspace(0, 1, 60), 9.0]
    assert detectors.isolation_scores(x).argmax() == 60 and detectors.local_outlier_factor(x).argmax() == 60
    assert (detectors.isolation_scores(x) == detectors.isolation_scores(x)).all()


def test_change_points():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.2, 100) for m in (0, 3, -2)])[:, None]
    found, _ = changepoint.search(x, 2, 2, 20)
    assert np.allclose(found, [100, 200], atol=2)


@pytest.mark.parametrize("seed", range(5))
def test_pruned_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=(24, 1)), axis=0)

    def cost(points):
        edges = [0, *points, len(x)]
        return sum(((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum() for a, b in itertools.pairwise(edges)) + 2.0 * len(points)

    options = [p for k in range(4) for p in itertools.combinations(range(1, 24), k) if all(b - a >= 5 for a, b in itertools.pairwise([0, *p, 24]))]
    assert cost(changepoint.pelt(x, 2.0, 5)) == pytest.approx(min(map(cost, options)))


def test_auc():
    assert validation.auc_of(np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.35, 0.8])) == pytest.approx(0.75)
    assert validation.auc_of(np.array([0, 1]), np.array([0.5, 0.5])) == pytest.approx(0.5)


def test_shapiro_wilk():
    # a published worked example: weights of eleven men
    w, p = series.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01
    assert series.shapiro_wilk(np.random.default_rng(1).normal(size=300))[1] > 0.05 > series.shapiro_wilk(np.random.default_rng(1).exponential(size=300))[1]


def test_edge_betweenness():
    path = graph(("a", "b", 1.0), ("b", "c", 1.0))
    assert graphs.edge_betweenness(path) == {(0, 1): pytest.approx(2 / 3), (1, 2): pytest.approx(2 / 3)}
