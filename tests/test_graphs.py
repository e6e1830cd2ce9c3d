"""Graph operators against small brute-force versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import scale
from textloom.operators import graphs


def edge_table(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def grid(a, b):
    return [(i * b + j, k) for i in range(a) for j in range(b) for k in ([i * b + j + 1] if j + 1 < b else []) + ([i * b + j + b] if i + 1 < a else [])]


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def adjacency(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def bfs(adj, s, without=None):
    dist, front = {s: 0}, [s]
    while front:
        nxt = []
        for v in front:
            for w in adj[v]:
                if w != without and w not in dist:
                    dist[w] = dist[v] + 1
                    nxt.append(w)
        front = nxt
    return dist


def naive_delta(d, ids):
    best = 0
    for a, b, c, e in itertools.combinations(ids, 4):
        s = sorted([d[a][b] + d[c][e], d[a][c] + d[b][e], d[a][e] + d[b][c]])
        best = max(best, s[2] - s[1])
    return best / 2


def blocks_of(pairs):
    """Biconnected components by the sequential depth-first method."""
    adj, number, low, out, stack, clock = adjacency(pairs), {}, {}, [], [], itertools.count()

    def visit(v, parent):
        number[v] = low[v] = next(clock)
        for w in sorted(adj[v]):
            if w not in number:
                stack.append((v, w))
                visit(w, v)
                low[v] = min(low[v], low[w])
                if low[w] >= number[v]:
                    block = set()
                    while True:
                        e = stack.pop()
                        block.add(tuple(sorted(e)))
                        if e == (v, w):
                            break
                    out.append(frozenset(block))
            elif w != parent and number[w] < number[v]:
                stack.append((v, w))
                low[v] = min(low[v], number[w])

    for v in sorted(adj):
        if v not in number:
            visit(v, None)
    return set(out)


def strong_of(pairs, ids):
    reach = {v: {v} for v in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    return {v: max(w for w in reach[v] if v in reach[w]) for v in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pairs = random_graph(60, 45, seed)
    adj = adjacency(pairs)
    want = {v: min(bfs(adj, v)) for v in adj}
    got = {r["id"]: r["component"] for r in graphs.components(edge_table(spark, pairs)).collect()}
    assert got == want


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(120)]
    got = {r["component"] for r in graphs.components(edge_table(spark, pairs)).collect()}
    assert got == {0}


def test_strong_components(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(45)})
    pairs = [(a, b) for a, b in pairs if a != b]
    ids = {v for e in pairs for v in e}
    got = {r["id"]: r["component"] for r in graphs.strong_components(edge_table(spark, pairs)).collect()}
    assert got == strong_of(pairs, ids)


@pytest.mark.parametrize(
    "pairs",
    [random_graph(24, 30, 5), grid(3, 3) + [(8, 9), (9, 10), (10, 11), (11, 9), (20, 21)]],
    ids=["random", "grid with tails"],
)
def test_biconnected(spark, pairs):
    got = {}
    for r in graphs.biconnected(edge_table(spark, pairs)).collect():
        got.setdefault(r["block"], set()).add((r["src"], r["dst"]))
    assert {frozenset(b) for b in got.values()} == blocks_of(pairs)


def test_biconnected_path_takes_logarithmic_rounds(spark, monkeypatch):
    """A path of 5,000 vertices with a triangle at its end: every edge of the path is a block."""
    rounds = []
    halved = graphs._halved
    monkeypatch.setattr(graphs, "_halved", lambda up: rounds.append(1) or halved(up))
    n = 5000
    path = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    tail = spark.createDataFrame([(n - 1, n), (n, n + 1), (n - 1, n + 1)], "src long, dst long")
    blocks = scale.settle(graphs.biconnected(path.unionByName(tail)))
    assert len(rounds) < 25
    sizes = graphs.block_sizes(blocks).groupBy("size", "edges").count().collect()
    assert {tuple(r) for r in sizes} == {(2, 1, n - 1), (3, 3, 1)}


def test_list_ranks(spark, monkeypatch):
    rounds = []
    release = graphs.release
    monkeypatch.setattr(graphs, "release", lambda *t: rounds.append(1) or release(*t))
    rows = [(i, i + 1 if (i + 1) % 700 else None) for i in range(2100)]
    items = spark.createDataFrame(rows, "item long, next long")
    got = {r["item"]: r["rank"] for r in graphs.list_ranks(items).collect()}
    assert got == {i: 699 - i % 700 for i in range(2100)} and len(rounds) <= 6


def test_preorder_numbers_subtrees(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (1, 5), (7, 9), (9, 8)], "u long, v long")
    roots = spark.createDataFrame([(i, 1) for i in range(1, 6)] + [(i, 7) for i in (7, 8, 9)], "id long, root long")
    got = {r["id"]: (r["parent"], r["pre"], r["size"]) for r in graphs.preorder(tree, roots).collect()}
    assert {i: (p, s) for i, (p, _, s) in got.items()} == {
        1: (None, 5), 2: (1, 3), 3: (2, 1), 4: (2, 1), 5: (1, 1), 7: (None, 3), 9: (7, 2), 8: (9, 1)
    }
    assert sorted(pre for _, pre, _ in got.values()) == list(range(1, 9))
    for parent, pre, _ in got.values():
        if parent is not None:
            assert got[parent][1] < pre < got[parent][1] + got[parent][2]


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_with_chains(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(14)}
    fresh = 100
    for a, b in sorted(pairs)[:6]:  # long ways between vertices, and tails
        way = [a, *range(fresh, fresh + rng.randrange(2, 9)), b]
        fresh += 20
        pairs |= set(zip(way, way[1:]))
    cycle = list(range(500, 507))
    pairs |= set(zip(cycle, cycle[1:] + cycle[:1])) | {(600, 601), (601, 602), (602, 0)}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    got = {r["id"]: r["component"] for r in graphs.strong_components(edge_table(spark, pairs)).collect()}
    assert got == strong_of(pairs, {v for e in pairs for v in e})


def test_strong_components_of_long_chains(spark, monkeypatch):
    """A path of 5,000 vertices and a cycle of 3,000 in a logarithmic number of tables."""
    written = []
    settle = graphs.settle
    monkeypatch.setattr(graphs, "settle", lambda df: written.append(1) or settle(df))
    path = spark.range(4999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    cycle = spark.range(3000).select((F.col("id") + 10_000).alias("src"), ((F.col("id") + 1) % 3000 + 10_000).alias("dst"))
    parts = scale.settle(graphs.strong_components(path.unionByName(cycle)))
    assert graphs.component_sizes(parts).where("size > 1").collect() == [(12_999, 3000)]
    assert parts.count() == 8000 and len(written) < 60


PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
CIRCULANT = [(i, (i + 2) % 16) for i in range(0, 16, 2)]


@pytest.mark.parametrize("pairs", [grid(3, 4), grid(2, 6), PETERSEN, CIRCULANT, random_graph(12, 26, 7)],
                         ids=["grid", "ladder", "petersen", "cycle", "random"])
def test_hyperbolicity_equals_the_naive_value(spark, pairs):
    pairs = [tuple(sorted(p)) for p in pairs]
    adj = adjacency(pairs)
    ids = sorted(bfs(adj, min(adj)))
    d = {v: bfs(adj, v) for v in ids}
    dist = spark.createDataFrame([(a, b, d[a][b]) for a in ids for b in ids], "src long, dst long, d int")
    row = graphs.hyperbolicity(dist, tile=5).first()
    assert row["delta"] == naive_delta(d, ids)
    sampled = graphs.sampled_hyperbolicity(edge_table(spark, pairs), 300, 10).first()
    assert sampled["delta"] <= row["delta"] and sampled["quadruples"] > 0


def test_distances_and_eccentricity(spark):
    pairs = random_graph(30, 40, 9)
    adj = adjacency(pairs)
    dist = graphs.distances(edge_table(spark, pairs))
    got = {(r["src"], r["dst"]): r["d"] for r in dist.collect()}
    assert got == {(a, b): d for a in adj for b, d in bfs(adj, a).items()}
    near = graphs.distances(edge_table(spark, pairs), max_hops=2)
    assert near.agg({"d": "max"}).first()[0] <= 2


def test_pagerank_against_dense_iteration(spark):
    rng = random.Random(11)
    pairs = sorted({(rng.randrange(15), rng.randrange(20)) for _ in range(50)})
    n = 20
    ids = sorted({v for e in pairs for v in e})
    m = np.zeros((n, n))
    for a, b in pairs:
        m[b, a] += 1
    out = m.sum(axis=0)
    x = np.array([1 / len(ids) if v in ids else 0 for v in range(n)])
    for _ in range(100):
        lost = sum(x[v] for v in ids if out[v] == 0)
        y = m @ np.divide(x, out, where=out > 0, out=np.zeros(n))
        x = np.array([0.15 / len(ids) + 0.85 * (y[v] + lost / len(ids)) if v in ids else 0 for v in range(n)])
    got = {r["id"]: r["pagerank"] for r in graphs.pagerank(edge_table(spark, pairs), tolerance=1e-9, max_rounds=40).collect()}
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-6)
    assert all(abs(got[v] - x[v]) < 1e-4 for v in ids)


def test_wiki_graph_is_case_insensitive_and_drops_lone_articles(spark):
    articles = spark.createDataFrame(
        [("Alpha", "[[BETA]] [[Alpha]] [[gamma]]"), ("beta", "[[!x]]"), ("Lone", "text")], "title string, contents string"
    )
    assert [tuple(r) for r in graphs.wiki_graph(articles).collect()] == [("Alpha", "beta")]


def test_twins_are_left_out_before_the_distances(spark):
    """A ring of six, two of its places with 40 leaves each, and a clique of 30 on a third."""
    ring = [(i, (i + 1) % 6) for i in range(6)]
    leaves = [(hub, 100 * hub + i) for hub in (1, 4) for i in range(40)]
    clique = [(a, b) for a in [2, *range(900, 930)] for b in range(900, 930) if a == 2 or a < b]
    edges = edge_table(spark, ring + leaves + clique)
    few = graphs.without_twin_vertices(edges).collect()
    assert len({v for r in few for v in (r["src"], r["dst"])}) == 6 + 4 + 2
    whole = graphs.distances(edges).cache()
    kept = graphs.distances(graphs.without_twin_vertices(edges)).cache()
    assert kept.join(whole, ["src", "dst", "d"], "left_anti").isEmpty()
    one, two = (graphs.hyperbolicity(d).first() for d in (whole, kept))
    assert (one["delta"], one["diameter"]) == (two["delta"], two["diameter"])


def test_samples_respect_the_graph(spark):
    pairs = grid(3, 3)
    rows = graphs.sample_neighbours(edge_table(spark, pairs), 3, 20).collect()
    linked = {p for a, b in pairs for p in ((a, b), (b, a))}
    assert all(((r["anchor"], r["other"]) in linked) == bool(r["positive"]) for r in rows)
    assert all(r["anchor"] != r["other"] for r in rows)
    again = graphs.sample_neighbours(edge_table(spark, pairs).repartition(5), 3, 20).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_every_negative_is_drawn(spark):
    """A star of 50: the leaves get all they ask for, the hub, linked to everything, gets none."""
    star = [(0, i) for i in range(1, 51)] + [(1, 2)]
    rows = graphs.sample_neighbours(edge_table(spark, star), 2, 7).where("positive = 0").collect()
    drawn = {}
    for r in rows:
        drawn.setdefault(r["anchor"], []).append(r["other"])
    assert set(drawn) == set(range(1, 51)) and all(len(v) == 7 for v in drawn.values())
    assert all(o not in (0, a) and {a, o} != {1, 2} for a, v in drawn.items() for o in v)


def test_spectral_clusters_part_two_cliques(spark):
    two = [(a + s, b + s) for s in (0, 50) for a in range(12) for b in range(a)] + [(0, 50)]
    found = {r["id"]: r["cluster"] for r in graphs.spectral_clusters(edge_table(spark, two), 2, 6, rounds=6, steps=4).collect()}
    assert len(found) == 24 and set(found.values()) <= {0, 1}
    assert len({found[i] for i in range(1, 12)}) == 1 and len({found[50 + i] for i in range(1, 12)}) == 1


def test_distance_pca_equals_the_decomposition(spark):
    pairs = [tuple(sorted(p)) for p in random_graph(14, 24, 3)]
    adj = adjacency(pairs)
    ids = sorted(bfs(adj, min(adj)))
    d = np.array([[bfs(adj, a)[b] for b in ids] for a in ids], float)
    dist = spark.createDataFrame([(a, b, int(d[i, j])) for i, a in enumerate(ids) for j, b in enumerate(ids)], "src long, dst long, d int")
    got = {r["id"]: r["point"] for r in graphs.distance_pca(dist, 2, rounds=20).collect()}
    h = -np.cosh(d / d.max())
    _, size, axes = np.linalg.svd(h - h.mean(axis=0), full_matrices=False)
    for k in range(2):
        axis = axes[k] * np.sign(axes[k][np.argmax(np.round(abs(axes[k]), 9))])
        assert np.allclose([got[v][k] for v in ids], axis, atol=1e-4)


def test_twins_do_not_change_delta(spark):
    """Leaves on every vertex and doubled vertices: the value stays, the table shrinks."""
    ring = [(i, (i + 1) % 9) for i in range(9)]
    doubled = ring + [(100, 1), (100, 3), (101, 1), (101, 3)] + [(200 + 10 * i + j, i) for i in range(9) for j in range(4)]
    pairs = [tuple(sorted(p)) for p in doubled]
    adj = adjacency(pairs)
    ids = sorted(adj)
    d = {v: bfs(adj, v) for v in ids}
    dist = scale.settle(spark.createDataFrame([(a, b, d[a][b]) for a in ids for b in ids], "src long, dst long, d int"))
    kept = graphs.vertices(graphs.without_twins(dist)).count()
    assert kept < len(ids) and kept == 9 + 2 + 18
    core = sorted(set(range(9)) | {100, 101} | {200 + 10 * i for i in range(9)})
    assert graphs.hyperbolicity(dist, tile=16).first()["delta"] == naive_delta(d, core)


def test_crawl_rules(spark):
    links = spark.createDataFrame(
        [("http://a/", "http://a/x"), ("http://a/x", "http://a/p.png"), ("http://a/x", "http://b/"), ("http://a/x", "http://a/y"),
         ("http://a/y", "http://a/")], "src string, dst string")
    start = spark.createDataFrame([("http://a/",)], "url string")
    got = lambda **k: {(r["url"], r["depth"]) for r in graphs.crawl(links, start, 2, **k).collect()}
    assert got() == {("http://a/", 0), ("http://a/x", 1), ("http://a/y", 2)}
    assert ("http://b/", 2) in got(include_external=True)
    assert ("http://a/p.png", 2) in got(include_images=True)
    assert got(pattern="x$") == {("http://a/", 0), ("http://a/x", 1)}


def drawn_plainly(pairs, n_positive, n_negative, seed=42):
    """The samples by sorted lists, a rank counting the vertices that may be drawn."""
    from hashlib import md5

    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    names, rows = sorted(near), set()
    rank = lambda *name: int(md5(":".join(map(str, (seed, *name))).encode()).hexdigest()[:12], 16)
    for a in names:
        some = sorted(near[a])
        free = [b for b in names if b not in near[a] and b != a]
        rows |= {(a, some[rank(a, "positive", d) % len(some)], d, 1) for d in range(1, n_positive + 1)}
        rows |= {(a, free[rank(a, "negative", d) % len(free)], d, 0) for d in range(1, n_negative + 1) if free}
    return rows


@pytest.mark.parametrize("rows", [2_000_000, 7])
def test_samples_of_vertices_on_the_borders_of_parts(spark, monkeypatch, rows):
    """Parts far smaller than a vertex's neighbours give the same draws, also from edges in both directions."""
    monkeypatch.setattr(graphs, "SORTED_ROWS", rows)
    pairs = [("hub", f"n{i}") for i in range(60)] + [(f"n{i}", f"n{(i * 7 + 3) % 60}") for i in range(60) if i != (i * 7 + 3) % 60] + [("far", "n1"), ("n1", "far")]
    want = drawn_plainly(pairs, 4, 9)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = graphs.sample_neighbours(edges, 4, 9).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    names = sorted({v for p in pairs for v in p})
    placed = graphs.sample_neighbours(edges, 4, 9, places=True).collect()
    assert {(r["anchor"], names[r["place"]], r["draw"], r["positive"]) for r in placed} == want and all(names[r["at"]] == r["anchor"] for r in placed)


def test_loss_in_blocks_of_points(spark, monkeypatch):
    """The same losses with points sent to pairs of blocks as with points joined to every sample, also with points of no numbers."""
    import random

    draw = random.Random(2)
    vector = lambda: [draw.gauss(0, 1) for _ in range(3)]
    lifted = [(i, [math.sqrt(1 + sum(x * x for x in v)), *v]) for i, v in enumerate(vector() for _ in range(30))]
    lifted += [(3, lifted[5][1]), (30, None), (31, [1.0, None, 0.0, 0.0]), (None, lifted[0][1])]  # a key of two points, points without numbers
    points = spark.createDataFrame(lifted, "id long, point array<double>")
    rows = [(f"a{i % 40}", i % 33, draw.randrange(34), int(i % 3 == 0)) for i in range(400)]
    rows += [("lone", 1, 2, 0), ("void", 30, 31, 1), (None, 1, 2, 1), ("gone", 99, 1, 1), ("part", 1, 30, 1), ("part", 1, 2, 0), ("part", 1, 4, 1)]
    samples = spark.createDataFrame(rows, "anchor string, at long, other long, positive int")
    order = lambda out: sorted((r["anchor"], r["loss"]) for r in out.collect())
    blocks = order(graphs.embedding_loss(samples, points, at="at"))
    monkeypatch.setattr(graphs, "CELL_SAMPLES", 10)
    layers = order(graphs.embedding_loss(samples, points, at="at"))
    monkeypatch.setattr(graphs, "POINT_VALUES", 0)
    joined = order(graphs.embedding_loss(samples, points, at="at"))
    assert [a for a, _ in blocks] == [a for a, _ in layers] == [a for a, _ in joined]
    assert "void" in dict(joined) and "lone" not in dict(joined) and len(joined) == 42
    for out in (blocks, layers):
        assert all(abs(x - y) < 1e-6 for (_, x), (_, y) in zip(out, joined))
