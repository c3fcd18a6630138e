"""Strong components, reachability and ancestor counts against a search per table."""

import random

import pytest

from weftline.operators import cycles


def digraph(n, m, seed, chain=0):
    rnd = random.Random(seed)
    names = [f"t{i:03d}" for i in range(n)]
    edges = {(rnd.choice(names), rnd.choice(names)) for _ in range(m)}
    edges |= {(names[i], names[i + 1]) for i in range(chain)}
    return names, sorted(edges)


def above(names, edges):
    """The tables that reach each table by one edge or more."""
    into = {n: {a for a, b in edges if b == n} for n in names}
    out = {}
    for n in names:
        seen, todo = set(), list(into[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += into[x]
        out[n] = seen
    return out


GRAPHS = {
    "sparse": digraph(60, 60, 1),
    "dense": digraph(30, 120, 2),
    "chain": digraph(40, 6, 3, chain=39),
    "ring": ([f"t{i}" for i in range(9)], [(f"t{i}", f"t{(i + 1) % 9}") for i in range(9)]),
    "self loops": (["a", "b"], [("a", "a"), ("a", "b")]),
    "two rings in a row": (list("abcdef"), [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e")]),
    "no edges": (["a", "b"], []),
    "empty": ([], []),
}


def frames(spark, name):
    names, edges = GRAPHS[name]
    return spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize("name", GRAPHS)
def test_strong_components(spark, name):
    up = above(*GRAPHS[name])
    want = {n: min([n, *(a for a in up[n] if n in up[a])]) for n in up}
    assert {r.name: r.representative for r in cycles.strong_components(*frames(spark, name)).collect()} == want


@pytest.mark.parametrize("name", ["dense", "two rings in a row", "chain", "no edges"])
def test_reachable(spark, name):
    up = above(*GRAPHS[name])
    seeds = sorted(up)[::2]
    got = cycles.reachable(*frames(spark, name), spark.createDataFrame([(s,) for s in [*seeds, seeds[0], "unknown"]], "name string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((s, n) for s in seeds for n in up[s] | {s})


@pytest.mark.parametrize("name", ["sparse", "dense", "ring", "self loops", "empty"])
def test_ancestor_counts_are_exact_below_the_sketch(spark, name):
    up = above(*GRAPHS[name])
    got = cycles.ancestor_counts(*frames(spark, name), 64).collect()
    assert {r.name: r.ancestors for r in got} == {n: len(a - {n}) for n, a in up.items()}
    assert all(r.exact for r in got)


def test_ancestor_estimates(spark):
    names = [f"x{i}" for i in range(3000)]
    edges = [(n, f"mid{i % 7}") for i, n in enumerate(names)] + [(f"mid{i}", "top") for i in range(7)] + [("top", "mid0")]
    nodes = [*names, *[f"mid{i}" for i in range(7)], "top"]
    got = cycles.ancestor_counts(
        spark.createDataFrame([(n,) for n in nodes], "name string"), spark.createDataFrame(edges, "src string, dst string"), 256
    )
    rows = {r.name: r for r in got.collect()}
    true = {"top": 3007, "mid0": 3007, "mid1": 429, "x5": 0}
    for name, number in true.items():
        assert rows[name].exact == (number <= 256)
        assert abs(rows[name].ancestors - number) <= 3 * number / 254**0.5
    with pytest.raises(ValueError):
        cycles.ancestor_counts(nodes, edges, 2)
