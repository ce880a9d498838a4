import pytest

from lumenframe.llm.graph import components
from lumenframe.llm.jaccard import choose_boundary, linked


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_agree_with_all_pairs(docs, corpus, width, percent):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in linked(docs, width, percent).collect())
    assert got == brute(corpus, width, percent)


def test_empty_table(none):
    assert linked(none).count() == 0


def test_boundary_follows_cost():
    assert choose_boundary({}, 90) == 0
    assert choose_boundary({12: 1000}, 90) >= 12
    assert choose_boundary({39: 1000}, 90) < 39


def test_graph_chain_and_hub(spark):
    rows = [(i, i + 1) for i in range(40)] + [(1000, 2000 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000: 1000} | {2000 + i: 1000 for i in range(50)}
