"""Connected components against union by hand."""

import random

import pytest

from labelrank.llm.tables import components


def brute(links):
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


CASES = {
    "path": [(i, i + 1) for i in range(200)],
    "shuffled path": None,
    "star": [(500, i) for i in range(300)],
    "random": None,
    "repeats": [(1, 2), (2, 1), (1, 2), (3, 3), (4, 5), (5, 6), (-7, 6)],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    rng = random.Random(1)
    links = CASES[case]
    if case == "shuffled path":
        names = rng.sample(range(10**6), 150)
        links = list(zip(names, names[1:]))
    elif case == "random":
        links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    out = components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3)).collect()
    assert {r["node"]: r["root"] for r in out} == brute(links) and len(out) == len(brute(links))
