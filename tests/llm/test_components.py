import random

import pytest

from harborline.llm.components import components
from tests.llm import brute


@pytest.mark.parametrize("pairs", [
    [], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)],
    [(random.Random(i).randrange(200), random.Random(-i - 1).randrange(200)) for i in range(150)],
])
def test_smallest_reachable(spark, pairs):
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = brute.smallest_reachable(301, pairs)
    assert found == {n: root[n] for p in pairs if p[0] != p[1] for n in p}
