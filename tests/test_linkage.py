"""What the comparison of candidate buckets moves and leaves behind."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.plans import linkage
from corpusq.plans.workspace import Workspace


def _rows(sets, components):
    return [(2, i, c, np.array(sorted(x), "<u8").tobytes()) for i, (x, c) in enumerate(zip(sets, components))]


def test_a_block_gives_no_more_links_than_join_components():
    sets = [set(range(100)) | {1000 + i} for i in range(60)]
    some = linkage.links(_rows(sets, range(60)), 80, forest=True)
    assert some.num_rows == 59 and linkage.links(_rows(sets, range(60)), 80).num_rows == 60 * 59
    assert linkage.links(_rows(sets, [0] * 30 + [1] * 30), 80, forest=True).num_rows == 1


@pytest.mark.parametrize("rows", [2, 1024])
def test_links_to_a_main_component_and_among_others(spark, monkeypatch, rows):
    monkeypatch.setattr(linkage, "ROWS", rows)
    monkeypatch.setattr(linkage, "SLICE", 200)
    rng = np.random.default_rng(rows)
    base = [set(rng.integers(0, 1 << 40, 80).tolist()) for _ in range(4)]
    sets = {i: base[0 if i < 24 else 1 + i % 3] | set(rng.integers(0, 1 << 40, int(rng.integers(2, 18))).tolist()) for i in range(40)}
    keyed = spark.createDataFrame([(k, i) for k in range(3) for i in sets if (i + k) % 5], "key long, node long")
    table = spark.createDataFrame([(i, len(x), np.array(sorted(x), "<u8").tobytes()) for i, x in sets.items()], "node long, n long, elements binary")
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(sets, 2):
        meet = any((a + k) % 5 and (b + k) % 5 for k in range(3))
        if meet and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    linked = {i: find(i) for i in sets if sum(find(j) == find(i) for j in sets) > 1}
    got = linkage.similar_components(Workspace(spark, "ln"), keyed, lambda nodes: table.join(nodes, "node", "left_semi"), 80)
    assert {r.node: r.component for r in got.collect()} == linked


def test_a_table_is_saved_with_the_setting_as_it_was(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    saved = Workspace(spark, "left").save("t", spark.range(1000).groupBy(F.pmod("id", F.lit(7)).alias("k")).count())
    assert saved.count() == 7 and spark.conf.get(name) == before
