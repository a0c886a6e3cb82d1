import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import trees


def components(m, connectivity):
    """Components of a mask by repeated flooding of labels."""
    lab = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 < abs(dy) + abs(dx) <= connectivity]
    parent = list(range(m.size + 1))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    h, w = m.shape
    for dy, dx in near:
        a = lab[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
        b = lab[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
        both = (a > 0) & (b > 0)
        for i, j in zip(a[both].tolist(), b[both].tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(m.size + 1)])[lab]


def level_sets(a, connectivity, sign=1):
    """Nodes (name, level, parent, area, sum of rows) of every upper level set that has cells at its level, and each cell's node."""
    nodes, node_of, held = {}, {}, {}
    flat = a.ravel()
    for level in sorted(np.unique(a), key=lambda v: sign * v):
        lab = components(sign * a >= sign * level, connectivity).ravel()
        order = np.argsort(lab, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(lab[order])) + 1):
            if lab[members[0]] == 0:
                continue
            mine = members[flat[members] == level]
            if len(mine):
                name = int(mine.min())
                nodes[name] = (float(level), held.get(int(members[0])), len(members), float((members // a.shape[1]).sum()))
                for i in members.tolist():
                    held[i] = name
                for i in mine.tolist():
                    node_of[i] = name
    return nodes, node_of


def pixels(spark, images):
    rows = [(k, *a.shape, y, x, float(v)) for k, a in enumerate(images) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, v double").repartition(4)


def arrays(out, images):
    got = [np.full(a.shape, np.nan) for a in images]
    for r in out.collect():
        got[r.image_id][r.y, r.x] = r.v
    return got


def pictures(seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:37, :41]
    return [
        rng.integers(0, 6, (23, 40)).astype(float),
        np.round(3 * np.sin(y / 5) + 3 * np.cos(x / 6) + rng.integers(0, 2, (37, 41))),
        np.full((9, 30), 4.0),
        np.array([[7.0]]),
        rng.integers(0, 200, (5, 66)).astype(float),
    ]


@pytest.mark.parametrize(("connectivity", "minima"), [(1, False), (2, False), (1, True), (2, True)])
def test_trees_are_those_of_level_sets(spark, connectivity, minima):
    images = pictures(connectivity)
    tree = trees.ComponentTree(pixels(spark, images), connectivity, minima, {"rows": F.col("y")}, tile=8)
    assert len(tree.rounds) == 3
    got = [{} for _ in images]
    for r in tree.nodes.collect():
        assert r.node not in got[r.image_id]
        got[r.image_id][r.node] = (r.level, r.parent, r.area, r.rows)
    cells = [{} for _ in images]
    for r in tree.cells.collect():
        cells[r.image_id][r.y * r.w + r.x] = r.node
    for k, a in enumerate(images):
        nodes, node_of = level_sets(a, connectivity, -1 if minima else 1)
        assert got[k] == nodes and cells[k] == node_of


def filtered(a, nodes, node_of, stays):
    out = np.zeros(a.size)
    for i in range(a.size):
        n = node_of[i]
        while n is not None and not stays(n, nodes[n]):
            n = nodes[n][1]
        out[i] = 0.0 if n is None else nodes[n][0]
    return out.reshape(a.shape)


@pytest.mark.parametrize("minima", [False, True])
def test_filters_and_labels(spark, minima):
    images, sign = pictures(5), -1 if minima else 1
    tree = trees.ComponentTree(pixels(spark, images), 1, minima, tile=8)
    found = [level_sets(a, 1, sign) for a in images]
    by_area = arrays(tree.filter(F.col("area") >= 12), images)
    values = tree.nodes.select("image_id", "node", ((F.col("node") * 7919) % 10).alias("value"))
    by_value = arrays(tree.filter(F.col("value") >= 4, values), images)
    labels = arrays(tree.labels(), images)
    for k, (a, (nodes, node_of)) in enumerate(zip(images, found, strict=True)):
        assert (by_area[k] == filtered(a, nodes, node_of, lambda _, e: e[2] >= 12)).all()
        assert (by_value[k] == filtered(a, nodes, node_of, lambda n, _: n * 7919 % 10 >= 4)).all()
        order = sorted(nodes, key=lambda n: (sign * nodes[n][0], n))
        first = 0 if nodes[order[0]][0] == 0 else 1
        number = {n: i + first for i, n in enumerate(order)}
        assert labels[k].ravel().tolist() == [number[node_of[i]] for i in range(a.size)]
    opened = arrays((trees.area_close if minima else trees.area_open)(pixels(spark, images), 12), images)
    assert all((x == y).all() for x, y in zip(opened, by_area, strict=True))


def test_a_picture_of_many_tiles_in_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    y, x = np.mgrid[:256, :256]
    a = np.round(20 * np.sin(y / 17) * np.cos(x / 23)) + rng.integers(0, 3, (256, 256))
    tree = trees.ComponentTree(pixels(spark, [a]), tile=32)
    nodes, node_of = level_sets(a, 1)
    assert (arrays(tree.filter(F.col("area") >= 40), [a])[0] == filtered(a, nodes, node_of, lambda _, e: e[2] >= 40)).all()
    largest = [t.where("kind > 0").groupBy("gy", "gx").count().agg(F.max("count")).first()[0] for t in tree.rounds[1:]]
    assert max(largest) < a.size / 2  # paths from seams, not areas
