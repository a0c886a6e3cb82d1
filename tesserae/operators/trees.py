"""Component trees (max- and min-trees) of images of any size, put together from tiles.

Each tile's tree is built by itself. A node whose component does not reach a seam is final: no other tile can
change it. The rest, the paths from seams to the root, go on: rounds merge the paths of
neighbouring tiles along their seams, let go of what became final, and hand on what reaches the outer
seams. What a group holds follows from a region's seams, not from its area. Attributes are summed as
nodes merge; filters go the other way, from the last round to the tiles.

A node is named by the least raster index (y * w + x) of the cells at its level.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frames import IMAGE, PIXEL, numbered, stored

c = F.col
#: Side of a tile; a round merges 2 ** BITS tiles a side.
TILE, BITS = 128, 2
CELL, NODE, SEAM = 0, 1, 2
#: Rows are cells (y, x, v, node), nodes (before, node, level, parent, own, open) or cells at seams (y, x, node).
ROWS = "image_id long, h int, w int, gy int, gx int, kind int, y int, x int, v double, before long, node long, level double, parent long, own array<double>, open boolean"


def at_seam(y: np.ndarray, x: np.ndarray, h: int, w: int, side: int) -> np.ndarray:
    """Whether cells lie at a border between regions of ``side`` cells, and not of the image."""
    return ((y % side == 0) & (y > 0)) | ((y % side == side - 1) & (y < h - 1)) | ((x % side == 0) & (x > 0)) | ((x % side == side - 1) & (x < w - 1))


class Forest:
    """Trees of nodes with levels: every parent's level is lower. Joining two nodes merges their paths to the roots."""

    def __init__(self, level: list[float], parent: list[int], own: np.ndarray):
        self.level, self.parent, self.own = level, parent, own
        self.root = list(range(len(level)))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: int, b: int) -> None:
        level, parent, find = self.level, self.parent, self.find
        a, b = find(a), find(b)
        while a != b:
            if level[a] < level[b]:
                a, b = b, a
            up = find(parent[a]) if parent[a] >= 0 else -1
            if up >= 0 and level[up] >= level[b]:
                a = up
            elif level[a] > level[b]:  # b comes between a and what is above it
                parent[a] = b
                if up < 0:
                    return
                a, b = b, up
            else:
                self.root[a] = b
                self.own[b] += self.own[a]
                over = find(parent[b]) if parent[b] >= 0 else -1
                if up < 0:
                    return
                if over < 0 or level[up] > level[over]:
                    parent[b] = up
                if over < 0:
                    return
                a, b = up, over

    def rows(self, names: np.ndarray, seams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each node: the name it has now, its parent's, what it and its final descendants sum to, and whether it is open.

        ``seams`` are nodes with a cell at a seam that is left; they and all above them are open.
        """
        n, find = len(self.level), self.find
        now = np.array([find(i) for i in range(n)], np.int64)
        name = names.copy()
        np.minimum.at(name, now, names)
        up = np.array([find(p) if p >= 0 else -1 for p in self.parent], np.int64)
        open_ = np.zeros(n, bool)
        for i in np.unique(now[seams]).tolist():
            while i >= 0 and not open_[i]:
                open_[i] = True
                i = up[i]
        for i in sorted(np.unique(now).tolist(), key=lambda i: -self.level[i]):
            if not open_[i] and up[i] >= 0:
                self.own[up[i]] += self.own[i]
        parent = np.where(up[now] >= 0, name[up[now]], -1)
        return name[now], parent, self.own[now], open_[now]


def _frame(head: tuple, gy: int, gx: int, parts: list[dict]) -> pd.DataFrame:
    """The parts' rows with all columns of ``ROWS``; ``head`` is the image's id, height and width."""
    names = [f.split()[0] for f in ROWS.split(", ")]
    known = dict(zip(("image_id", "h", "w"), head, strict=True)) | {"gy": gy, "gx": gx}
    frames = [pd.DataFrame({n: p.get(n, [known.get(n)] * len(p["node"])) for n in names}) for p in parts if len(p["node"])]
    return pd.concat(frames) if frames else pd.DataFrame({n: [] for n in names})


def _nodes(forest: Forest, names: np.ndarray, seams: np.ndarray, sign: int) -> dict:
    now, parent, own, open_ = forest.rows(names, seams)
    level = np.array(forest.level)
    return {"kind": NODE, "before": names, "node": now, "level": sign * level, "parent": pd.array([None if p < 0 else int(p) for p in parent], "Int64"), "own": list(own), "open": open_}


def steps(connectivity: int) -> list[tuple[int, int]]:
    """Half of the neighbours of a cell; the other half sees it as theirs."""
    return [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 2 else [])


def _tile(connectivity: int, sign: int, side: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["h"].iloc[0]), int(rows["w"].iloc[0])
        y, x = rows["y"].to_numpy(np.int64), rows["x"].to_numpy(np.int64)
        v, own = sign * rows["v"].to_numpy(float), np.array(rows["own"].tolist(), float)
        y0, x0 = y.min(), x.min()
        place = np.full((y.max() - y0 + 3, x.max() - x0 + 3), -1)
        place[y - y0 + 1, x - x0 + 1] = np.arange(len(y))
        # Equal neighbours are one node from the start; the others are joined from high to low.
        pairs = np.concatenate([np.stack([np.arange(len(y)), place[y - y0 + 1 + dy, x - x0 + 1 + dx]], axis=1) for dy, dx in steps(connectivity)])
        pairs = pairs[pairs[:, 1] >= 0]
        forest = Forest(v.tolist(), [-1] * len(y), own)
        low = np.minimum(v[pairs[:, 0]], v[pairs[:, 1]])
        for a, b in pairs[np.argsort(-low, kind="stable")].tolist():
            forest.join(a, b)
        names = y * w + x
        now = np.array([forest.find(i) for i in range(len(y))])
        least = names.copy()
        np.minimum.at(least, now, names)
        reps = np.unique(now)
        seam = at_seam(y, x, h, w, side)
        small = np.full(len(y), -1)
        small[reps] = np.arange(len(reps))
        parents = [-1 if forest.parent[r] < 0 else int(small[forest.find(forest.parent[r])]) for r in reps.tolist()]
        nodes = Forest([forest.level[r] for r in reps.tolist()], parents, forest.own[reps])
        node = least[now]
        cells = {"kind": CELL, "y": y, "x": x, "v": sign * v, "node": node}
        seams = {"kind": SEAM, "y": y[seam], "x": x[seam], "node": node[seam]}
        return _frame((key[0], h, w), key[1], key[2], [cells, _nodes(nodes, least[reps], small[now[seam]], sign), seams])

    return run


def _merge(connectivity: int, sign: int, side: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["h"].iloc[0]), int(rows["w"].iloc[0])
        nodes, seams = rows[rows["kind"] == NODE], rows[rows["kind"] == SEAM]
        nodes = nodes.drop_duplicates("node")  # those that were merged have one name
        names = nodes["node"].to_numpy(np.int64)
        place = {n: i for i, n in enumerate(names.tolist())}
        parents = [-1 if pd.isna(p) else place[int(p)] for p in nodes["parent"]]
        forest = Forest((sign * nodes["level"]).tolist(), parents, np.array(nodes["own"].tolist(), float))
        y, x = seams["y"].to_numpy(np.int64), seams["x"].to_numpy(np.int64)
        node = [place[n] for n in seams["node"].astype(np.int64).tolist()]
        cells = {(a, b): n for a, b, n in zip(y.tolist(), x.tolist(), node, strict=True)}
        for (a, b), n in cells.items():
            for dy, dx in steps(connectivity):
                other = cells.get((a + dy, b + dx))
                if other is not None:
                    forest.join(n, other)
        left = at_seam(y, x, h, w, side)
        out = _nodes(forest, names, np.array(node, np.int64)[left], sign)
        now = dict(zip(names.tolist(), out["node"].tolist(), strict=True))
        seam = {"kind": SEAM, "y": y[left], "x": x[left], "node": np.array([now[n] for n in seams["node"].astype(np.int64)[left].tolist()], np.int64)}
        return _frame((key[0], h, w), key[1], key[2], [out, seam])

    return run


def _descend(sign: int):
    """Outputs of a region's nodes, from low to high: a node that stays gives its level, another its parent's output, a root 0."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(rows.loc[rows["open"], "node"].tolist(), rows.loc[rows["open"], "out"].tolist(), strict=True))
        final = rows[~rows["open"]].drop_duplicates("node")
        for r in final.iloc[np.argsort(sign * final["level"].to_numpy(), kind="stable")].itertuples():
            known[r.node] = r.level if r.stays else 0.0 if pd.isna(r.parent) else known[int(r.parent)]
        return pd.DataFrame({"image_id": key[0], "before": rows["before"], "out": [known[n] for n in rows["node"].tolist()]})

    return run


class ComponentTree:
    """The max-tree (``minima``: min-tree) of every image of ``px``.

    ``nodes`` has image_id, h, w, node, level, parent (null for a root), area and the sums ``attributes`` (name to
    column of ``px``) over each node's component; ``cells`` the rows of ``px`` with the node that holds each.
    """

    def __init__(self, px: DataFrame, connectivity: int = 1, minima: bool = False, attributes: dict[str, Column] | None = None, tile: int = TILE):
        sign, names = -1 if minima else 1, ["area", *(attributes or {})]
        self.sign = sign
        own = F.array(F.lit(1.0), *(a.cast("double") for a in (attributes or {}).values()))
        rows = px.select(*PIXEL, c("v").cast("double").alias("v"), own.alias("own")).withColumn("gy", F.floor(c("y") / tile).cast("int")).withColumn("gx", F.floor(c("x") / tile).cast("int"))
        side = tile
        largest = px.agg(F.max(F.greatest("h", "w"))).first()[0] or 0
        self.rounds = [stored(rows.groupBy("image_id", "gy", "gx").applyInPandas(_tile(connectivity, sign, side), ROWS), "tiles")]
        while side < largest:
            side <<= BITS
            going = self.rounds[-1].where((c("kind") == SEAM) | ((c("kind") == NODE) & c("open")))
            up = lambda n: F.floor(c(n) / 2**BITS).cast("int").alias(n)
            going = going.select(*[f for f in going.columns if f not in ("gy", "gx")], up("gy"), up("gx"))
            self.rounds.append(stored(going.groupBy("image_id", "gy", "gx").applyInPandas(_merge(connectivity, sign, side), ROWS), "regions"))
        name, done = None, []
        for table in reversed(self.rounds):  # a node's last name, from the round where it became final
            nodes = table.where(c("kind") == NODE)
            if name is None:
                last = nodes.select("image_id", "before", c("node").alias("last"))
                parents = nodes.where(~c("open"))
            else:
                later = name.withColumnsRenamed({"before": "node", "last": "later"})
                last = nodes.join(later, ["image_id", "node"], "left").select("image_id", "before", F.coalesce("later", "node").alias("last"))
                over = name.withColumnsRenamed({"before": "parent", "last": "later"})
                parents = nodes.where(~c("open")).join(over, ["image_id", "parent"], "left").withColumn("parent", F.coalesce("later", "parent"))
            done.append(parents.select(*IMAGE, "node", "level", "parent", *(c("own")[i].alias(n) for i, n in enumerate(names))))
            name = stored(last, "names")
        nodes = done[0]
        for d in done[1:]:
            nodes = nodes.unionByName(d)
        self.nodes = stored(nodes.withColumn("area", c("area").cast("long")).dropDuplicates(["image_id", "node"]), "nodes")
        self.names = name
        self.cells = self._cells().join(name, ["image_id", "before"]).select(*PIXEL, "v", c("last").alias("node"))

    def _cells(self) -> DataFrame:
        """Cells with the name that their node has in the tile, so that no name has more cells than a tile."""
        return self.rounds[0].where(c("kind") == CELL).select(*PIXEL, "v", c("node").alias("before"))

    def filter(self, stays: Column, values: DataFrame | None = None) -> DataFrame:
        """Cells with the level of the nearest node above that stays (their own, if it does); 0 where none does.

        ``stays`` is a condition on ``nodes``, or on ``values``: any table (image_id, node, ...) of further columns.
        """
        rows = self.nodes if values is None else self.nodes.join(values, ["image_id", "node"], "left")
        rows = stored(rows.select("image_id", "node", F.coalesce(stays, F.lit(False)).alias("stays")), "stays")
        out = None
        for table in reversed(self.rounds):
            nodes = table.where(c("kind") == NODE).select("image_id", "gy", "gx", "before", "node", "level", "parent", "open")
            nodes = nodes.join(rows, ["image_id", "node"], "left")
            above = nodes.withColumn("out", F.lit(None).cast("double")) if out is None else nodes.join(out.withColumnsRenamed({"before": "node"}), ["image_id", "node"], "left")
            out = stored(above.groupBy("image_id", "gy", "gx").applyInPandas(_descend(self.sign), "image_id long, before long, out double"), "outputs")
        return self._cells().drop("v").join(out, ["image_id", "before"]).select(*PIXEL, c("out").alias("v"))

    def labels(self) -> DataFrame:
        """Flat zones, numbered from the root by level, then node; a root of level 0 is background, with 0."""
        order = [c("level") * self.sign, c("node")]
        rows = numbered(self.nodes.select("image_id", "node", "parent", "level"), "image_id", order, "n")
        empty = F.max(c("parent").isNull() & (c("level") == 0)).alias("empty")
        less = self.nodes.groupBy("image_id").agg(empty)
        rows = rows.join(less, "image_id").select("image_id", "node", (c("n") - c("empty").cast("int")).alias("n"))
        rows = self.names.join(rows.withColumnRenamed("node", "last"), ["image_id", "last"]).select("image_id", "before", "n")
        return self._cells().drop("v").join(rows, ["image_id", "before"]).select(*PIXEL, c("n").cast("double").alias("v"))


def area_open(px: DataFrame, threshold: int = 32, connectivity: int = 1) -> DataFrame:
    """Bright components of fewer than ``threshold`` cells sink to the level around them."""
    return ComponentTree(px, connectivity).filter(c("area") >= threshold)


def area_close(px: DataFrame, threshold: int = 32, connectivity: int = 1) -> DataFrame:
    """Dark components of fewer than ``threshold`` cells rise to the level around them."""
    return ComponentTree(px, connectivity, minima=True).filter(c("area") >= threshold)


def tree_labels(px: DataFrame, connectivity: int = 1, minima: bool = False) -> DataFrame:
    return ComponentTree(px, connectivity, minima).labels()
