"""SQL forms of the operators, for checks in another engine: gathers by self-join, labels by recursion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..functions import kernels as K
from ..functions.borders import fit_sql

CELL = "image_id, h, w, y, x"


def shown(px: str, v: str = "v", digits: int = 6) -> str:
    return f"SELECT image_id, y, x, round({v}, {digits}) + 0.0 AS v FROM ({px})"


def values(taps: Sequence[K.Tap]) -> str:
    return ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in taps)


def gather(px: str, taps: Sequence[K.Tap], agg: str, mode: str = "constant", value: float = 0.0, having: str = "") -> str:
    """Cells of ``px`` with aggregates over what their taps read: wt and v."""
    y, x = fit_sql("(p.y + k.dy)", "p.h", mode), fit_sql("(p.x + k.dx)", "p.w", mode)
    join = "JOIN" if mode == "valid" else "LEFT JOIN"
    having = f"HAVING count(*) = {len(taps)}" if mode == "valid" else having
    return (
        f"SELECT p.image_id, p.h, p.w, p.y, p.x, {agg} FROM ({px}) p CROSS JOIN (VALUES {values(taps)}) k(dy, dx, wt) "
        f"{join} ({px}) s ON s.image_id = p.image_id AND s.y = {y} AND s.x = {x} GROUP BY ALL {having}"
    ).replace("@v", f"coalesce(s.v, {value!r})").replace("@w", "k.wt")


def convolved(px: str, kernel: K.Kernel, mode: str = "constant", value: float = 0.0, anchor=None) -> str:
    return gather(px, K.taps(kernel, anchor), "sum(@w * @v) AS v", mode, value)


def blurred(px: str, sigma: float, mode: str = "reflect", radius: int | None = None) -> str:
    line = K.gaussian_line(sigma, radius=radius)
    return convolved(convolved(px, [[w] for w in line], mode), [line], mode)


def ranked(px: str, footprint: K.Kernel, rank: int, mode: str = "constant", value: float = 0.0) -> str:
    return gather(px, K.taps(footprint, flip=False), f"list_sort(list(@v))[{rank}] AS v", mode, value)


def eroded(px: str, element: K.Kernel, border: float = 0.0, anchor=None) -> str:
    return gather(px, K.taps(element, anchor), "min(@v) AS v", "constant", border)


def dilated(px: str, element: K.Kernel, border: float = 0.0, anchor=None) -> str:
    return gather(px, K.taps(element, anchor), "max(@v) AS v", "constant", border)


def minus(a: str, b: str, expr: str = "a.v - b.v") -> str:
    return f"SELECT a.image_id, a.h, a.w, a.y, a.x, {expr} AS v FROM ({a}) a JOIN ({b}) b USING (image_id, y, x)"


def gradients(px: str, name: str = "sobel", mode: str = "symmetric", normalise: bool = True, value: float = 0.0) -> str:
    parts = [gather(px, K.taps(K.edge(name, axis, normalise)), f"sum(@w * @v) AS {n}", mode, value) for axis, n in ((0, "gy"), (1, "gx"))]
    return f"SELECT a.*, b.gx FROM ({parts[0]}) a JOIN ({parts[1]}) b USING (image_id, y, x)"


def rooted(px: str, connectivity: int = 1) -> str:
    """Every cell of ``px`` with root: the raster number of its component's first cell, null for background."""
    return (
        f"WITH RECURSIVE f AS (SELECT image_id, y, x, v, y * w + x AS id FROM ({px}) WHERE v <> 0), "
        "e AS (SELECT f.image_id, f.id AS a, g.id AS b FROM f JOIN f g ON g.image_id = f.image_id AND g.v = f.v "
        f"AND abs(g.y - f.y) <= 1 AND abs(g.x - f.x) <= 1 AND abs(g.y - f.y) + abs(g.x - f.x) <= {connectivity}), "
        "r AS (SELECT image_id, id AS a, id AS b FROM f UNION SELECT r.image_id, r.a, e.b FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.b), "
        "m AS (SELECT image_id, a AS id, min(b) AS root FROM r GROUP BY ALL) "
        f"SELECT p.*, m.root FROM ({px}) p LEFT JOIN m ON m.image_id = p.image_id AND m.id = p.y * p.w + p.x"
    )


def labelled(px: str, connectivity: int = 1) -> str:
    return (
        "SELECT image_id, h, w, y, x, CASE WHEN root IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY image_id ORDER BY root NULLS LAST) END::BIGINT AS label "
        f"FROM ({rooted(px, connectivity)})"
    )


def by_area(px: str, threshold: int, connectivity: int = 1) -> str:
    return (
        "SELECT image_id, h, w, y, x, (root IS NOT NULL AND n > "
        f"{threshold})::INT::DOUBLE AS v FROM (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM ({rooted(px, connectivity)}))"
    )


def inverted(px: str) -> str:
    return f"SELECT * REPLACE ((v = 0)::INT::DOUBLE AS v) FROM ({px})"


def filled(px: str, connectivity: int = 1) -> str:
    edge = "y = 0 OR x = 0 OR y = h - 1 OR x = w - 1"
    return f"SELECT image_id, h, w, y, x, (NOT coalesce(max(CASE WHEN {edge} THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, root) = 1 AND root IS NOT NULL, false))::INT::DOUBLE AS v FROM ({rooted(inverted(px), connectivity)})"


def counts(px: str) -> str:
    """Counts of whole values from each image's least to its greatest."""
    return (
        f"SELECT r.image_id, r.b::DOUBLE AS bin, coalesce(c.cnt, 0)::BIGINT AS cnt FROM (SELECT image_id, unnest(range(min(v)::INT, max(v)::INT + 1)) AS b FROM ({px}) GROUP BY 1) r "
        f"LEFT JOIN (SELECT image_id, v, count(*) AS cnt FROM ({px}) GROUP BY ALL) c ON c.image_id = r.image_id AND c.v = r.b"
    )


def sums(px: str) -> str:
    up, down = (f"OVER (PARTITION BY image_id ORDER BY bin ROWS BETWEEN {a})" for a in ("UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
    return (
        f"SELECT *, sum(cnt) {up} AS n1, sum(cnt) {down} AS n2, sum(cnt * bin) {up} / sum(cnt) {up} AS m1, sum(cnt * bin) {down} / sum(cnt) {down} AS m2, "
        f"sum(cnt) OVER (PARTITION BY image_id) AS n FROM ({counts(px)})"
    )


def best(rows: str, crit: str, shift: int = 0, least: bool = False) -> str:
    lead = "OVER (PARTITION BY image_id ORDER BY bin)"
    at = f"lead(bin, {shift}) {lead}" if shift else "bin"
    order = "crit" if least else "crit DESC"
    return f"SELECT image_id, place AS th FROM (SELECT image_id, bin, {at} AS place, round({crit.replace('@lead', lead)}, 9) AS crit FROM ({rows})) WHERE crit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {order}, bin) = 1"


def otsu(px: str) -> str:
    return best(sums(px), "n1 * lead(n2) @lead * pow(m1 - lead(m2) @lead, 2)")


def valley(px: str) -> str:
    """Threshold of each image's histogram, smoothed until two peaks are left: the first least bin between them."""
    peaks = "list_filter(range(1, len({n}) + 1), lambda i: {n}[i] > coalesce({n}[i - 1], -1) AND {n}[i] > coalesce({n}[i + 1], -1))"
    smooth = "[(coalesce(n[i - 1], 0) + n[i] + coalesce(n[i + 1], 0)) / 3 FOR i IN range(1, len(n) + 1)]"
    between = "n[p[1] : p[2]]"
    return (
        f"WITH RECURSIVE t AS MATERIALIZED (SELECT image_id, list(bin ORDER BY bin) AS bins, list(cnt::DOUBLE ORDER BY bin) AS n FROM ({counts(px)}) GROUP BY 1), "
        f"r AS (SELECT image_id, 0 AS step, n, {peaks.format(n='n')} AS p FROM t UNION ALL SELECT image_id, step, m, {peaks.format(n='m')} FROM (SELECT image_id, step + 1 AS step, {smooth} AS m FROM r WHERE len(p) > 2 AND step < 9999)) "
        f"SELECT r.image_id, CASE WHEN len(p) = 2 THEN t.bins[p[1] + list_position({between.replace('n[', 'r.n[')}, list_min({between.replace('n[', 'r.n[')})) - 1] END AS th FROM r JOIN t USING (image_id) WHERE len(p) <= 2"
    )


def weights(p: str, order: int) -> list[tuple[str, str]]:
    """(index, weight) pairs of an interpolation at p."""
    p = f"round({p}, 9)"
    near = f"floor({p})" if order % 2 else f"floor({p} + 0.5)"
    d = f"({p} - {near})"
    w = {
        0: ["1.0"],
        1: [f"(1 - {d})", d],
        2: [f"(({d} * {d} - {d}) / 2)", f"(1 - {d} * {d})", f"(({d} * {d} + {d}) / 2)"],
        3: [f"((-{d} + 2 * pow({d}, 2) - pow({d}, 3)) / 2)", f"((2 - 5 * pow({d}, 2) + 3 * pow({d}, 3)) / 2)", f"(({d} + 4 * pow({d}, 2) - 3 * pow({d}, 3)) / 2)", f"((-pow({d}, 2) + pow({d}, 3)) / 2)"],
    }[order]
    return [(f"({near} - {order // 2} + {k})::INT", x) for k, x in enumerate(w)]


def sampled(px: str, shape: tuple[int, int], sy: str, sx: str, order: int, mode: str = "constant", value: float = 0.0) -> str:
    """A grid of a shape that reads ``px`` at (sy, sx), expressions over o.y, o.x and the input's ih, iw."""
    cells = f"SELECT i.image_id, i.h AS ih, i.w AS iw, y.y::INT AS y, x.x::INT AS x FROM (SELECT DISTINCT image_id, h, w FROM ({px})) i, range({shape[0]}) y(y), range({shape[1]}) x(x)"
    taps = " UNION ALL ".join(
        f"SELECT image_id, y, x, {fit_sql(iy, 'ih', mode)} AS iy, {fit_sql(ix, 'iw', mode)} AS ix, {wy} * {wx} AS wt FROM (SELECT o.*, {sy} AS sy, {sx} AS sx FROM ({cells}) o)" for iy, wy in weights("sy", order) for ix, wx in weights("sx", order)
    )
    return f"SELECT t.image_id, {shape[0]} AS h, {shape[1]} AS w, t.y, t.x, sum(t.wt * coalesce(p.v, {value!r})) AS v FROM ({taps}) t LEFT JOIN ({px}) p ON p.image_id = t.image_id AND p.y = t.iy AND p.x = t.ix GROUP BY ALL"


def sampled_at(px: str, points: str, order: int, mode: str = "constant", value: float = 0.0) -> str:
    """``points`` (image_id, id, y, x) with v, read from ``px``."""
    rows = f"SELECT o.image_id, o.id, o.y AS sy, o.x AS sx, i.h AS ih, i.w AS iw FROM ({points}) o JOIN (SELECT DISTINCT image_id, h, w FROM ({px})) i USING (image_id)"
    taps = " UNION ALL ".join(f"SELECT image_id, id, sy, sx, {fit_sql(iy, 'ih', mode)} AS iy, {fit_sql(ix, 'iw', mode)} AS ix, {wy} * {wx} AS wt FROM ({rows})" for iy, wy in weights("sy", order) for ix, wx in weights("sx", order))
    return f"SELECT t.image_id, t.id, t.sy AS y, t.sx AS x, sum(t.wt * coalesce(p.v, {value!r})) AS v FROM ({taps}) t LEFT JOIN ({px}) p ON p.image_id = t.image_id AND p.y = t.iy AND p.x = t.ix GROUP BY ALL"


def resized(px: str, shape: tuple[int, int], order: int, mode: str = "constant") -> str:
    return sampled(px, shape, f"o.y * (o.ih - 1)::DOUBLE / {shape[0] - 1}", f"o.x * (o.iw - 1)::DOUBLE / {shape[1] - 1}", order, mode)


def warped(px: str, shape: tuple[int, int], m, order: int) -> str:
    x, y, w = (f"({float(r[0])!r}::DOUBLE * o.x + {float(r[1])!r}::DOUBLE * o.y + {float(r[2])!r}::DOUBLE)" for r in m)
    return sampled(px, shape, f"{y} / {w}", f"{x} / {w}", order)


def trees(px: str, connectivity: int = 1) -> str:
    """Common tables of max-trees: ``r`` has all cells b of each cell a's component at a's level l, ``n`` that component's node
    (its least cell at level l) and area, ``o`` each node's parent (null for a root); a node is a row of ``n`` with node = a."""
    return (
        f"WITH RECURSIVE f AS MATERIALIZED (SELECT image_id, h, w, y, x, y::BIGINT * w + x AS id, v FROM ({px})), "
        "e AS MATERIALIZED (SELECT f.image_id, f.id AS a, g.id AS b, g.v FROM f JOIN f g ON g.image_id = f.image_id "
        f"AND abs(g.y - f.y) <= 1 AND abs(g.x - f.x) <= 1 AND abs(g.y - f.y) + abs(g.x - f.x) BETWEEN 1 AND {connectivity}), "
        "r AS (SELECT image_id, id AS a, id AS b, v AS l, v FROM f UNION SELECT r.image_id, r.a, e.b, r.l, e.v FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.b AND e.v >= r.l), "
        "n AS MATERIALIZED (SELECT image_id, a, l, count(*) AS area, sum(v) AS mass, min(CASE WHEN v = l THEN b END) AS node FROM r GROUP BY 1, 2, 3), "
        "q AS (SELECT r.image_id, r.a, arg_max(e.b, e.v) AS near FROM n JOIN r USING (image_id, a) JOIN e ON e.image_id = r.image_id AND e.a = r.b AND e.v < r.l WHERE n.node = n.a GROUP BY 1, 2), "
        "o AS MATERIALIZED (SELECT n.image_id, n.node, n.l AS level, n.area, n.mass, m.node AS parent, m.l AS below FROM n LEFT JOIN q USING (image_id, a) LEFT JOIN n m ON m.image_id = n.image_id AND m.a = q.near WHERE n.node = n.a) "
    )


def tree_filtered(px: str, stays: str, connectivity: int = 1) -> str:
    """Each cell's level of the highest node over it that ``stays`` (a condition on ``o``), 0 where none does."""
    return (
        f"{trees(px, connectivity)} SELECT f.image_id, f.h, f.w, f.y, f.x, coalesce(t.l, 0.0) AS v FROM f LEFT JOIN "
        f"(SELECT r.image_id, r.b, max(r.l) AS l FROM r JOIN o ON o.image_id = r.image_id AND o.node = r.a WHERE {stays} GROUP BY 1, 2) t ON t.image_id = f.image_id AND t.b = f.id"
    )


def thinned(px: str, steps: int) -> str:
    """Set cells after ``steps`` sub-passes, each cell sending its bit to its neighbours; the rule names the codes that go."""
    from ..operators.thinning import RING, TABLES

    bits = ", ".join(f"({-dy}, {-dx}, {1 << i})" for i, (dy, dx) in enumerate(RING)) + ", (0, 0, 256)"
    gone = " WHEN ".join(f"{k} THEN code - 256 IN ({', '.join(str(i) for i in np.flatnonzero(t))})" for k, t in enumerate(TABLES))
    return (
        f"WITH RECURSIVE t(dy, dx, bit) AS (VALUES {bits}), g AS MATERIALIZED (SELECT * FROM ({px})), r AS (SELECT 0 AS step, image_id, y, x FROM g WHERE v <> 0 UNION ALL "
        "SELECT step + 1, image_id, y, x FROM (SELECT r.step, r.image_id, r.y + t.dy AS y, r.x + t.dx AS x, sum(t.bit) AS code FROM r, t GROUP BY 1, 2, 3, 4) "
        f"WHERE step < {steps} AND code >= 256 AND NOT (CASE step % 2 WHEN {gone} END)) "
        f"SELECT g.* REPLACE ((r.step IS NOT NULL)::INT::DOUBLE AS v) FROM g LEFT JOIN r ON r.step = {steps} AND r.image_id = g.image_id AND r.y = g.y AND r.x = g.x"
    )


def gather_volume(px: str, taps: Sequence[tuple[tuple[int, int, int], float]], agg: str, mode: str = "constant", value: float = 0.0) -> str:
    """``gather`` on volumes."""
    at = [f"s.{a} = {fit_sql(f'(p.{a} + k.d{a})', f'p.{n}', mode)}" for a, n in zip("zyx", "dhw", strict=True)]
    rows = ", ".join(f"({z}, {y}, {x}, {w!r}::DOUBLE)" for (z, y, x), w in taps)
    return (
        f"SELECT p.image_id, p.d, p.h, p.w, p.z, p.y, p.x, {agg} FROM ({px}) p CROSS JOIN (VALUES {rows}) k(dz, dy, dx, wt) "
        f"LEFT JOIN ({px}) s ON s.image_id = p.image_id AND {' AND '.join(at)} GROUP BY ALL"
    ).replace("@v", f"coalesce(s.v, {value!r})").replace("@w", "k.wt")


def rooted_volume(px: str, connectivity: int = 1) -> str:
    """``rooted`` on volumes, with n, the component's cells."""
    return (
        f"WITH RECURSIVE g AS MATERIALIZED (SELECT *, (z::BIGINT * h + y) * w + x AS id FROM ({px})), f AS (SELECT * FROM g WHERE v <> 0), "
        "e AS MATERIALIZED (SELECT f.image_id, f.id AS a, g.id AS b FROM f JOIN f g ON g.image_id = f.image_id AND g.v = f.v AND abs(g.z - f.z) <= 1 "
        f"AND abs(g.y - f.y) <= 1 AND abs(g.x - f.x) <= 1 AND (g.z <> f.z)::INT + (g.y <> f.y)::INT + (g.x <> f.x)::INT BETWEEN 1 AND {connectivity}), "
        "r AS (SELECT image_id, id AS a, id AS b FROM f UNION SELECT r.image_id, r.a, e.b FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.b), "
        "m AS (SELECT image_id, a AS id, min(b) AS root, count(*) AS n FROM r GROUP BY 1, 2) SELECT g.*, m.root, m.n FROM g LEFT JOIN m USING (image_id, id)"
    )


def reached(px: str, open_: str, seeds: str, moves: Sequence[tuple[int, int]], kept: str) -> str:
    """Cells of ``px`` with v by ``kept`` (of ``hit``), where open cells are reached from seeds by moves (dy, dx)."""
    steps = ", ".join(f"({dy}, {dx})" for dy, dx in moves)
    return (
        f"WITH RECURSIVE g AS MATERIALIZED (SELECT *, {open_} AS free FROM ({px}) p), k(dy, dx) AS (VALUES {steps}), r AS (SELECT image_id, y, x FROM g WHERE free AND ({seeds}) "
        "UNION SELECT g.image_id, g.y, g.x FROM r CROSS JOIN k JOIN g ON g.image_id = r.image_id AND g.y = r.y + k.dy AND g.x = r.x + k.dx AND g.free) "
        f"SELECT image_id, h, w, y, x, ({kept})::INT::DOUBLE AS v FROM (SELECT g.*, r.y IS NOT NULL AS hit FROM g LEFT JOIN r USING (image_id, y, x))"
    )
