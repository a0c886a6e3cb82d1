"""Table functions for SQL: shapes as relations that a query joins laterally.

    register(spark)
    spark.sql("SELECT s.id, c.y, c.x FROM segments s, LATERAL draw_line(s.y1, s.x1, s.y2, s.x2) c")

Lines, circles and stamps are SQL functions, which Spark plans into the query; ellipses follow their midpoints and are a
Python table function. ``register`` takes further ones: a name and its definition, or a table function of Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .shapes import ellipse_points

#: Parameters, columns and body of each function.
DEFINED = {
    "draw_line": (
        "y1 INT, x1 INT, y2 INT, x2 INT",
        "i INT, y INT, x INT",
        """SELECT t.i,
            y1 + sign(y2 - y1)::INT * CASE WHEN abs(y2 - y1) > abs(x2 - x1) OR x1 = x2 THEN t.i ELSE ((2 * abs(y2 - y1) * t.i + abs(x2 - x1)) div (2 * abs(x2 - x1)))::INT END,
            x1 + sign(x2 - x1)::INT * CASE WHEN abs(y2 - y1) > abs(x2 - x1) THEN ((2 * abs(x2 - x1) * t.i + abs(y2 - y1)) div (2 * abs(y2 - y1)))::INT ELSE t.i END
        FROM explode(sequence(0, greatest(abs(y2 - y1), abs(x2 - x1)))) AS t(i)""",
    ),
    # Columns x of the octant y > x and one more: the greatest y with y^2 + (y - 1)^2 < 2 (r^2 - x^2).
    "draw_circle": (
        "cy INT, cx INT, r INT",
        "y INT, x INT",
        """SELECT DISTINCT cy + o.dy, cx + o.dx FROM inline(flatten(transform(
            filter(transform(sequence(0, r), x -> named_struct('x', x, 'y', CASE WHEN x = 0 THEN r WHEN r * r - x * x <= 0 THEN 0
                ELSE ((1 + floor(sqrt(4 * (r * r - x * x) - 2))) div 2)::INT END)), (k, i) -> k.y > k.x OR i = 0
                OR i = 1 + size(filter(transform(sequence(1, r), x -> CASE WHEN r * r - x * x <= 0 THEN 0 ELSE ((1 + floor(sqrt(4 * (r * r - x * x) - 2))) div 2)::INT END - x), g -> g > 0))),
            k -> CASE WHEN k.y > k.x THEN array(named_struct('dy', k.y, 'dx', k.x), named_struct('dy', -k.y, 'dx', -k.x), named_struct('dy', -k.y, 'dx', k.x), named_struct('dy', k.y, 'dx', -k.x),
                named_struct('dy', k.x, 'dx', k.y), named_struct('dy', -k.x, 'dx', -k.y), named_struct('dy', -k.x, 'dx', k.y), named_struct('dy', k.x, 'dx', -k.y))
                ELSE array(named_struct('dy', k.y, 'dx', k.x), named_struct('dy', -k.y, 'dx', -k.x), named_struct('dy', -k.y, 'dx', k.x), named_struct('dy', k.y, 'dx', -k.x)) END))) AS o(dy, dx)""",
    ),
    "stamp": (
        "cy INT, cx INT, shape STRING, r INT",
        "y INT, x INT",
        """SELECT cy + o.dy, cx + o.dx FROM inline(filter(flatten(transform(sequence(-r, r), a -> transform(sequence(-r, r), b -> named_struct('dy', a, 'dx', b)))),
            q -> CASE shape WHEN 'SQUARE' THEN greatest(abs(q.dy), abs(q.dx)) = r WHEN 'CROSS' THEN q.dy = 0 OR q.dx = 0 ELSE raise_error('shape is SQUARE or CROSS') END)) AS o(dy, dx)""",
    ),
}


class Ellipse:
    """Cells of an ellipse about (cy, cx) with half axes a along x and b along y."""

    def eval(self, cy: int, cx: int, a: int, b: int):
        if None not in (cy, cx, a, b):
            for dy, dx in dict.fromkeys(ellipse_points(a, b)):
                yield cy + dy, cx + dx


PYTHON = {"draw_ellipse": udtf(Ellipse, returnType="y int, x int")}


def register(spark: SparkSession, more: dict | None = None) -> list[str]:
    """Make the table functions known to ``spark``, with ``more`` by name: (parameters, columns, body) or a Python table function."""
    every = {**DEFINED, **PYTHON, **(more or {})}
    for name, f in every.items():
        if isinstance(f, tuple):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({f[0]}) RETURNS TABLE ({f[1]}) RETURN {f[2]}")
        else:
            spark.udtf.register(name, f)
    return list(every)
