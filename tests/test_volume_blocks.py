import numpy as np
import pyarrow as pa
import pytest

from tesserae.operators import volumes
from tesserae.operators.volumes import Space


def test_cells_are_read_once_and_blocks_go_together(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    px = spark.range(300 * 8).selectExpr("id div 8 AS image_id", "2 AS d", "2 AS h", "2 AS w", "CAST(id div 4 % 2 AS int) AS z", "CAST(id div 2 % 2 AS int) AS y", "CAST(id % 2 AS int) AS x", "CAST(id % 8 IN (0, 3, 7) AS double) AS v")
    out = Space().label(px.mapInArrow(counted, px.schema))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {(r.image_id, r.z, r.y, r.x): r.label for r in out.collect()}
    want = {(i, n // 4, n // 2 % 2, n % 2): {0: 1, 3: 2, 7: 2}.get(n, 0) for i in range(300) for n in range(8)}
    assert got == want and seen.value == len(want)


@pytest.mark.parametrize("gathered", [1, 50, 10_000])
def test_parts_do_not_depend_on_batches(monkeypatch, gathered):
    monkeypatch.setattr(volumes, "GATHERED", gathered)
    rng = np.random.default_rng(4)
    grids = [rng.integers(0, 2, (5, 6)).astype(float) for _ in range(7)]
    rows = []
    for k, g in enumerate(grids):
        for (y, x), v in np.ndenumerate(g):
            rows.append({"key": None if k == 3 else str(k), "y": y, "x": x, "v": None if v and (y + x) % 9 == 0 else v, "__n": y * 6 + x, "__y": y // 4, "__x": x // 4})
    rows.sort(key=lambda r: (r["key"] or "", r["__y"], r["__x"], r["__n"]))
    kinds = pa.schema([("key", pa.string()), ("y", pa.int32()), ("x", pa.int32()), ("v", pa.float64()), ("__n", pa.int64()), ("__y", pa.int64()), ("__x", pa.int64())])
    batches = pa.Table.from_pylist(rows, kinds).to_batches(max_chunksize=11)
    run = volumes._parts(["key"], ["y", "x"], 4, [(0, 1), (1, 0)])
    got = {(r["key"], r["y"], r["x"]): r["part"] for b in run(iter(batches)) for r in b.to_pylist()}
    assert len(got) == len(rows)
    on = {(r["key"], r["y"], r["x"]): (r["__y"], r["__x"]) for r in rows if r["v"]}
    for at in got:
        if at not in on:
            assert got[at] is None
            continue
        reached, todo = {at}, [at]
        while todo:
            k, y, x = todo.pop()
            near = {(k, y + 1, x), (k, y - 1, x), (k, y, x + 1), (k, y, x - 1)} & on.keys()
            near = {n for n in near - reached if on[n] == on[at]}
            reached |= near
            todo += near
        assert got[at] == min(y * 6 + x for _, y, x in reached)
