"""Vector code compression: product codes of integer vectors, with codebooks by Lloyd's rounds under Hamerly's bounds.

Each vector is cut in parts; each part keeps the entry that it is assigned to, one
upper bound of the distance to it and one lower bound of the distance to the second
nearest. A round moves the bounds by how far the entries went, and scans all entries
only for parts whose bounds no longer fail strictly to meet. Integers decide every
assignment, so ties go to the lower index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A label with more than this share of the rows meets its sum in a broadcast join; there are at most as many as its inverse.
HOT = 1000
#: Rounding of floating bounds is far below this share of them.
SLACK = 1e-12
#: What a row carries from round to round beside its integers, a byte and two 32-bit bounds a part.
STATE = ["at", "upper", "lower"]


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries; floating point serves where it is exact."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    kind = np.float64 if 4 * float(most) ** 2 * max(x.shape[1], 1) < 2**52 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)).astype(np.int64)


def own_squares(x: np.ndarray, book: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - book[at]
    return (d * d).sum(1)


class Bounds:
    """One part's codebook, with how far its entries moved and half of how far they are from each other."""

    def __init__(self, book: np.ndarray, moved: np.ndarray | None):
        self.book = book
        between = np.sqrt(squares(book, book).astype(float))
        np.fill_diagonal(between, np.inf)
        self.half = between.min(1) / 2 * (1 - SLACK)
        if moved is not None:
            self.moved = moved * (1 + SLACK)
            order = np.argsort(-self.moved, kind="stable")
            self.others = np.full(len(book), self.moved[order[0]])
            self.others[order[0]] = self.moved[order[1]] if len(order) > 1 else 0.0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry (the lower of equal ones), upper bound to it and lower bound to the next."""
        d = squares(x, self.book)
        at, rows = d.argmin(1), np.arange(len(d))
        upper = np.sqrt(d[rows, at].astype(float)) * (1 + SLACK)
        if len(self.book) == 1:
            return at, upper, np.full(len(d), np.inf)
        d[rows, at] = np.iinfo(np.int64).max
        return at, upper, np.sqrt(d.min(1).astype(float)) * (1 - SLACK)

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring assignments and bounds up to date in place; the number of full scans."""
        upper += self.moved[at]
        lower -= self.others[at]
        open_ = np.flatnonzero(~(upper < np.maximum(lower, self.half[at])))
        if len(open_):
            upper[open_] = np.sqrt(own_squares(x[open_], self.book, at[open_]).astype(float)) * (1 + SLACK)
            open_ = open_[~(upper[open_] < np.maximum(lower[open_], self.half[at[open_]]))]
        if len(open_):
            at[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return len(open_)


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    step = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int64) * step
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def outward(x: np.ndarray, to: float) -> np.ndarray:
    """Bounds in 32 bits, rounded to the safe side."""
    return np.nextafter(x.astype(np.float32), np.float32(to))


def _integers(width: int, most: int):
    """Vectors (lists of doubles) as packed integers, zeros behind those shorter than ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
            out = np.zeros((len(batch), width), np.int32)
            out[np.arange(width) < sizes[:, None]] = np.clip(flat, -most, most).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed(out)], names=["vec_id", "label", "q"])

    return run


def _round(books: np.ndarray, moved: np.ndarray | None, last: bool):
    """Assign every part; then, but for the last time, one further row of sums and counts for each task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(b, None if moved is None else m) for b, m in zip(books, moved if moved is not None else books, strict=True)]
        sums = np.zeros((parts, entries, width + 2), np.int64)
        kinds = None
        for batch in batches:
            kinds = [batch.column(c).type for c in ("vec_id", "label")]
            n = len(batch)
            q = unpacked(batch.column("q"), np.int32, parts * width).reshape(n, parts, width) if n else np.zeros((0, parts, width), np.int32)
            if moved is None:
                at, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts))
            else:
                at = unpacked(batch.column("at"), np.uint8, parts).copy()
                upper, lower = (unpacked(batch.column(c), np.float32, parts).astype(float) for c in ("upper", "lower"))
            error = np.zeros(n, np.int64)
            for p, b in enumerate(bounds):
                x, a, u, low = q[:, p], at[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                if moved is None:
                    a, u, low = b.scan(x)
                    scanned = n
                else:
                    scanned = b.assign(x, a, u, low)
                at[:, p], upper[:, p], lower[:, p] = a, u, low
                if last:
                    error += own_squares(x, b.book, a)
                else:
                    one = np.zeros((entries, n), np.int64)
                    one[a, np.arange(n)] = 1
                    sums[p, :, :width] += one @ x.astype(np.int64)
                    sums[p, :, width] += one.sum(1)
                    sums[p, 0, width + 1] += scanned
            if last:
                code = pa.array([bytes(r).hex() for r in at], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(error)], names=["vec_id", "label", "code", "error"])
            else:
                none = pa.nulls(n, pa.list_(pa.int64()))
                state = [packed(at), packed(outward(upper, np.inf)), packed(outward(lower, -np.inf))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("q"), *state, none], names=["vec_id", "label", "q", *STATE, "sums"])
        if kinds is not None and not last:
            empty = [pa.nulls(1, k) for k in (*kinds, *[pa.binary()] * 4)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=["vec_id", "label", "q", *STATE, "sums"])

    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Product codes of ``vectors`` (vec_id, embedding, label): rows (vec_id, label, code, error), final codebooks, scans.

    Rows go whose vector is null or holds null, NaN or infinite components. The others'
    components become floor(4096 * x). Vectors of several lengths, or of one that ``parts``
    does not divide, count as padded with zeros to the next that it does; components so
    far out that an error would not fit a long saturate. A codebook starts as the parts
    of the smallest vec_ids (nulls last; equal ids by their packed integers), fewer where
    there are fewer rows. Repeated rows have the same code; an empty table gives an empty
    result; further columns are left alone. ``code`` has two hex digits for each part.

    Every round is one pass over a table in the shared folder, without a shuffle of
    vectors: tasks add up their own parts, and only those sums, whose number the
    parameters bound, go to the driver. ``scans`` counts full scans of parts by round.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    most = math.isqrt(2**61 // max(longest, 1))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    plain = f"vec_id {kind['vec_id']}, label {kind['label']}, q binary"
    table = stored(rows.mapInArrow(_integers(width * parts, most), plain), "vectors")
    first = table.orderBy(F.col("vec_id").isNull(), "vec_id", "q").limit(entries).collect()
    if not first:
        return table.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, width), np.int64), []
    books = np.array([np.frombuffer(r.q, np.int32) for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    moved, scans = None, []
    for _ in range(rounds):
        out = stored(table.mapInArrow(_round(books, moved, False), plain + ", at binary, upper binary, lower binary, sums array<bigint>"), "codes")
        discard(table)
        added = out.where("sums is not null").select(F.posexplode("sums").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n")).collect()
        sums = np.zeros(parts * len(first) * (width + 2), np.int64)
        sums[[r.place for r in added]] = [r.n for r in added]
        sums = sums.reshape(parts, len(first), width + 2)
        count = sums[:, :, width, None]
        new = np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books)
        moved = np.sqrt(((new - books).astype(float) ** 2).sum(2))
        scans.append(int(sums[:, 0, width + 1].sum()))
        at_rest, books = (new == books).all(), new
        kept = out.where("q is not null").drop("sums")
        kept.stored_at = out.stored_at
        table = kept
        if at_rest:  # every further round would give the same entries
            break
    done = stored(table.mapInArrow(_round(books, moved, True), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "coded")
    discard(table)
    return done, books, scans


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` (label, error) with the sum of the errors of all equal labels; nulls are one label.

    Labels with over a thousandth of all rows, of which there are fewer than a thousand,
    are broadcast with their sums; the rest meet theirs in a join that no label makes uneven.
    A sum that no long holds is null.
    """
    total = rows.count()
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error"))
    sums = stored(sums.select(F.struct("label").alias("__of"), "label_error", (F.col("n") * HOT > total).alias("hot")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("__of.label"))
    split = rows.join(F.broadcast(sums.where("hot")), same, "left")
    hot = split.where("hot").drop("__of", "hot")
    cold = split.where("hot is null").drop("__of", "hot", "label_error").join(sums.where("not hot"), same).drop("__of", "hot")
    return hot.unionByName(cold)


def digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    rows, books, _ = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out: parts are rows (vec_id, part, list), entries (part, entry, list)."""
    nearest = """
        select vec_id, p, min_by(e, d * 256 + e) as e, min(d) as d from (
            select q.vec_id, q.p, b.e, list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
            from q join b{r} as b using (p)) group by vec_id, p"""
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} as materialized ({nearest.format(r=r)})")
        steps.append(f"""s{r} as (
            select p, e, j, sum(x)::bigint as s, count(*) as n from (
                select a.p, a.e, generate_subscripts(q.v, 1) as j, unnest(q.v) as x from a{r} as a join q using (vec_id, p)) group by p, e, j)""")
        steps.append(f"""u{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by j) as v from s{r} group by p, e)""")
        steps.append(f"b{r + 1} as materialized (select b.p, b.e, coalesce(u.v, b.v) as v from b{r} as b left join u{r} as u using (p, e))")
    steps = ",\n".join(steps)
    return f"""
    with kept as (
        select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
        where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
    q as materialized (
        select vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as v from kept, range({PARTS}) t(p)),
    b0 as materialized (
        select q.p, f.e, q.v from q join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit {ENTRIES}) f using (vec_id)),
    {steps},
    final as ({nearest.format(r=ROUNDS)}),
    coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from final group by vec_id),
    named as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from b{ROUNDS})
    select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
    from coded join kept using (vec_id), named"""


SQL = _sql()
