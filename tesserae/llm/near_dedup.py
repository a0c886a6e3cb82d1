"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

SuperMinHash gives element e a random permutation p of the m slots and ranks
r + j that grow with the step j; slot p[j] keeps the least rank. The slots' values
are correlated so that the estimate varies less than that of independent hashes,
and once every slot holds a value below j no later step can change anything: with
many elements two or three steps do.

Documents with the same set of shingles become one node first. Nodes that share a
band are candidates. A band's members are first linked to its most typical node; links
are confirmed on the full sets; then only members of one band that ended up in
different components are compared, which loses no link and yet spares the pairs
within a group. Of those, parity sketches of the sets rule out nearly all that are
no link, without error, before they become rows. A band of many components (texts of
one template that differ too much for links) is cut into blocks; each pair of blocks
is a group of bounded size that any task can take, and sizes that no link can have
between them are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHash, grams, in_files, key, located_texts, mixed, rows_kept, signed, stored

SHINGLE = 5
SLOTS = 128
BAND = 4
#: Similarity, in hundredths.
LEAST = 75
#: Longs of a set's parity sketch.
SKETCH = 32
#: Elements hashed at once in a task.
ELEMENTS = 300_000
#: Nodes of a block of a band; a group of two blocks holds some 10 MB of sketches.
BLOCK = 1 << 14


def shingle_set(text: bytes, words: WordHash, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, one hash of them all."""
    w = text.lower().split()
    if not w:
        return np.empty(0, U64)
    h = words.of(w)
    if len(w) < shingle:
        return grams(h, len(w), base=0xD6E8FEB86659FD93 + 2 * len(w))
    return np.unique(grams(h, shingle))


def super_minhash(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures of several sets at once: ``owner`` numbers the set of each element."""
    least = np.full(sets * slots, np.iinfo(np.int64).max, np.int64)
    chosen: list[np.ndarray] = []
    for j in range(slots):
        x = mixed(elements + U64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x & U64(0xFFFFFFFF)) * U64(slots - j)) >> U64(32)).astype(np.int16)
        place = k
        for i in range(j - 1, -1, -1):  # where the swaps so far have brought slot k from
            place = np.where(place == chosen[i], np.int16(i), place)
        rank = (x >> U64(32)).astype(np.int64) | (j << 32)
        np.minimum.at(least, owner * slots + place, rank)
        chosen.append(k)
        going = least.reshape(sets, slots).max(axis=1) >= (j + 1) << 32
        live = going[owner]
        if not live.any():
            break
        if not live.all():
            elements, owner, chosen = elements[live], owner[live], [c[live] for c in chosen]
    return least.reshape(sets, slots)


def band_keys(signatures: np.ndarray, band: int = BAND) -> np.ndarray:
    s = mixed(signatures.astype(U64)).reshape(len(signatures), -1, band)
    h = np.broadcast_to(np.arange(s.shape[1], dtype=U64), s.shape[:2]).copy()
    for i in range(band):
        h = mixed(h * U64(0x9E3779B97F4A7C15) + s[:, :, i])
    return signed(h)


def parity_sketches(elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """Every element flips one bit of its set's sketch. Two sketches differ in no more bits than their sets
    have elements that are not common, so a pair whose sketches differ too much is surely no link."""
    size = SKETCH * 64
    bits = np.bincount(owner * size + (mixed(elements ^ U64(0x5851F42D4C957F2D)) & U64(size - 1)).astype(np.int64), minlength=sets * size) & 1
    return np.packbits(bits.astype(np.uint8).reshape(sets, size), axis=1).view(np.int64)


def _signatures(shingle: int, slots: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = batch.column("row_no")
            ids = batch.column("doc_id")
            begin, sets, size = 0, [], 0
            for i in range(len(texts)):
                sets.append(shingle_set(texts[i].as_py(), words, shingle))
                size += len(sets[-1])
                if size >= ELEMENTS or i + 1 == len(texts):
                    yield _signed_sets(rows[begin : i + 1], ids[begin : i + 1], sets, slots, band)
                    begin, sets, size = i + 1, [], 0

    return run


def _signed_sets(rows, ids, sets, slots, band) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(full)), sizes[full])
    keys = band_keys(super_minhash(elements, owner, len(full), slots), band) if len(full) else np.empty((0, slots // band), np.int64)
    sketches = parity_sketches(elements, owner, len(full))
    with np.errstate(over="ignore"):
        sums = [np.array([f(s).sum(dtype=U64) for s in sets], U64) for f in (mixed, lambda s: mixed(s ^ U64(0xA5A5A5A5A5A5A5A5)))]
    offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, keys.shape[1], 0))))
    bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))
    held = iter(sketches)
    sketch = pa.array([next(held).tobytes() if n else None for n in sizes], pa.binary())
    names = ["row_no", "doc_id", "n_shingles", "s1", "s2", "bands", "sketch"]
    return pa.RecordBatch.from_arrays([rows, ids, pa.array(sizes), pa.array(signed(sums[0])), pa.array(signed(sums[1])), bands, sketch], names=names)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            data = [shingle_set(t.as_py(), words, shingle).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), pa.array(data, pa.binary())], names=["node", "elements"])

    return run


def _confirmed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(100 * both >= least * (len(a) + len(b) - both))
            yield pc.filter(batch.select(["a", "b"]), pa.array(keep, pa.bool_()))

    return run


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, least: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose full shingle sets are similar enough.

    The set of b is shuffled with each pair, that of a is not: what is in many pairs should be an a.
    """
    nodes = pairs.select(F.col("a").alias("row_no")).unionByName(pairs.select(F.col("b").alias("row_no"))).distinct()
    texts = located_texts(docs).select("row_no", "text").join(nodes.hint("merge"), "row_no", "left_semi")
    sets = stored(texts.mapInArrow(_sets(shingle), "node long, elements binary"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    return stored(both.mapInArrow(_confirmed(least), "a long, b long"), "links")


def near_pairs(group: np.ndarray, n: np.ndarray, root: np.ndarray, sketch: np.ndarray, side: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (indices) within groups, across their sides if they have two, that sizes and sketches do not rule out as links.

    |A - B| + |B - A| <= (|A| + |B|) * (100 - least) / (100 + least) for links; the sketches bound the left side
    from below. Each row, by size, meets the next of its group, then the one after, until that is too large.
    """
    order = np.lexsort((n, group))
    group, n, root, sketch, side = group[order], n[order], root[order], sketch[order].view(np.uint64), side[order]
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    two = np.repeat(np.minimum.reduceat(side, start) != np.maximum.reduceat(side, start), np.diff(np.append(start, len(n))))
    found, live, step = [], np.arange(len(n) - 1), 1
    while len(live):
        i, j = live, live + step
        go = (group[i] == group[j]) & (least * n[j] <= 100 * n[i])
        i, j = i[go], j[go]
        live = i[i + step + 1 < len(n)]
        go = (root[i] != root[j]) & (~two[i] | (side[i] != side[j]))
        i, j = i[go], j[go]
        apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        go = (100 + least) * apart <= (100 - least) * (n[i] + n[j])
        found.append(np.stack([order[i[go]], order[j[go]]]))
        step += 1
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def _crossed(least: int, rows: int = 20_000):
    """Rows sorted by band and pair of blocks: the pairs (a, b), a < b, of nodes that may be links. Small groups are worked on together."""

    def pairs(held: list[pa.RecordBatch], groups: list[np.ndarray]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        node, n, root, mine = (table.column(c).to_numpy() for c in ("node", "n", "root", "mine"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.int64).reshape(-1, SKETCH)
        i, j = near_pairs(np.concatenate(groups), n, root, sketch, mine, least)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups, size, last, at = [], [], 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "low", "high")], 1)
            new = np.concatenate(([last is None or (keys[0] != last).any()], (keys[1:] != keys[:-1]).any(axis=1)))
            group, last = at + np.cumsum(new), keys[-1]
            if size >= rows and new.any():  # what came before the last group's first row is complete
                cut = int(np.flatnonzero(new)[-1])
                yield pairs([*held, batch.slice(0, cut)], [*groups, group[:cut]])
                held, groups, size = [], [], 0
                held.append(batch.slice(cut))
                groups.append(group[cut:])
            else:
                held.append(batch)
                groups.append(group)
            size += len(groups[-1])
            at = int(group[-1])
        if held:
            yield pairs(held, groups)

    return run


def crossing(at: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """Pairs of nodes of different roots that share a band of ``at`` (node, n, band, root, sketch) and may be links."""
    sizes = at.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    blocks = F.ceil(F.col("members") / block).cast("int")
    rows = at.join(sizes.select("band", blocks.alias("blocks")).hint("merge"), "band")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("band", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") < F.col("other")).alias("mine"), "node", "n", "root", "sketch")
    dealt = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    return dealt.mapInArrow(_crossed(least), "a long, b long").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one batch after the other: each edge leads to a smaller node."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        edges = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([r for _, r in edges], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node and its root, the smallest node; lone nodes are left out.

    Union-find within tasks shrinks the edges; rounds of large and small stars, each
    an aggregation and a join, then pull every node to its root. No component is
    gathered in one task.
    """
    edges = links.where("a != b").mapInArrow(_joined, "a long, b long")
    edges, before = stored(edges.distinct(), "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = stored(small.where("a != b").distinct(), "edges")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, slots: int = SLOTS, band: int = BAND) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``least`` hundredths.

    ``docs`` is a table read from files with ``doc_id`` and ``text``. Returns one row
    per row: row_no, doc_id, n_shingles, component_id (the smallest doc_id of the
    component), kept. Texts without words, empty or null ones have no shingles and
    are linked with nothing, not even each other. Of repeated rows one is kept; a
    null id counts as the largest. An empty table gives an empty result; further columns are
    left alone. What a task holds grows with its longest text, and no text is cut. Links are confirmed on full sets; with 32 bands of
    4 slots a pair at exactly 0.75 is missed as a candidate with probability 5e-6.
    """
    docs = in_files(docs)
    schema = "row_no long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"
    signs = stored(located_texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_signatures(shingle, slots, band), schema), "signatures")
    by = ["s1", "s2", "n_shingles"]
    one = signs.where("n_shingles > 0").groupBy(*by).agg(F.min(F.struct("row_no", "bands", "sketch")).alias("one"))
    nodes = stored(one.select(F.col("one.row_no").alias("node"), "one.bands", "one.sketch", *by), "nodes")

    rows = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    counts = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(rows.join(counts, "band"), "shared")
    # The text that others were made from has the most company in its bands: a good centre to link them to.
    score = shared.groupBy("node").agg(F.sum("members").alias("score"))
    ranked = shared.join(score, "node").withColumn("rank", F.struct("score", -F.col("node"), "node", "n"))
    heads = ranked.groupBy("band").agg(F.max("rank").alias("head"))
    alike = lambda x, y: 100 * F.least(x, y) >= least * F.greatest(x, y)
    star = shared.join(heads, "band").where((F.col("node") != F.col("head.node")) & alike(F.col("n"), F.col("head.n")))
    # A head is in many pairs.
    pairs = stored(star.select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = confirmed(docs, pairs, shingle, least)
    roots = components(links)

    at = shared.join(roots, "node", "left").select("node", "n", "band", F.coalesce("root", "node").alias("root"))
    torn = at.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    at = stored(at.join(torn, "band", "left_semi").join(nodes.select("node", "sketch"), "node"), "torn")
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = stored(crossing(at, least).join(done, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        roots = components(links.unionByName(confirmed(docs, cross, shingle, least)))

    member = signs.drop("bands", "sketch").join(nodes.drop("bands", "sketch"), by, "left").join(roots, "node", "left")
    member = member.select("row_no", "doc_id", "n_shingles", F.coalesce("root", "node").alias("part"))
    first = member.where("part is not null").groupBy("part").agg(F.min(F.struct(key().alias("id"), "row_no")).alias("first"))
    return member.join(first, "part", "left").select(
        "row_no",
        "doc_id",
        "n_shingles",
        F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("first.id.doc_id")).alias("component_id"),
        (F.col("part").isNull() | (F.col("first.row_no") == F.col("row_no"))).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all columns as they were."""
    docs = in_files(docs)
    return rows_kept(docs, near_groups(docs).where("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_no")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
