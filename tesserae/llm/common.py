"""Helpers shared by the corpus operators: shared storage, row keys, words and hashes."""

from __future__ import annotations

import re
import uuid

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table that turns ASCII upper case to lower case and every other non-word byte to a space.
ALNUM_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset in a local
    session, as in tests, the SQL warehouse serves, which one machine shares with itself.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: what follows depends on files that survive any executor,
    and values such as row keys are fixed once and for all.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more: all that was made of them is stored itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """``row_no`` (unique per row), ``doc_id``, further columns, and the text with null as empty.

    Row numbers follow from the partitions of the scan, so a lost task gives the
    same ones again; repeated doc_ids and nulls stay apart. A later job may scan
    in other partitions: numbers that are met again there come from ``located``.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col("doc_id"),
        *columns,
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


#: Steps of a plan that give each row of a file at most once.
ROW_BY_ROW = {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "View"}


def bare_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of Parquet files, filtered and projected at most: no explode, join or union has made rows of its rows."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    step = docs._jdf.queryExecution().analyzed()
    while step.nodeName().split(" ")[0] in ROW_BY_ROW:
        if step.children().isEmpty():
            return True
        step = step.children().head()
    return False


def in_files(docs: DataFrame) -> DataFrame:
    """``docs`` if each of its rows has a place of its own in Parquet files, else a stored copy, whose rows have."""
    return docs if bare_scan(docs) else stored(docs, "rows")


def located(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of ``docs`` (from ``in_files``) and ``row_no``, unique per row and the same in every job.

    The number is the file's rank by path and the row's place in the file; neither
    depends on how a scan is cut into partitions.
    """
    rows = docs.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__place"), *columns)
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    files = docs.sparkSession.createDataFrame([(p, i << 40) for i, p in enumerate(paths)], "__path string, __first long")
    rows = rows.join(F.broadcast(files), "__path")
    return rows.withColumn("row_no", F.col("__first") + F.col("__place")).drop("__path", "__place", "__first")


def located_texts(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``located`` with doc_id, further columns, and the text with null as empty."""
    return located(docs, "doc_id", *columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one column ``row``, whatever its columns are called, and its text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def rows_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number (of ``located``) is in ``kept`` (row_no), all columns as they were."""
    rows = located(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(kept.select("row_no").hint("merge"), "row_no", "left_semi").select("row.*")


def key(row: str = "doc_id"):
    """Order key that puts null ids last."""
    return F.struct(F.col(row).isNull(), F.col(row))


class WordHash(dict):
    """Word to 64-bit hash; bounded, as it forgets all it knows when full."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


class WordPrint(dict):
    """Word to two independent 64-bit hashes; bounded like ``WordHash``."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_128_digest(word)
        return value

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(map(self.__getitem__, words)), U64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grams(hashes: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of n words, by Horner's rule modulo 2^64."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, U64)
    b = U64(base | 1)
    total = np.zeros(count, U64)
    for k in range(n):
        total = total * b + hashes[k : count + k]
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
