"""Shared helpers: scratch tables in the cluster's shared folder, grouped Arrow streams, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one in the warehouse, which executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/orbitlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            sc = t.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most `rows`, so that a step's Python objects and results stay few.

    A worker lives on for later steps; what Arrow holds unused goes back to the system at the end.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def carried(docs: DataFrame, text: str, keep: list[str], results: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The text as `t` and the columns to carry as `c0`, `c1`, ...; a carried column that clashes with a result is left out."""
    names = [c for c in keep if c not in set(results)]
    return docs.select(docs[text].cast("string").alias("t"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)]), names


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    at = {f"c{i}": n for i, n in enumerate(names)}
    return df.select(*[F.col(c).alias(at.get(c, c)) for c in df.columns])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from batches sorted by integer keys."""
    held: list[pa.Table] = []

    def key_rows(t: pa.Table) -> np.ndarray:
        return np.stack([t[k].to_numpy(zero_copy_only=False) for k in keys])

    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        k = key_rows(t)
        if last is not None and (k == last[:, None]).all():
            held.append(t)
            continue
        change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        first = 0 if last is None or (k[:, 0] == last).all() else -1
        start = int(change[-1]) if len(change) else 0
        if start or first < 0:
            done = held + ([t.slice(0, start)] if start else [])
            if done:
                yield pa.concat_tables(done)
            held = [t.slice(start)]
        else:
            held.append(t)
        last = k[:, -1]
    if held:
        yield pa.concat_tables(held)


#: Bits that tell which keys another table may hold.
BITMAP = 1 << 24


def marked(df: DataFrame, keys: DataFrame, columns: list[str], mark: str) -> DataFrame:
    """The rows with a column that is false only where `keys` holds no row of the same columns.

    A bitmap of the keys' hashes, 2 MB whatever their number, goes to all tasks, so that rows without a mate (texts above
    all) need not be shuffled to find that out. A true mark is no proof: the join decides.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(BITMAP))
    rows = keys.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("w")).toArrow()
    words = np.zeros(BITMAP // 64, np.int64)
    words[rows["at"].to_numpy()] = rows["w"].to_numpy()
    bits = df.sparkSession.createDataFrame(pa.table({"bits__": pa.array([words])}))
    word = F.get("bits__", F.floor(slot / 64).cast("int"))
    test = word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))) != 0
    return df.crossJoin(F.broadcast(bits)).withColumn(mark, test).drop("bits__")


def spread(column: str):
    """A number from 0 to 1 by the hash of a column; equal values get equal numbers."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 52)) / float(1 << 52)


def together(*columns: str):
    """What to give repartition() so that the rows of a group come into one task, also behind a join on the same columns.

    By the columns themselves Spark leaves the step out there, as the join is dealt by them already, and then may split
    the join's large groups over tasks.
    """
    return F.xxhash64(*columns)


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, with the length at the end."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def components(edges: DataFrame, src: str = "a", dst: str = "b", name: str = "cc") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps until the edge set stays the same; each round is stored.
    Rounds grow with the logarithm of the longest path. Null ends and loops are ignored.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u <> v and u is not null and v is not null")
        .distinct()
    )
    now = stored(e, name)

    def sign(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    was = sign(now)
    while was[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low2, "u")
        small = (
            star.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where("u <> v")
            .distinct()
        )
        new = stored(small, name)
        drop_stored(now)
        now, is_ = new, sign(new)
        if is_ == was:
            break
        was = is_
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
