"""Helpers shared by the operators: lineage cuts, skew-safe look-ups and Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and give tests a checkpoint folder where none is set."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = known or f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        if not known:
            spark.sparkContext.setCheckpointDir(found)
    return found


def tidy(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to any more: plans, broadcasts, generated classes, tables that were cut."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


CUTS = [0]  # tables cut since the last ``tidy``


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; lost executors don't lose it.

    With spark.cleaner.referenceTracking.cleanCheckpoints it goes when its last reference goes. Operators of many rounds
    leave many plans behind, so the driver is tidied after every 16 tables.
    """
    ready(df.sparkSession)
    CUTS[0] += 1
    if CUTS[0] > 16:
        CUTS[0] = 0
        tidy(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(df: DataFrame):
    """About how many bytes a row takes: eight for a fixed value, and the lengths of texts, byte strings and arrays of numbers."""
    out = F.lit(0)
    for f in df.schema:
        kind = f.dataType.typeName()
        size = F.octet_length(f.name) if kind in ("string", "binary") else F.size(f.name) * 8 if kind == "array" else F.lit(8)
        out = out + F.greatest(F.coalesce(size, F.lit(0)), F.lit(8))
    return out.cast("bigint")


def kept(df: DataFrame, per_part: int = 50_000, part_bytes: int = 64 << 20) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows; small tables come back in as few partitions as their rows and bytes need, so that what follows has few tasks."""
    out = cut(df)
    n, size = out.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(out)), F.lit(0))).first()
    return out.coalesce(1 + max(n // per_part, size // part_bytes)), n


def table(df: DataFrame, path: str | None = None) -> DataFrame:
    """As ``cut``, but as compressed Parquet, for wide rows; in a new folder unless ``path`` names one."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def for_now(df: DataFrame) -> Iterator[DataFrame]:
    """``table``, whose files go at the end of the block."""
    spark = df.sparkSession
    name = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    try:
        yield table(df, name)
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ready(df.sparkSession)
    return df.mapInArrow(fn, schema)


def look_up(big: DataFrame, small: DataFrame, keys: list[str], weight: str, rows: int, hot: int = 2000) -> DataFrame:
    """Left-join ``big`` with ``small`` (one row per key, ``weight`` = its rows in ``big``) without a hot task.

    Keys with more than ``rows / hot`` rows in ``big`` number fewer than ``hot``: only those are broadcast, so the
    broadcast side has a proven bound. All other keys are joined by a shuffle in which no key is large. Keys must not
    be null.
    """
    most = max(1, rows // hot)
    extra = [c for c in small.columns if c not in keys]
    packed = small.select(*keys, F.struct(*extra).alias("_v"))
    heavy = packed.filter(F.col(f"_v.{weight}") > most).withColumnRenamed("_v", "_h")
    tagged = big.join(F.broadcast(heavy), keys, "left")
    done = tagged.filter(F.col("_h").isNotNull()).withColumnRenamed("_h", "_v")
    rest = tagged.filter(F.col("_h").isNull()).drop("_h").join(packed, keys, "left")
    return done.unionByName(rest).select(*big.columns, *[F.col(f"_v.{c}").alias(c) for c in extra])


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read; a null text counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text, modulo 3, is 1: rows that no model may learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled documents, those with the smallest hash of the id.

    The sample of ids is bounded by ``sample``, so it is broadcast and no text moves but the sampled ones. Of several
    labels of one id the smallest counts.
    """
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
