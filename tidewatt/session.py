"""Session helpers: written intermediate tables and size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when its counted rows and its written bytes stay under these bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, as named by the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="run-")


#: Folders written by this process that ``release`` has not removed yet.
_WRITTEN: list[tuple[SparkSession, str]] = []


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends at the written files, so a lost executor costs no rework, and
    later reads still prune columns and push filters down.  The files go with
    ``release`` or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """A mark for ``release``: how many tables stand written now."""
    return len(_WRITTEN)


def release(since: int = 0) -> None:
    """Remove the tables written after mark ``since``; results that read them must be saved before."""
    while len(_WRITTEN) > since:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the session may have ended; the folder's owner cleans up then
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def settled(df: DataFrame, since: int) -> DataFrame:
    """``durable(df)``, after which the tables that it was made from, written after mark ``since``, are removed."""
    out = durable(df)
    kept = _WRITTEN.pop()
    release(since)
    _WRITTEN.append(kept)
    return out


atexit.register(release)

# Spark's setting by which an action removes its shuffle files when it has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Actions inside leave no shuffle files behind.

    Otherwise those of every step stay on disk until the driver happens to collect its
    garbage.  A plan that is run again makes its shuffles anew.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def join_shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sends neither side through the driver.

    The size of a written table is guessed from its compressed files, and lists of
    regular steps shrink a hundredfold there, so a plain join broadcasts large tables.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join one fact row per key (null keys match each other).

    ``facts`` is materialised and measured.  Within the bounds it is broadcast;
    beyond them the join shuffles and adaptive execution splits skewed keys.
    """
    facts = durable(facts)
    written = int(facts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    small = written <= BROADCAST_BYTES and facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    renamed = facts.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = [rows[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys]
    joined = rows.join(F.broadcast(renamed), on, how) if small else join_shuffled(rows, renamed, on, how)
    return joined.drop(*[f"_key_{k}" for k in keys])
