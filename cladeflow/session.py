"""Session helpers: sizing, durable lineage cuts and table access."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "cladeflow", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with adaptive execution and skew handling on, in UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
    if shuffle:
        conf["spark.sql.shuffle.partitions"] = str(shuffle)
    return builder.config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the context's checkpoint folder, else
    spark.checkpoint.dir, else (only a local master, as in tests) a temporary one."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cladeflow-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows written as a Parquet table in the shared folder and
    read back. It survives the loss of executors like a checkpoint, is smaller, is pruned by column,
    and its size is known, where a checkpoint keeps the estimate of the plan it
    came from, which grows without bound when a join is iterated. It stays until forget(),
    drop_stored() or the end of the process."""
    return counted(df)[0]


def counted(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """stored(df), and sums over its rows taken while they are written (0 for none): whether anything
    is left to do costs no job of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    seen = Observation()
    rows = df.observe(seen, *(F.sum(c).alias(n) for n, c in sums.items())) if sums else df
    rows.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._cladeflow_path = path
    return back, {n: v or 0 for n, v in seen.get.items()} if sums else {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    at = (df.sparkSession, df._cladeflow_path)
    if at in _written:
        _written.remove(at)
    _delete(*at)


def drop_stored() -> None:
    """Remove the tables that stored() wrote in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the context may be gone already
            pass


atexit.register(drop_stored)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per context,
    wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_cladeflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cladeflow-code-")
    archive = f"{folder}/cladeflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._cladeflow_shipped = True
    atexit.register(shutil.rmtree, folder, True)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if a small file left it in fewer:
    for steps whose work per row outweighs moving the row."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(want) if have < want else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))
