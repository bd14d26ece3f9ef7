"""Session settings, durable cut points and scratch space.

Every place that must survive the loss of an executor goes through `durable`
(a reliable checkpoint) or `scratch_path` (a table written to shared storage).
Both live under `spark.checkpoint.dir`, which the cluster names.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES = "8m"  # rows that a Python worker gets at once; it holds several times as much while it works on them

_LOCAL_DIRS: dict[str, str] = {}  # temp folder per local session that names none


def local_session(app: str = "threadloom", cores: str = "8", checkpoint_dir: str | None = None) -> SparkSession:
    """A session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach; only a local master may fall back to a temp one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="threadloom-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (never a local one)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to shared storage and read back.

    Used for the small side of a join whose other side may have a hot key: an aggregate on the join
    key would sit between its shuffle and the join, and the adaptive skew join splits only inputs that
    come straight from a shuffle. Read back, a small table is broadcast by its known size, and a large
    one is shuffled alone.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _store(path: str):
    """File system and path inside it, for small files that tasks write to shared storage themselves."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def make_dir(path: str) -> None:
    fs, base = _store(path)
    fs.create_dir(base, recursive=True)


def has_file(folder: str, name: str) -> bool:
    fs, base = _store(folder)
    return fs.get_file_info(f"{base}/{name}").is_file


def commit_bytes(folder: str, name: str, data: bytes) -> None:
    """Whole or not at all: written under a temporary name, then renamed."""
    fs, base = _store(folder)
    temporary = f"{base}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, f"{base}/{name}")


def commit_text(folder: str, name: str, text: str) -> None:
    commit_bytes(folder, name, text.encode())


def open_file(folder: str, name: str):
    fs, base = _store(folder)
    return fs.open_input_file(f"{base}/{name}")


def read_bytes(folder: str, name: str) -> bytes:
    with open_file(folder, name) as f:
        return f.read()


def drop_file(folder: str, name: str) -> None:
    """Remove a file that tasks wrote, if it is there."""
    fs, base = _store(folder)
    if fs.get_file_info(f"{base}/{name}").is_file:
        fs.delete_file(f"{base}/{name}")


def fetch_if_small(df: DataFrame, max_rows: int) -> list | None:
    """Rows of `df` when there are at most `max_rows` of them, else None.

    The limit is pushed below the collect, so an oversized input costs the driver
    `max_rows + 1` rows and no more; callers then take their shuffled path.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def _bytes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.lower().rstrip("b")
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def splits(df: DataFrame) -> int:
    """About how many tasks read `df`, by its estimated size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size // _bytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")) + 1


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on an input too small to have a split per core.

    A table of one small file is read by one task. Its estimated size decides: anything that
    gives every core a split of its own is left alone, so a large table is never shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) else df
