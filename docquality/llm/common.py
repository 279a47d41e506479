"""What the operators share: scratch tables on shared storage, text batches, stable hashes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a worker holds as Python strings at a time.
BATCH_ROWS = 512
#: What a session that has Spark's own bounds of Arrow batches gets instead: (setting, default, bound).
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16m"))
#: Bytes of kept tables that one task writes on from.
TASK_BYTES = 8_000_000
#: Bytes of a kept table that may be broadcast.
SMALL_BYTES = 8_000_000
#: Lets Spark remove the shuffle files of a write when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a cluster, once for each application, and keep Arrow batches small.

    Results are lazy, so the bounds have to hold when the caller runs them; those that the caller has set are left."""
    sc, package = spark.sparkContext, Path(__file__).parents[1]
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        path = Path(tempfile.mkdtemp(prefix="docquality-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
    for key, default, bound in BATCHES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, bound)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, empty ones left out."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_memories: dict[str, list] = {}


def remembers(owner: str, clear) -> None:
    """Tell how an operator's memory in this process is cleared; see holds_memory()."""
    _memories.setdefault(owner, []).append(clear)


def holds_memory(owner: str) -> None:
    """Say that an operator begins a task in this worker: what others remember from earlier tasks is dropped, so that a
    worker that lives through all stages of a pipeline holds one operator's memory at a time."""
    for other, clears in _memories.items():
        if other != owner:
            for clear in clears:
                clear()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session without other machines gets a
    temporary folder; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docquality-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds within the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Scratch:
    """Tables written once to shared storage, which survive the loss of executors and cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, None] = {}
        self.n = 0

    def keep(self, df: DataFrame, of: tuple[DataFrame, ...] = ()) -> DataFrame:
        """Write df, and return it as read back; its shuffle files go. The schema is given, so that no job infers it.

        of: the kept tables that df is made of. A table made of little is written by few tasks, TASK_BYTES of them each,
        so that rounds over small tables do not leave, and read, a small file for every partition."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        if of:
            df = df.coalesce(1 + sum(map(self.bytes_of, of)) // TASK_BYTES)
        with setting(self.spark, CLEANUP, "true"):
            df.write.parquet(path)
        self.paths[path] = None
        out = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)
        out._scratch_path = path
        return out

    def bytes_of(self, df: DataFrame) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def small(self, df: DataFrame) -> DataFrame:
        """A kept table for a join: to be broadcast if its files are small enough for that, else as it is."""
        return F.broadcast(df) if self.bytes_of(df) <= SMALL_BYTES else df

    def drop(self, *frames: DataFrame) -> None:
        """Free the storage of tables that nothing reads any more."""
        for df in frames:
            self._delete(df._scratch_path)

    def drop_all_but(self, *frames: DataFrame) -> None:
        """Free every table but these."""
        stay = {df._scratch_path for df in frames}
        for path in [p for p in self.paths if p not in stay]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        if path in self.paths:
            del self.paths[path]
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of an Arrow batch; null reads as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """f: batch of BATCH_ROWS at most → dict of columns."""
    ship(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = f(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value, f):
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def lower_ascii(col):
    """A-Z to lower case, and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
