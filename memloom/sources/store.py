"""Tables as directories of snapshots: copy-on-write Parquet, one writer, many readers."""

from __future__ import annotations

import atexit
import contextlib
import json
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all tasks run on this machine (tests).
LOCAL_SHARED = "file:///tmp/checkpoints/memloom"
_folders: set[str] = set()
#: Paths written within the innermost ``settled``.
_steps: ContextVar[list[str] | None] = ContextVar("memloom_steps", default=None)
#: Spark then deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_SHARED
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _discarded(spark: SparkSession, folder: str) -> None:
    """Delete this application's written tables when the driver's Python ends."""

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, folder)

    atexit.register(drop)


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files; for plans that run once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once into the shared folder and read it back.

    A lost executor costs no recomputation of what is written here.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        _discarded(spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.parquet(path)
    steps = _steps.get()
    if steps is not None:
        steps.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written; the tables that ``make`` wrote on its way are deleted. Only its result may be read later."""
    steps: list[str] = []
    token = _steps.set(steps)
    try:
        plan = make()
    finally:
        _steps.reset(token)
    out = written(plan)
    for path in steps:
        _delete(spark, path)
    return out


def insert_absent(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``table`` and the first row of each new key."""
    first = new.dropDuplicates([key])
    return table.unionByName(first.join(table.select(key), key, "left_anti").select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, key: str = "id", columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """New rows replace ``columns`` (all by default) of rows of equal key; of several new rows the last by ``order`` counts."""
    if order:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        new = new.withColumn("up_n", last).where("up_n = 1").drop("up_n")
    change = columns or [c for c in table.columns if c != key]
    fresh = new.select(key, F.lit(True).alias("up_hit"), *[F.col(c).alias(f"up_{c}") for c in table.columns if c != key])
    out = table.withColumn("up_old", F.lit(True)).join(fresh, key, "full")
    return out.select(
        key,
        *[
            F.when(F.col("up_hit") & (F.col("up_old").isNull() | F.lit(c in change)), F.col(f"up_{c}")).otherwise(F.col(c)).alias(c)
            for c in table.columns
            if c != key
        ],
    ).select(*table.columns)


def update_from(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` takes the value of ``values`` where there is one."""
    v = values.select(key, F.col(column).alias("up_value"))
    return table.join(v, key, "left").withColumn(column, F.coalesce("up_value", column)).select(*table.columns)


def retire(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Soft retirement: rows stay, but represent nothing."""
    gone = ids.select(key).distinct().withColumn("up_gone", F.lit(True))
    return table.join(gone, key, "left").withColumn("is_representative", F.col("is_representative") & F.col("up_gone").isNull()).select(*table.columns)


def delete(table: DataFrame, ids: DataFrame, key: str = "id", cascade: dict[str, tuple[DataFrame, str]] | None = None):
    """``table`` without the ids; with ``cascade`` also the dependent tables, by name."""
    left = table.join(ids.select(key), key, "left_anti")
    if cascade is None:
        return left
    return left, {n: d.join(ids.select(F.col(key).alias(c)), c, "left_anti") for n, (d, c) in cascade.items()}


class Store:
    """Named tables under a root. A table is a list of file folders, kept in numbered manifests; readers see the highest number.

    A writer creates the next number without overwriting: of two writers one fails and tries again, and a crash
    leaves the last manifest in place. Appending adds a folder, it rewrites nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _manifests(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def exists(self, name: str) -> bool:
        return bool(self._manifests(name))

    def current(self, name: str) -> dict:
        """The highest manifest: its number, schema version and folders."""
        number = self._manifests(name)[-1]
        rows = self.spark.read.text(f"{self.root}/{name}/manifests/{number:012d}").collect()  # one line
        return json.loads(rows[0][0]) | {"number": number}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{name}/{x}" for x in self.current(name)["folders"]])

    def _put(self, name: str, number: int, folders: list[str], version: int) -> bool:
        """Create a manifest; False if another writer took the number."""
        target = self._path(f"{self.root}/{name}/manifests/{number:012d}")
        draft = self._path(f"{self.root}/{name}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"folders": folders, "schema_version": version}).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        if not self._fs.exists(target):
            # Hadoop's rename does not replace a file that is there.
            if self._fs.rename(draft, target):
                return True
        self._fs.delete(draft, False)
        return False

    def _written(self, name: str, df: DataFrame, partition: list[str] | None) -> str:
        folder = uuid.uuid4().hex
        writer = df.write.partitionBy(*partition) if partition else df.write
        writer.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def write(self, name: str, df: DataFrame, partition: list[str] | None = None, version: int = 6) -> None:
        """Replace the table. Fails if another writer changed it meanwhile: ``df`` may derive from what it was."""
        number = (self._manifests(name) or [0])[-1] + 1
        folder = self._written(name, df, partition)
        if not self._put(name, number, [folder], version):
            raise RuntimeError(f"{name} was changed by another writer")

    def append(self, name: str, df: DataFrame, version: int = 6, attempts: int = 20) -> None:
        """Add rows. Independent of what is there, so a lost race is tried again."""
        folder = self._written(name, df, None)
        for _ in range(attempts):
            have = self.current(name) if self.exists(name) else {"number": 0, "folders": []}
            if self._put(name, have["number"] + 1, [*have["folders"], folder], version):
                return
        raise RuntimeError(f"{name}: {attempts} attempts to append were overtaken")


def verify_schema(df: DataFrame, expected: str) -> None:
    """Raise unless ``df`` has the columns and types of a DDL string."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType for f in StructType.fromDDL(expected).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{n}: {t.simpleString()} expected, {have[n].simpleString() if n in have else 'nothing'} found" for n, t in want.items() if have.get(n) != t]
    if wrong:
        raise ValueError("; ".join(wrong))
