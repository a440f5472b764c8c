"""State tables and crawled pages: reading, and writing a run's new state all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.schemas import CRAWLED_PAGES, JOB_HISTORY, KEYS, TABLES, conform
from jobtide.sources.shared import exists

# History is read by change date (scoring looks back two days), so its folders are split by month.
_MONTH = "change_month"
# Folders of history: by the run that wrote them, and whether that was all of it or what it added.
_HISTORY = f"{JOB_HISTORY}, whole BOOLEAN, run STRING, {_MONTH} DATE"


def load_tables(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    columns: dict[str, dict[str, str]] | None = None,
    values: dict[str, dict[str, dict[str, str]]] | None = None,
    **options,
) -> dict[str, DataFrame]:
    """The four state tables below ``path`` with declared columns and defaults, one stored table to a folder.

    ``columns`` gives our name of a stored column, ``values`` our value of a stored
    one (both by table); a table without its key column is an error. What ``write_snapshot`` wrote is read by ``read_snapshot``.
    """
    read = spark.read.format(fmt).options(**options)
    return {name: _stored(read.load(f"{path}/{name}"), name, (columns or {}).get(name), (values or {}).get(name)) for name in TABLES}


def load_jdbc(
    spark: SparkSession, url: str, options: dict[str, dict[str, str]] | None = None, columns=None, values=None, **shared
) -> dict[str, DataFrame]:
    """The same tables from a database. ``options`` by table can hold its ``partitionColumn`` and bounds, to read it in parallel."""
    found = {name: spark.read.format("jdbc").options(url=url, **shared, **(options or {}).get(name, {})).option("dbtable", name).load() for name in TABLES}
    return {name: _stored(df, name, (columns or {}).get(name), (values or {}).get(name)) for name, df in found.items()}


def _stored(df: DataFrame, table: str, columns: dict[str, str] | None = None, values: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """A stored table in the declared layout."""
    df = df.withColumnsRenamed(columns or {})
    if missing := [k for k in KEYS[table] if k not in df.columns]:
        raise ValueError(f"{table} has no column {', '.join(missing)}; name it in columns")
    for name, ours in (values or {}).items():
        df = df.withColumn(name, F.coalesce(*[F.when(F.col(name) == old, new) for old, new in ours.items()], F.col(name)))
    return conform(df, table)


def crawled_pages(pages: DataFrame, max_pages: int = 5) -> DataFrame:
    """At most the first ``max_pages`` pages of every crawl; ``pages`` may be a table or a stream."""
    return pages.filter(F.col("page_num") <= max_pages)


def spread(df: DataFrame) -> DataFrame:
    """Split a scan that has fewer partitions than there are cores.

    A file with one big row group is read by one task, however costly the work on its rows. For small tables only: all rows are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def conform_pages(pages: DataFrame) -> DataFrame:
    """Exactly the declared columns of crawled pages; absent ones become null."""
    fields = [f.split() for f in CRAWLED_PAGES.split(", ")]
    return pages.select(*[(F.col(name) if name in pages.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def load_pages(spark: SparkSession, path: str, max_pages: int = 5) -> DataFrame:
    """Stored pages. Write them in small row groups: a scan is split by these and ``spark.sql.files.maxPartitionBytes``, and no html is shuffled."""
    return crawled_pages(spark.read.schema(CRAWLED_PAGES).parquet(path), max_pages)


def stream_pages(spark: SparkSession, path: str, max_pages: int = 5, files_per_trigger: int = 1000) -> DataFrame:
    stream = spark.readStream.schema(CRAWLED_PAGES).option("maxFilesPerTrigger", files_per_trigger)
    return crawled_pages(stream.parquet(path), max_pages)


def write_snapshot(tables: dict[str, DataFrame], path: str, run_id: str, added: dict[str, DataFrame] | None = None) -> None:
    """Write the tables that a run changed below ``path``, and history rows that it added; then mark the run as whole.

    Each table is an ordinary Parquet write of its own, ``path/table/run=run_id``, history by month below; a table that is not given stays as the last run before left it. Run
    ids sort in the order of the runs. A run that is not whole does not count, and can be written again; one that is whole stays as it is, and doing it
    again takes another id.
    """
    if not tables and not added:
        raise ValueError("a snapshot needs at least one table")
    spark = next(iter([*tables.values(), *(added or {}).values()])).sparkSession
    if run_id in _whole_runs(spark, path):
        raise ValueError(f"run {run_id} is there already")
    for name, df in tables.items():
        if name == "job_history":
            _write_history(df, path, run_id, whole=True)
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}/run={run_id}")
    for name, df in (added or {}).items():
        if name != "job_history":
            raise ValueError(f"rows are only added to history, not to {name}")
        _write_history(df, path, run_id, whole=False)
    # an empty table of its own, whose _SUCCESS says that all others are there
    spark.createDataFrame([], "table_name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/{run_id}")


def _write_history(df: DataFrame, path: str, run_id: str, whole: bool) -> None:
    # Ranges of time, then of job for busy moments: a task writes into one or two month folders, and
    # row groups cover narrow spans of time that a reader can skip.
    dated = df.select(*[f.split()[0] for f in JOB_HISTORY.split(", ")], F.trunc("changed_at", "month").alias(_MONTH))
    ranged = dated.repartitionByRange("changed_at", "job_id").sortWithinPartitions("changed_at", "job_id")
    ranged.write.mode("overwrite").partitionBy(_MONTH).parquet(f"{path}/job_history/whole={str(whole).lower()}/run={run_id}")


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``, in order."""
    if not exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(s.getPath().getName() for s in found)


def _whole_runs(spark: SparkSession, path: str) -> list[str]:
    return [run for run in _names(spark, f"{path}/runs") if exists(spark, f"{path}/runs/{run}/_SUCCESS")]


def read_snapshot(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """Tables as they were after a run; fails when the run is not whole. History keeps the month its folders go by."""
    done = [run for run in _whole_runs(spark, path) if run <= run_id]
    if run_id not in done:
        raise ValueError(f"run {run_id} is not whole below {path}")

    def last(folder: str) -> str | None:
        written = {name.removeprefix("run=") for name in _names(spark, folder)}
        return max(written.intersection(done), default=None)

    tables = {name: spark.read.schema(TABLES[name]).parquet(f"{path}/{name}/run={run}") for name in TABLES if name != "job_history" and (run := last(f"{path}/{name}"))}
    first = last(f"{path}/job_history/whole=true")
    broken = [n.removeprefix("run=") for n in _names(spark, f"{path}/job_history/whole=false") if n.removeprefix("run=") not in done]
    if first is None:
        return tables
    rows = spark.read.schema(_HISTORY).parquet(f"{path}/job_history")
    since_then = (F.col("run") >= first) & (F.col("run") <= run_id) & ~F.col("run").isin(broken)
    kept = rows.where((F.col("whole") & (F.col("run") == first)) | (~F.col("whole") & since_then))
    return {**tables, "job_history": kept.drop("whole", "run")}


def append_history(history: DataFrame, changes: DataFrame) -> DataFrame:
    """History with new rows, which also get the month their folder goes by where history has it."""
    if _MONTH in history.columns:
        changes = changes.withColumn(_MONTH, F.trunc("changed_at", "month"))
    return history.unionByName(changes, allowMissingColumns=True)


def since(history: DataFrame, moment) -> DataFrame:
    """History rows from ``moment`` on, pruned to the month folders that can hold them."""
    kept = history.filter(F.col("changed_at") >= moment)
    return kept.filter(F.col(_MONTH) >= F.trunc(moment, "month")) if _MONTH in history.columns else kept
