"""File sources and sinks with the contracts checked on the way in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.contracts import SPARK_TYPES, ColumnSpec, ContractError, require


def _missing_path(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)


def read_csv_contract(spark: SparkSession, path: str, specs: Sequence[ColumnSpec], validate: bool = True) -> DataFrame:
    """Typed CSV scan. Extra columns are kept as text so that validation reports them."""
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if _missing_path(e):
            raise FileNotFoundError(path) from e
        raise
    family = {s.name: s.family for s in specs}
    schema = T.StructType([T.StructField(c, SPARK_TYPES.get(family.get(c, "text"))) for c in header])
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
          .option("mode", "FAILFAST").csv(path))
    return require(df, specs) if validate else df


def read_tables(spark: SparkSession, paths: dict[str, tuple[str, T.StructType]]) -> dict[str, DataFrame]:
    """Several CSV tables, each with a declared schema."""
    return {n: spark.read.schema(s).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(p)
            for n, (p, s) in paths.items()}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, min_rows: int = 100) -> DataFrame:
    """One JSON record per line; blank lines are skipped and a bad line or too few rows fails."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    n = df.limit(min_rows).count()
    if n < min_rows:
        raise ContractError(f"{path}: {n} records, expected at least {min_rows}")
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line, characters kept as they are."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def materialise(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a parquet folder when its writer has marked it complete, otherwise build and write it first.

    Only a folder without the mark is written anew; any other trouble with a complete one is the caller's to see.
    """
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def oof_table(df: DataFrame, key: Sequence[str], probs: Sequence[str], y: str, yhat: str) -> DataFrame:
    """The stored out-of-fold layout, with the id."""
    return df.select(*key, *[F.col(p).alias(f"prob_{i + 1}") for i, p in enumerate(probs)],
                     F.col(y).alias("true_label"), F.col(yhat).alias("pred_label"))


RUN_SCHEMA = "run string, model string, fold int, metric string, value double"


def append_run_records(df: DataFrame, path: str) -> None:
    """Add run records (run, model, fold, metric, value) to a parquet log."""
    df.select(*[f.split()[0] for f in RUN_SCHEMA.split(", ")]).write.mode("append").parquet(path)


#: Bytes of one read, and the schemes that tasks can read as streams.
READ, STREAMED = 1 << 23, {"file", "hdfs", "s3", "s3a", "gs"}


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, length) of the files that a path or pattern names, directly or as a folder's content."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(at) or []:
        found += [f for f in fs.listStatus(s.getPath()) if f.isFile()] if s.isDirectory() else [s]
    return [(f.getPath().toUri().toString(), f.getLen()) for f in found]


def _streamed(uri: str) -> str:
    scheme, _, rest = uri.partition(":")
    return f"{'s3' if scheme == 's3a' else scheme}://{rest.removeprefix('//')}"


def file_fingerprints(spark: SparkSession, paths: Sequence[str], read: int = READ) -> DataFrame:
    """SHA-256 of each file's bytes, or a missing marker. Files of any size are read as streams by the executors, one file a task and `read` bytes at once.

    Paths of other schemes than those in STREAMED are read whole.
    """
    import hashlib

    found, missing = [], []
    for p in paths:
        own = _listed(spark, p)
        found += own
        missing += [] if own else [(p, "missing", None)]

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(_streamed(uri))
                digest, n = hashlib.sha256(), 0
                with system.open_input_stream(at, compression=None) as f:
                    while block := f.read(read):
                        digest.update(block)
                        n += len(block)
                out.append((uri, digest.hexdigest(), n))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([r[1] for r in out]), pa.array([r[2] for r in out], pa.int64())], ["path", "sha256", "length"])

    schema = "path string, sha256 string, length bigint"
    streams = [(u,) for u, _ in found if u.partition(":")[0] in STREAMED]
    whole = [u for u, _ in found if u.partition(":")[0] not in STREAMED]
    out = spark.createDataFrame(missing, schema)
    if streams:
        out = out.union(spark.createDataFrame(streams, "path string").repartition(len(streams)).mapInArrow(run, schema))
    if whole:
        f = spark.read.format("binaryFile").load(whole)
        out = out.union(f.select("path", F.sha2("content", 256).alias("sha256"), "length"))
    return out


def table_fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row count and the sum of a 60-bit md5 prefix per row; independent of order and partitioning."""
    text = [F.col(c).cast("string") for c in cols]
    # Length and value of each cell, so that neither a missing cell nor a separator in a text can stand for another row.
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    h = F.conv(F.substring(F.md5(F.concat(*cells)), 1, 15), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def discover_one(spark: SparkSession, root: str, name: str) -> str:
    """The only file of a given name below a folder; none or several is an error."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name)
             .load(root).select("path").distinct().limit(3).collect())
    if len(found) != 1:
        raise FileNotFoundError(f"expected exactly one {name} below {root}, found {'several' if found else 'none'}")
    return found[0]["path"]
