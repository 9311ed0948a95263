"""Plumbing shared by the operators: the folder all executors see, and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``materialize`` that no plan needs any more."""
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


#: A key is heavy with more rows than this, and than the PARTS-th part of all rows, so there are fewer than PARTS heavy keys.
HEAVY, PARTS = 512, 4096


def spread_join(left: DataFrame, right: DataFrame, key: str, number: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key`` and in ``number`` about how many rows of ``left`` have it.

    Heavy keys are dealt in parts, each with its copy of the row of ``right``; rows of ``left`` without a key are dealt too.
    """
    most = max(HEAVY, total // PARTS)
    parts = F.ceil(F.col(number) / most).cast("int")
    heavy = F.broadcast(right.where(F.col(number) > most).select(key, parts.alias("_parts")))  # fewer than PARTS rows
    row = F.xxhash64(*[left[c] for c in left.columns])
    salt = F.pmod("_row", F.when(F.col(key).isNull(), PARTS).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")
    dealt = left.withColumn("_row", row).join(heavy, key, "left").withColumn("_salt", salt).drop("_row", "_parts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(number) > most, parts).otherwise(1) - 1)))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; rows where it is 0 are held out. A null identifier counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


#: Rows and bytes of an Arrow batch of texts; a Python worker holds a few copies of a batch.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def text_of(docs: DataFrame) -> Column:
    """The text with null as ''. Texts may be long, so the session's Arrow batches are bounded where they are larger."""
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return F.coalesce(docs["text"].cast("string"), F.lit(""))
