"""What the operators share: reading tables, the shared folder, words, hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one is set if all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="relweave-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_column(df: DataFrame, name: str) -> None:
    """Raises where a column that an operator adds would replace one that is there."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {name!r} already; give the operator another name to write to")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read again: the lineage ends here, and the files
    outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/relweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text) -> F.Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def parts(rows: int, per_part: int, spark: SparkSession) -> int:
    """As many partitions as the rows need, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part), 1)
