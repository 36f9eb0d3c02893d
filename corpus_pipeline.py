"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the last
return the columns of docs. A null text counts as empty, which the quality rules reject; an empty table stays empty; extra
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import lines, minhash, mixing, quality, sentencepiece_codec
from relweave.llm.common import table, written
from relweave.llm.queries import piece_model


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.quality(docs, into="__quality")
    return judged.where("__quality.kept").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that are boilerplate in its source; n_chars follows the text."""
    out = lines.line_dedup(docs, "source").select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number each, written so that a row has the same number wherever the table is read."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), f"pipeline-{name}-rows")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the least id (rows without id come last), whether or not rows share an
    id; repeated rows become one."""
    keyed = numbered(docs, "near-dedup")
    kept = minhash.near_duplicates(keyed, row_col="__row").where("kept").select("__row")
    return keyed.join(kept, "__row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whether or not others share its id."""
    keyed = numbered(docs, "mixing")
    plan = mixing.mix(keyed, row_col="__row").where("copies > 0").select("__row", F.col("copies").alias("__copies"))
    return keyed.join(plan, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with its ids, their number and the digest of what they decode to."""
    out = sentencepiece_codec.encode(docs, piece_model(), into="__pieces")
    ids = F.col("__pieces.ids")
    return out.select(*[c for c in docs.columns if c != "text"], ids.alias("ids"), F.size(ids).cast("long").alias("n_tokens"), F.sha2("__pieces.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_boilerplate),
    ("minhash near-dedup", one_of_each),
    ("mixing sources", mix_sources),
    ("sentencepiece encoding", encode),
]

#: SentencePiece and suffix arrays can't be said in SQL; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
