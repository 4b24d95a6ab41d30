"""A training-data pipeline over ``documents``, of five operators of flatscan.llm.

Each stage takes the documents that the one before it kept and returns their
columns; the last returns the encoded texts. Between stages the rows are written
as Parquet, so a stage never runs the ones before it again; what no stage reads any
more is deleted. Texts of any length go through whole, and columns of other names
than documents has stay as far as the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatscan.llm.common import new_dir, remove_dir, spread, table
from flatscan.llm.decontamination import decontaminate
from flatscan.llm.line_dedup import line_dedup
from flatscan.llm.near_duplicates import keep_one
from flatscan.llm.pieces import encode
from flatscan.llm.quality_classifier import fit, score
from flatscan.llm.queries import PIECE_MODEL

THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null text is judged as an empty one. Ties at the threshold stay, and repeated
    rows stay or go together. An empty table stays empty; without labels all stay.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    kept = "__p_score"
    return score(docs, model, out=kept).where(F.col(kept) >= THRESHOLD).drop(kept)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that occurred before; n_chars follows the text.

    A null text stays null; copies may end up with an empty text, which stays a
    row. Ties and repeated rows keep their lines alike. An empty table stays empty.
    """
    out = line_dedup(docs, whole_runs=True).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Empty texts are one group; rows with a null text all stay. Of repeated rows one
    stays. An empty table stays empty.
    """
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together. An
    empty table stays empty, and without items all stay.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless): a sampled segmentation of each document, and whether it decodes to the text.

    A null text has null pieces and decodes to null; an empty one has none. Rows
    with equal ids and texts get equal pieces. An empty table stays empty. Other
    columns are not returned, whatever their names.
    """
    out = encode(docs.select("doc_id", "text"), PIECE_MODEL, decoded="decoded")
    n = F.coalesce(F.size("pieces"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_pieces"), "pieces", F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", pieces),
]

#: Not expressible: the classifier is fitted in Python, and sampling needs its hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table."""
    docs, folder = spread(table(spark, sf_dir, "documents")), new_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            remove_dir(spark, f"{folder}/{k - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
