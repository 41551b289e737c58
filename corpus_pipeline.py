"""Documents to packed sequences: toxic ones go, recurring lines, near copies and benchmark passages too; what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm import common
from tidemark.llm.decontaminate import CONTAMINATED, contamination
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.packing import pack
from tidemark.llm.templates import drop_recurring_lines
from tidemark.llm.toxicity import fit, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL states the trained scores or the token ids.
ORACLE_SQL = None


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_key``: what a stage decides about a text holds for every row with that text, whatever its ``doc_id``."""
    return docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))


def _as_documents(docs: DataFrame) -> DataFrame:
    """Texts with their keys in place of ids, which may be null or stand twice."""
    return docs.select(F.xxhash64("text").alias("doc_id"), "text")


def _without(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text is not in ``verdict`` (doc_id: a text key)."""
    gone = common.stored(verdict.select(F.col("doc_id").alias("gone")).distinct(), "pipeline-gone")
    if gone.count() <= common.SMALL_ROWS:
        gone = F.broadcast(gone)
    marked = _marked(docs)
    return marked.join(gone, marked["text_key"] == gone["gone"], "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows whose text is scored as toxic, also those without ``doc_id``; null and empty texts stay.

    Labels of a fifth of the documents stay unused, as in the operator's own query. Rows of one ``doc_id`` are judged each by its own text.
    """
    model = fit(docs, common.documents(spark, sf_dir, "labels"))
    return _without(docs, score(_as_documents(docs), model).where("score >= 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that recur over documents; ``n_chars`` follows the text. A text of recurring lines only becomes empty, unless others are exact copies of it."""
    out = drop_recurring_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: of the rows with the text that names the class, the one with the smallest ``doc_id``, a null one last.

    Texts without words link with nothing and stay, each row of them.
    """
    classes = jaccard_components(_as_documents(docs)).where("n_shingles > 0").select(F.col("doc_id").alias("own"), "component_id").distinct()
    classes = common.stored(classes, "pipeline-classes")
    marked = _marked(docs)
    known = marked.join(classes, marked["text_key"] == classes["own"], "left")
    first = Window.partitionBy("text_key").orderBy(F.asc_nulls_last("doc_id"), "source", "lang", "n_chars")
    named = known.where("own = component_id").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return known.where("own IS NULL").select(*COLUMNS).unionAll(named.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows of whose words at least a twentieth stand in benchmark windows, also those without ``doc_id``; wordless texts stay."""
    found = contamination(_as_documents(docs), common.documents(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(CONTAMINATED))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with the crc32 of their ids in place of the ids; rows without ``doc_id`` and repeated ones are packed as well."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
