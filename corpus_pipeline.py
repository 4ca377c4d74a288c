"""Cleaning of a document corpus: five stages, each written as Parquet and read again as the next one's input.

Stages but the last return the columns of documents.

Cases: a null or empty text scores by the model's bias, has no lines and no words,
and is one near copy of all such texts, of which one stays. Repeated rows (equal
in doc_id and text) stay until the near copies, which keep one of them. Of texts
that tie the smallest doc_id stays, a null one last. Columns named like the
operators' own are set aside and come back. An empty table gives none from
every stage. The last stage's rows are those of ``packing.pack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import decontaminate, line_dedup, near_copies, packing, toxicity
from loomtrace.llm.shared import table, written


#: Columns that the operators add; documents' own ones of such a name are set aside meanwhile.
WORKING = {"score", "clean_text", "n_lines", "n_removed", "n_words", "n_hit", "spans", "items", "id", "text_key", "runs"}


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns under names that no operator uses, and what each is called in the end."""
    names = {f"own {c}" if c.lower() in WORKING else c: c for c in docs.columns}
    return docs.toDF(*names), names


def _back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def _with_text(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """clean_text for text; n_chars follows where the text has changed."""
    changed = ~F.col("text").eqNullSafe(F.col("clean_text"))
    if "n_chars" in names:
        found = found.withColumn("n_chars", F.when(changed, F.length("clean_text").cast(found.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _back(found.withColumn("text", F.col("clean_text")), names)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold. The model learns from the labelled documents of sf_dir."""
    docs, names = _aside(docs)
    model = toxicity.trained(spark, sf_dir)
    return _back(toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD), names)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of passages; a document that was nothing else goes."""
    docs, names = _aside(docs)
    return _with_text(line_dedup.deduplicated(docs).where("n_removed = 0 OR n_removed < n_lines"), names)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (SimHash and MinHash find them, 5-word shingles decide: similarity of 0.8 at least): that of the smallest doc_id."""
    docs, names = _aside(docs)
    return _back(near_copies.one_of_each(docs), names)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that occur in benchmark items; a document that was nothing else goes."""
    docs, names = _aside(docs)
    found = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), clean=True)
    return _with_text(found.where("n_hit = 0 OR n_hit < n_words"), names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences."""
    return packing.pack(written(packing.pieces(docs), "pieces"))


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("simhash", copies_out), ("decontamination", leaks_out), ("packing", packed)]

#: Hashing, trained weights and tokenization aren't SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
