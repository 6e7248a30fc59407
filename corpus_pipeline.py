"""A training corpus, stage by stage: quality, near duplicates, benchmark passages, personal data, sampled pieces.

Each stage takes (spark, docs, sf_dir), decides on every row of docs and returns a DataFrame, which run() writes as Parquet in
the shared folder and rereads for the next. All but the last return the columns of docs.

* quality drops rows whose score is under 0.5; without labels nothing is known against a row and all stay.
* near_duplicates keeps one row of each group of five-word-shingle likeness 0.8 or more.
* decontaminate drops rows of which benchmark windows cover a twentieth of the words or more, and cuts the windows' words from others.
* personal_data writes [PII] for every span found.
* pieces returns sampled piece ids, their number and the text they decode to.

Every stage decides on each row by itself, but for near_duplicates: of a group of copies the least doc_id stays, ties and
repeated rows are one row of any of them. Texts are read whole, however long. Null and empty texts pass the stages as they are (a null text stays null up to the last stage, which decodes it to ""); where the
text changes, n_chars, if the table has it, is counted anew. Empty tables stay empty. Further columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm import decontam, neardup, pieces, pii, quality
from hashloom.llm.common import drop_path, persist_table, scratch_dir

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def _with_text(docs: DataFrame, text) -> list:
    """The columns of docs, out of struct `row`, with another text, and n_chars to match."""
    out = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        if c == "text":
            own = text
        elif c == "n_chars":
            own = F.when(text.eqNullSafe(F.col("row.text")), own).otherwise(F.char_length(text).cast(docs.schema[c].dataType))
        out.append(own.alias(c))
    return out


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stats = persist_table(quality.statistics_table(docs.select("doc_id", "text")), "pipe-stats")
    model = quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored_rows(docs, model).where("score >= 0.5").select("row.*")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit, words = F.col("found.n_hit"), F.col("found.n_words")
    return found.where(~((hit > 0) & (20 * hit >= words))).select(*_with_text(docs, F.coalesce("found.cut_text", "row.text")))


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.find(docs).select(*_with_text(docs, pii.redacted(F.col("row.text"))))


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.sampled_pieces(docs).select("doc_id", F.col("decoded").alias("text"), "n_pieces", "pieces")


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("personal_data", stage_personal_data),
    ("pieces", stage_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's table. A stage's table goes when the next one's is written."""
    root = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:
            drop_path(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
