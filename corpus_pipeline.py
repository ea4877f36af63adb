"""A corpus pipeline: five stages, each on all that the one before it kept.

Each function takes (spark, docs, sf_dir). All but the last return the columns of `docs`; every stage is written as
Parquet and read again before the next, and deleted once the next one is written.

Defined results, by stage: the classifier scores a null or empty text as one without words; the rules drop it, as it has too few words;
of null, empty and blank texts near_dedup keeps one, and of rows that repeat under one id with one text as well, while rows without an id
stay; personal_data leaves null texts null; packing gives each document at least its end identifier. Columns besides `doc_id` and
`text` pass through whatever their names; an empty table gives no rows.

Stages write Parquet in small row groups and read it in small pieces (`common.lean`), a setting of the session that stays. An input whose
row groups don't fit the heap of all cores at once is first copied to small ones by fewer tasks (`common.regrouped`); called by itself, a stage
leaves that copy to `common.clean`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import gam, likeness, packing, pii, rules
from ledgerloom.llm.common import dropped, few_at_once, own_prefix, regrouped, table, written
from ledgerloom.llm.queries import BYTE_BPE, documents, labels, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the additive model takes for label 0."""
    docs = regrouped(docs)
    model = gam.fitted(few_at_once(documents(spark, sf_dir)), labels(spark, sf_dir))
    own = own_prefix(docs)
    return gam.scored(docs, model, *docs.columns, prefix=own).where(F.col(f"{own}predicted") == 1).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or meet a rule of the list, which is learned from all of `documents`."""
    docs = regrouped(docs)
    found = rules.fitted(few_at_once(documents(spark, sf_dir)), labels(spark, sf_dir))
    own = own_prefix(docs)
    return rules.judged(docs, found, *docs.columns, prefix=own).where(F.col(f"{own}kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates, alike in 0.8 of their five-word shingles, the document with the smallest id."""
    docs = regrouped(docs)
    return likeness.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind's name for each span of personal data, and counts the characters again."""
    docs = regrouped(docs)
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of 2048 tokens: one row per piece."""
    docs = regrouped(docs)
    return packing.pack_texts(docs, tokenizer_path(BYTE_BPE), end_id=1, max_tokens=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: No SQL can express the learned models, the fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = regrouped(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), name)
        dropped(docs)  # what an earlier stage wrote; the tables of the input stay
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
