"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding, one stage after the other.

Every stage works on all rows that the stage before it kept and returns the columns of ``documents``; the last
adds the shard of each row. ``run`` writes what a stage returns and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ohmline.llm import decontamination, language_id, mixing, sharding, simhash
from ohmline.shared import cut, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; null texts and texts without letters go."""
    own = {c: f"__{i}_{c}" for i, c in enumerate(docs.columns)}
    renamed = docs.withColumnsRenamed(own)
    dictionaries = language_id.learn(renamed, text_col=own["text"], lang_col=own["lang"])
    kept = language_id.identify(renamed, dictionaries, text_col=own["text"]).where("not rejected")
    return kept.select(*[kept[new].alias(old) for old, new in own.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at three bits or fewer: that of the least id."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; a document may be left out or repeated."""
    return mixing.mixed_rows(docs)


def shard_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_records),
]

#: Compression and fingerprints are beyond DuckDB's SQL; a test holds the chain of stages against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
