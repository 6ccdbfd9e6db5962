"""The corpus pipeline: five stages that each apply one operator to all that the stage before kept.

1. `language_id`            labels every text; those without a letter, or without a leading language, go.
2. `simhash_near_dedup`     one document of every near-duplicate group stays, the one with the smallest id.
3. `substring_dedup`        passages of 35 or more words that occur elsewhere are cut; untouched texts keep every byte.
4. `benchmark_decontamination`  documents that hold a benchmark item go.
5. `packing`                the rest becomes sequences of 4096 tokens, every source at its share in each of them.

The first four return the columns of `documents`, the last the pieces with their token ids. Rows with a null id take part
like all others; of rows that repeat wholly one stays after stage 2. Texts of any length pass whole through every stage, each in
the task that reads it. Each stage's result is written before the next reads it.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import decontaminate, langid, packing, simhash, substring
from gridloom.llm.queries import WORD_BPE, vocabulary
from gridloom.llm.tables import crc_fold, stored, table

LEAST_SHARE = 0.35  # of a text's words that its language must have
ORACLE_SQL = None  # learned, hashed and tokenised stages are not SQL; the tests hold them against plain Python


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """The table with its columns renamed c0, c1, ..., so that no column can clash with a stage's own; the new names by the
    old, and the columns that lead back."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), {n: f"c{i}" for i, n in enumerate(names)}, [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3, learned from the documents at hand whose crc32(doc_id) mod 5 is not 0."""
    plain, at, back = _plain(docs)
    field = langid.fit(plain, crc_fold(F.col(at["doc_id"]), 5) != 0, key=at["doc_id"], text=at["text"], lang=at["lang"])
    out = langid.label(plain, field, text=at["text"], keep=plain.columns)
    return out.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SHARE)).select(*back)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7 with 4-word shingles and 4 bits, over (id, text) so that rows without an id can be told apart."""
    plain, at, back = _plain(docs)
    key, sig = F.col(at["doc_id"]), F.xxhash64(at["text"])
    named = plain.select(F.struct(key.isNull().alias("none"), key.alias("id"), sig.alias("sig")).alias("doc_id"), F.col(at["text"]).alias("text"))
    groups = simhash.near_duplicates(named, shingle=4, radius=4)
    stay = groups.filter(F.col("doc") == F.col("component")).select("doc.id", F.col("doc.sig").alias("other")).distinct()
    kept = plain.withColumn("sig", sig).join(stay, key.eqNullSafe(F.col("id")) & (F.col("sig") == F.col("other")), "left_semi")
    return kept.dropDuplicates([at["doc_id"], "sig"]).select(*back)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2 with 35 words; a text that loses words becomes its other words, joined by one space."""
    out = substring.remove_repeats(docs, words=35, carry=True)
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6 with 5-word shingles and a similarity of 0.8."""
    plain, at, back = _plain(docs)
    name = F.xxhash64(at["doc_id"], at["text"])
    hits = decontaminate.contaminated(plain.select(name.alias("doc_id"), F.col(at["text"]).alias("text")), table(spark, sf_dir, "benchmark"), shingle=5, least=0.8)
    return plain.withColumn("name", name).join(hits.select(F.col("doc").alias("name")).distinct(), "name", "left_anti").select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5 with 4096 tokens and the corpus's own proportions of sources."""
    return packing.pack(docs, vocabulary(WORD_BPE), window=4096, end=2).withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
