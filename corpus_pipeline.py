"""A corpus from documents to tokens, in five stages; each reads all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Nulls and odd texts are treated as the operators say. Rows that are equal in all columns are
one document with as many copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import bpe, language, mixing, overlap, private
from stationlake.llm.common import WORD, cut, documents, fresh, kept, release

#: A document is rejected if its language is unknown (no letter), or less sure than this.
LEAST_SURE = 0.2


def _key(docs: DataFrame) -> Column:
    """doc_id and a hash of the row: equal for equal rows only."""
    return F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(*docs.columns).alias("row"))


def _languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language; lang becomes what was recognised."""
    pred, sure = fresh("lang"), fresh("sure")
    tree = language.learn(docs, F.lit(True))
    known = language.predict(docs, tree, lang=pred, score=sure).where((F.col(pred) != "und") & (F.col(sure) >= LEAST_SURE))
    return known.withColumn("lang", F.col(pred)).select(docs.columns)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group that five-word Jaccard similarities of 0.8 or more connect.

    Multi-index hashing of SimHash fingerprints finds them; bands of least shingles follow for those that it misses, and whole
    sets are compared, as ``overlap`` says."""
    key = fresh("key")
    keyed = docs.withColumn(key, _key(docs))
    found = overlap.near_copies(keyed.select(key, "text"), doc_id=key)
    kept = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    return keyed.join(kept, key).dropDuplicates([key]).select(docs.columns)


def _private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in place of personal data."""
    return private.replace(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources come to their target weights."""
    key, copies = fresh("key"), fresh("copies")
    keyed = docs.withColumn(key, _key(docs))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    narrow = cut(keyed.select(F.col(key).alias("key"), words.alias("size"), F.array("source").alias("sources")))
    mixed, _, _ = mixing.mix(narrow, "size", "sources", order=["key"])
    taken = mixed.groupBy(F.col("key").alias(key)).agg(F.sum("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    return keyed.join(taken, key).dropDuplicates([key]).withColumn(copies, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, their number, and whether they decode to the text again."""
    import public_tokenizers as P

    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _languages),
    ("simhash_near_dedup", _near_copies),
    ("private_surrogates", _private),
    ("source_mixing", _mixed),
    ("byte_bpe", _tokens),
]

#: Fingerprints, learned languages and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each leaves is written to the shared folder, so that the next reads it as often as it needs, and
    deleted when the next has written what it leaves."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        left = kept(stage(spark, docs, sf_dir))
        release(docs)
        docs = left
    return STAGES[-1][1](spark, docs, sf_dir)
