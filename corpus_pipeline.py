"""From raw documents to packed token sequences in five stages.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.

The near-duplicate stage tells rows apart by ``doc_id`` and text together, so different texts under one id (or none)
are different documents.  Null texts and languages, empty tables, repeated rows and more columns (whatever their names) are fine in every stage: columns a
stage doesn't use come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolens.llm import decontaminate, jaccard, packing, rules, secrets
from geolens.llm.queries import vocabulary
from geolens.session import cut_lineage

REMOVED_AT_ONCE = 500_000
NEAR_SHINGLE, NEAR_PERCENT = 5, 80  # of the near-duplicate stage; the op1 query has a contract of its own
BATCH_ROWS = 2500  # rows of an Arrow batch at most: stages carry whole texts

_USED = ("doc_id", "text", "lang", "n_chars")


def _neutral(docs: DataFrame) -> DataFrame:
    """Columns that no stage uses get names that no operator uses.

    Also keeps the session's Arrow batches small, for whole texts pass through Python workers that live on.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs.toDF(*[n if n in _USED else f"_own_{i}" for i, n in enumerate(docs.columns)])


def _restored(changed: DataFrame, docs: DataFrame, text: F.Column | None = None) -> DataFrame:
    """The columns of ``docs`` from a frame that began as ``_neutral(docs)``; with a new text, ``n_chars`` follows it."""
    out = []
    for i, n in enumerate(docs.columns):
        column = F.col(n if n in _USED else f"_own_{i}")
        if n == "n_chars" and text is not None:
            column = F.when(text, F.length("text").cast(docs.schema[n].dataType)).otherwise(column)
        out.append(column.alias(n))
    return changed.select(*out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules or the distance to their language reject go."""
    return _restored(rules.quality(_neutral(docs)).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of repeated rows one.

    Linked are documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
    """
    # Rows are equal if id and text are; a null id comes after all others, so it represents only its like.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5("text")).alias("digest"))
    keyed = _neutral(docs).withColumn("_key", key)
    found = jaccard.near_duplicates(keyed, doc="_key", shingle=NEAR_SHINGLE, percent=NEAR_PERCENT).withColumnRenamed("doc_id", "_key")
    removed = _bounded(found.filter("_key <> component_id").select("_key").distinct())
    kept = keyed.join(removed, "_key", "left_anti")
    repeated = found.groupBy("_key").count().filter("count > 1").select("_key")
    if not repeated.isEmpty():
        repeated = _bounded(repeated)
        kept = kept.join(repeated, "_key", "left_anti").unionByName(kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    return _restored(kept, docs)


def _bounded(keys: DataFrame) -> DataFrame:
    """A broadcast hint for keys whose number was counted and is bounded."""
    return F.broadcast(keys) if keys.count() <= REMOVED_AT_ONCE else keys


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_hits(_neutral(docs), benchmark, remove=True)
    hit = F.size("hits") > 0
    cut = found.filter(~hit | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return _restored(cut, docs, hit)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the network is trained on this stage's own documents."""
    plain = _neutral(docs)
    found = secrets.scan(plain, secrets.learn(plain), mask="[SECRET]")
    return _restored(found, docs, F.size("secret_bytes") > 0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None  # quality distances, the network and the packing are not SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
