"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, folder of the tables) and gives a DataFrame; all but the last keep the columns of documents.
``run`` applies them to the documents of a folder; what a stage gives is written and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontam import find_benchmark
from docloom.llm.jaccard import SPREAD_ROWS, similar_documents
from docloom.llm.lines import dedupe_lines
from docloom.llm.packing import pack_documents
from docloom.llm.quality import fit, score
from docloom.llm.store import staged


def _beside(docs: DataFrame, made: list[str], use: Callable[[DataFrame], DataFrame], keep: str, changed: str = "false") -> DataFrame:
    """The columns of ``docs`` for the rows that ``keep`` names after ``use``, with n_chars counted again where ``changed`` holds.

    Columns of ``docs`` that are named like those an operator makes are put aside while it works, and come back."""
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in made}
    out = use(docs.withColumnsRenamed(aside)).where(keep)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.expr(changed), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored 0.5 or more stay."""
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return _beside(docs, ["score"], lambda d: score(d, model), "score >= 0.5")


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document that had lines and lost all of them goes with them."""
    return _beside(docs, ["n_lines", "n_removed"], dedupe_lines, "n_removed < n_lines or n_lines = 0", "n_removed > 0")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The first document of each class of linked documents stays."""
    found = staged(similar_documents(docs), "similar")
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__mark") == F.col("b.mark"))

    def rows_in(keys: DataFrame, how: str, table: DataFrame) -> DataFrame:
        keys = F.broadcast(keys) if keys.count() <= SPREAD_ROWS else keys
        return table.alias("a").join(keys.alias("b"), same, how)

    left = rows_in(found.where("not stays").select("doc_id", "mark").distinct(), "left_anti", marked)
    # Rows that agree in key and text are all first of their class: one of them is kept.
    repeated = found.where("stays and n_links > 0").groupBy("doc_id", "mark").count().where("count > 1").drop("count")
    if repeated.head(1):
        left = rows_in(repeated, "left_anti", left).unionByName(rows_in(repeated, "left_semi", left).dropDuplicates(["doc_id", "__mark"]))
    return left.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return _beside(docs, ["n_hit", "items"], lambda d: find_benchmark(d, benchmark, clean=True), "true", "n_hit > 0")


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of all documents and their places in the sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The classifier is trained and tokens come from a library: no SQL gives the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
