"""A corpus cleaned, deduplicated, mixed and tokenised: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.exact_dedup import exact_dedup
from inkveil.llm.jaccard_join import jaccard_components
from inkveil.llm.mixing import mix
from inkveil.llm.pieces import encode_texts
from inkveil.llm.queries import piece_model
from inkveil.llm.toxicity import grade_toxicity, train
from inkveil.session import Scratch


#: Rows of decisions (a hash and a number each) up to which they are broadcast; beyond it the documents are shuffled to them.
BROADCAST_ROWS = 2_000_000


def _spared(docs: DataFrame, *new: str) -> tuple[DataFrame, list]:
    """docs with columns renamed that an operator would replace by its own, and the columns that give docs back."""
    names = {c: f"_own_{c}" for c in docs.columns if c in new}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a hash of each whole row, which stands for the row whatever its doc_id: null, or shared by several."""
    return docs.withColumn("_row", F.xxhash64(*docs.columns))


def _small(decisions: DataFrame, most: int) -> DataFrame:
    return F.broadcast(decisions) if decisions.limit(most + 1).count() <= most else decisions


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of any toxicity is not above one half.

    Null and empty texts stay, and so does every row that repeats a kept one. An empty table stays empty.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    spared, back = _spared(docs, "severity", "p_toxic", "grade", "rejected")
    return grade_toxicity(spared, model).filter(~F.col("rejected")).select(*back)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id, null being the smallest; exactly one row of each group.

    Null and empty texts are one group. An empty table stays empty.
    """
    spared, back = _spared(docs, "keep_id", "group_size", "kept", "text_sha256")
    return exact_dedup(spared).filter("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more (five-word shingles) the row with the smallest hash of all columns.

    Rows are told apart by that hash, so null and shared doc_ids don't matter; of rows that are identical in all columns
    one stays if their group keeps it. Null, empty and blank texts are linked with nothing and stay (identical rows once). An empty table stays empty.
    """
    docs, back = _spared(docs, "_row")
    keyed = _keyed(docs)
    scratch = Scratch(spark, "near-duplicates")
    found = jaccard_components(keyed, key="_row", words=5, top=80, bottom=100).groupBy("_row").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    found = scratch.save(found.filter("least <> _row or n > 1").select("_row", (F.col("least") != F.col("_row")).alias("goes")), "decisions")
    kept = keyed.join(_small(found.filter("goes").select("_row"), broadcast_rows), "_row", "left_anti")
    twice = found.filter("not goes").select("_row")
    if twice.isEmpty():
        return kept.select(*back)
    twice = _small(twice, broadcast_rows)
    return kept.join(twice, "_row", "left_anti").select(*back).unionByName(kept.join(twice, "_row", "left_semi").dropDuplicates(["_row"]).select(*back))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents as often as the mix takes them; rows identical in all columns together as often as it takes each of them.

    Documents without words are taken by the whole part of their source's share; a null source is a source. An empty table stays empty.
    """
    docs, back = _spared(docs, "_row", "_copies", "_copy")
    keyed = _keyed(docs)
    scratch = Scratch(spark, "mixed")
    found = mix(keyed, key="_row").groupBy("_row").agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_n"))
    found = scratch.save(found.filter("_copies > 0"), "copies")
    once = keyed.join(_small(found.filter("_n = 1").drop("_n"), broadcast_rows), "_row")
    if not (several := found.filter("_n > 1").drop("_n")).isEmpty():
        once = once.unionByName(keyed.join(_small(several, broadcast_rows), "_row").dropDuplicates(["_row"]))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*back)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and their number: both null for a null text, none and 0 for an empty one. Rows that repeat stay; columns of docs with these two names give way."""
    docs = docs.drop("piece_ids", "n_pieces")
    return encode_texts(docs, piece_model).select(*docs.columns, "piece_ids", F.size("piece_ids").alias("n_pieces"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixed_sources", mixed_sources),
    ("piece_ids", piece_ids),
]

#: The first stage fits a model and the fourth draws at random, which SQL can't express; tests/llm/test_pipeline.py holds
#: each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        scratch.keep(f"{k}-{name}")
    return docs
