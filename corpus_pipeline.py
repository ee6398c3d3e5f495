"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's input.

toxicity: predicted documents go.  simhash_near_dedup: of each component the row of the smallest doc_id stays; links are
those of SimHash over 5-word shingles and all pairs of an exact 5-word Jaccard similarity >= 0.8, most of which lie beyond
a radius that can be searched (0.8 is 10 of 64 bits on average, up to 19).
suffix_array_dedup: repeated byte strings are cut out of the texts (rows stay, also where nothing is left).
benchmark_decontamination: documents in which an item occurs go.  sentencepiece: the rest becomes ids.

Defined cases are those of the operators.  The middle stages know a row by a hash of all its columns, so rows without a
doc_id or with a repeated one are decided each by its own text; of a group of near copies the row of the smallest doc_id
stays (those without one last), and of rows that are equal in all columns one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, pieces, shingle_dedup, simhash, suffix_dedup, toxicity
from panelforge.llm.components import components
from panelforge.llm.queries import tokenizer_path
from panelforge.session import remove_dir, shared_dir, ship, table

ROW = "_row_key"
SHINGLE = 5


def _free(docs: DataFrame, name: str) -> str:
    """The name, longer where a column has it already."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a hash of all their columns, and its name."""
    row = _free(docs, ROW)
    return docs.withColumn(row, F.xxhash64(*docs.columns)), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents of the corpus; filters its own input."""
    scorer = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.flag_rows(docs, scorer)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash of 5-word shingles links what lies within its radius; the rest of the links of similarity 0.8 or more, for which that radius is too tight, come from the shingle sets themselves."""
    rows, row = _named(docs)
    near = simhash.near_duplicates(rows, k=SHINGLE, id_col=row), shingle_dedup.near_duplicates(rows, k=SHINGLE, id_col=row)
    edges = [g.where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")) for g in near]
    groups = components(edges[0].union(edges[1])).withColumnRenamed("vertex", row)
    ranked = rows.select(row, "doc_id").join(groups, row, "left").withColumn("component", F.coalesce("component", row))
    first = ranked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    # rows that differ and yet share a hash are told apart by a second one, and all of them stay
    check = _free(rows, "_row_check")
    told = rows.withColumn(check, F.xxhash64(F.lit(7), *docs.columns))
    twins = told.groupBy(row).agg(F.min(check).alias("lo"), F.max(check).alias("hi")).where("lo <> hi").select(row)
    kept = first.select(F.col(f"first.{row}").alias(row)).union(twins)
    return told.dropDuplicates([row, check]).join(kept, row, "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, new = _free(docs, ROW), _free(docs, "_kept_text")
    rows = docs.withColumn(row, F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *docs.columns)), 16, "0") for seed in (1, 2))))  # 128 bits
    kept = suffix_dedup.remove_repeats(rows, with_text=True, row_col=row).where("n_removed > 0").select(F.col("row").alias(row), F.col("text").alias(new)).dropDuplicates([row])
    joined = rows.join(kept, row, "left")
    cut = F.col(new).isNotNull()
    own = {"text": F.when(cut, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(cut, F.length(new).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return joined.select(*(own.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _named(docs)
    leaks = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(leaks, row, "left_anti").select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", to_pieces),
]
#: No stage but the joins between them is expressible in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents.  Each stage's table goes once the next one is written; the last stays for the result to be read from."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_dir(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
