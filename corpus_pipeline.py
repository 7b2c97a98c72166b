"""A training corpus in five stages: toxicity, near-duplicates, benchmark
decontamination, secrets, mixture.

Every stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it
to the shared folder as Parquet and hands the reread table to the next stage.
Each stage works on all that its predecessor kept; all but the last return
the columns they were given.

Edge cases: what a stage does with nulls, empty and repeated rows is its
operator's rule; rows with one id stay or go together, but of exact copies of a
text under one id, or without an id, the near-duplicates stage keeps one row;
an empty table passes through every stage; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.llm import decontaminate, mixing, near_duplicates, secrets, toxicity
from postingflow.llm.queries import domain_of, table
from postingflow.llm.sizing import written
from postingflow.session import ship_package

#: Near-duplicates of the corpus: shingles of five words, similarity 0.8.
WORDS, PERCENT = 5, 80


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as a struct beside its text, so that no column name can clash."""
    return docs.select(F.struct("*").alias("row"), F.col("text").alias("body"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity model's cut stay."""
    ship_package(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.element_at("p", -1) < model.threshold).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays,
    and one row of those that repeat a text under one id, or without an id."""
    ship_package(spark)
    groups = near_duplicates.near_duplicates(docs, words=WORDS, percent=PERCENT)
    copies = groups.where("node <> component").select("node").distinct()
    rows = _rows(docs).withColumn("node", near_duplicates.node_of("row.doc_id", "body")) \
        .withColumn("key", F.md5(F.coalesce("body", F.lit(""))))
    repeated = rows.groupBy("node", "key").agg(F.count("*").alias("n")).where("n > 1").select("node").distinct()
    single = rows.join(copies.unionByName(repeated).distinct(), "node", "left_anti").select("row")
    one = rows.join(repeated.join(copies, "node", "left_anti"), "node", "left_semi") \
        .groupBy("node", "key").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row")).select("row")
    return single.unionByName(one).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window stay."""
    ship_package(spark)
    found = decontaminate.contaminated_words(
        _rows(docs), table(spark, sf_dir, "benchmark"), id="row", text="body")
    return found.where(F.size("items") == 0).select("id.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; ``n_chars`` follows the text."""
    ship_package(spark)
    found = secrets.find_secrets(_rows(docs), id="row", text="body")
    text = secrets.redacted(F.col("text"), F.col("spans"))
    new = found.select("id", text.alias("clean"), (F.size("spans") > 0).alias("changed"))
    columns = []
    for f in docs.schema.fields:
        old = F.col("id").getField(f.name)
        if f.name == "text":
            columns.append(F.when(F.col("changed"), F.col("clean")).otherwise(old).alias(f.name))
        elif f.name == "n_chars":
            columns.append(F.when(F.col("changed"), F.length("clean").cast(f.dataType)).otherwise(old).alias(f.name))
        else:
            columns.append(old.alias(f.name))
    return new.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus at its target weights: documents by epoch, with the tokens taken."""
    ship_package(spark)
    domain = _free("mix_domain", docs)
    marked = docs.select("*", domain_of(F.col("source")).alias(domain))
    taken = mixing.mix(marked, levels=(domain, "lang", "source"))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns),
                        *(F.col(c).alias(_free(n, docs)) for c, n in (
                            ("level_1", "mix_domain"), ("n_tokens", "mix_tokens"), ("epoch", "mix_epoch"),
                            ("n_taken", "mix_taken"))))


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with underscores until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
]

#: Trained models and MinHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
