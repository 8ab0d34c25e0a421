"""Documents to packed training sequences, in stages that each call one operator of ``wardline.llm``.

Every stage but the last returns the columns of its input, whatever the names of further ones. Rows may repeat, ids and texts may
be null or empty, and tables may be empty; what a stage does with them is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import jaccard_join, mixing, packing, sanitise, toxicity
from wardline.llm.common import checkpoint_dir


#: Pieces of text that a worker remembers in packing. Earlier stages have filled the executor's heap by then, so that workers
#: have less room than in a job of their own.
REMEMBERED = 150_000


def as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, also those whose names hold dots."""
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model scores below 0.5.

    Null and empty texts are scored like any other, repeated rows alike; without labels nothing is rejected that the model
    does not know.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return as_before(toxicity.score(docs, labels).where("tox_predicted = 0"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id; of rows that repeat id and text, one.

    Null, empty and wordless texts and rows without an id are near nothing and stay.
    """
    return jaccard_join.deduplicate(docs)


def sanitise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and without terms that give it away; ``n_chars`` follows. Null and empty texts stay so."""
    clean = sanitise.sanitise(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("san_clean")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(
            F.size("san_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return as_before(clean, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it. The null source is a source of its own; documents
    without words weigh nothing, and rows that repeat are documents of their own."""
    return as_before(mixing.emit(mixing.mix(docs)), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids. Every row is a document; null and empty texts are the end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, remembered=REMEMBERED)


STAGES = [
    ("toxicity", reject_toxic), ("near-duplicates", keep_one_of_each), ("personal data", sanitise_texts),
    ("mixing", mix_sources), ("packing", pack_sequences),
]
#: Classifier, similarity join and tokenizer have no SQL form; tests hold near-duplicates and personal data against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read by the next."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
