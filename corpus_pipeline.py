"""The corpus pipeline: two filters, near-duplicates, mixing and packing, each stage a stored table.

What a stage writes on its way is in a folder of its own. A stage gets its documents from a stored
table, so when it begins, what the stages before it have written on their way is removed.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from drywell.llm import common, mixing, packing, quality, simhash, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels are learned from their training part."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted to what the stage gets."""
    common.prepare(spark)
    return quality.keep_good(docs, quality.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more): that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents of the mix, placed in sequences."""
    return packing.pack_documents(docs, tokens.tokenizer_path())


#: Folders that stages have left, by the stage's place.
_left: dict[int, list[str]] = {}


def tidied(place: int, stage):
    """The stage in a folder of its own; the folders of earlier stages are removed first. Their results must be stored by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for k in [k for k in _left if k < place]:
            for path in _left.pop(k):
                common.remove(spark, path)
        common.tidy(spark)
        with common.inside(spark, f"stage-{place}") as folder:
            out = stage(spark, docs, sf_dir)
        _left.setdefault(place, []).append(folder)
        return out

    return run


STAGES = [
    ("toxicity", tidied(0, drop_toxic)),
    ("quality classifier", tidied(1, keep_good)),
    ("SimHash near-dedup", tidied(2, drop_near_duplicates)),
    ("source mixing", tidied(3, mix_sources)),
    ("best-fit packing", tidied(4, pack)),
]
#: Tokenizers, learned scores and the search for components are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder for the next."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = common.fresh(spark, f"kept-{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            if before:  # the stage that read it has stored its result; the last stage stores its pieces before it returns
                common.remove(spark, before)
            before = path
    return docs
