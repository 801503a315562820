"""The corpus pipeline: five stages over ``documents``, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. The first four return the
columns of ``documents``; the last returns the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm import bpe, decontaminate, language, simhash, substrings
from attrition.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a learned language stay. Null text, text without a letter, and
    text whose score lies below ``language.learn_bound`` go: half of the score that all but
    0.1 % of the labelled rows reach. Filters and bound are learned from the rows that are
    not held out. Repeated rows are judged alike; names may clash with the operator's."""
    labelled = docs.where(~language.held_out())
    filters = language.learn(labelled)
    bound = language.learn_bound(labelled, filters)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    told = language.predict(plain, filters, text_col=f"c{names.index('text')}")
    kept = told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= bound))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document of the smallest id stays. Null and empty texts
    have fingerprint zero and are one component; of several rows of the kept id in it one
    stays; rows with a null id all stay; names may clash with the operator's."""
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document of smaller id also holds are cut out, and
    ``n_chars`` follows; a document that loses all its words goes."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    ident, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    cut = substrings.remove_repeats(inner, ident, text).where("n_removed = 0 OR n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length(text).cast("long"))
    return cut.select(*[(F.coalesce(length, F.col(f"c{i}")) if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item of at least ``decontaminate.MIN_TOKENS``
    tokens go, with all their repeats. Null and empty texts stay; names may clash with the
    operator's."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number of ids, digests of the ids and of what they decode to, and the ids.
    Null text counts as empty; repeated rows are encoded each; other columns are not read."""
    return bpe.encode_digests(docs, *bpe.default_vocabulary(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The language model and the fingerprints' hash cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, all stages applied to ``documents`` in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
