"""The corpus pipeline: documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
to the shared folder and reads it back for the next. All but the last return the columns
of their input. A stage keeps what it is not meant to remove: the language stage drops
texts without letters or like no language, line dedup drops documents of which nothing is
left, the join keeps one document of each group, and mixing gives every document once at
least. Nulls and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.llm import bpe, common, jaccard_join, language_id, line_dedup, mixing

#: Least share of a text's n-grams that its language must have.
LEAST_SCORE = 0.2
#: Rows of an id and a count, 16 MB, that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000


def _checked(df: DataFrame) -> DataFrame:
    """A stash of df, broadcast if it is small."""
    df = common.stash(df, "ids")
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language and drops what is in none."""
    model = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out()))
    rows = language_id.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, keep=("row",))
    rows = rows.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return rows.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, and documents of which only blanks are left."""
    rows = line_dedup.dedup(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), counts=True)
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & (F.trim(F.col("text")) == "")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_exact") + F.col("n_near") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.where(F.coalesce(~emptied, F.lit(True))).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    joined = common.stash(jaccard_join.join(docs, n=5, percent=80), "components")
    gone = _checked(joined.where("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = _checked(joined.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    # Of rows that share an id, the one whose text, then other columns, sort first.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row"))
    return single.unionByName(first.select(*[F.col("doc_id") if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as often as the mixture takes them. Rows that share an id share
    its copies, rounded up."""
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("epoch") == 0).alias("rows"))
    copies = _checked(taken.select(F.col("doc_id").alias("id"), F.ceil(F.col("n") / F.greatest("rows", F.lit(1))).cast("int").alias("copies")))
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(copies, F.col("row.doc_id").eqNullSafe(F.col("id")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, lang, source, n_tokens, ids)."""
    import public_tokenizers

    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", identify), ("line dedup", drop_lines), ("n-gram Jaccard join", one_of_each), ("mixing", mix), ("BPE", encode)]

#: SQL cannot express the trained language filter; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
