"""From raw documents to packed sequences: quality, language, near-duplicates, packing.

Each stage takes what its predecessor kept, whole. All but the last return the columns of documents. Columns are
renamed to their numbers inside a stage, so further ones may be called whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm import dedup, langid, packing, quality
from triplane.llm.common import discard, held_out, materialise

#: Scores below this are rejected; between it and the classifier's own threshold a document may well be clean.
LEAST_QUALITY = 0.5
#: Least similarity of near-duplicates over runs of five words, in percent.
LEAST_SIMILARITY = 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns called by number, and the number of each name."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names again."""
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``LEAST_QUALITY`` or more, whole rows with all their columns.

    Null and empty texts are scored as empty ones. Null or repeated ids, repeated rows: each row by its own text.
    Empty table: no rows. Without labels of both kinds all documents score alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, at = _numbered(docs)
    model = quality.fit(rows, labels.where(~held_out()), id_col=at["doc_id"], text_col=at["text"])
    scored = quality.score(rows, model, id_col=at["doc_id"], text_col=at["text"], keep=tuple(rows.columns))
    return _named(scored.where(F.col("score") >= LEAST_QUALITY).withColumnRenamed("doc_id", at["doc_id"]), docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows and tells clearly; no letter or no clear lead is rejected.

    Null and empty texts have no letter. Null or repeated ids, repeated rows: each row by its own text. Empty table,
    or nothing to learn from: no rows.
    """
    rows, at = _numbered(docs)
    cols = {"id_col": at["doc_id"], "text_col": at["text"]}
    model = langid.fit(rows.where(~held_out(at["doc_id"])), lang_col=at["lang"], **cols)
    told = langid.predict(rows, model, keep=tuple(rows.columns), **cols)
    return _named(told.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).withColumnRenamed("doc_id", at["doc_id"]), docs)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id, a null one last, then the least hash of a row.

    Every row is a document of its own, whatever its id; of equal rows one stays. Texts without words are no copies of
    each other, unless their rows are equal. Empty table: no rows. Rows are written with a number each, and the
    decisions are joined by it.
    """
    rows, at = _numbered(docs)
    values = [f(F.col(c)) for c in rows.columns for f in (F.isnull, lambda x: x)]
    numbered = materialise(rows.select("*", F.monotonically_increasing_id().alias("row"), F.xxhash64(*values).alias("hash")), "numbered")
    found = dedup.near_duplicates(numbered, LEAST_SIMILARITY, id_col="row", text_col=at["text"])
    order = F.struct(F.isnull(at["doc_id"]).alias("none"), F.col(at["doc_id"]).alias("id"), "hash", "row")
    linked = found.where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id").join(numbered.select("row", "hash", at["doc_id"]), "row")
    kept = linked.groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    wordless = numbered.where(~F.coalesce(F.col(at["text"]).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    alone = wordless.dropDuplicates(rows.columns).select("row")
    chosen = materialise(kept.unionByName(alone), "kept")
    discard(found)
    # a merge at every size: what is kept grows with the input
    out = _named(numbered.join(chosen.hint("merge"), "row", "left_semi"), docs)
    out._triplane_reads = (numbered, chosen)
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in sequences of byte-level tokens, one more token ending each document; see :func:`packing.pack`.

    Null and empty texts have the ending token alone. Null or repeated ids, repeated rows: each row is packed. Empty
    table: no rows.
    """
    rows, at = _numbered(docs)
    return packing.pack(rows, F.coalesce(F.octet_length(at["text"]), F.lit(0)) + 1, id_col=at["doc_id"])


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("MinHash near-dedup", keep_one_of_copies),
    ("best-fit packing", pack_sequences),
]

#: The stages learn models and link sets, which SQL cannot express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        kept = materialise(out, name.replace(" ", "-"))
        discard(docs, *getattr(out, "_triplane_reads", ()))  # the table before, if a stage wrote it, and the stage's own
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
