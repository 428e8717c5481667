"""The corpus pipeline: quality, lines, near copies, benchmark passages, pieces.

Every stage takes all documents that the one before kept and returns the columns of
``documents``; the last adds ``piece_ids``.  Extra columns pass through; one that is called
``piece_ids`` is replaced.  Null and empty texts pass every stage as they are, except that the
quality stage scores them like any other text.
"""

from pyspark.sql import functions as F

from stockmill.llm import decontaminate, line_dedup, ngram_join, pieces, quality
from stockmill.llm.common import stored, table

ORACLE_SQL = None  # the first stage is trained and the last one sampled


def keep_good(spark, docs, sf_dir):
    """The documents that the compression classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("out.score") >= quality.KEEP_FROM).select(
        "row.*")


def drop_repeated_lines(spark, docs, sf_dir):
    """Texts without lines that repeat earlier ones, exactly or but for a word; a document that
    had nothing else goes."""
    cut = line_dedup.dedupe_lines(docs)
    emptied = (F.size("out.dropped") > 0) & (F.trim(F.col("out.text")) == "")
    new = {"text": F.col("out.text"), "n_chars": F.length("out.text").cast("bigint")}
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(
        *[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark, docs, sf_dir):
    """Of documents tied by near-equal word sets, the one with the smallest id.

    Rows without an id stay; rows equal in id and text are one document.
    """
    found = ngram_join.similar(docs)
    kept = stored(found.where("doc_id = component_id").select("doc_id").distinct(), "kept-ids")
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.union(docs.where("doc_id IS NULL")).select(*docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """The documents without benchmark contamination."""
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return scanned.where(~F.col("out.contaminated")).select("row.*")


def segment(spark, docs, sf_dir):
    """Sampled pieces of every text; they decode to the text."""
    coded = pieces.encode(docs, pieces.load())
    return coded.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "piece_ids"],
                        F.col("out.ids").alias("piece_ids"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", segment),
]


def run(spark, sf_dir):
    """Rows of the last stage; each stage is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "-".join(name.lower().split()))
    return docs
