"""A corpus pipeline: language ID, near-duplicate removal, secrets, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result and reads it again. All
but the last return the columns of ``documents``, others that it may hold among them. Stages that put columns of their
own beside them keep the row whole in one struct, so no name can clash. Stages that join by row write their rows with a
number first and scan that table only.

Defined cases: null and blank texts go with the language stage, as they have no language (given to a later stage, they
stay); null ids count as the largest; repeated rows are near duplicates of each other; long texts are read whole; an
empty table gives an empty one from every stage; extra columns of any name are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.llm import common as C
from scanledger.llm import hyper_langid, jaccard_join, secret_ownership, source_mixing, suffix_pieces

#: Texts of at least so many characters that are further than this from every language are no language.
LONG, LEAST_COSINE = 200, 0.1
MASK = "<secret>"
#: A secret stays in the texts, as a widely copied example, if so many sources and so many documents hold it.
EXAMPLE_SOURCES, EXAMPLE_DOCUMENTS = 3, 10


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter, or are long and unlike every language; fills in missing languages."""
    model = hyper_langid.learn(docs.where(~hyper_langid.held_out()), "text", "lang")
    found = hyper_langid.identify(C.boxed(docs), [F.col("doc")], "doc.text", model)
    known = (F.col("lang_pred") != hyper_langid.UNKNOWN) & ((F.length("doc.text") < LONG) | (F.col("score") >= LEAST_COSINE))
    return found.where(known).select(F.col("doc").withField("lang", F.coalesce("doc.lang", "lang_pred")).alias("doc")).select("doc.*")


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays (null last); texts without words all stay."""
    rows = C.numbered(C.boxed(docs))
    groups = jaccard_join.jaccard_components(rows, "_row", "doc.text").where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    ids = groups.join(rows.select("_row", F.col("doc.doc_id").alias("doc_id")), "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    several = C.spread_join(ids.select("_row", "component_id"), first.select("component_id", F.col("first._row").alias("stays")), "component_id", "_row")
    return rows.join(C.by_row(several.where("_row <> stays").select("_row")), "_row", "left_anti").select("doc.*")


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span (ascending starts) replaced; spans inside one before are part of it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret not proven widely copied, and long keys that only one source holds; everything else stays."""
    rows = C.numbered(C.boxed(docs))
    found = secret_ownership.secret_scan(rows, "_row", "doc.text", "doc.source", "doc.doc_id", example_owners=EXAMPLE_SOURCES, example_repositories=EXAMPLE_DOCUMENTS, widely=None)
    live = F.transform(F.filter("found", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    live = C.by_row(found.select(F.col("doc_id").alias("_row"), live.alias("_spans")).where(F.size("_spans") > 0))
    masked = _masked(F.col("doc.text"), F.col("_spans"))
    doc = F.col("doc").withField("text", masked).withField("n_chars", F.length(masked).cast("long"))
    return rows.join(live, "_row", "left").select(F.when(F.col("_spans").isNotNull(), doc).otherwise(F.col("doc")).alias("doc")).select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks: not at all, or up to 3 times."""
    rows = C.numbered(C.boxed(docs))
    copies = source_mixing.mix_sources(rows, "_row", "doc.text", "doc.source").where("copies <> 1").select(F.col("doc_id").alias("_row"), F.col("copies").cast("int").alias("_copies"))
    out = rows.join(C.by_row(copies), "_row", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1))).where("_copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("doc.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, round_trip, n_tokens) of each text."""
    return suffix_pieces.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language_id", language_id), ("jaccard_join", jaccard), ("secret_scan", secrets), ("source_mixing", mixing), ("sentencepiece", sentencepiece)]

#: Language ID and encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
