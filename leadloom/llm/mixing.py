"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of the mix. A source whose share is above
``max_epochs`` times its size is clamped there and the excess goes to the others by
weight, until none is above. That fixed point has a closed form: with sources in
order of cap / weight, the level before source k is (total - caps before k) / (weights
from k on); the level rises while sources are clamped and falls after, so the final
level is the largest of these, and a target is min(cap, level * weight).

A source's rate (target / size) splits into whole epochs, which every document gets,
and a fraction. For the fraction, documents are dealt by a seeded digest into strata
of about ``STRATUM`` documents; in each, documents in digest order are repeated once
more until the stratum's quota of words is met, the last one in part. So a source's
total is within half a word for each stratum, reruns agree, and no task holds more
than a stratum, however hot the source.

Defined results: null text has size 0; null is a source of its own, last in order;
sources of size 0 get target 0; an empty table gives an empty result; rows with
equal ids are told apart by size; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.llm.common import SPACE, WORD, numbered, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
STRATUM = 4096
SEED = "mix-1"


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, source, size`` and ``more``, written once: texts are read once."""
    return written(docs.select(*more, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")


def _running(rows: DataFrame, order: list, name: str, **values) -> DataFrame:
    """Sums of ``values`` over all rows before each one in the order given.

    Rows are dealt by ranges of the order, summed in each range, and ranges, few rows, among
    themselves: no task holds all rows, should every host be a source.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    sums = dealt.groupBy("_range").agg(*(F.sum(v).alias(f"_{k}") for k, v in values.items()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = written(sums.select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values)), "range-sums")
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumns({k: F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in values.items()}).join(sums, "_range")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in values}).drop("_range", *(f"_{k}" for k in values))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: ``source, source_size, n_docs, target``."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = F.col("source").asc_nulls_last()
    per = _running(per, [by_name], "sources", rank=F.lit(1))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", max_epochs * F.col("source_size"))
    per = per.withColumn("_by", F.col("cap") / F.col("weight"))
    per = written(_running(per, [F.col("_by").asc(), by_name], "sources", caps=F.col("cap"), weights=F.col("weight")), "sources")
    # Three numbers over all sources.
    size, weight = per.agg(F.sum("source_size"), F.sum("weight")).head()
    total = share * (size or 0)
    level = per.agg(F.max((F.lit(float(total)) - F.col("caps")) / (F.lit(weight) - F.col("weights")))).head()[0]
    return per.select("source", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight")).alias("target"))


def mix(sized: DataFrame, seed: str = SEED, row: str | None = None, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``whole``, the epochs of the whole document in ``taken``; and ``row``, which tells rows of equal id and size apart."""
    more = [row] if row else []
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("null"))
    # Written, the table of sources has a known size: Spark broadcasts it below its threshold and else joins by key.
    per = written(targets(sized, **how).select(key(F.col("source")).alias("key"), "source_size", "n_docs", "target"), "targets")
    rows = sized.select(*more, "doc_id", "size", key(F.col("source")).alias("key")).join(per, "key")
    rows = rows.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor("rate"))
    rows = rows.withColumn("draw", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("doc_id").cast("string"))))
    strata = F.ceil(F.col("n_docs") / STRATUM)
    rows = rows.withColumn("stratum", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % strata)
    # One column: a join dealt by "key" alone would else be taken as dealt for the window, a hot source in one task.
    one = W.partitionBy(F.concat_ws(":", "stratum", "key"))
    upto = F.sum("size").over(one.orderBy("draw", "doc_id", "size", *more).rowsBetween(W.unboundedPreceding, 0))
    quota = F.floor((F.col("rate") - F.col("whole")) * F.sum("size").over(one) + 0.5)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), quota - upto + F.col("size")))
    return rows.select(*more, "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), "whole")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(sizes(docs)).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it; a last repetition in part has its first words.

    Rows are numbered and written, so that each meets its own share, whether its id is null or repeated;
    rows without words have nothing to give and go, as do those that the mix takes nothing of.
    """
    counted = numbered(docs)
    taken = mix(sizes(counted, "_row"), row="_row").filter("taken > 0").select("_row", F.col("taken").alias("_taken"), F.col("size").alias("_size"))
    rows = counted.join(taken, "_row")
    parts = F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))
    rows = rows.withColumn("_epoch", F.explode(parts)).withColumn("_words", F.least(F.col("_size"), F.col("_taken") - (F.col("_epoch") - 1) * F.col("_size")).cast("int"))
    head = F.concat_ws(" ", F.slice(F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE), F.lit(1), F.col("_words")))
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(head)
    cut = {"text": text} | ({"n_chars": F.when(F.col("_words") == F.col("_size"), F.col("n_chars")).otherwise(F.length(head).cast("long"))} if "n_chars" in docs.columns else {})
    return rows.withColumns(cut).select(docs.columns)


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM p
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, n_docs, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         md5('{SEED}:' || d.doc_id::VARCHAR) AS draw, ceil(t.n_docs / {STRATUM})::BIGINT AS strata
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), s AS (
  SELECT *, ('0x' || substr(draw, 1, 8))::BIGINT % strata AS stratum FROM r
), x AS (
  SELECT *, sum(size) OVER (PARTITION BY source, stratum ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY source, stratum) AS ssize FROM s
)
SELECT doc_id, size, source_size, target,
       (floor(rate)::BIGINT * size + greatest(0, least(size, floor((rate - floor(rate)) * ssize::DOUBLE + 0.5)::BIGINT - upto::BIGINT + size)))::BIGINT AS taken
FROM x
"""
