"""Leads from a stream of pages: the batch plan for each micro-batch, domains seen before left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.plans.leads import page_leads
from leadloom.schema import EngineConfig
from leadloom.sources.files import exists
from leadloom.sources.history import merged_domains, new_urls


def start(spark: SparkSession, pages: DataFrame, leads_path: str, domains_path: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """``pages(page_id, url, html)`` as a stream to leads under ``leads_path``.

    A batch writes its leads and its domains to folders named by the batch's number,
    overwriting, so a batch that runs again after a failure replaces what it had written
    and reads only the domains of earlier batches.
    """

    def each(batch: DataFrame, number: int) -> None:
        seen = spark.createDataFrame([], "domain string")
        if exists(spark, domains_path):
            seen = spark.read.schema("domain string, batch long").parquet(domains_path).filter(F.col("batch") < number).select("domain")
        fresh = new_urls(batch, seen, ["page_id"])
        page_leads(fresh.select("page_id", "url", "html"), config).write.mode("overwrite").parquet(f"{leads_path}/batch={number}")
        merged_domains(seen.limit(0), fresh).write.mode("overwrite").parquet(f"{domains_path}/batch={number}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
