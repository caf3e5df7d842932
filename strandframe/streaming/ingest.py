"""Streaming import of VCF lines (an extension): new files of a folder are upserted into a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.sources import formats
from strandframe.sources.catalog import Catalog


def vcf_stream(spark: SparkSession, folder: str) -> DataFrame:
    return formats.vcf_rows(spark.readStream.text(folder))


def into_catalog(stream: DataFrame, catalog: Catalog, tax_id: int, assembly: str, checkpoint: str):
    """Upserts by key, so a batch that is run again after a failure changes nothing."""

    def put(rows: DataFrame, _: int) -> None:
        catalog.put("variant_records", rows.withColumn("tax_id", F.lit(tax_id)).withColumn("assembly_name", F.lit(assembly)))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
