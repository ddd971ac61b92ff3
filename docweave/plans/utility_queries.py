"""Queries of utility receipts and image metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.images import image_metrics
from docweave.functions.joined import readable_name, readable_provider
from docweave.operators import utility
from docweave.plans.views import view, with_view

_TODAY = "2026-06-03"


def utility_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = utility.parse_utility_bill(view(spark, sf_dir, "receipts"), F.lit(_TODAY).cast("date"))
    return found.select(
        "doc_id", "utility_type", "receipt_type", "provider", "provider_code", "service_address", "meter_number", "token", "units_purchased_kwh",
        "amount_paid", "document_date", "document_date_label", F.col("days_old").cast("long").alias("days_old"),
        F.col("months_old").cast("long").alias("months_old"), "is_recent", "confidence", F.array_join("reasons", "|").alias("reasons"),
    )


def provider_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view(spark, sf_dir, "provider_names")
    return utility.with_provider_code(names, F.col("name"), "code").select("doc_id", "code")


def readable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "joined_names")
    return t.select("doc_id", readable_name(F.col("name")).alias("name"), readable_provider(F.col("provider")).alias("provider"))


def image_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "customers_as_images")
    data = F.unhex(F.concat(F.repeat(F.col("light"), 60), F.repeat(F.col("dark"), 40)))
    return image_metrics(t.select("doc_id", F.lit(10).alias("height"), F.lit(10).alias("width"), data.alias("data")))


_UTILITY = with_view("receipts", rf"""
p AS (SELECT *, CASE form WHEN 0 THEN 'IKEJA ELECTRIC' WHEN 1 THEN 'Abuja Electricity Distribution' WHEN 2 THEN 'Eko Electricity' END AS provider,
  CASE WHEN form = 3 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS document_date, CASE WHEN form IN (0, 1) THEN 'transaction_date' WHEN form = 2 THEN 'receipt_date' END AS document_date_label,
  CASE WHEN form = 3 THEN NULL ELSE DATE '{_TODAY}' - d END AS days_old,
  CASE WHEN form = 3 THEN NULL ELSE greatest(0, (2026 - year(d)) * 12 + 6 - month(d) - CASE WHEN 3 < day(d) THEN 1 ELSE 0 END) END AS months_old FROM receipts)
SELECT doc_id, CASE WHEN form = 3 THEN 'UNKNOWN' ELSE 'ELECTRICITY' END AS utility_type,
  CASE form WHEN 0 THEN 'PREPAID_RECEIPT' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'POSTPAID_BILL' ELSE 'UNKNOWN' END AS receipt_type,
  provider, CASE form WHEN 0 THEN 'IKEDC' WHEN 1 THEN 'AEDC' WHEN 2 THEN 'EKEDC' END AS provider_code,
  CASE form WHEN 0 THEN k || ' SAMPLE STREET, LAGOS' WHEN 1 THEN 'PLOT ' || k || ' SAMPLE ROAD KUBWA' WHEN 2 THEN k || ' MARINA ROAD' END AS service_address,
  CASE form WHEN 0 THEN CAST(10000000000 + k AS STRING) WHEN 1 THEN CAST(20000000000 + k AS STRING) END AS meter_number,
  CASE form WHEN 0 THEN '1234-5678-9012-3456-' || lpad(CAST(k % 10000 AS STRING), 4, '0') WHEN 1 THEN CAST(k AS STRING) || 'TT' END AS token,
  CASE WHEN form = 0 THEN CAST(k % 50 AS STRING) || '.5' END AS units_purchased_kwh, CASE form WHEN 0 THEN CAST(1000 + k % 1000 AS STRING) || '.00' END AS amount_paid,
  document_date, document_date_label, days_old, months_old, coalesce(days_old BETWEEN 0 AND 90, false) AS is_recent,
  CASE form WHEN 3 THEN 'REJECT' ELSE 'HIGH' END AS confidence,
  CASE WHEN form = 3 THEN 'missing_service_address|missing_document_date' WHEN days_old BETWEEN 0 AND 90 THEN '' ELSE 'outside_recency_window' END AS reasons
FROM p""")

_NAMES = with_view("joined_names", """
w AS (SELECT doc_id, translate(doc_id::VARCHAR, '0123456789', 'ABCDEFGHIJ') AS w FROM joined_names)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'EDWARD SAMPLE' || w WHEN 1 THEN 'EDWARD SAMPLE ' || w || 'X' WHEN 2 THEN 'SAMPLE' || w || ' SAMPLE' || w
       WHEN 3 THEN 'MICHAEL EBUBE QQQ' || w || ' EMMANUEL' WHEN 4 THEN 'ADA' || ' ' || w || ' LEE' END AS name,
       CASE doc_id % 3 WHEN 0 THEN 'Abuja Electricity Distribution Prepaid' WHEN 1 THEN 'IKEJA ELECTRIC' ELSE 'ABUJA ELECTRICITY plc' END AS provider FROM w""")

QUERIES = {"utility_fields": utility_fields, "readable_names": readable_names, "provider_codes": provider_codes, "image_quality_metrics": image_quality_metrics}
ORACLES = {"utility_fields": _UTILITY, "readable_names": _NAMES}
