"""Vendor and invoice extracts of three source systems, derived from customer and orders.

The SQL runs unchanged on Spark and DuckDB, so both sides of a comparison start from the same rows.  Defects
follow from the keys: blank and cut tax ids, unknown countries, broken e-mails, typos; blank, negative and hundredfold
amounts, invalid and future dates, missing and unknown currencies, unknown vendors, repeated invoices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quarrystone.config import NAME_ABBREVIATIONS

# The parts that vendor names are made of.
STEMS = "Apex Nova Orion Zenith Vertex Summit Pioneer Atlas Quantum Sterling Horizon Cobalt Evergreen Falcon Meridian Crescent".split()
PLACES = "Park Hill River Lake Forest Harbor Valley".split()
INDUSTRIES = "TECH ENGG SVCS PHARMACEUTICALS INTL MFG DIST COMMS FOODS TEXTILES LOGISTICS STEEL CHEMICALS ENERGY MEDIA RETAIL".split()


def _pick(values: list[str], index: str) -> str:
    return "CASE " + index + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _div(a: str, n: int) -> str:
    return f"CAST(({a} - {a} % {n}) / {n} AS BIGINT)"


VENDORS_SQL = f"""
SELECT source, source_vendor_id, source || ':' || source_vendor_id AS record_key, t AS true_vendor,
       CASE WHEN k % 13 = 4 THEN substr(plain_name, 1, 5) || substr(plain_name, 7) ELSE plain_name END
         || CASE WHEN k % 2 = 0 THEN ' Pvt. Ltd.' ELSE ' LIMITED' END AS vendor_name,
       CAST(100 + t % 900 AS STRING) || ' Main Street' AS street,
       CASE WHEN k % 10 = 3 THEN '' WHEN k % 17 = 5 THEN substr(tax, 1, 7) ELSE tax END AS tax_id_raw,
       CASE WHEN k % 20 = 11 THEN 'ZZZ' WHEN k % 3 = 0 THEN iso2
            WHEN k % 3 = 1 THEN {_pick(["India", "United States", "United Kingdom", "Germany", "Singapore"], "ci")}
            ELSE {_pick(["IND", "USA", "GBR", "DEU", "SGP"], "ci")} END AS country_raw,
       {_pick(["Bangalore", "NYC", "London", "Muenchen", "Singapore"], "ci")} AS city_raw,
       '0091' || CAST(9000000000 + (t * 7919) % 1000000 AS STRING) AS phone_raw,
       replace('ap@' || lower(replace(plain_name, ' ', '')) || '.com', '@', CASE WHEN k % 12 = 7 THEN ' at ' ELSE '@' END) AS email_raw,
       CAST(100000000000 + t * 104729 AS STRING) AS bank_raw
FROM (
  SELECT *, {_pick(list(("ERP_A", "ERP_B", "ERP_C")), "k % 3")} AS source, CAST(k AS STRING) AS source_vendor_id,
         {_pick(["IN", "US", "GB", "DE", "SG"], "ci")} AS iso2,
         {_pick(STEMS, "t % 16")} || ' ' || {_pick(PLACES, "t % 7")} || ' ' || {_pick(INDUSTRIES, _div("t", 16) + " % 16")} AS plain_name,
         lower({_pick(["IN", "US", "GB", "DE", "SG"], "ci")}) || '-' || substr(md5(CAST(t AS STRING)), 1, 4) || ' ' || substr(md5(CAST(t AS STRING)), 5, 6) AS tax
  FROM (SELECT c_custkey AS k, {_div("c_custkey", 2)} AS t, {_div("c_custkey", 2)} % 5 AS ci FROM customer) a
) b"""

#: The vendor's name with its industry written out, but for one vendor in a hundred.
_WRITTEN_OUT = reduce(lambda x, pair: f"replace({x}, ' {pair[0]} ', ' {pair[1]} ')", NAME_ABBREVIATIONS.items(), "vendor_name")
SPELLED_SQL = f"CASE WHEN CAST(source_vendor_id AS BIGINT) % 100 = 7 THEN vendor_name ELSE {_WRITTEN_OUT} END"

_WHOLE = "substr(plain, 1, length(plain) - 3)"
_GROUPED = (
    f"CASE WHEN length(plain) > 9 THEN substr(plain, 1, length(plain) - 9) || ',' || substr(plain, length(plain) - 8, 3) || ',' || substr(plain, length(plain) - 5)"
    f" WHEN length(plain) > 6 THEN substr(plain, 1, length(plain) - 6) || ',' || substr(plain, length(plain) - 5) ELSE plain END"
)

INVOICES_SQL = f"""
SELECT source, invoice_no, source || ':INV:' || invoice_no AS record_key, source_vendor_id, source || ':' || source_vendor_id AS vendor_record_key,
       CASE WHEN k % 33 = 2 THEN '' WHEN k % 25 = 1 THEN '-' || shown ELSE shown END AS amount_raw,
       CASE WHEN k % 33 = 5 THEN 'not a date' WHEN c % 3 = 0 THEN yyyy || mm || dd
            WHEN c % 3 = 1 THEN dd || '-' || substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST(3 * mon - 2 AS INT), 3) || '-' || yyyy
            ELSE yyyy || '-' || mm || '-' || dd END AS invoice_date_raw,
       CASE WHEN k % 20 = 6 THEN '' WHEN k % 20 = 16 THEN 'XXX' ELSE {_pick(["INR", "USD", "GBP", "EUR", "SGD"], "ci")} END AS currency_raw
FROM (
  SELECT *, CASE WHEN c % 3 = 1 THEN {_GROUPED} ELSE plain END AS shown
  FROM (
    SELECT k, c, {_pick(["ERP_A", "ERP_B", "ERP_C"], "c % 3")} AS source, {_div("c", 2)} % 5 AS ci,
           'INV' || lpad(CAST(k AS STRING), 9, '0') AS invoice_no,
           CAST(CASE WHEN k % 20 = 7 THEN 990000000 + k ELSE c END AS STRING) AS source_vendor_id,
           CAST(CAST(CASE WHEN k % 25 <> 1 AND k % 33 = 3 THEN price * 100 ELSE price END AS DECIMAL(18, 2)) AS STRING) AS plain,
           CASE WHEN k % 25 = 4 THEN '2028' ELSE CAST(year(d) AS STRING) END AS yyyy, month(d) AS mon,
           lpad(CAST(month(d) AS STRING), 2, '0') AS mm, lpad(CAST(CASE WHEN day(d) > 28 THEN 28 ELSE day(d) END AS STRING), 2, '0') AS dd
    FROM (SELECT o_orderkey AS k, o_custkey AS c, round(o_totalprice, 2) AS price, o_orderdate AS d FROM orders
          UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice, 2), o_orderdate FROM orders WHERE o_orderkey % 25 = 8) o
  ) a
) b"""

#: Java date patterns of the sources.
DATE_PATTERNS = {"ERP_A": "yyyyMMdd", "ERP_B": "dd-MMM-yyyy", "ERP_C": "yyyy-MM-dd"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VENDORS_SQL.replace("FROM customer)", "FROM {customer})"), customer=table(spark, sf_dir, "customer"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = INVOICES_SQL.replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"))
