"""Identifier-bearing text derived from the customer table.

The expressions are plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FIRST = "CASE c_custkey % 5 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Bruno' WHEN 2 THEN 'Clara' WHEN 3 THEN 'Dario' ELSE 'Elena' END"
_LAST = "CASE c_custkey % 7 WHEN 0 THEN 'Keller' WHEN 1 THEN 'Moreau' WHEN 2 THEN 'Novak' WHEN 3 THEN 'Okafor' WHEN 4 THEN 'Petrov' WHEN 5 THEN 'Quist' ELSE 'Rossi' END"
_STEM = "CASE c_custkey % 6 WHEN 0 THEN 'Northgate' WHEN 1 THEN 'Silverbrook' WHEN 2 THEN 'Oakfield' WHEN 3 THEN 'Harbour Point' WHEN 4 THEN 'Redstone' ELSE 'Westmere' END"
_TAIL = "CASE c_custkey % 4 WHEN 0 THEN 'Trading' WHEN 1 THEN 'Capital' WHEN 2 THEN 'Logistics' ELSE 'Foods' END"
_SUFFIX = "CASE c_custkey % 3 WHEN 0 THEN 'Limited' WHEN 1 THEN 'PLC' ELSE 'LLP' END"

#: customer with the parts of its text
PARTS = f"""
SELECT c_custkey AS doc_id, c_mktsegment AS segment, n_name AS nation, {_FIRST} AS first_name, {_LAST} AS last_name,
  {_STEM} || ' ' || {_TAIL} AS stem, {_STEM} || ' ' || {_TAIL} || ' ' || {_SUFFIX} AS org,
  lpad(CAST(c_custkey AS STRING), 8, '0') AS number, c_acctbal AS balance,
  lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0') AS two
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

_EMAIL = "lower(first_name) || '.' || lower(last_name) || '@' || replace(lower(stem), ' ', '') || '.com'"
_IBAN_BODY = "'ABCD' || two || '3456' || number"
_IBAN_MOD = "CAST(CAST('10111213' || two || '3456' || number || '161100' AS DECIMAL(38,0)) % 97 AS INT)"
_LEI_MOD = "CAST(CAST('52990000000000' || substring(number, 5, 4) || '00' AS DECIMAL(38,0)) % 97 AS INT)"

TEXT = f"""
SELECT doc_id, segment, nation, first_name, last_name, stem, org, number, two, balance, email,
  'Client Name: ' || org || chr(10) ||
  'Director: ' || first_name || ' ' || last_name || chr(10) ||
  'Email: ' || email || chr(10) ||
  CASE WHEN doc_id % 4 = 0 THEN 'Company Number:' || chr(10) || number ELSE 'Company Number: ' || number || '.' END || chr(10) ||
  'Sort Code: ' || two || '-34-56' || chr(10) ||
  'IBAN: GB' || lpad(CAST(CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 98 - iban_mod END AS STRING), 2, '0') || {_IBAN_BODY} || chr(10) ||
  'LEI: 52990000000000' || substring(number, 5, 4) || lpad(CAST(98 - lei_mod AS STRING), 2, '0') || chr(10) ||
  'SWIFT: ABCDGB' || two || CASE WHEN doc_id % 2 = 0 THEN 'XXX' ELSE '' END || chr(10) ||
  'VAT: GB9' || number || chr(10) ||
  'Tax ID: 1' || two || '-' || two || '-1' || substring(number, 6, 3) || chr(10) ||
  'National Insurance: AB' || two || '3456C' || chr(10) ||
  'Address: ' || CAST(doc_id % 200 + 1 AS STRING) || ' Mill Lane, London EC1A 1BB' || chr(10) ||
  'Registered ' || two || '/11/2001 and reviewed 2019-03-' || CAST(doc_id % 9 + 1 AS STRING) || ' by SC' || substring(number, 3, 6) || chr(10) ||
  'Website: https://www.' || replace(lower(stem), ' ', '') || '.com/about' || chr(10) ||
  'Phone: +44 20 7946 ' || substring(number, 5, 4) || chr(10) ||
  'DIRECTOR notes: ' || stem || ' agreed with the Client. ' || last_name || ' signed for ' || upper(stem) || '.' AS text
FROM (SELECT *, {_EMAIL} AS email, {_IBAN_MOD} AS iban_mod, {_LEI_MOD} AS lei_mod FROM ({PARTS}) p) q
"""


#: A customer's text and its mentions weigh a thousand times the row they come from.
ROWS_A_TASK, LEAST_ROWS = 4_000, 500


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by their key to a number of tasks that grows with them.
    A file is split by row groups, which hold up to a million narrow rows; the
    text derived from them would all be scanned in one task."""
    n = rows.count()
    few = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    return rows.repartition(max(1, few, -(-n // ROWS_A_TASK)), key)


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        rows = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        (spread(rows, "c_custkey") if n == "customer" else rows).createOrReplaceTempView(n)


def kyc(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer", "nation")
    return spark.sql(TEXT)
