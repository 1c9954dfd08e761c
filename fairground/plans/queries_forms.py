"""Posted forms, made from customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forms
from .catalog import query
from .standins import table

SENT = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'website' ELSE 'event' END AS kind, CASE WHEN c_custkey % 17 = 1 THEN ' x ' ELSE ' ' END AS company, c_name AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'a@b.ca' WHEN 1 THEN 'not an address' WHEN 2 THEN ' ' END AS email, CASE WHEN c_custkey % 4 = 0 THEN '  Fair ' END AS title,
  CASE c_custkey % 7 WHEN 0 THEN 'example.org/fair' WHEN 1 THEN 'ftp://example.org' WHEN 2 THEN 'http://x.ca' WHEN 3 THEN 'nowhere' END AS url,
  CASE WHEN c_custkey % 2 = 0 THEN '2026-02-30' ELSE '2026-13-01' END AS date, CASE WHEN c_custkey % 2 = 0 THEN '19:30' ELSE '24:00' END AS time, CASE WHEN c_custkey % 6 = 1 THEN 'All are welcome' END AS description, CASE WHEN c_custkey % 11 = 5 THEN 'Thanks' END AS comments FROM {customer}"""


@query(f"""WITH f AS ({SENT.format(customer='customer')}), v AS (SELECT *, CASE WHEN trim(company) <> '' THEN 'spam' WHEN email = 'not an address' THEN 'bad email' WHEN url IN ('ftp://example.org', 'nowhere') THEN 'bad url'
  WHEN title IS NULL AND url IS NULL AND comments IS NULL AND (kind = 'website' OR description IS NULL) THEN 'empty' ELSE 'ok' END AS verdict FROM f)
SELECT id, verdict, kind, CASE WHEN verdict = 'ok' THEN name END AS name, CASE WHEN verdict = 'ok' THEN nullif(trim(email), '') END AS email, CASE WHEN verdict = 'ok' THEN trim(title) END AS title,
  CASE WHEN verdict = 'ok' THEN comments END AS comments, CASE WHEN verdict = 'ok' THEN CASE WHEN url = 'example.org/fair' THEN 'https://' || url ELSE url END END AS url,
  CASE WHEN verdict = 'ok' AND kind = 'event' THEN description END AS description, CASE WHEN verdict = 'ok' AND kind = 'event' AND id % 2 = 0 THEN date END AS date, CASE WHEN verdict = 'ok' AND kind = 'event' AND id % 2 = 0 THEN time END AS time FROM v""")
def suggestion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.suggestions(spark.sql(SENT, customer=table(spark, sf_dir, "customer")))


POSTED = """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'Fair' END AS title, CASE c_custkey % 4 WHEN 0 THEN 'tay' WHEN 1 THEN 'atlantis' END AS municipality, CASE c_custkey % 5 WHEN 0 THEN 'music' WHEN 1 THEN 'noise' END AS category,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '2026-7-1' ELSE '2026-07-01' END AS date, CASE c_custkey % 3 WHEN 0 THEN '19:00' WHEN 1 THEN '7pm' END AS start_time, CASE c_custkey % 4 WHEN 0 THEN '18:00' WHEN 1 THEN '21:00' WHEN 2 THEN '99' END AS end_time,
  CASE c_custkey % 7 WHEN 0 THEN '2026-06-30' WHEN 1 THEN '2026-07-02' WHEN 2 THEN 'later' END AS end_date, CASE WHEN c_custkey % 8 = 3 THEN 'mailto:x@y.ca' END AS url, CASE WHEN c_custkey % 8 = 5 THEN 'http://x.ca/a.png' END AS image_url,
  CASE WHEN c_custkey % 10 = 7 THEN 'cheap' END AS cost, CASE WHEN c_custkey % 10 = 8 THEN 'maybe' END AS status FROM {customer}"""


@query(f"""WITH f AS ({POSTED.format(customer='customer')}), c AS (SELECT *, coalesce(date <> '2026-07-01', TRUE) AS d, coalesce(start_time = '7pm', FALSE) AS s, coalesce(end_time = '99', FALSE) OR (end_time IS NOT NULL AND start_time IS NULL) AS e,
  coalesce(end_date = 'later', FALSE) OR coalesce(end_date < date, FALSE) AS x FROM f)
SELECT id, concat_ws(',', CASE WHEN category = 'noise' THEN 'category' END, CASE WHEN cost = 'cheap' THEN 'cost' END, CASE WHEN d THEN 'date' END, CASE WHEN x THEN 'end_date' END,
  CASE WHEN e OR (NOT d AND NOT s AND NOT x AND coalesce(coalesce(end_date, date) || end_time <= date || start_time, FALSE)) THEN 'end_time' END, CASE WHEN image_url IS NOT NULL THEN 'image_url' END, CASE WHEN municipality = 'atlantis' THEN 'municipality' END,
  CASE WHEN s THEN 'start_time' END, CASE WHEN status IS NOT NULL THEN 'status' END, CASE WHEN title = ' ' THEN 'title' END, CASE WHEN url IS NOT NULL THEN 'url' END) AS errors FROM c""")
def event_form_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = forms.event_errors(spark.sql(POSTED, customer=table(spark, sf_dir, "customer")))
    return checked.select("id", F.array_join("errors", ",").alias("errors"))
