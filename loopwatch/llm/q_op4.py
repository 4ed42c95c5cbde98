"""op4: web pages to WARC archives and back."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm import warc
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages"))


ORACLE_SQL = """
with p as (
  select page_id, coalesce(octet_length(encode(html)), 0) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
