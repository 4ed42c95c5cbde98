"""op11: strings of 100 bytes that occur earlier."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import substrings
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
with b as (
  select doc_id, coalesce(hex(encode(text)), '') as h from documents
), s as (
  select doc_id, i, substr(h, 2 * i + 1, 200) as g from (select doc_id, h, unnest(range(length(h) // 2 - 99)) as i from b)
), f as (
  select doc_id, i, row_number() over (partition by md5(g) order by doc_id, i) > 1 as later from s
), r as (
  select doc_id, i, sum(new) over (partition by doc_id order by i) as run from (
    select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as new from f where later
  )
), p as (
  select doc_id, run, min(i) as a, max(i) + 100 as e from r group by doc_id, run
), g as (
  select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as before from p
), k as (
  select g.doc_id, count(*) as n_spans, sum(e - a) as n_removed, max(e) as last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as parts
  from g join b on b.doc_id = g.doc_id group by g.doc_id
)
select b.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when k.doc_id is null then h else parts || substr(h, 2 * last + 1) end)) as kept_sha256
from b left join k on k.doc_id = b.doc_id
"""
