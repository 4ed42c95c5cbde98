"""op5: repeated runs of lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import line_runs
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = r"""
with l as (
  select doc_id, unnest(range(len(p))) as k, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents)
), w as (
  select *, row_number() over (partition by doc_id order by k) as i from l where regexp_matches(line, '[^ \x09-\x0D]')
), n as (
  select *, lead(line) over (partition by doc_id order by i) as next_line from w
), f as (
  select *, next_line is not null and row_number() over (partition by line, next_line order by doc_id, i) > 1 as later from n
), d as (
  select doc_id, k, i, later or coalesce(lag(later) over (partition by doc_id order by i), false) as dead from f
), c as (
  select doc_id, count(*) as n_lines, count(*) filter (where dead) as n_deleted from d group by doc_id
), t as (
  select l.doc_id, string_agg(line, chr(10) order by l.k) as text from l left join d on l.doc_id = d.doc_id and l.k = d.k
  where not coalesce(dead, false) group by l.doc_id
)
select documents.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted,
  sha256(case when n_deleted = n_lines and n_lines > 0 then '' else t.text end) as text_sha256
from documents left join c on c.doc_id = documents.doc_id left join t on t.doc_id = documents.doc_id
"""
