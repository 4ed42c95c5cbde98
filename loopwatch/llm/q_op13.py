"""op13: documents drawn by importance towards the benchmark's texts."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm import resampling
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), w as (
  select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark)
), f as (
  select kind, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from w
), c as (
  select kind, id, f, count(*) as n from f group by all
), h as (
  select f, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) as r
  from (select f, hex(encode(f)) as x from (select distinct f from c)), crc
), k as (
  select kind, id, n, xor(r, 4294967295) % 10000 as bucket from c join h using (f)
), b as (
  select range as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from range(10000)
  left join (select bucket, sum(n) filter (where kind = 'd') as s, sum(n) filter (where kind = 'b') as t from k group by bucket) x on x.bucket = range
), g as (
  select bucket, cast(floor(1000 * ln(cast((t + 1) * ((select sum(s) from b) + 10000) as double) / cast((s + 1) * ((select sum(t) from b) + 10000) as double))) as bigint) as gain from b
), d as (
  select id as doc_id, sum(n) as n, sum(n * gain) as total from k join g using (bucket) where kind = 'd' group by id
), s as (
  select documents.doc_id, coalesce(n, 0) as n_features, coalesce(cast(floor(cast(total as double) / n) as bigint), 0) as weight,
    cast('0x' || substr(sha256('7:' || documents.doc_id), 1, 8) as bigint) as h
  from documents left join d on d.doc_id = documents.doc_id
), p as (
  select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score, n_features >= 39 as fit from s
), r as (
  select *, row_number() over (partition by fit order by score desc, doc_id) as place, count(*) filter (where fit) over () as n_fit from p
)
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when fit and place <= 25 * n_fit // 100 then place end as rank from r
"""
