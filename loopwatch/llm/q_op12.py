"""op12: exact clusters of the embeddings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import lloyd
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lloyd.cluster(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    name = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", name.alias("centroid_sha256"))


def _rounds() -> str:
    """A pair of common tables for each round: the nearest centroids, and the new ones."""
    square = "cast(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    out = []
    for k in range(lloyd.ROUNDS + 1):
        out.append(f"a{k} as materialized (select vec_id, v.e, min(struct_pack(d := {square}, c := c.c)) as n from v, c{k} c group by vec_id, v.e)")
        if k < lloyd.ROUNDS:
            out.append(
                f"c{k + 1} as materialized (select c, list(x order by j) as e from (select c{k}.c, j, case when s is null then c{k}.e[j] else cast((s - ((s % m) + m) % m) // m as bigint) end as x"
                f" from c{k} cross join (select unnest(range(1, 65)) as j) left join (select c, j, sum(x) as s, count(*) as m from (select n.c as c, unnest(range(1, 65)) as j, unnest(e) as x from a{k}) group by c, j) using (c, j)) group by c)"
            )
    return ", ".join(out)


ORACLE_SQL = f"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
  select cast(row_number() over (order by h, e) - 1 as integer) as c, e from (select sha256('2:' || vec_id) as h, e from v) order by h, e limit 40
), {_rounds()}
select vec_id, n.c as cluster, n.d as distance, cast(sum(n.d) over (partition by n.c) as bigint) as cluster_inertia,
  cast(sum(n.d) over () as bigint) as inertia, sha256(array_to_string(f.e, ',')) as centroid_sha256
from a{lloyd.ROUNDS} a join c{lloyd.ROUNDS} f on f.c = a.n.c
"""
