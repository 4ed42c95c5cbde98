"""The equipment picture: what each node shows, from current alerts and the diagnosis, and how fresh it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwatch.functions.dims import fixed

# Names by which a cause points at a node.
CAUSE_NODES = [
    ("filter", ["filter_clog", "过滤器堵塞", "滤网堵塞"]), ("pump", ["pump_cavitation", "水泵气蚀", "水泵汽蚀"]), ("pipework", ["pipe_leak", "管道泄漏", "管路泄漏"]),
    ("furnaces", ["scale_buildup", "线圈结垢"]), ("tower", ["heat_exchanger_degradation", "换热器散热衰退", "换热器散热异常", "换热衰退"]), ("tank", ["water_quality", "水质恶化"]),
    ("power", ["cabinet_fan_failure", "柜风机失效", "电气柜风机", "凝露"]), ("makeup", ["makeup_valve_stuck_open", "补水阀卡开"]),
]
RANKS, STALE = ["idle", "warning", "fault", "critical"], 30


def cause_aliases() -> list[tuple[str, str]]:
    return [(node, alias) for node, names in CAUSE_NODES for alias in names]


def cause_nodes(causes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Nodes that a case's cause names by any alias; no row where it names none. Aliases are a fixed few."""
    return causes.join(F.broadcast(fixed(aliases, "the aliases")), F.contains("cause", "alias")).select("case_id", "node").distinct()


def finding_level(manual: Column, more_data: Column, level: Column) -> Column:
    return F.when(manual | more_data, "warning").when(level == "red", "critical").otherwise("fault")


def node_levels(issues: DataFrame) -> DataFrame:
    """The gravest level of each case's node, and how many issues it has. Issues without a node don't count."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("level"))
    top = issues.where("node is not null").groupBy("case_id", "node").agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("n_issues"))
    return top.select("case_id", "node", F.element_at(F.array(*map(F.lit, RANKS)), F.col("r").cast("int")).alias("level"), "n_issues")


def shown_status(status: Column, age: Column) -> Column:
    """A running session whose last frame is over half a minute old, or that has none, is stale."""
    return F.when((status == "running") & (age.isNull() | (age > STALE)), "stale").otherwise(status)


def flow_seconds(flow: Column) -> Column:
    """How long the picture's flow takes for a round: slower with less flow, 0 without any."""
    return F.when(flow > 0, F.greatest(F.lit(0.6), F.least(F.lit(8.0), 2.4 * 8 / flow))).otherwise(0.0)
