"""The sensor contract: column names, types, coercion, and the view that turns the driver's tables into a sensor panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The channels of the contract and the two label columns.
CHANNELS = [
    "inlet_temp", "outlet_temp", "pressure", "flow_rate", "flow_velocity", "tank_level",
    "conductivity", "cabinet_temp", "cabinet_humidity", "furnace_temp", "electric_power", "electric_current",
]
LABELS = ["operating_condition", "fault_label"]
REQUIRED = ["timestamp", *CHANNELS, *LABELS]


def finite(c: Column | str) -> Column:
    """A double that is neither NaN nor infinite, else null: a missing reading must not pass for a high one."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def validate(df: DataFrame) -> DataFrame:
    """The contract's columns in order, coerced; what can't be read becomes null. Missing columns raise ValueError."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return coerce(df)


def fill_contract(df: DataFrame) -> DataFrame:
    """Columns that are missing are added as nulls; rows without a timestamp go."""
    added = df.withColumns({c: F.lit(None).cast("string") for c in REQUIRED if c not in df.columns})
    return coerce(added).where(F.col("timestamp").isNotNull())


def coerce(df: DataFrame) -> DataFrame:
    ts = F.try_to_timestamp(F.col("timestamp").cast("string")).cast("timestamp_ntz")
    return df.select(ts.alias("timestamp"), *(finite(c).alias(c) for c in CHANNELS), *(F.col(c).cast("string").alias(c) for c in LABELS))


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A list of records as a frame of the contract: what is missing is null. Rows without a timestamp go."""
    present = [c for c in REQUIRED if any(c in r for r in rows)]
    text = [tuple(None if r.get(c) is None else str(r[c]) for c in present) for r in rows]
    return fill_contract(spark.createDataFrame(text, ", ".join(f"{c} string" for c in present) or "timestamp string"))


def json_safe(df: DataFrame) -> DataFrame:
    """Doubles that are NaN or infinite become null and timestamps become text, as JSON can't hold them."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            out[f.name] = F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name))
        elif kind.startswith("timestamp") or kind == "date":
            out[f.name] = F.col(f.name).cast("string")
    return df.withColumns(out) if out else df


#: A sensor panel from lineitem, in SQL that Spark and DuckDB read alike. Rows arrive once a second for each device. A device
#: is 25 suppliers, so more data means more devices and not longer series.
PANEL = """
select device_id, seq as arrival_seq, seq as t,
  22e0 + 200e0 * l_tax + 1e-1 * l_quantity as inlet_temp,
  30e0 + 200e0 * l_tax + 1e-1 * l_quantity + 250e0 * l_discount as outlet_temp,
  120e0 + 22e-1 * (4e0 + 12e-2 * l_quantity) * (4e0 + 12e-2 * l_quantity) + 2000e0 * (l_tax - 4e-2) as pressure,
  4e0 + 12e-2 * l_quantity as flow_rate,
  1e0 + 3e-2 * l_quantity as flow_velocity,
  100e0 + 10e0 * l_linenumber as tank_level,
  300e0 + 6000e0 * l_discount as conductivity,
  25e0 + 50e0 * l_tax as cabinet_temp,
  40e0 + 400e0 * l_discount as cabinet_humidity,
  1000e0 + 5e-1 * (seq % 600) + l_quantity as furnace_temp,
  400e0 + 40e0 * l_quantity as electric_power,
  600e0 + 60e0 * l_quantity as electric_current,
  case l_returnflag when 'A' then 'melting' when 'N' then 'holding' else 'idle' end as operating_condition,
  case when l_quantity > 40 and l_discount > 5e-2 then '线圈结垢' when l_quantity < 8 then '过滤器堵塞' else 'none' end as fault_label
from (
  select *, cast((l_suppkey - l_suppkey % 25) / 25 as bigint) as device_id, cast(row_number() over (
    partition by l_suppkey - l_suppkey % 25
    order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  ) - 1 as bigint) as seq
  from lineitem
)
"""

#: The same panel with repeated, late, missing and impossible readings, for the quality operators.
DIRTY = f"""
select device_id,
  arrival_seq,
  case when arrival_seq % 97 = 5 then t - 1 when arrival_seq % 89 = 3 then t - 2 else t end as t,
  case when arrival_seq % 20 = 7 then null else inlet_temp end as inlet_temp,
  case when arrival_seq % 50 = 9 then outlet_temp + 40 when arrival_seq % 23 = 4 then null else outlet_temp end as outlet_temp,
  case when arrival_seq % 101 = 11 then 999e0 else pressure end as pressure,
  flow_rate, flow_velocity, tank_level, conductivity, cabinet_temp, cabinet_humidity, furnace_temp, electric_power, electric_current,
  case when arrival_seq % 31 = 8 then null else operating_condition end as operating_condition, fault_label
from ({PANEL}) as clean
where arrival_seq % 61 <> 13
"""


def load(spark: SparkSession, sf_dir: str, text: str = PANEL) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(text)
