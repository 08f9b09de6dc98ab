"""As-of joins whose keys may be hot: the latest earlier row of the same key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged

#: Rows of one key in one stretch of time.
STRETCH_ROWS = 1 << 16


def latest_earlier(rows: DataFrame, key: str, time: str, value: str, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """rows with `latest`: `value` of the last row before (by key and time) at which it isn't null.

    Rows of equal time don't see one another; of several values at one time the greatest counts.
    Null keys find nothing. Rows are cut by their rank in (key, time) into stretches, and what a
    stretch begins with comes from one row a key and stretch, so a key with a third of all rows
    is spread over as many tasks as it has stretches, also where they come in bursts. `rows` is
    read twice, so it should be a written table.
    """
    stretches = max(1, math.ceil(rows.count() / stretch_rows))
    held = Staged(rows.repartitionByRange(stretches, key, time).withColumn("__stretch", F.spark_partition_id()))
    cut = held.df
    last = cut.filter(F.col(value).isNotNull()).groupBy(key, "__stretch").agg(F.max(F.struct(time, value))[value].alias("__last"))
    with_rows = cut.select(key, "__stretch").distinct().join(last, [key, "__stretch"], "left")
    before = W.partitionBy(key).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    carrying = with_rows.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).filter("__carried is not null")
    carried = Staged(carrying.select(F.col(key).alias("__key"), F.col("__stretch").alias("__in"), "__carried"))
    earlier = W.partitionBy(key, "__stretch").orderBy(time).rangeBetween(W.unboundedPreceding, -1)
    inside = cut.withColumn("__inside", F.max(F.when(F.col(value).isNotNull(), F.struct(time, value))).over(earlier)[value])
    small = carried.for_join(carried.row_bytes())
    joined = inside.join(small, (F.col(key) == F.col("__key")) & (F.col("__stretch") == F.col("__in")), "left")
    found = F.when(F.col(key).isNotNull(), F.coalesce("__inside", "__carried"))
    return joined.withColumn("latest", found).select(*rows.columns, "latest")
