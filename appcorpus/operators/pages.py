"""Pages deep inside an order: counts by range say where a page lies, only those ranges are sorted."""

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcorpus.shared import stored

#: Rows of a range, about: what a page needs beside its own rows.
RANGE_ROWS = 50_000
MAX_RANGES = 1_000


def page(rows: DataFrame, order: list[str], offset: int, limit: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows `offset` to `offset + limit` in the order of the columns (nulls first), in that order; an offset behind the end gives none.

    `offset(n).limit(m)` on sorted rows brings n + m rows to one place. Here Spark's range partitioner deals the rows out once, each range
    is counted, and of the ranges that the page touches the first rows are passed over: at most a range's rows, however deep
    the page. Rows are computed once; the driver gets a count for each range. The order should tell rows apart; equal ones come in any order.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit: 0 or more")
    number = "_range"
    while number in rows.columns:
        number = f"_{number}"
    rows = stored(rows)
    ranges = max(1, min(MAX_RANGES, -(-rows.count() // range_rows)))
    dealt = stored(rows.repartitionByRange(ranges, *order).withColumn(number, F.spark_partition_id()))
    sizes = {r[number]: r["count"] for r in dealt.groupBy(number).count().collect()}
    ends = list(accumulate(sizes.get(k, 0) for k in range(ranges)))
    low = bisect_right(ends, offset)
    high = bisect_right(ends, offset + limit - 1) if limit else low
    before = ends[low - 1] if low else 0
    inside = dealt.where(F.col(number).between(low, high)).drop(number)
    return inside.orderBy(*order).offset(offset - before if low < ranges else 0).limit(limit)
