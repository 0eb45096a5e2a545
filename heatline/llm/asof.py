"""As-of join with a tolerance: the latest order of a client at or before a click.

A client equi-join with a time-range predicate. To keep a busy client's clicks from meeting all its orders, the key also
holds a cell of time (`cell_us`) and, in cells with many orders, a salt: a cell is cut into slices, a power of two so
that a slice begins some `slice_orders` order times. An order is replicated to the slices from its own to the one where the
client's next order time falls, and the last order before a cell, or before the chunk of `tolerance_us` that the cell is in,
to the slices until the cell's first order. So a click meets the orders of its own slice and at most one older, whatever
the client's share of the rows. The candidates of a click are aggregated by max_by on the order time, and a left join
returns clicks without any.

Orders of one client and time are one row beforehand (how many, and the best by the tie order), with map-side sums. A
cell's orders are one task's to sort, and so are the cells of a client's chunk, which are no more than tolerance / cell; no
task gets a client's history. Nothing is collected or broadcast by the operator.

Defined results: a click_id counts once (copies that differ: the latest time used, then the larger client; null loses);
rows with null click_id take no part; a null client or time on either side matches nothing, and such a click is returned
unmatched; orders of equal time go to the larger total_cents, then the larger sale_id, null losing; totals that are no
finite number of cents in a long are null; repeated orders are orders of their own; an empty table of orders leaves all
clicks unmatched; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatline.functions.scalar import finite, micros

from .common import read_table

HOUR = 3_600_000_000
TOLERANCE, CELL, SLICE_ORDERS, MOST_SLICES = 720 * HOUR, HOUR, 4, 1 << 20
STEP = 6 * HOUR


def digits_crc(c: Column) -> Column:
    """Unsigned CRC-32 of an integer's decimal digits."""
    return F.crc32(c.cast("string").cast("binary"))


def used_time(ts: Column, id_: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, to a multiple of six hours below where the id's checksum is odd."""
    us = micros(ts)
    return F.when(digits_crc(id_) % 2 == 1, us - F.pmod(us, F.lit(STEP))).otherwise(us)


def clicks_of(clicks: DataFrame) -> DataFrame:
    """click_id, client_id, ts_us: one row for each click_id."""
    rows = clicks.where("click_id is not null").select(F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("client_id"), used_time(F.col("ts"), F.col("click_id")).alias("ts_us"))
    return rows.groupBy("click_id").agg(F.max(F.struct("ts_us", "client_id")).alias("c")).select("click_id", "c.client_id", "c.ts_us")


def orders_of(sales: DataFrame) -> DataFrame:
    """client_id, us, sale_id, total_cents, priority: every sale, and a twin of those whose checksum three doesn't divide."""
    cents = F.floor(100 * F.col("total") + 0.5)
    total = F.when(finite(F.col("total")) & (F.abs("total") < 9e16), cents)
    rows = sales.select(F.col("client_id").cast("long").alias("client_id"), used_time(F.col("sold_at"), F.col("sale_id")).alias("us"), F.col("sale_id").cast("long").alias("sale_id"), total.alias("total_cents"), "priority", (digits_crc(F.col("sale_id")) % 3).alias("third"))
    own = F.struct(F.col("sale_id").alias("sale_id"), F.col("priority").alias("priority"))
    twin = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    both = rows.withColumn("o", F.explode(F.when(F.col("third") != 0, F.array(own, twin)).otherwise(F.array(own))))
    return both.select("client_id", "us", "o.sale_id", "total_cents", "o.priority")


def latest(clicks: DataFrame, orders: DataFrame, tolerance_us: int = TOLERANCE, cell_us: int = CELL, slice_orders: int = SLICE_ORDERS) -> DataFrame:
    """clicks (click_id, client_id, ts_us; one row each) with sale_id, lag_us, total_cents and n_tied of the latest order
    (client_id, us, sale_id, total_cents) at or before and at most tolerance_us earlier."""
    if tolerance_us % cell_us:
        raise ValueError("the tolerance is to be a multiple of the cell")
    cells = tolerance_us // cell_us  # of a chunk
    cell = lambda us: F.floor(F.col(us) / cell_us).cast("long")
    asked = clicks.where("client_id is not null and ts_us is not null").withColumn("cell", cell("ts_us"))
    tied = orders.where("client_id is not null and us is not null").groupBy("client_id", "us").agg(F.max(F.struct("total_cents", "sale_id")).alias("best"), F.count("*").alias("n_tied"))
    tied = tied.select("client_id", "us", F.struct("us", "best", "n_tied").alias("order"), cell("us").alias("cell"))

    # of each cell with clicks: its order times, the first, and the last order before it in its chunk or the chunk before
    by_cell = tied.groupBy("client_id", "cell").agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("order").alias("last"))
    wanted = asked.select("client_id", "cell").distinct()
    none = lambda c, like: F.lit(None).cast(by_cell.schema[like].dataType).alias(c)
    known = by_cell.select("*", F.lit(False).alias("asked")).unionByName(wanted.select("client_id", "cell", none("n", "n"), none("first", "first"), none("last", "last"), F.lit(True).alias("asked")))
    known = known.groupBy("client_id", "cell").agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("asked").alias("asked"))
    known = known.withColumn("chunk", F.floor(F.col("cell") / cells).cast("long"))
    # a chunk's last order stands before the first cell of the next chunk
    handed = known.withColumn("next", F.explode(F.array(F.col("chunk"), F.col("chunk") + 1))).withColumn("own", F.col("next") == F.col("chunk"))
    handed = handed.where("own or last is not null").withColumn("at", F.when(F.col("own"), F.col("cell")).otherwise(F.lit(-(1 << 62))))
    handed = handed.groupBy("client_id", "next", "at").agg(F.max("n").alias("n"), F.min(F.when(F.col("own"), F.col("first"))).alias("first"), F.max("last").alias("last"), F.max(F.col("own") & F.col("asked")).alias("asked"))
    before = Window.partitionBy("client_id", "next").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ready = handed.withColumn("older", F.last("last", ignorenulls=True).over(before)).where("asked").select("client_id", F.col("at").alias("cell"), "n", "first", "older")
    slices = lambda n: F.least(F.lit(MOST_SLICES), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.coalesce(n, F.lit(1)) / slice_orders, F.lit(1.0)))))).cast("long")
    of = lambda us, n: F.floor(F.pmod(F.col(us), F.lit(cell_us)) * slices(F.col(n)) / cell_us).cast("long")

    # orders in the slices that they may serve
    inside = Window.partitionBy("client_id", "cell")
    own = tied.withColumn("n", F.count("*").over(inside)).withColumn("then", F.lead("us").over(inside.orderBy("us")))
    last_slice = slices(F.col("n")) - 1
    own = own.select("client_id", "cell", "order", F.explode(F.sequence(of("us", "n"), F.coalesce(of("then", "n"), last_slice))).alias("slice"))
    old = ready.where("older is not null").select("client_id", "cell", F.col("older").alias("order"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(of("first", "n"), last_slice))).alias("slice"))
    served = own.unionByName(old).withColumnRenamed("client_id", "of_client").withColumnRenamed("cell", "of_cell").withColumnRenamed("slice", "of_slice")

    placed = asked.join(ready.select("client_id", "cell", "n"), ["client_id", "cell"]).withColumn("slice", of("ts_us", "n"))
    same = (F.col("client_id") == F.col("of_client")) & (F.col("cell") == F.col("of_cell")) & (F.col("slice") == F.col("of_slice"))
    pairs = placed.join(served, same & F.col("order.us").between(F.col("ts_us") - tolerance_us, F.col("ts_us")))
    found = pairs.groupBy("click_id").agg(F.max_by("order", "order.us").alias("order"))
    out = clicks.join(found, "click_id", "left")
    lag = F.col("ts_us") - F.col("order.us")
    return out.select("click_id", "client_id", "ts_us", F.col("order.best.sale_id").alias("sale_id"), lag.alias("lag_us"), F.col("order.best.total_cents").alias("total_cents"), F.coalesce("order.n_tied", F.lit(0)).cast("long").alias("n_tied"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(clicks_of(read_table(spark, sf_dir, "clicks")), orders_of(read_table(spark, sf_dir, "sales")))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(substr({0}::VARCHAR, i, 1))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
_USED = "CASE WHEN {h} % 2 = 1 THEN {us} - (({us} % 21600000000) + 21600000000) % 21600000000 ELSE {us} END"
#: The checksum's table follows from its polynomial; orders of a client and time are one row, and clicks take the last at or before.
SQL = f"""WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
c0 AS (SELECT click_id, client_id, epoch_us(ts) AS us, {_CRC.format('click_id')} AS h FROM clicks, t WHERE click_id IS NOT NULL),
c AS (SELECT click_id, x.client_id AS client_id, x.ts_us AS ts_us FROM (SELECT click_id, max(struct_pack(ts_us := coalesce(ts_us, -9223372036854775808), client_id := client_id)) AS x FROM (SELECT click_id, client_id, {_USED.format(h='h', us='us')} AS ts_us FROM c0) GROUP BY 1)),
c1 AS (SELECT click_id, client_id, CASE WHEN ts_us > -9223372036854775808 THEN ts_us END AS ts_us FROM c),
s0 AS (SELECT sale_id, client_id, epoch_us(sold_at) AS us, total, {_CRC.format('sale_id')} AS h FROM sales, t),
s1 AS (SELECT sale_id, client_id, {_USED.format(h='h', us='us')} AS us, CAST(floor(100 * total + 0.5) AS BIGINT) AS total_cents, h FROM s0),
s2 AS (SELECT sale_id, client_id, us, total_cents FROM s1 UNION ALL SELECT -1 - sale_id, client_id, us, total_cents FROM s1 WHERE h % 3 <> 0),
o AS (SELECT * FROM (SELECT client_id, us, sale_id, total_cents, count(*) OVER (PARTITION BY client_id, us) AS n_tied, row_number() OVER (PARTITION BY client_id, us ORDER BY total_cents DESC NULLS LAST, sale_id DESC NULLS LAST) AS k FROM s2 WHERE client_id IS NOT NULL AND us IS NOT NULL) WHERE k = 1),
j AS (SELECT c1.click_id, c1.client_id, c1.ts_us, o.sale_id, o.us, o.total_cents, o.n_tied, o.us IS NOT NULL AND o.us >= c1.ts_us - {TOLERANCE} AS ok FROM c1 ASOF LEFT JOIN o ON c1.client_id = o.client_id AND c1.ts_us >= o.us)
SELECT click_id, client_id, ts_us, CASE WHEN ok THEN sale_id END AS sale_id, CASE WHEN ok THEN ts_us - us END AS lag_us, CASE WHEN ok THEN total_cents END AS total_cents, CASE WHEN ok THEN n_tied ELSE 0 END AS n_tied FROM j"""
