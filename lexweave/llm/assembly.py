"""Sale completeness assembly: a sale and its lines arrive on different days; a stateful stream puts them together and says of each
assembly whether it became complete, or what it lacked when its time was over.

Before the stream, distinct lines are summed per sale and day (``arrivals``), so that a hot sale is a row per day however many lines it
has, and cut into batches by day. The batches are written under the shared folder and moved, one by one, into the folder that the
stream reads. The stream is started once per batch, on one checkpoint:
  state       applyInPandasWithState; a tuple per open assembly (sale_id, first and last day, lines, cents, due, sales), folded day by day
  keys        groups of sale_ids by hash, about KEY_ROWS rows each over all batches, since a Python call per sale_id costs more than
              its work (per_sale keys the state by sale_id alone; both are tested to agree)
  time        the watermark runs over d without delay, so at each start it is the largest day of the batches before; a key's timeout is
              the first deadline of its assemblies
  empty days  no-data batches are disabled; each batch holds a sentinel row, so that an empty one runs too and closes what is over
  the end     the last batch's sentinel lies far in the future; one more start, fed with a sentinel alone, times everything out
Each start writes its closings under its batch number, so a start that is repeated replaces its own.

Defined cases: a line without sale_id, and a sale without one, is dropped; a line without shipped_at has a day by hash; a sale without
arrived_at arrives on the first day; a null amount or total is zero cents; a null line_no is hashed as the empty string; equal lines
count once; of several sales with one id and day the largest due holds; days before the first and after the last batch belong to those;
empty tables give no row; further columns are ignored but tell lines apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import delete, move, shared_dir

BATCHES, FIRST_DAY, SPAN, OPEN_DAYS = 8, 19723, 160, 5
#: Rows of a state key over all batches.
KEY_ROWS = 8192
#: Event time is a second a day, counted from so many days before 1970, since it has to be positive and pandas ends in 2262; the end
#: of all days.
TICK_MS, SHIFT, FAR = 1000, 1_000_000, 50_000_000
#: The key of sentinels: no hash, and no sale_id of a shop.
SENTINEL = -(1 << 63)
ARRIVAL = "sale_id bigint, d int, held int, due bigint, lines bigint, cents bigint"
CLOSED = "sale_id bigint, first_day bigint, last_day bigint, n_lines bigint, cents bigint, due bigint, status string"
STATE = "sale_id array<bigint>, first_day array<bigint>, last_day array<bigint>, lines array<bigint>, cents array<bigint>, due array<bigint>, held array<bigint>"


def _hash(*parts: Column) -> Column:
    return F.crc32(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _cents(amount: Column) -> Column:
    return F.coalesce(F.floor(100 * amount + 0.5), F.lit(0)).cast("bigint")


def _day(at: Column) -> Column:
    return F.unix_date(F.to_date(at))


def arrivals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """A row per sale_id and day: whether a sale arrived (held, with what is due), and the number and cents of its lines. Rows are
    partitioned by sale_id, a hot one having a row per day by then."""
    h = _hash(F.col("sale_id"), F.col("line_no"))
    day = F.coalesce(_day(F.col("shipped_at")) + h % 8, FIRST_DAY + h % 152).cast("int")
    sent = lines.where("sale_id is not null").distinct().select("sale_id", day.alias("d"), _cents(F.col("amount")).alias("cents"))
    sent = sent.groupBy("sale_id", "d").agg(F.count("*").alias("lines"), F.sum("cents").alias("cents"))
    sold = sales.where("sale_id is not null").select("sale_id", F.coalesce(_day(F.col("arrived_at")), F.lit(FIRST_DAY)).alias("d"), _cents(F.col("total")).alias("total"))
    rows = sent.select("sale_id", "d", F.lit(0).alias("held"), F.lit(0).cast("bigint").alias("total"), "lines", "cents")
    rows = rows.unionByName(sold.select("sale_id", "d", F.lit(1).alias("held"), "total", F.lit(0).cast("bigint").alias("lines"), F.lit(0).cast("bigint").alias("cents")))
    own, kind = Window.partitionBy("sale_id"), _hash(F.col("sale_id")) % 5
    rows = rows.withColumn("last", F.max(F.when(F.col("lines") > 0, F.col("d"))).over(own))
    before = F.coalesce(F.sum(F.when(F.col("d") < F.col("last"), F.col("cents"))).over(own), F.lit(0))
    rows = rows.withColumns({"all": F.sum("cents").over(own), "before": before})
    due = F.when(F.col("held") == 0, 0).when(kind == 0, F.col("total")).when(kind == 1, F.col("before")).otherwise(F.col("all"))
    rows = rows.select("sale_id", "d", "held", due.cast("bigint").alias("due"), "lines", "cents")
    return rows.groupBy("sale_id", "d").agg(F.max("held").alias("held"), F.max("due").alias("due"), F.sum("lines").alias("lines"), F.sum("cents").alias("cents"))


def batch_of(day: Column, batches: int = BATCHES) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - FIRST_DAY) * batches / SPAN))).cast("int")


Assembly = tuple[int, int, int, int, int, int]  # first and last day, lines, cents, due, sales


def joined(open_: dict[int, Assembly], sale_id: int, d: int, held: int, due: int, lines: int, cents: int) -> tuple | None:
    """Add the rows of a sale_id and day to its open assembly, or begin one; the closing, if it is complete then."""
    first, _, n, sum_, asked, sales = open_.get(sale_id, (d, d, 0, 0, 0, 0))
    now = (first, d, n + lines, sum_ + cents, due if held else asked, sales + held)
    if now[5] and now[2] and now[3] == now[4]:
        open_.pop(sale_id, None)
        return (sale_id, *now[:5], "complete")
    open_[sale_id] = now
    return None


def expired(open_: dict[int, Assembly], watermark: int) -> list[tuple]:
    """Take out and close what was first seen OPEN_DAYS before the watermark or earlier."""
    out = []
    for sale_id in [s for s, a in open_.items() if a[0] + OPEN_DAYS <= watermark]:
        first, last, n, cents, due, held = open_.pop(sale_id)
        status = "headless" if not held else "orphan" if not n else "short" if cents < due else "over"
        out.append((sale_id, first, last, n, cents, due if held else None, status))
    return out


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The stateful step of a key: first the new rows day by day, then what is over."""
    open_: dict[int, Assembly] = {s: tuple(a) for s, *a in zip(*state.get, strict=True)} if state.exists else {}
    closed: list[tuple] = []
    if not state.hasTimedOut:
        rows = pd.concat(list(frames)).sort_values("d", kind="stable")
        if key[0] == SENTINEL:
            return
        columns = (rows[c].tolist() for c in ("sale_id", "d", "held", "due", "lines", "cents"))
        closed += [c for row in zip(*columns, strict=True) if (c := joined(open_, *row))]
    closed += expired(open_, state.getCurrentWatermarkMs() // TICK_MS - SHIFT)
    if open_:
        state.update(tuple(map(list, zip(*((s, *a) for s, a in open_.items()), strict=True))))
        state.setTimeoutTimestamp((min(a[0] for a in open_.values()) + OPEN_DAYS + SHIFT) * TICK_MS - 1)
    elif state.exists:
        state.remove()
    if closed:
        out = pd.DataFrame(closed, columns=["sale_id", "first_day", "last_day", "n_lines", "cents", "due", "status"])
        yield out.astype({"due": "Int64"})


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _staged(rows: DataFrame, path: str, batches: int) -> None:
    """Write the batches, and one more; each with a sentinel, the last two's in the far future."""
    spark = rows.sparkSession
    ends = spark.range(batches + 1).select(
        F.lit(None).cast("bigint").alias("sale_id"), F.when(F.col("id") < batches - 1, -SHIFT).otherwise(FAR).cast("int").alias("d"), F.lit(0).alias("held"),
        *(F.lit(0).cast("bigint").alias(c) for c in ("due", "lines", "cents")), F.col("id").cast("int").alias("batch"),
    )
    rows.withColumn("batch", batch_of(F.col("d"), batches)).unionByName(ends).write.partitionBy("batch").parquet(path)


def _start(spark: SparkSession, feed: str, checkpoint: str, out: str, keys: int | None, batches: int) -> None:
    """One start of the stream: everything new in the feed is one micro-batch."""
    rows = spark.readStream.schema(f"{ARRIVAL}, batch int").parquet(feed)
    key = F.col("sale_id") if keys is None else F.pmod(F.xxhash64("sale_id"), F.lit(keys))
    timed = rows.withColumn("at", F.timestamp_seconds((F.col("d").cast("bigint") + SHIFT) * (TICK_MS // 1000))).withWatermark("at", "0 seconds")
    # no row can be late: a batch's days all lie behind those of the batches before, so behind the watermark; sentinels may be
    grouped = timed.select(F.when(F.col("sale_id").isNull(), SENTINEL).otherwise(key).alias("key"), "sale_id", "d", "held", "due", "lines", "cents", "at").groupBy("key")
    closed = grouped.applyInPandasWithState(fold, CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def store(found: DataFrame, batch_id: int) -> None:
        found.withColumn("closing_batch", F.lit(min(batch_id, batches - 1))).write.mode("overwrite").parquet(f"{out}/start={batch_id}")

    closed.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def assemble(sales: DataFrame, lines: DataFrame, batches: int = BATCHES, per_sale: bool = False) -> DataFrame:
    """The closings of all assemblies, as a written table; what was written on the way is deleted."""
    spark = sales.sparkSession
    home = f"{shared_dir(spark)}/assembly-{uuid.uuid4().hex}"
    stage, feed, checkpoint, out = (f"{home}/{name}" for name in ("stage", "feed", "checkpoint", "closed"))
    _staged(arrivals(sales, lines), stage, batches)
    keys = None if per_sale else spark.read.parquet(stage).count() // KEY_ROWS + 1
    with _setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"):
        for batch in range(batches + 1):
            move(spark, f"{stage}/batch={batch}", f"{feed}/batch={batch}")
            _start(spark, feed, checkpoint, out, keys, batches)
    for done in (stage, feed, checkpoint):
        delete(spark, done)
    return spark.read.schema(f"{CLOSED}, closing_batch int").parquet(*(f"{out}/start={b}" for b in range(batches + 1)))
