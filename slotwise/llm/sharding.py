"""Shards as runs of a Hilbert curve over several metadata columns.

Each column is cut into cells of about equal numbers of rows, in the order of
its values; the cells of a row are a point, and its place on a Hilbert curve
through all points is the row's key. Rows are range sorted by that key and the
curve is cut into shards, so that a shard, and each file of it, covers a small
box in every one of the columns and readers skip files by their statistics.

Column expressions and DataFrame operations only. Only narrow rows are sorted;
texts are shuffled once, when a row meets its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from slotwise.llm.tables import numbered, read, shares, without, write_out

SHARDS = 8
BITS = 4
DIMENSIONS = ("lang", "source", "size")
RANGE_ROWS = 500_000
OUT = ("size", "shard", "slot")


def in_ranges(rows: DataFrame, order: list, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Written rows in ranges of at most about ``range_rows``: ``_p`` numbers the range, ``_i`` rises within it."""
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shares(rows.count(), range_rows))
    return write_out(
        rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    )


def before(ranged: DataFrame, amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows of earlier ranges and earlier rows of the same one.

    The totals of the ranges are one row per ``RANGE_ROWS`` rows.
    """
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").agg(F.sum(amount).alias("_t")).select(
        "_p", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_offset")
    )
    own = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn(name, F.coalesce(F.sum(amount).over(own), F.lit(0))).join(offsets, "_p")
        .withColumn(name, F.col(name) + F.col("_offset")).drop("_offset")
    )


def cuts(rows: DataFrame, column: str, cells: int, range_rows: int = RANGE_ROWS) -> list:
    """Least value of each cell but the first that is used: at most ``cells - 1`` values.

    A value's cell is the share of rows with a smaller one, in steps of
    ``1 / cells``; a value that many rows hold is never split.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    counts = before(in_ranges(counts, ["v"], range_rows), F.col("k"), "less")
    total = counts.agg(F.sum("k")).first()[0]
    if total is None:
        return []
    starts = counts.groupBy(F.expr(f"less * {cells} div {total}").alias("cell")).agg(F.min("v").alias("v"))
    return [r["v"] for r in starts.orderBy("cell").collect()][1:]


def cell_of(column: str, values: list) -> Column:
    """Number of ``values`` that are not above the column; nulls lie in the first cell."""
    if not values:
        return F.lit(0).cast("long")
    reached = F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v <= F.col(column))
    return F.coalesce(F.size(reached), F.lit(0)).cast("long")


def on_curve(rows: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """Add the place on the Hilbert curve of the point in columns ``axes`` (``bits`` bits each).

    The coordinates are turned and mirrored bit by bit from the top, Gray coded
    and interleaved; one projection per step keeps the expressions short.
    """
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in axes:
            swap = f"(({axes[0]} ^ {axis}) & {low})"
            upper = f"({axis} & {1 << bit}) <> 0"
            steps = {axes[0]: f"if({upper}, {axes[0]} ^ {low}, {axes[0]} ^ {swap})"}
            if axis != axes[0]:
                steps[axis] = f"if({upper}, {axis}, {axis} ^ {swap})"
            rows = rows.withColumns({c: F.expr(e) for c, e in steps.items()})
    for left, axis in zip(axes, axes[1:], strict=False):
        rows = rows.withColumn(axis, F.expr(f"{axis} ^ {left}"))
    turn = " ^ ".join(f"if(({axes[-1]} & {1 << bit}) <> 0, {(1 << bit) - 1}, 0)" for bit in range(bits - 1, 0, -1))
    if turn:
        rows = rows.withColumn("_turn", F.expr(f"cast({turn} as bigint)"))
        rows = rows.withColumns({axis: F.expr(f"{axis} ^ _turn") for axis in axes}).drop("_turn")
    places = [f"shiftleft(shiftright({axis}, {bit}) & 1L, {bit * len(axes) + len(axes) - 1 - i})"
              for bit in range(bits) for i, axis in enumerate(axes)]
    return rows.withColumn(name, F.expr(" | ".join(places)))


def shard_of(ranged: DataFrame, shards: int, law: str) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows in ranges: runs of the order, cut as ``law`` says."""
    placed = before(ranged, F.lit(1).cast("long"), "_rank")
    if law == "rows":
        total = ranged.count()
        big, each = total % shards, total // shards
        return placed.selectExpr(
            "*",
            f"cast(if(_rank < {big * (each + 1)}, _rank div {each + 1}, {big} + (_rank - {big * (each + 1)}) div {max(each, 1)}) as int) as shard",
        ).selectExpr("*", f"_rank - (cast(shard as bigint) * {each} + least(shard, {big})) as slot")
    if law != "bytes":
        raise ValueError(f"unknown law {law!r}")
    total = ranged.agg(F.sum("size")).first()[0] or 1
    # a row lies where its middle byte lies, so a shard is off by half a row at most at each end
    placed = placed.join(before(ranged.select("_p", "_i", "size"), F.col("size"), "_bytes").drop("_p", "size"), "_i")
    placed = placed.withColumn(
        "shard", F.expr(f"cast((cast(2 * _bytes + size as decimal(38,0)) * {shards}) div {2 * total} as int)")
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))


def shard(
    docs: DataFrame, shards: int = SHARDS, law: str = "rows", dimensions: tuple[str, ...] = DIMENSIONS,
    bits: int = BITS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (from 0) and ``slot`` (place in the shard, gapless from 0).

    ``size`` is the bytes of ``text`` (0 for a null) plus 1 and may be one of the
    ``dimensions``; the others are columns of ``docs``. Law ``rows`` cuts the
    curve into runs whose counts differ by one at most, ``bytes`` into runs of
    near equal size. Rows at one place of the curve come by a hash of their
    text, so that equal texts lie together, then by ``doc_id``, nulls last, and
    in any order where all that is equal; a row is never split and a group of
    copies may be.

    A null in a dimension counts as its smallest value. A column that holds one
    value only orders nothing. Repeated rows are placed as often as they come;
    an empty table gives no rows. Input columns with those names give way.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = numbered(without(docs, *OUT, "_row"), "_row")
    keys = ["doc_id"] if "doc_id" in rows.columns else []
    found = [F.col(f"`{c}`").alias(f"_d{i}") if c != "size" else size.alias(f"_d{i}") for i, c in enumerate(dimensions)]
    narrow = write_out(
        rows.select("_row", *keys, *found, size.alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    )
    axes = [f"_x{i}" for i in range(len(dimensions))]
    points = narrow.withColumns(
        {axis: cell_of(f"_d{i}", cuts(narrow, f"_d{i}", 1 << bits, range_rows)) for i, axis in enumerate(axes)}
    )
    order = ["_place", "_text", *[F.col(k).asc_nulls_last() for k in keys], "_row"]
    curve = on_curve(points, axes, bits, "_place").select("_row", *keys, "size", "_text", "_place")
    ranged = in_ranges(curve, order, range_rows).select("_row", "size", "_p", "_i")
    placed = write_out(shard_of(ranged, shards, law).select("_row", "size", "shard", "slot"))
    return rows.join(placed, "_row").drop("_row")


def write_shards(sharded: DataFrame, path: str, file_rows: int = RANGE_ROWS) -> None:
    """Files of each shard below ``shard=N``, each a run of the curve of about ``file_rows`` rows."""
    files = shares(sharded.count(), file_rows)
    (
        sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its shard among eight and its place there."""
    found = shard(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )

