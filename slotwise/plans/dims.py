"""Looking up fitted values in dimension tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CASE_ROWS = 64
BROADCAST_ROWS = 100_000


def small_rows(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> list | None:
    """The rows of ``dim``, or None if there are more than ``max_rows`` (never fetched)."""
    rows = dim.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def bounded(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """(evaluated rows, True) if ``dim`` is small, else (the untouched lazy ``dim``, False)."""
    rows = small_rows(dim, max_rows)
    if rows is None:
        return dim, False
    return dim.sparkSession.createDataFrame(rows, dim.schema), True


def left_lookup(
    df: DataFrame, dim: DataFrame, on: str | list[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join; broadcast when ``dim`` is small, else a shuffled join (AQE splits hot keys)."""
    rows, fits = bounded(dim, max_rows)
    return df.join(F.broadcast(rows) if fits else rows, on, "left")


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def with_pairs(
    df: DataFrame, pairs: list[tuple], key: str, name: str, default, kind: str
) -> DataFrame:
    """Add ``name``, the value paired with column ``key``, else ``default``.

    A handful of pairs becomes one CASE inside the scan stage, more of them a
    broadcast join; the caller has checked their number.
    """
    pairs = [(known, value) for known, value in pairs if known is not None]
    if not pairs:
        return df.withColumn(name, F.expr(f"CAST({_literal(default)} AS {kind})"))
    if len(pairs) <= CASE_ROWS:
        whens = " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in pairs)
        case = f"CASE `{key}` {whens} ELSE {_literal(default)} END"
        return df.withColumn(name, F.expr(f"CAST({case} AS {kind})"))
    key_kind = df.schema[key].dataType.simpleString()
    table = df.sparkSession.createDataFrame(pairs, f"`{key}` {key_kind}, _value {kind}")
    return _joined(df, F.broadcast(table), key, name, default, kind)


def _joined(df: DataFrame, dim: DataFrame, key: str, name: str, default, kind: str) -> DataFrame:
    found = F.coalesce("_value", F.lit(default).cast(kind))
    return df.join(dim, key, "left").withColumn(name, found).drop("_value")


def with_value(df: DataFrame, dim: DataFrame, key: str, value: str, name: str, default) -> DataFrame:
    """``with_pairs`` from a table with unique ``key``; a shuffled join if it is not small."""
    kind = dim.schema[value].dataType.simpleString()
    pairs = small_rows(dim.select(key, value))
    if pairs is not None:
        return with_pairs(df, [tuple(row) for row in pairs], key, name, default, kind)
    return _joined(df, dim.select(key, F.col(value).alias("_value")), key, name, default, kind)
