"""Document fingerprints by winnowing, in column expressions only.

A text is cut into words of at most 12 characters (a longer run of characters
gives several). Each run of four words is hashed; of every eight consecutive
hashes the smallest is kept, the rightmost of equals, with its position. Two
texts that share eleven such words in a row share a fingerprint entry.

A hash holds 40 bits above 24 bits of position counted from the right, so that
one comparison of longs finds the minimum and breaks ties (texts beyond 16
million words count positions modulo that number when hashes tie).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.tables import read, without, write_out

GRAM, WINDOW = 4, 8
LOW = 2**24 - 1
RANGE_ROWS = 50_000
OUT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def winnowed(text: str, gram: int = GRAM, window: int = WINDOW) -> str:
    """SQL for the kept hashes of a text column, in the order of their positions."""
    words = rf"regexp_extract_all({text}, '[^ \\t\\n\\x0B\\f\\r]{{1,12}}', 0)"
    hashed = "transform(ws, x -> xxhash64(x))"
    parts = ", ".join(f"get(h, i + {j})" for j in range(gram))
    grams = (
        f"transform(sequence(0, greatest(size(h) - {gram}, 0)), i -> "
        f"(xxhash64({parts}) & {~LOW}L) | ({LOW}L - (cast(i as bigint) & {LOW}L)))"
    )
    least = f"transform(sequence(0, greatest(size(g) - {window}, 0)), i -> array_min(slice(g, i + 1, {window})))"
    body = _let(hashed, "h", _let(grams, "g", f"array_distinct({least})"))
    return _let(words, "ws", f"if(size(ws) = 0, cast(array() as array<bigint>), {body})")


def shown(kept: str) -> str:
    """SQL for a fingerprint as text: hash and position of each entry."""
    return (
        f"array_join(transform({kept}, x -> concat(lpad(hex(shiftrightunsigned(x, 24)), 10, '0'), "
        f"':', cast({LOW}L - (x & {LOW}L) as string))), ' ')"
    )


def likeness(a: str, b: str) -> str:
    """SQL for the share of common hashes in all hashes of two fingerprints; empty ones are alike."""
    left, right = (f"array_distinct(transform({x}, v -> shiftrightunsigned(v, 24)))" for x in (a, b))
    share = _let("size(array_intersect(l, r))", "c", "cast(c as double) / (size(l) + size(r) - c)")
    return _let(left, "l", _let(right, "r", f"if(size(l) + size(r) = 0, 1.0D, {share})"))


def next_keys(keys: DataFrame) -> DataFrame:
    """The following row's ``_k`` as ``_next`` by descending ``doc_id``; the last is followed by the first.

    Rows are range sorted and numbered range by range, so no task sorts them
    all; the first rows of the ranges are few, one in 50,000.
    """
    rows = keys.distinct()
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_k")]
    ranged = write_out(
        rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    )
    firsts = ranged.groupBy("_p").agg(F.min_by("_k", "_i").alias("_first"))
    around = firsts.selectExpr(
        "_p", "coalesce(lead(_first) over (order by _p), first(_first) over (order by _p)) as _beyond"
    )
    return (
        ranged.selectExpr("_k", "n_chars", "_p", "lead(_k) over (partition by _p order by _i) as _follows")
        .join(around, "_p")
        .select("_k", "n_chars", F.coalesce("_follows", "_beyond").alias("_next"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by
    the first as many of the next document by descending ``doc_id`` (all, if it
    has fewer; after the last comes the first). Returns the columns of ``docs``
    but ``text``, and ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``: shares of common
    hashes, 1 for two empty fingerprints.

    A null text counts as empty, and has an empty fingerprint. Null ids come
    last. Rows of one id are ordered by a digest of id and text; a repeated row
    stands once in that order and is returned as often as it comes. A sole
    document follows itself. Input columns with those names give way.
    """
    base = without(docs, *OUT).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = base.withColumn(
        "_k", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text"))
    )
    links = write_out(next_keys(keyed.select("_k", "doc_id", F.length("text").cast("long").alias("n_chars"))))
    # one exchange of the texts, read by both joins
    texts = keyed.select("_k", "text").dropDuplicates(["_k"])
    ahead = (
        texts.withColumnRenamed("_k", "_next").join(links, "_next")
        .selectExpr("_k", "n_chars", "left(text, cast(floor(n_chars / 3) as int)) as _new", f"{winnowed('text')} as _next_kept")
    )
    found = (
        texts.join(ahead, "_k")
        .withColumn("_edited", F.expr("concat(left(text, cast(n_chars - floor(n_chars / 3) as int)), _new)"))
        .withColumn("_kept", F.expr(winnowed("text")))
        .withColumn("_edited_kept", F.expr(winnowed("_edited")))
        .selectExpr(
            "_k", "n_chars", "sha2(_edited, 256) as edited_sha256",
            f"{shown('_kept')} as fingerprint", f"{shown('_edited_kept')} as edited_fingerprint",
            f"{likeness('_kept', '_edited_kept')} as near_edited", f"{likeness('_kept', '_next_kept')} as near_next",
        )
    )
    rest = [c for c in base.columns if c != "text"]
    return keyed.select("_k", *[F.col(f"`{c}`") for c in rest]).join(found, "_k").select(*[F.col(f"`{c}`") for c in rest], *OUT)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how near they are."""
    return fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))
