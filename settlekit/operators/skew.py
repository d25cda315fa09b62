"""Joining a possibly skewed table to a one-row-per-key table.

``orders`` may hold a third of all its rows under one order key. A plain
sort-merge join sends all of them to one task, and AQE's skew-join split
does not apply when the other side is an aggregate (its rule needs two bare
shuffle stages). So hot keys are salted explicitly and selectively:

1. ``hot_keys``: keys with at least ``min_rows`` rows, found without
   shuffling the key column (rows counted by a hash of the key, exact count
   of the keys with a hot hash). There are at most ``rows / min_rows`` of them —
   a proven bound, so they may be broadcast.
2. Rows of a hot key get a salt in ``[0, n)`` with ``n = ceil(count /
   min_rows)``, from a hash of the row (deterministic, so a recomputed task
   assigns the same salts); other rows get salt 0.
3. The partner row of a hot key is replicated ``n`` times (one per salt);
   all others once. The join runs on ``(key, salt)``.

When no key is hot (checked by fetching at most one row), the plain join is
used and nothing extra is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key before it is spread over several tasks.
HOT_KEY_ROWS = 1_000_000
SALT, SALTS = "_salt", "_salts"


# Hashes of keys that are counted to find the hot ones.
HASHES = 1 << 14


def hot_keys(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """(key, number of salts) for every key with at least ``min_rows`` rows.

    No shuffle of the key column: rows are counted by ``HASHES`` hashes of the
    key (a hash aggregate on the map side, one pass, one row per hash and task).
    A hot key makes its hash hot, so only the keys of hot hashes are counted
    exactly, and where there is none the list is empty. The time is linear in
    the rows whatever the bound; NULL is a key as any other (a missing order id
    can be the hottest of all)."""
    k = df.select(key)
    schema = f"`{key}` {k.schema[0].dataType.simpleString()}, {SALTS} int"
    hashed = F.pmod(F.xxhash64(key), F.lit(HASHES))
    # at most rows / min_rows hashes
    hot = [r[0] for r in k.groupBy(hashed.alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select("_h").collect()]
    if not hot:
        return df.sparkSession.createDataFrame([], schema)
    wanted = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in hot], "_h long"))
    return (k.withColumn("_h", hashed).join(wanted, "_h", "left_semi").groupBy(key).agg(F.count("*").alias("_n"))
             .where(F.col("_n") >= min_rows)
             .select(key, F.ceil(F.col("_n") / F.lit(min_rows)).cast("int").alias(SALTS)))


def hot_of_counts(df: DataFrame, key: str, counts: dict, min_rows: int) -> DataFrame | None:
    """``hot_keys`` from stored row counts of heavy keys: no job, no scan. None
    when no key is hot."""
    hot = [(k, -(-n // min_rows)) for k, n in counts.items() if n >= min_rows]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {SALTS} int"
    return df.sparkSession.createDataFrame(hot, schema) if hot else None


def join_unique(big: DataFrame, small: DataFrame, key: str, how: str = "left",
                min_rows: int | None = HOT_KEY_ROWS, null_safe: bool = False,
                detect: bool = True, counts: dict | None = None) -> DataFrame:
    """``big <how> JOIN small ON key`` where ``small`` has one row per key.

    ``how``: ``left``, ``left_semi`` or ``left_anti``. ``null_safe`` makes a
    NULL key match a NULL key. ``min_rows=None`` turns salting off. ``counts``:
    rows of every key of ``big`` that may be hot, where these are stored."""
    sk = "_k"
    s = small.withColumnRenamed(key, sk)

    def match(extra=None):
        c = F.col(key).eqNullSafe(F.col(sk)) if null_safe else (F.col(key) == F.col(sk))
        return c if extra is None else c & extra

    def finish(df: DataFrame) -> DataFrame:
        return df.drop(sk) if how == "left" else df

    if counts is not None and min_rows:
        hot = hot_of_counts(big, key, counts, min_rows)
        detect = False
    else:
        hot = hot_keys(big, key, min_rows) if min_rows else None
    if hot is None or (detect and not hot.take(1)):
        return finish(big.join(s, match(), how))
    # the hot list is matched NULL-safely, so rows of a hot NULL key are
    # spread too (whether NULL matches in the join itself is ``null_safe``)
    hb = F.broadcast(hot.withColumnRenamed(key, "_hk"))
    # by place, not content: identical rows of a hot key must spread too
    place = F.monotonically_increasing_id()
    b = (big.join(hb, F.col(key).eqNullSafe(F.col("_hk")), "left")
            .withColumn(SALT, F.when(F.col(SALTS).isNull(), F.lit(0))
                        .otherwise(F.pmod(place, F.col(SALTS).cast("long")).cast("int")))
            .drop(SALTS, "_hk"))
    s2 = (s.join(hb, F.col(sk).eqNullSafe(F.col("_hk")), "left")
           .withColumn("_salt_s", F.explode(F.when(F.col(SALTS).isNull(), F.array(F.lit(0)))
                                            .otherwise(F.sequence(F.lit(0), F.col(SALTS) - 1))))
           .drop(SALTS, "_hk"))
    out = b.join(s2, match(F.col(SALT) == F.col("_salt_s")), how)
    return finish(out.drop(SALT, "_salt_s"))


def left_join_unique(big: DataFrame, small: DataFrame, key: str, min_rows: int | None = HOT_KEY_ROWS,
                     detect: bool = True, counts: dict | None = None) -> DataFrame:
    """``big LEFT JOIN small USING key`` where ``small`` has one row per key."""
    return join_unique(big, small, key, "left", min_rows, detect=detect, counts=counts)
