"""Keep-latest upsert of master tables.

``merge_latest`` is one aggregation over ``master ∪ incoming`` keyed by the
record key: ``max(struct((upload_timestamp, source, order), row))``. Being an
aggregate, it is combined map-side first, so a key with millions of copies
is reduced inside each input partition before anything is shuffled (a
window ``row_number`` would instead sort every copy of a hot key in one
task). Ties are broken totally: later upload, then incoming over master,
then the row order column, so reruns give the same winner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.operators.skew import join_unique
from settlekit.schema import KEY

SRC = "_source"        # 0 = master, 1 = incoming
ORD = "_ord"
INCOMING = 1 << 20     # newer than any age


def _ordering(df: DataFrame, ts_col: str, order_col: str | None, payload: list[str]) -> F.Column:
    """Later upload, then incoming over master, then the row order column;
    without one, the remaining columns decide (a total order on distinct rows).
    ``merge_latest`` orders its rows alike, each column held once."""
    parts = [F.col(ts_col), F.col(SRC)]
    if order_col and order_col in df.columns:
        parts.append(F.col(order_col))
    else:
        parts.append(F.struct(*[F.col(c) for c in payload if c != ts_col]))
    return F.struct(*parts)


def tag_sources(master: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become NULL. A master
    whose rows have a source already (their age) keeps it."""
    aged = SRC in master.columns
    return ((master if aged else master.withColumn(SRC, F.lit(0)))
            .unionByName(incoming.withColumn(SRC, F.lit(INCOMING if aged else 1)), allowMissingColumns=True))


def merge_latest(master: DataFrame, incoming: DataFrame, keys: list[str] | None = None,
                 ts_col: str = "upload_timestamp", order_col: str | None = ORD, dealt: tuple[int, str] | None = None) -> DataFrame:
    """Latest record per key wins (NULL upload time loses). ``dealt``:
    (number, key column) of the partitions that the result shall have; the rows
    move once, to those, but copies of a key meet only there."""
    keys = keys or KEY
    u = tag_sources(master, incoming)
    if dealt:
        u = u.repartition(*dealt)
    payload = [c for c in u.columns if c not in keys and c != SRC]
    ordered = [ts_col, SRC, *([order_col] if order_col and order_col in u.columns else [])]
    # every column once: the map side sorts and the shuffle carries these rows
    row = F.struct(*ordered, *[c for c in payload if c not in ordered])
    return (u.groupBy(*keys).agg(F.max(row).alias("_w"))
             .select(*keys, *[F.col("_w").getField(c).alias(c) for c in payload]))


def duplicate_keys(incoming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every row of a key that occurs more than once in the new file.

    Counting is a partial aggregate; the repeated keys (one row each) are
    matched back with a semi join that salts a hot key."""
    keys = keys or KEY
    dup = (incoming.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*keys))
    msg = F.concat(F.lit("Duplicate key found: "),
                   F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"),
                                                                            F.lit("nan")))
                                      for k in keys]))
    # one (struct) key, so the skew-safe semi join applies to composite keys
    packed = F.struct(*[F.col(k) for k in keys])
    hits = join_unique(incoming.withColumn("_key", packed), dup.select(packed.alias("_key")),
                       "_key", "left_semi")
    return hits.drop("_key").withColumn("message", msg)


def merge_stats(master: DataFrame, incoming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total / valid / new / updated (= merged - master) in one pass,
    plus the true number of inserted and of updated keys."""
    keys = keys or KEY
    per_key = (tag_sources(master.select(*keys), incoming.select(*keys))
               .groupBy(*keys)
               .agg(F.count_if(F.col(SRC) == 0).alias("m"), F.count_if(F.col(SRC) == 1).alias("n")))
    return per_key.agg(
        F.count("*").alias("total_rows"),
        F.count("*").alias("valid_rows"),
        F.sum("n").cast("long").alias("new_records"),
        (F.count("*") - F.sum("m")).cast("long").alias("updated_records"),
        F.count_if((F.col("m") == 0) & (F.col("n") > 0)).alias("inserted_keys"),
        F.count_if((F.col("m") > 0) & (F.col("n") > 0)).alias("updated_keys"),
    )


def remove_duplicates(new: DataFrame, history: DataFrame, id_column: str) -> DataFrame:
    """Drop incoming rows whose id already exists in the history."""
    return join_unique(new, history.select(id_column).distinct(), id_column, "left_anti", null_safe=True)


def merge_latest_bucketed(master: DataFrame, incoming: DataFrame, buckets: int,
                          bucket_key: str = "order_release_id", keys: list[str] | None = None,
                          ts_col: str = "upload_timestamp", order_col: str | None = ORD, dealt: bool = False) -> DataFrame:
    """W1 for a master stored bucketed by ``bucket_key`` into ``buckets``.

    The incoming rows are first reduced to their latest row per full key (a
    partial aggregate, so copies of a hot key meet before the exchange), then
    partitioned like the master's buckets and combined with the master by a
    full outer join on the key — one row per key on each side — whose master
    side is read in place (with spark.sql.requireAllClusterKeysForCoPartition
    off, as the ingest sets it, so that the buckets may serve a join on more
    columns). Rows with a missing key part, which an equi-join
    would not match, are merged apart by ``merge_latest``. Same winner and
    columns as ``merge_latest``. ``dealt``: the incoming rows are partitioned
    first, then reduced (no order of theirs is hot)."""
    keys = keys or KEY
    has_order = bool(order_col) and order_col in incoming.columns
    extra = [c for c in incoming.columns if c not in master.columns and c != order_col]
    cols = [*(c for c in master.columns if not has_order or c != order_col), *extra]

    def aligned(df: DataFrame, other: DataFrame) -> DataFrame:
        kind = lambda c: (other if c not in df.columns else df).schema[c].dataType
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast(kind(c))).alias(c) for c in cols],
                         *([F.col(order_col) if order_col in df.columns else
                            F.lit(None).cast(incoming.schema[order_col].dataType).alias(order_col)] if has_order else []))

    old, new = aligned(master, incoming), aligned(incoming, master)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    apart = merge_latest(old.where(missing), new.where(missing), keys, ts_col, order_col if has_order else None)

    payload = [c for c in cols if c not in keys]

    def packed(df: DataFrame, source: int) -> DataFrame:
        df = df.withColumn(SRC, F.lit(source))
        return df.select(*keys, F.struct(_ordering(df, ts_col, order_col if has_order else None, payload).alias("o"),
                                         F.struct(*[F.col(c) for c in payload]).alias("p")).alias("row"))

    fresh = packed(new.where(~missing), 1)
    latest = ((fresh.repartition(buckets, bucket_key) if dealt else fresh).groupBy(*keys).agg(F.max("row").alias("_i"))
              .repartition(buckets, bucket_key))
    m = packed(old.where(~missing), 0).withColumnRenamed("row", "_m")
    j = m.join(latest, keys, "full_outer")
    take_inc = F.col("_m").isNull() | (F.col("_i").isNotNull() & (F.col("_i.o") > F.col("_m.o")))
    win = F.when(take_inc, F.col("_i.p")).otherwise(F.col("_m.p"))
    merged = j.select(*keys, *[win.getField(c).alias(c) for c in payload])
    return merged.unionByName(apart.select(*merged.columns))
