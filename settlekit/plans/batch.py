"""The batch run: land -> cleanse -> upsert masters -> analyse -> report.

Every stage boundary is a written table in the warehouse folder (a new
master version per entity, a new analysis version), so a lost executor
never forces recomputation from the landing files, and later stages read
compact Parquet instead of the CSV lineage. Actions happen only at the
sinks; the driver sees the file listing and one-row summaries only.

Layout under ``warehouse``::

    masters/<entity>/v=.../          + masters/<entity>/_CURRENT
    analysis/v=.../settlement_month=/ + analysis/_CURRENT
    runs/<stamp>/anomalies, report, issues, stats
"""

from __future__ import annotations

import datetime as _dt
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit import masters
from settlekit import schema as S
from settlekit import sinks
from settlekit.operators import anomaly as AN
from settlekit.operators import cleanse as CL
from settlekit.operators import merge as MG
from settlekit.operators import metrics as M
from settlekit.operators import track as T
from settlekit.operators.analyze import analyze
from settlekit.plans import reports as RP
from settlekit.operators.skew import HOT_KEY_ROWS, hot_keys
from settlekit.session import LANDED_PARTITION_BYTES, landed_bytes, settings, sized_ingest, without_old_shuffles
from settlekit.sources import csv as CSV

ENTITY_ORDER = ("orders", "returns", "settlement")

#: Landed text for one bucket, about.
TARGET_PARTITION_BYTES = LANDED_PARTITION_BYTES
#: Landed text from which the entities are ingested one after the other: each
#: keeps the cores busy then, and only one has its working tables on disk.
SIDE_BY_SIDE_BYTES = 1024 * 1024 * 1024
#: Called with an entity's issues and statistics while their tables still stand.
Report = Callable[[str, list[DataFrame], list[DataFrame]], None]


@dataclass
class BatchResult:
    analysis: DataFrame
    summary: DataFrame
    paths: dict[str, str] = field(default_factory=dict)


def _master(spark: SparkSession, warehouse: str, entity: str) -> DataFrame | None:
    path = sinks.current_master(spark, f"{warehouse}/masters", entity)
    return sinks.read_version(spark, path) if path else None


def _typed_empty(spark: SparkSession, entity: str) -> DataFrame:
    return spark.createDataFrame([], S.struct_type(entity))


@dataclass
class Extract:
    """One landed extract: its rank among the entity's (name order, as landed;
    a later one wins a tie on upload time) and the files to read."""
    rank: int
    name: str
    path: str
    files: list[str]


def _problem(spark: SparkSession, entity: str, name: str, error: Exception) -> DataFrame:
    """Issue row for an extract that could not be read: it fails alone."""
    text = (str(error).strip().splitlines() or [type(error).__name__])[0][:500]
    return spark.createDataFrame([(entity, "error", None, "file", f"Error processing file {name}: {text}", name)],
                                 "file_type string, severity string, row_index long, column string, message string, value string")


def _stage(spark: SparkSession, staging: str, entity: str, group: int, header: tuple[str, list[str]],
           extracts: list[Extract], run_ts: _dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parse and cleanse all extracts of one header in one scan, through a raw
    and a clean staging table; returns (rows, issues, stats)."""
    raw, names = CSV.scan_raw(spark, [f for e in extracts for f in e.files], header=header,
                              staging=f"{staging}/records/{entity}/{group:05d}")
    raw_path = f"{staging}/raw/{entity}/{group:05d}"
    raw.write.parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    rows, bad = CSV.split_raw(raw, names)
    result = CL.clean(rows, entity, "default", run_ts)
    # Row order for ties on (key, upload time): the later extract wins; within
    # one extract the content decides, in the schema's order (not the file
    # layout): the merge compares the columns after this one.
    ranks = F.broadcast(spark.createDataFrame([(e.path, e.rank) for e in extracts], "_extract string, _rank int"))
    clean_path = f"{staging}/clean/{entity}/{group:05d}"
    (result.df.withColumn("_extract", CSV.extract_path(F.col("_source_file"))).join(ranks, "_extract", "left")
     .withColumn("_ord", F.struct(F.col("_rank").alias("extract")))
     .drop("_source_file", "_extract", "_rank").write.parquet(clean_path))
    staged = spark.read.parquet(clean_path)
    issues, stats = CL.summarize(staged.drop("_ord"), entity, result.column_issues)
    issues = issues.unionByName(CL.cell_issues(rows, entity, "default", run_ts).drop("_source_file"))
    for lines in (bad, CSV.short_lines(raw, names), CSV.stray_quotes(raw, names)):
        issues = issues.unionByName(lines.select(
            F.lit(entity).alias("file_type"), F.lit("warning").alias("severity"),
            F.lit(None).cast("long").alias("row_index"), F.lit("line").alias("column"), "message", "value"))
    return staged, issues, stats


def _ingest_entity(spark: SparkSession, warehouse: str, staging: str, entity: str, extracts: list[Extract],
                   run_ts: _dt.datetime, buckets: int | None, commit: str | None = None):
    headers: dict[tuple, list[Extract]] = {}
    cleaned, issues, stats = [], [], []
    for e in extracts:
        try:
            sep, names = CSV.sniff(spark, e.files[0])
            if not names:
                raise ValueError("the file is empty")
            headers.setdefault((sep, tuple(names)), []).append(e)
        except Exception as error:  # noqa: BLE001 - one bad file fails alone, and is reported
            issues.append(_problem(spark, entity, e.name, error))
    work = [((sep, list(names)), group) for (sep, names), group in headers.items()]
    n = 0
    while work:
        header, group = work.pop(0)
        try:
            staged, part_issues, part_stats = _stage(spark, staging, entity, n, header, group, run_ts)
            cleaned.append(staged)
            issues.append(part_issues)
            stats.append(part_stats)
        except Exception as error:  # noqa: BLE001 - look for the bad file, go on with the others
            if len(group) == 1:
                issues.append(_problem(spark, entity, group[0].name, error))
            else:
                half = len(group) // 2   # so one bad file of n costs log n jobs, not n
                work += [(header, group[:half]), (header, group[half:])]
        n += 1
    if cleaned:
        root = f"{warehouse}/masters"
        current = sinks.current_master(spark, root, entity)
        incoming = cleaned[0]
        for part in cleaned[1:]:
            incoming = incoming.unionByName(part, allowMissingColumns=True)
        if commit and not buckets or masters.read_manifest(spark, current):
            # a micro-batch, or a master kept so: only the buckets that it touches are written
            masters.upsert(incoming, root, entity, masters.sized_buckets(spark, [f for e in extracts for f in e.files]), commit=commit,
                           empty=_typed_empty(spark, entity))
            return issues, stats
        # without a hot order the rows go to their buckets at once, else the copies of its keys meet first
        dealt = bool(buckets) and hot_keys(incoming, "order_release_id", HOT_KEY_ROWS).isEmpty()
        master = sinks.read_version(spark, current) if current else None
        if master is not None and buckets and sinks.bucket_spec(spark, current) == (buckets, "order_release_id"):
            # the master is read in place; only the incoming rows are shuffled
            merged = MG.merge_latest_bucketed(master, incoming, buckets, dealt=dealt)
        else:
            base = master if master is not None else _typed_empty(spark, entity)
            merged = MG.merge_latest(base, incoming, dealt=(buckets, "order_release_id") if dealt else None).drop("_ord")
        sinks.write_master(merged, root, entity, buckets, commit=commit)
    return issues, stats


def ingest_extracts(spark: SparkSession, found: list[tuple[str, str, str, list[str]]], warehouse: str,
                    run_ts: _dt.datetime, buckets: int | None = None, commit: str | None = None,
                    report: Report | None = None) -> dict[str, DataFrame]:
    """Ingest (entity, name, path, files) extracts; the entities are
    independent (separate masters), so the jobs of small ones run side by side.
    Returns issues and statistics (empty when nothing was found). With
    ``report`` they are handed to it entity by entity, and the entity's staging
    tables, which they read, are removed after it."""
    # per attempt; a lost executor recomputes from these tables, no CSV is parsed twice
    staging = f"{warehouse}/staging/{run_ts:%Y%m%d_%H%M%S}-{time.time_ns():020d}"
    work: dict[str, list[Extract]] = {}
    for entity, name, path, files in sorted(found, key=lambda x: (x[0], x[1], x[2])):
        group = work.setdefault(entity, [])
        group.append(Extract(len(group), name, path, files))
    if commit:   # a replayed micro-batch: masters that have it already stay
        work = {e: x for e, x in work.items() if not sinks.committed(spark, f"{warehouse}/masters", e, commit)}
    if not work:
        return {}
    # a join on (order_release_id, order_line_id) may use a master's buckets on
    # order_release_id alone; all joins of this block run before it ends
    nbytes = landed_bytes(spark, *[f for group in work.values() for e in group for f in e.files])

    def one(entity: str) -> tuple[list[DataFrame], list[DataFrame]]:
        own = f"{staging}/{entity}"
        result = _ingest_entity(spark, warehouse, own, entity, work[entity], run_ts, buckets, commit)
        if report:
            report(entity, *result)
            sinks.remove(spark, own)
        return result

    with (settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}), without_old_shuffles(spark),
          ThreadPoolExecutor(max_workers=len(work) if nbytes < SIDE_BY_SIDE_BYTES else 1) as pool):
        futures = [pool.submit(one, e) for e in ENTITY_ORDER if e in work]
        results = [f.result() for f in futures]
    if report:
        sinks.remove(spark, staging)
        return {}
    issues = [i for part, _ in results for i in part]
    stats = [s for _, part in results for s in part]
    out = {"staging": staging, "issues": _union(issues)}
    if stats:
        out["stats"] = _union(stats)
    return out


def ingest(spark: SparkSession, landing: str, warehouse: str, run_ts: _dt.datetime,
           buckets: int | None = None, report: Report | None = None) -> dict[str, DataFrame]:
    """Route the landed extracts, cleanse them and upsert each master once.

    Extracts of one header are parsed in one distributed scan. The extract's
    rank leads the row order; within an extract the row content breaks a tie,
    so the result does not depend on how the files were split. An extract that
    can't be read is reported as an issue and the others go on."""
    listing = CSV.list_landing(spark, landing).where(F.col("file_type").isNotNull())
    # File metadata only (one row per landed extract), bounded by the number
    # of files, so it may come to the driver.
    found = [(r.file_type, r.extract, r.path, [r.path]) for r in listing.select("file_type", "extract", "path").collect()]
    return ingest_extracts(spark, found, warehouse, run_ts, buckets, report=report)


_FINDINGS = threading.Lock()


def write_findings(issues: list[DataFrame], stats: list[DataFrame], issues_path: str, stats_path: str) -> dict[str, str]:
    """Add an entity's issues and statistics to those of a run; what was
    written. One at a time: a committed job clears its output folder's
    temporary files, those of a job beside it too."""
    out = {}
    with _FINDINGS:
        if issues:
            sinks.write_issues_json(_union(issues), issues_path, "append")
            out["issues"] = issues_path
        if stats:
            _union(stats).write.mode("append").json(stats_path)
            out["stats"] = stats_path
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def analyse(spark: SparkSession, warehouse: str,
            run_ts: _dt.datetime) -> tuple[DataFrame, DataFrame | None]:
    """Analyse the current masters against the previous analysis and write
    the result as a new analysis version (partitioned by month)."""
    orders = _master(spark, warehouse, "orders")
    if orders is None:
        raise ValueError("no orders master: nothing to analyse")
    returns = _master(spark, warehouse, "returns") or _typed_empty(spark, "returns")
    settlements = _master(spark, warehouse, "settlement") or _typed_empty(spark, "settlement")
    prev_path = sinks.current_master(spark, warehouse, "analysis")
    previous = spark.read.parquet(prev_path) if prev_path else None
    current = sinks.current_master(spark, f"{warehouse}/masters", "orders")
    counts = masters.heavy_orders(spark, current)
    spec = sinks.bucket_spec(spark, current)
    # a new folder per write (never the one read as the previous analysis)
    version = f"{warehouse}/analysis/v={time.time_ns():020d}"
    # masters in buckets are joined bucket by bucket; what has none is shuffled into as many
    with settings(spark, {"spark.sql.shuffle.partitions": str(spec[0])} if spec else {}):
        a = analyze(orders, returns, settlements, previous, run_ts, order_col=None, order_counts=counts, apart=spec is not None)
        sinks.write_analysis(a, version)
    sinks._write_text_file(spark, f"{warehouse}/analysis/{sinks.POINTER}", version)
    return spark.read.parquet(version), previous


def _sized_buckets(spark: SparkSession, warehouse: str, buckets: int, nbytes: int) -> int:
    """``buckets``, or so many times as many that one holds about
    ``TARGET_PARTITION_BYTES``; those of the orders master while they do."""
    wanted = buckets * max(1, -(-nbytes // (buckets * TARGET_PARTITION_BYTES)))
    current = sinks.current_master(spark, f"{warehouse}/masters", "orders")
    spec = sinks.bucket_spec(spark, current) if current else None
    return spec[0] if spec and buckets <= spec[0] and wanted <= 2 * spec[0] else wanted


def run_batch(spark: SparkSession, landing: str, warehouse: str,
              run_ts: _dt.datetime | None = None, buckets: int | None = None,
              size_partitions: bool = False) -> BatchResult:
    """The whole run. ``buckets``: write the masters bucketed by order key so
    the analysis join reads the orders master without shuffling it.
    ``size_partitions``: raise the shuffle partition count to the size of the
    landed files plus the masters (file-system metadata) / 64 MB, and the
    buckets alike, since one task sorts and writes a bucket; masters keep the
    buckets they have until these hold twice as much."""
    run_ts = run_ts or _dt.datetime.now()
    if size_partitions:
        nbytes = landed_bytes(spark, landing, f"{warehouse}/masters")
        if buckets:
            buckets = _sized_buckets(spark, warehouse, buckets, nbytes)
        with sized_ingest(spark, nbytes):
            return run_batch(spark, landing, warehouse, run_ts, buckets)
    stamp = f"{run_ts:%Y%m%d_%H%M%S}"
    run_dir = f"{warehouse}/runs/{stamp}"
    for kind in ("issues", "stats"):   # a rerun of the same run replaces them
        sinks.remove(spark, f"{run_dir}/{kind}")
    paths: dict[str, str] = {}

    def tell(entity, issues, stats):
        paths.update(write_findings(issues, stats, f"{run_dir}/issues", f"{run_dir}/stats"))

    # K6: the state before this run (versions are never changed, so naming them is a copy)
    snapshot = sinks.snapshot_versions(spark, f"{warehouse}/masters", ENTITY_ORDER, f"{warehouse}/snapshots", run_ts)
    ingest(spark, landing, warehouse, run_ts, buckets, tell)
    a, previous = analyse(spark, warehouse, run_ts)
    month = run_ts.strftime("%Y-%m")
    np_ = T.new_pending(a, previous, month)
    rs = T.newly_resolved(a, previous, month)
    paths |= {"analysis": sinks.current_master(spark, warehouse, "analysis"),
              "report": f"{run_dir}/report", "report_latest": f"{warehouse}/reports/latest", "snapshot": snapshot}

    def anomalies():
        if sinks.write_anomalies(AN.anomalies(a), f"{run_dir}/anomalies"):
            paths["anomalies"] = f"{run_dir}/anomalies"

    def report():
        sinks.write_report(RP.recon_report(a, np_, rs, month), paths["report"])
        # K4: the same report once more as "latest" (copied from the written text)
        spark.read.text(paths["report"]).coalesce(1).write.mode("overwrite").text(paths["report_latest"])

    # independent sinks of the written analysis: submitted as concurrent jobs
    with ThreadPoolExecutor(max_workers=4) as pool:
        for f in [pool.submit(fn) for fn in (anomalies, report)]:
            f.result()
    return BatchResult(a, M.run_summary(a), paths)
