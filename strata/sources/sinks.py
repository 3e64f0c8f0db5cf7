"""What the engine writes to files: vectors, datasets, training pairs and dashboards."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import udfs


def build_index(memories: DataFrame, path: str, size: int = 256) -> DataFrame:
    """Vectors (id, embedding) of title, summary and content of all memories, written as Parquet and read again."""
    body = F.concat_ws("\n", "title", "summary", "content")
    memories.select("id", udfs.embedding(body, size).alias("embedding")).write.mode("overwrite").parquet(path)
    return memories.sparkSession.read.parquet(path)


def write_dataset(rows: DataFrame, path: str) -> None:
    """Rows of a dataset as they came, a JSON object a line."""
    rows.write.mode("overwrite").json(path)


def write_pairs(pairs: DataFrame, path: str) -> DataFrame:
    """Training pairs, a JSON object a line; gives the manifest of what was written."""
    pairs.write.mode("overwrite").json(path)
    return manifest(pairs)


def manifest(pairs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: files scanned, chunks, pairs, and positive and negative ones."""
    high = F.col("label") > 0.5
    counted = pairs.agg(F.count_if(high).alias("chunksCollected"), F.count("*").alias("pairsWritten"), F.count_if(high).alias("positivePairs"), F.count_if(~high).alias("negativePairs"))
    scanned = files.select(F.count_distinct("path").alias("filesScanned")) if files is not None else None
    return scanned.crossJoin(counted) if scanned is not None else counted  # one row each


def moment(ms: int | None) -> str:
    if not ms or ms <= 0:
        return "-"
    at = datetime.fromtimestamp(ms / 1000, timezone.utc)
    return at.strftime("%Y-%m-%d %H:%M:%S") + (f".{ms % 1000:03d}" if ms % 1000 else "") + "Z"


def table(heads: list[str], rows: list[list[str]]) -> list[str]:
    """Padded columns under their heads."""
    widths = [max(map(len, column)) for column in zip(heads, *rows, strict=True)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True))
    return [line(heads), "-+-".join("-" * w for w in widths), *map(line, rows)]


def trend_lines(title: str, trend: list[Row], most: int) -> list[str]:
    """A trend, oldest first: its window, what changed, and its latest points."""
    if not trend:
        return [title, "  (no snapshots)"]
    a, b = trend[0], trend[-1]
    moved = lambda x: f"{x:+.2f}" if x > 0 else f"{x:.2f}"
    anomalies = b["integrityAnomalyTotal"] - a["integrityAnomalyTotal"]
    rows = [[moment(r["createdAt"]), f"{r['totalRows']:,}", f"{r['compactionRate'] * 100:.2f}%", f"{r['savedPercent']:.2f}%", f"{r['integrityAnomalyTotal']:,}"] for r in trend[-most:]]
    return [
        title, f"  window: {moment(a['createdAt'])} -> {moment(b['createdAt'])} ({len(trend)} points)",
        f"  delta: saved={moved(b['savedPercent'] - a['savedPercent'])}pp compaction={moved((b['compactionRate'] - a['compactionRate']) * 100)}pp anomalies={anomalies:+d}",
        *("  " + x for x in table(["timestamp", "rows", "compaction", "saved", "anomalies"], rows)),
    ]


def dashboard_text(parts: dict[str, DataFrame], now: int, scope: str | None = None, days: int = 30, projects: int = 12, points: int = 8, persisted: bool = True) -> str:
    """A dashboard (``records.dashboard``) as text; its tables are a row, a row per shown project and the points of a trend."""
    current, totals = parts["current"].first(), parts["totals"].first()
    c = current.asDict() if current else dict.fromkeys(parts["current"].columns, 0) | {"averageCompressionRatio": 1.0}  # no rows at all
    trend = parts["trend"].collect()
    of = lambda scoped: [r for r in trend if r["projectId"] == scoped]
    n = lambda x: f"{x:,}"
    percent = lambda x: f"{x:.2f}%"
    shown = [[str(i), r["projectId"], r["risk"].upper(), n(r["totalRows"]), percent(r["compactionRate"] * 100), percent(r["savedPercent"]), n(r["anomalies"]), moment(r["lastAccessedAt"])] for i, r in enumerate(parts["perProject"].limit(projects).collect(), 1)]
    per_project = ["  " + x for x in table(["#", "project", "risk", "rows", "compaction", "saved", "anomalies", "lastAccess"], shown)] if shown else ["  (no project rows)"]
    lines: Iterable[str] = [
        "COMPACTION DASHBOARD", "=" * 32, f"generated: {moment(now)}", f"scope: {scope or 'all projects'}", f"lookback: {days} days", f"persistSnapshot: {'enabled' if persisted else 'disabled'}", "",
        "Current totals", f"  rows: total={n(c['totalRows'])} compacted={n(c['compactedRows'])} plain={n(c['plainRows'])} ({percent(c['compactionRate'] * 100)} compacted)",
        f"  chars: original={n(c['originalChars'])} stored={n(c['storedChars'])} saved={n(c['savedChars'])} ({percent(c['savedPercent'])})", f"  compression: avgRatio={c['averageCompressionRatio']:.4f} (stored/original)",
        f"  integrity: total={n(c['anomalies'])} invalidChecksum={n(c['invalidChecksum'])} decodeError={n(c['decodeError'])}", "",
        f"Portfolio totals: projects={n(totals['projectCount'])} anomalies={n(totals['projectsWithAnomalies'])} mostlyCompacted={n(totals['projectsMostlyCompacted'])}", "",
        *trend_lines("Global trend", of(None), points), "", *trend_lines(f"Scoped trend ({scope})" if scope else "Scoped trend", of(scope) if scope else [], points), "", "Per-project breakdown", *per_project,
    ]
    return "\n".join(lines)


def prometheus(name: str, kind: str, what: str, rows: DataFrame, labels: list[str], value: str) -> str:
    """A metric as text for a scraper: a line for each of its few label sets."""
    escaped = lambda x: str(x).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    told = lambda x: str(int(x)) if float(x).is_integer() else repr(float(x))
    lines = [f"# HELP {name} {what}", f"# TYPE {name} {kind}"]
    for r in (rows.orderBy(*labels) if labels else rows).collect():
        at = ",".join(f'{n}="{escaped(r[n])}"' for n in labels)
        lines.append(f"{name}{{{at}}} {told(r[value])}" if at else f"{name} {told(r[value])}")
    return "\n".join(lines) + "\n"
