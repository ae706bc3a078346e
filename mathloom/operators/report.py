"""Reports of evaluation runs: tables and failures as JSON and Markdown, and merging a run with an earlier report."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.operators import evaluate as E

#: Groups of a table and failures of a kind that a report shows; counts always cover all rows.
MOST_GROUPS, MOST_FAILURES = 200, 15
_RATES = {"hit_rate": "hit@3", "first_rate": "first", "gold_original_rate": "marked original", "extra_original_rate": "others marked", "empty_rate": "empty"}


def grouped(log: DataFrame, keys: list[str]) -> dict[str, dict[str, dict]]:
    """key -> value -> summary; sources in their fixed order, others by name. Keys are labels of few values; of more
    than MOST_GROUPS the largest are shown."""
    by = E.summary_by(log, keys)
    rows = by.orderBy("key", F.desc("samples"), "value").limit(MOST_GROUPS * len(keys)).collect()
    rank = {s: i for i, s in enumerate(E.SOURCE_ORDER)}
    out: dict = {k: {} for k in keys}
    for r in sorted(rows, key=lambda r: (r["key"], rank.get(r["value"], len(rank)), r["value"])):
        out[r["key"]][r["value"]] = {k: v for k, v in r.asDict().items() if k not in ("key", "value")}
    return out


def failure_samples(log: DataFrame, limit: int = 30) -> dict[str, dict]:
    """kind -> {n, rows}: how many rows failed in that way and the first of them with their text and best results;
    kinds without any are there with 0."""
    brief = log.select("row_id", "id", "source", F.left("query_text", F.lit(120)).alias("query_text"), "error", F.slice("results", 1, 3).alias("results"))
    found = E.failures(log, limit).select("sample", "n", "rank", "row_id").join(brief, "row_id").orderBy("sample", "rank").collect()  # at most limit rows a kind
    out = {k: {"n": 0, "rows": []} for k in ("miss", "not_first", "hit_not_marked_original", "extra_original")}
    for r in found:
        out[r["sample"]]["n"] = r["n"]
        out[r["sample"]]["rows"].append({k: r[k] for k in ("id", "source", "query_text", "error")} | {"results": [x.asDict() for x in r["results"] or []]})
    return out


def section(log: DataFrame) -> dict:
    """All numbers of one phase."""
    return {"all": E.summary(log).first().asDict(), "by": grouped(log, ["source", "kind"]), "failures": failure_samples(log)}


def table(title: str, groups: dict[str, dict]) -> str:
    head = ["group", "samples", *_RATES.values(), "mean returned", "mean seconds"]
    lines = [f"### {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for name, g in groups.items():
        cells = [name, str(g["samples"]), *(f"{100 * g[r]:.1f}%" for r in _RATES), f"{g['avg_returned']:.2f}", f"{g['avg_elapsed_s']:.2f}"]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join([*lines, ""])


def failure_list(title: str, failures: dict[str, dict]) -> str:
    lines = [f"### {title}", "", ", ".join(f"{k.replace('_', ' ')}: {f['n']}" for k, f in failures.items()), ""]
    for kind, f in failures.items():
        for row in f["rows"][:MOST_FAILURES]:
            best = ", ".join(f"{x['id']}:{x['relation']}/{x['final'] or 0:.3f}" for x in row["results"]) or "nothing"
            lines += [f"- {kind}: `{row['id']}` ({row['source']}) {' '.join((row['query_text'] or '').split())}{' error: ' + row['error'] if row['error'] else ''}", f"  - {best}"]
    return "\n".join([*lines, ""])


def load_report(folder: str) -> dict | None:
    """An earlier report; None where there is none or it is damaged."""
    try:
        found = json.loads((Path(folder) / "report.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def write_report(log: DataFrame, folder: str, sources: list[str] | None = None) -> dict:
    """Write report.json and report.md of a log (columns of the evaluation log) and return the report. With
    ``sources`` only these were run again: the others keep the numbers of the earlier report in the folder, and the
    totals are combined from all sources. Driver files of a bounded size."""
    old = load_report(folder) if sources else None
    phases = [r[0] for r in log.where("phase is not null").select("phase").distinct().orderBy("phase").limit(MOST_GROUPS).collect()]
    report = {p: section(log.where(F.col("phase") == p)) for p in phases}
    for phase, before in (old or {}).items():
        kept = {s: g for s, g in before["by"]["source"].items() if s not in sources}
        if phase not in report:
            report[phase] = before
        elif kept:
            by = report[phase]["by"]["source"]
            report[phase]["by"]["source"] = {**kept, **by}
            parts = log.sparkSession.createDataFrame([{k: float(v) if k.startswith("avg") or k.endswith("rate") else int(v) for k, v in g.items()} for g in {**kept, **by}.values()])
            report[phase]["all"] = E.combined(parts).first().asDict()
    lines = ["# Evaluation", ""]
    for phase, s in report.items():
        lines += [table(f"{phase}: all", {"all": s["all"]}), *(table(f"{phase}: by {k}", g) for k, g in s["by"].items()), failure_list(f"{phase}: failures", s["failures"])]
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "report.json").write_text(json.dumps(report, ensure_ascii=False, indent=1), encoding="utf-8")
    (Path(folder) / "report.md").write_text("\n".join(lines), encoding="utf-8")
    return report
