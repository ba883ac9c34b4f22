"""Leaderboards, summaries and charts over small aggregates."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.domains import DIFFICULTIES, DOMAINS
from ..sources import records

# The metrics of a run's summary.json.
SUMMARY = ["exact_match_rate", "mean_ned", "required_f1", "hallucination_rate", "schema_valid", "parse_success", "mean_correction_gain"]
#: Samples that a report lists.
LISTED = 50


def leaderboard(runs: DataFrame, metric: str = "exact_match_rate") -> DataFrame:
    """Runs by a metric, best first; runs without one, or with 0, stand last."""
    rank = F.when(F.coalesce(metric, F.lit(0.0)) == 0, F.lit(-1.0)).otherwise(F.col(metric))
    return runs.orderBy(rank.desc(), F.col("run_id"))


def leaderboard_markdown(runs: DataFrame, metrics: list[str]) -> str:
    rows = leaderboard(runs, metrics[0]).collect()
    show = lambda v: "-" if v is None else f"{v:.4f}"
    lines = ["| run | " + " | ".join(metrics) + " |", "|---" * (len(metrics) + 1) + "|"]
    return "\n".join(lines + [f"| {r['run_id']} | " + " | ".join(show(r[m]) for m in metrics) + " |" for r in rows]) + "\n"


def summary_json(summary: DataFrame, run_id: str, model: str, modes: DataFrame | None = None) -> str:
    """The overall means of a summary, with counts of failure modes."""
    rows = summary.where("level = 'overall'").collect()
    out = {"run_id": run_id, "model": model, "n": max((r["n"] for r in rows), default=0), "metrics": {r["metric"]: r["mean"] for r in rows}}
    if modes is not None:
        out["failure_modes"] = {r["mode"]: r["count"] for r in modes.collect()}
    return json.dumps(out, indent=2)


def write_summary(spark: SparkSession, found: DataFrame, path: str, config: dict) -> dict:
    """A run's summary.json: model, backend, split, number of records, time, the SUMMARY metrics' means, and failure modes."""
    means = found.agg(F.count("*").alias("n_records"), *[F.round(F.avg(m), 4).alias(m) for m in SUMMARY]).head()
    modes = {r["mode"]: r["count"] for r in stats.mode_counts(found).collect()}
    out = {
        "model": config.get("model"), "backend": config.get("backend"), "split": (config.get("filters") or {}).get("split"), "n_records": means["n_records"], "timestamp_utc": config.get("timestamp_utc"),
        "metrics": {m: means[m] for m in SUMMARY}, "failure_modes": modes,
    }
    records.write_text(spark, f"{path}/summary.json", json.dumps(out, indent=2))
    return out


def score_class(value: float | None, higher_better: bool = True) -> str:
    """good, fair or poor; none without a value."""
    if value is None:
        return "none"
    if higher_better:
        return "good" if value >= 0.85 else "fair" if value >= 0.65 else "poor"
    return "good" if value <= 0.05 else "fair" if value <= 0.15 else "poor"


def heat_class(value: float) -> str:
    return "hot" if value >= 0.85 else "warm" if value >= 0.70 else "mild" if value >= 0.50 else "cold"


def bars(data: dict[str, float], title: str = "", width: int = 30) -> str:
    """A bar of blocks per value between 0 and 1."""
    wide = max(map(len, data), default=0)
    return "\n".join([title] * bool(title) + [f"{k:<{wide}} {'█' * round(v * width):░<{width}} {v:.3f}" for k, v in data.items()])


def matrix(summary: DataFrame, metric: str, row: str = "domain", column: str = "difficulty") -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for r in summary.where((F.col("level") == f"{row}_x_{column}") & (F.col("metric") == metric)).collect():
        out.setdefault(r[row], {})[r[column]] = r["mean"]
    return out


def heatmap(data: dict[str, dict[str, float]], columns: list[str]) -> str:
    head = " " * 12 + "".join(f"{c:>10}" for c in columns)
    return "\n".join([head] + [f"{k:<12}" + "".join(f"{v[c]:>10.3f}" if c in v else " " * 9 + "-" for c in columns) for k, v in data.items()])


def comparison_text(compared: DataFrame) -> str:
    return "\n".join(f"{r['metric']:<24} {r['ci_a']['mean']:.4f} {r['ci_b']['mean']:.4f} {r['mean_diff']:+.4f} {r['winner']}" for r in compared.orderBy("metric").collect())


def svg_bars(data: dict[str, tuple[float, float, float]], width: int = 480, height: int = 28) -> str:
    """Bars with interval whiskers: value, lower, upper."""
    parts = []
    for i, (name, (v, low, high)) in enumerate(data.items()):
        y = i * height
        x = [120 + round((width - 130) * max(0.0, min(1.0, t))) for t in (v, low, high)]
        parts.append(f'<text x="0" y="{y + 18}">{html.escape(name)}</text><rect x="120" y="{y + 6}" width="{x[0] - 120}" height="{height - 12}"/><line x1="{x[1]}" x2="{x[2]}" y1="{y + height // 2}" y2="{y + height // 2}" stroke="black"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height * len(data)}">{"".join(parts)}</svg>'


def html_report(summary: DataFrame, title: str, columns: list[str], metric: str = "mean_ned") -> str:
    """A page with the overall table and the domain by difficulty table of one metric."""
    rows = summary.where("level = 'overall'").orderBy("metric").collect()
    overall = "".join(f"<tr><td>{html.escape(r['metric'])}</td><td>{r['n']}</td><td>{r['mean']}</td><td>{r['median']}</td><td>{r['p10']}</td><td>{r['p90']}</td></tr>" for r in rows)
    cells = lambda v: "".join(f'<td class="{score_class(v.get(c), False)}">{v.get(c, "-")}</td>' for c in columns)
    grid = "".join(f"<tr><td>{html.escape(k)}</td>{cells(v)}</tr>" for k, v in sorted(matrix(summary, metric).items()))
    head = "".join(f"<th>{c}</th>" for c in columns)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th>metric</th><th>n</th><th>mean</th><th>median</th><th>p10</th><th>p90</th></tr>{overall}</table><h2>{metric}</h2><table><tr><th></th>{head}</tr>{grid}</table></body></html>"


def means_by(summary: DataFrame, level: str, metric: str, order: list[str]) -> dict[str, float]:
    """A metric's means by a column, in the given order; groups without one are left out."""
    found = {r[level]: r["mean"] for r in summary.where((F.col("level") == level) & (F.col("metric") == metric)).collect()}
    return {k: found[k] for k in order if found.get(k) is not None}


def svg_pairs(compared: list[dict], width: int = 480, height: int = 22) -> str:
    """Two bars a metric, one for each run, with interval whiskers."""
    bars_of = {}
    for r in compared:
        for side in "ab":
            ci = r[f"ci_{side}"]
            bars_of[f"{r['metric']} {side}"] = (ci["mean"], ci["lower"], ci["upper"])
    return svg_bars(bars_of, width, height)


def html_heatmap(data: dict[str, dict[str, float]], columns: list[str], title: str, higher_better: bool = False) -> str:
    cell = lambda v: f'<td class="{score_class(v, higher_better)}">{"-" if v is None else f"{v:.3f}"}</td>'
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    rows = "".join(f"<tr><th>{html.escape(k)}</th>{''.join(cell(v.get(c)) for c in columns)}</tr>" for k, v in sorted(data.items()))
    return f"<table><caption>{html.escape(title)}</caption><tr><th></th>{head}</tr>{rows}</table>"


def charts(summary: DataFrame, compared: list[dict] | None = None) -> dict[str, str]:
    """All charts of a summary by domain and difficulty: name to text, SVG or HTML."""
    by_difficulty = means_by(summary, "difficulty", "mean_ned", DIFFICULTIES)
    by_domain = means_by(summary, "domain", "exact_match_rate", list(DOMAINS))
    grid = matrix(summary, "mean_ned")
    plain = lambda data: {k: (v, v, v) for k, v in data.items()}
    out = {
        "text_ned_by_difficulty": bars(by_difficulty, "Mean edit distance by difficulty (less is better)"), "svg_ned_by_difficulty": svg_bars(plain(by_difficulty)),
        "text_exact_by_domain": bars(by_domain, "Exact matches by domain"), "svg_exact_by_domain": svg_bars(plain(by_domain)),
        "text_hallucination_by_difficulty": bars(means_by(summary, "difficulty", "hallucination_rate", DIFFICULTIES), "Hallucination rate by difficulty"),
        "text_heatmap": heatmap(grid, DIFFICULTIES), "html_heatmap": html_heatmap(grid, DIFFICULTIES, "Mean edit distance (less is better)"),
    }
    if compared:
        out["svg_comparison"] = svg_pairs(compared)
    return out


def report(spark: SparkSession, found: DataFrame, path: str, config: dict, compared: DataFrame | None = None, resamples: int = stats.RESAMPLES) -> str:
    """A run's report.html: headline means with intervals, failure modes, domain by difficulty, charts, the comparison with another
    run, and the first LISTED samples by id. What is collected are aggregates by group and that list; returns the page."""
    summary = stats.summarize(found, SUMMARY + ["field_f1"])
    overall = {r["metric"]: r for r in summary.where("level = 'overall'").collect()}
    ci = {r["metric"]: r for r in stats.bootstrap(stats.long_form(found, SUMMARY, ["id"]), "value", ["metric"], resamples=resamples).collect()}
    modes = {r["mode"]: r["count"] for r in stats.mode_counts(found).collect()}
    other = [r.asDict(recursive=True) for r in compared.orderBy("metric").collect()] if compared is not None else None
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else html.escape(str(v))
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    table = lambda head, rows: "<table>" + row(head, "th") + "".join(rows) + "</table>"
    n = found.count()
    sections = [
        ("Scores", table(["metric", "n", "mean", "interval", "median"], [row([m, r["n"], show(r["mean"]), f"{show(ci[m]['lower'])} to {show(ci[m]['upper'])}" if m in ci else "-", show(r["median"])]) for m, r in sorted(overall.items())])),
        ("Failure modes", table(["mode", "records", "share"], [row([html.escape(m), c, f"{100 * c / n:.1f} %"]) for m, c in sorted(modes.items(), key=lambda x: (-x[1], x[0]))])),
    ]
    grids = {m: matrix(summary, m) for m in ("field_f1", "required_f1", "mean_ned", "hallucination_rate")}
    cells = [row([html.escape(d), x, *[show(grids[m].get(d, {}).get(x)) for m in grids]]) for d in sorted(grids["field_f1"]) for x in DIFFICULTIES if x in grids["field_f1"][d]]
    sections.append(("Domain by difficulty", table(["domain", "difficulty", *grids], cells)))
    sections += [(name, f"<pre>{html.escape(text)}</pre>" if name.startswith("text") else text) for name, text in charts(summary, other).items()]
    if other:
        sections.append(("Comparison", table(["metric", "first", "second", "difference", "winner"], [row([r["metric"], show(r["ci_a"]["mean"]), show(r["ci_b"]["mean"]), show(r["mean_diff"]), r["winner"]]) for r in other])))
    listed = found.orderBy("id").limit(LISTED).collect()
    samples = [row([html.escape(r["id"]), r["domain"], r["difficulty"], show(r["field_f1"]), show(r["hallucination_rate"]), "yes" if r["schema_valid"] else "no", r["parse_status"], html.escape(", ".join(r["failure_modes"]) or "-")]) for r in listed]
    sections.append(("Samples", table(["id", "domain", "difficulty", "field F1", "hallucination", "schema", "parsed", "failure modes"], samples)))
    title = f"{config.get('model', 'unknown')}, {(config.get('filters') or {}).get('split') or 'all'}"
    body = "".join(f"<h2>{html.escape(name)}</h2>{text}" for name, text in sections)
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{n} records</p>{body}</body></html>"
    records.write_text(spark, f"{path}/report.html", page)
    return page
