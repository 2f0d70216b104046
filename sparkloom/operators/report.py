"""Profiles as JSON and HTML."""

from __future__ import annotations

import html
import json
import math

from .profile import DatasetProfile, Finding, Thresholds, run_checks


def number(x: float | None) -> str:
    """Four decimals; very large and very small numbers with an exponent; a dash for none."""
    if x is None or not math.isfinite(x):
        return "—"
    return f"{x:.3e}" if x and (abs(x) >= 1e6 or abs(x) < 1e-4) else f"{x:.4f}"


def to_json(p: DatasetProfile, thresholds: Thresholds | None = None) -> str:
    """The profile with its findings; numbers that JSON has no sign for are null."""

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    findings = [vars(f) for f in run_checks(p, thresholds)]
    return json.dumps(clean({"profile": p.to_dict(), "findings": findings}), ensure_ascii=False, allow_nan=False)


_STYLE = """body{font-family:sans-serif;margin:2em;color:#222}table{border-collapse:collapse}td,th{padding:.25em .6em;border:1px solid #ddd}
.card{display:inline-block;vertical-align:top;border:1px solid #ddd;border-radius:6px;padding:1em;margin:.5em}
.bar{background:#4878a8;height:.8em}.Critical{color:#a00}.Warning{color:#a60}.Info{color:#346}"""


def _size(n: int) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def _grid(p: DatasetProfile, kind: str, title: str) -> str:
    found = [a for a in p.associations if a.kind == kind]
    if not found:
        return ""
    names = list(dict.fromkeys(n for a in found for n in (a.left, a.right)))
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    rows = ""
    for a in names:
        cells = ""
        for b in names:
            v = 1.0 if a == b else p.association(kind, a, b)
            shade = abs(v) if v is not None and math.isfinite(v) else 0.0
            cells += f'<td style="background:rgba(72,120,168,{shade:.2f})">{number(v)}</td>'
        rows += f"<tr><th>{html.escape(a)}</th>{cells}</tr>"
    return f"<h2>{title}</h2><table><tr><th></th>{head}</tr>{rows}</table>"


def _bars(pairs: list[tuple[str, int]]) -> str:
    most = max((n for _, n in pairs), default=0) or 1
    return "<table>" + "".join(f'<tr><td>{html.escape(k)}</td><td>{n}</td><td style="width:120px"><div class="bar" style="width:{100 * n / most:.0f}%"></div></td></tr>' for k, n in pairs) + "</table>"


def _card(c) -> str:
    rows = [("type", c.column_type), ("count", str(c.count)), ("missing", f"{c.missing_count} ({c.missing_fraction:.1%})")]
    bars = ""
    if s := c.numeric:
        rows += [(k, number(getattr(s, k))) for k in ("mean", "std", "min", "q1", "median", "q3", "max", "skewness", "kurtosis")]
        rows.append(("outliers", f"{s.outlier_count} ({s.outlier_fraction:.1%})"))
        bars = _bars([(f"{number(a)} – {number(b)}", n) for a, b, n in zip(s.edges, s.edges[1:], s.counts, strict=False)])
    if k := c.categorical:
        rows += [("unique", str(k.unique)), ("top", f"{k.top} ({k.freq})"), ("imbalance", f"{k.imbalance_ratio:.1%}")]
        bars = _bars(k.top_values)
    table = "".join(f"<tr><td>{html.escape(a)}</td><td>{html.escape(b)}</td></tr>" for a, b in rows)
    return f'<div class="card"><h3>{html.escape(c.name)}</h3><table>{table}</table>{bars}</div>'


def to_html(p: DatasetProfile, title: str = "Data profile", thresholds: Thresholds | None = None) -> str:
    """A page of its own: summary, findings, associations, a card for each column."""
    findings: list[Finding] = run_checks(p, thresholds)
    summary = [("rows", p.n_rows), ("columns", p.n_columns), ("memory", _size(p.memory_bytes)), ("duplicate rows", f"{p.duplicate_rows} ({p.duplicate_fraction:.2%})")]
    cards = "".join(f'<div class="card"><b>{html.escape(k)}</b><br>{html.escape(str(v))}</div>' for k, v in summary)
    issues = "".join(f'<li class="{f.severity}">{html.escape(f.severity)} {html.escape(f.kind)}: {html.escape(f.message)}</li>' for f in findings) or "<li>none</li>"
    binary = [a for a in p.associations if a.kind == "point_biserial"]
    table = "<h2>Point-biserial</h2><table>" + "".join(f"<tr><td>{html.escape(a.left)}</td><td>{html.escape(a.right)}</td><td>{number(a.value)}</td></tr>" for a in binary) + "</table>" if binary else ""
    body = f"<h1>{html.escape(title)}</h1>{cards}<h2>Findings</h2><ul>{issues}</ul>{_grid(p, 'pearson', 'Pearson')}{_grid(p, 'cramers_v', 'Cramér’s V')}{table}<h2>Columns</h2>{''.join(map(_card, p.columns))}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body>{body}</body></html>'
