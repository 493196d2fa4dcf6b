"""What a report says in words and on a page. Tables come as lists of rows of what is shown."""

from __future__ import annotations

import html
import json


def compact(value: float | None) -> str:
    """A number without needless digits; - for none."""
    return "-" if value is None else f"{value:g}"


def signed(value: float | None) -> str:
    return "-" if value is None else f"{value:+g}"


def aligned(head: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
    """Columns as wide as their widest entry."""
    widths = [max(map(len, column)) for column in zip(head, *rows)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(head), line(tuple("-" * w for w in widths)), *map(line, rows)]) + "\n"


def worst_table(rows: list[dict]) -> str:
    """The worst functions: rank, path, name, line, score, cyclomatic, cognitive."""
    if not rows:
        return "no function has a complexity\n"
    place = lambda r: r["path"] if r.get("line") is None else f"{r['path']}:{r['line']}"
    body = [(str(r["rank"]), compact(r["score"]), compact(r["cyclomatic"]), compact(r["cognitive"]), r["name"], place(r)) for r in rows]
    return aligned(("rank", "score", "cyclomatic", "cognitive", "function", "place"), body)


def schema_warnings(old: int | None, new: int | None) -> list[str]:
    """A warning where two snapshots are of different versions; what both have is compared all the same."""
    return [] if old == new else [f"the baseline has version {old}, the snapshot version {new}: only what both have is compared"]


def diff_summary(label: str, files: list[dict], values: list[dict], violations: list[dict], regressions: list[dict], improvements: list[dict], epsilon: float) -> str:
    """What differs from a baseline: files, violations, functions that are worse and better, and files' values."""
    by = {k: sorted(f["path"] for f in files if f["status"] == k) for k in ("added", "removed")}
    changed = [v for v in values if not v.get("name")]
    head = f"compared with {label}"
    if not any((by["added"], by["removed"], values, violations, regressions, improvements)):
        return f"{head}: nothing differs by more than {epsilon:g}\n"
    out = [head, f"files: {len(by['added'])} new, {len(by['removed'])} gone, {len({v['path'] for v in changed})} changed"]
    out += [f"  new {p}" for p in by["added"]] + [f"  gone {p}" for p in by["removed"]]
    for title, kind in (("new violations", "added"), ("violations no more", "removed")):
        mine = [v for v in violations if v["change"] == kind]
        out += [f"{title}: {len(mine)}"] * bool(mine) + [f"  {v['path']}: {v['metric']}" + (f" ({v['name']})" if v.get("name") else "") for v in mine]
    for title, rows in (("worse functions (* with a new violation)", regressions), ("better functions", improvements)):
        out += [f"{title}: {len(rows)}"] * bool(rows) + [f"  {signed(r['delta'])} {r['path']} {r['name']}" + " *" * bool(r.get("newly")) for r in rows]
    if changed:
        out.append("values of files")
        out += [f"  {v['path']} {v['metric']}: {compact(v['old'])} to {compact(v['new'])} ({signed(v['delta'])})" for v in changed]
    return "\n".join(out) + "\n"


_STYLE = "body{font:14px sans-serif;margin:16px}td,th{padding:2px 8px;text-align:left}th{cursor:pointer}#map{position:relative;width:960px;height:480px;background:#eee}#map div{position:absolute;overflow:hidden;font-size:11px;border:1px solid #fff;box-sizing:border-box}"
#: Draws the map of folders by slices, and sorts tables by a click on a heading, rows without a value last.
_SCRIPT = """
const data = JSON.parse(document.getElementById('data').textContent), kids = {}, sum = {};
for (const n of data.treemap) (kids[n.parent] ??= []).push(n);
const size = n => sum[n.id] ??= kids[n.id] ? kids[n.id].reduce((s, k) => s + size(k), 0) : n.value || 0;
const files = Object.fromEntries(data.files.map(f => [f.path, f]));
function draw(n, x, y, w, h, wide) {
  if (w < 2 || h < 2) return;
  const d = document.createElement('div'), bad = files[n.id] ? files[n.id].violations.length : 0;
  d.style.cssText = `left:${x}px;top:${y}px;width:${w}px;height:${h}px;background:${kids[n.id] ? '#dde' : bad ? '#e99' : '#9c9'}`;
  d.title = `${n.id} ${size(n)}`; d.textContent = kids[n.id] ? '' : n.label;
  document.getElementById('map').append(d);
  let at = 0;
  for (const k of (kids[n.id] || []).sort((a, b) => size(b) - size(a))) {
    const part = size(n) ? size(k) / size(n) : 0;
    wide ? draw(k, x + at * w, y, part * w, h, !wide) : draw(k, x, y + at * h, w, part * h, !wide);
    at += part;
  }
}
for (const root of kids[null] || []) draw(root, 0, 0, 960, 480, true);
for (const t of document.querySelectorAll('table')) t.querySelectorAll('th').forEach((th, i) => th.onclick = () => {
  const up = th.dataset.up = th.dataset.up === '1' ? '' : '1', rows = [...t.tBodies[0].rows], cell = r => r.cells[i].textContent;
  const order = (a, b) => isNaN(a) || isNaN(b) ? a.localeCompare(b) : a - b;
  rows.sort((a, b) => (cell(a) === '-') - (cell(b) === '-') || (up ? 1 : -1) * order(cell(a), cell(b))).forEach(r => t.tBodies[0].append(r));
});
"""


def _table(title: str, head: tuple[str, ...], rows: list[tuple]) -> str:
    cells = lambda r, tag: "".join(f"<{tag}>{html.escape(compact(c) if isinstance(c, (int, float)) or c is None else str(c))}</{tag}>" for c in r)
    return f"<h2>{html.escape(title)}</h2><table><thead><tr>{cells(head, 'th')}</tr></thead><tbody>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows) + "</tbody></table>"


def page(snapshot: dict) -> str:
    """A page of its own, without any reference to a network: the map of folders, the worst functions of how many, the
    files, and, where there is a baseline, what is worse and better and which of it is still there."""
    data = json.dumps(snapshot).replace("/", "\\/").replace("<", "\\u003c")
    worst = snapshot.get("worst") or []
    here = {f["path"] for f in snapshot["files"]}
    parts = [_table(f"Worst functions ({len(worst)} of {sum(len(f['functions']) for f in snapshot['files'])})", ("score", "function", "file", "cyclomatic", "cognitive"), [(w["score"], w["name"], w["path"], w["cyclomatic"], w["cognitive"]) for w in worst])]
    diff = snapshot.get("diff") or {}
    for title in ("regressions", "improvements"):
        if diff.get(title):
            rows = diff[title]
            parts.append(_table(f"{title.capitalize()} ({min(50, len(rows))} of {len(rows)})", ("change", "function", "file", "still there"), [(r["delta"], ("! " if r.get("newly") else "") + r["name"], r["path"], "yes" if r["path"] in here else "-") for r in rows[:50]]))
    parts.append(_table("Files", ("file", "functions", "violations"), [(f["path"], len(f["functions"]), len(f["violations"])) for f in snapshot["files"]]))
    out = f"<!doctype html><meta charset=utf-8><title>Metrics</title><style>{_STYLE}</style><div id=map></div>{''.join(parts)}<script type=\"application/json\" id=\"data\">{data}</script><script>{_SCRIPT}</script>"
    if "://" in out:
        raise ValueError("the page refers to a network")
    return out
