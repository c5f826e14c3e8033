"""Text and JSON reports of an analysis."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame

from ..operators import code_analysis as C


def rows_of(df: DataFrame, limit: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.limit(limit) if limit else df).collect()]


# op: K10
def table(rows: list[dict], columns: list[str] | None = None, widest: int = 50) -> str:
    """Rows as a box; long values lose their beginning. Columns are those of the rows' shape."""
    if not rows:
        return "(none)"
    columns = columns or list(rows[0])
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v)
    cells = [[x if len(x := show(r.get(c))) <= widest else "…" + x[-(widest - 1) :] for c in columns] for r in rows]
    size = [max(len(c), *(len(r[k]) for r in cells)) for k, c in enumerate(columns)]
    line = lambda a, b, c: a + b.join("─" * (n + 2) for n in size) + c
    put = lambda r: "│" + "│".join(f" {x.ljust(n)} " for x, n in zip(r, size, strict=True)) + "│"
    return "\n".join([line("┌", "┬", "┐"), put(columns), line("├", "┼", "┤"), *map(put, cells), line("└", "┴", "┘")])


# op: K9
def summary(result) -> str:
    s = rows_of(result.stats)[0]
    return " | ".join(f"{name}: {s[key]}" for name, key in (("Files", "total_files"), ("Edges", "total_edges"), ("Cycles", "cycles"), ("Violations", "confirmed_violations"), ("Orphans", "orphan_nodes")))


# op: K2
def as_json(result) -> str:
    parts = {name: rows_of(df) for name, df in result.tables().items()}
    return json.dumps({"project": result.project, "timestamp": result.timestamp, **parts}, indent=2, default=str, ensure_ascii=False)


# The lines of the summary, the columns of files, and the headings of advice by its type.
SUMMARY = (
    ("Files", "total_files"), ("Edges", "total_edges"), ("Violations", "confirmed_violations"), ("False pos.", "false_positives"), ("Orphans", "orphan_nodes"), ("Complex", "complex_files"), ("Max depth", "max_depth"),
    ("Cycles", "cycles"), ("Max fan-in", "max_fan_in"), ("Max fan-out", "max_fan_out"), ("Longest path", "longest_path"), ("Dup. instances", "duplicate_instantiations"),
)
FILE_COLUMNS = (("fn", "functions", 3), ("exp", "exports", 4), ("int", "internals", 3), ("ratio", "ratio", 5), ("calls", "calls", 5), ("in", "fan_in", 4), ("out", "fan_out", 3), ("depth", "depth", 5), ("lines", "lines", 6))
ADVICE_HEADINGS = {
    "violation": "Fix Encapsulation", "cycle": "Break Cycles", "complexity": "Reduce Complexity", "coupling": "Reduce Coupling", "orphan": "Remove/Wire Orphans", "schema_gap": "Sync Schema", "schema_stale": "Clean Stale Schema",
    "hot_path": "Critical Paths", "duplicate_instantiation": "Duplicate Instantiation",
}
MARKED, SEVERE = ("Violations", "Cycles"), {"error": "!!", "warning": "! "}
TOP_FUNCTIONS, PATH_WIDTH = 10, 50


def grouped(rows: list[dict], key: str, value: str) -> dict[str, list]:
    """Distinct values by key, both in the order in which they come up."""
    out: dict[str, dict] = {}
    for r in rows:
        out.setdefault(r[key], {})[r[value]] = None
    return {k: list(v) for k, v in out.items()}


def audit_lines(rows: list[dict], indent: str = "  ", wide: bool = True) -> list[str]:
    """Of the rows kind, item, detail of a schema audit."""
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    out = []
    for kind, title, line in (
        ("dead_definition", "Dead definitions", lambda r: r["item"]),
        ("broken_ref", "Broken $ref", lambda r: f"{r['item']} → {r['detail']}"),
        ("ref_cycle", "$ref cycles", lambda r: r["item"].replace(" -> ", " → ")),
    ):
        if found := of(kind):
            out += ["", f"{indent}{title if wide else title[0].lower() + title[1:]} ({len(found)}):", *(f"{indent}  {line(r)}" for r in found)]
    for kind, title in (("duplicate_name", "Duplicate names"), ("orphan_file", "Orphan schema files")):
        if found := of(kind):
            out += ["", f"{indent}{title if wide else title[0].lower() + title[1:]}: {', '.join(r['item'] for r in found)}"]
    return out if any(of(k) for k in ("dead_definition", "broken_ref", "ref_cycle")) else [*out, f"{indent}(no issues found)"]


# op: K3
def as_text(result, boxes: bool = False) -> str:
    """Sections: header, summary, violations by file, cycles, chains, files, functions, schema drift, schema audit, false positives, advice."""
    found, stats = rows_of(result.violations), rows_of(result.stats)[0]
    confirmed, supposed = [r for r in found if r["confirmed"]], [r for r in found if not r["confirmed"]]
    out = [f"# Graph Analysis — {result.project.rstrip('/').split('/')[-1]}", f"  {result.timestamp}", "", "## Summary", ""]
    width = max(len(name) for name, _ in SUMMARY)
    out += [f"  {name.ljust(width)}  {str(stats[key]).rjust(4)}{' !!' if name in MARKED and stats[key] else ''}" for name, key in SUMMARY]

    def section(title: str, lines: list[str]) -> None:
        if lines:
            out.extend(["", f"## {title}", "", *lines])

    section("Encapsulation Violations", [x for file in dict.fromkeys(r["defined_in"] for r in confirmed) for x in (f"  {file}", *(f"    {r['fn']}() ← called from {r['called_from']}" for r in confirmed if r["defined_in"] == file))] or ["  (none)"])
    section("Circular Dependencies", [f"  {k}. {' → '.join([*r['path'], r['path'][0]])}" for k, r in enumerate(rows_of(result.cycles), 1)])
    section("Dependency Chains", [x for r in rows_of(result.hot_paths) for x in (f"  {r['length']} hops:", f"    {r['path'][0]}", *(f"    → {p}" for p in r["path"][1:]))] or ["  (none)"])
    section("File Details", file_lines(result, confirmed, boxes))
    central = sorted((r for r in rows_of(result.centrality) if r["symbol"]), key=lambda r: -r["betweenness"])[:TOP_FUNCTIONS]
    section(f"Function Centrality (top {TOP_FUNCTIONS})", [f"  {r['id'].ljust(60)} betw={r['betweenness']:.3f} pr={r['pagerank']:.3f}" for r in central])
    gaps = rows_of(result.schema_gaps) if result.schema_gaps is not None else []
    drift = lambda kind, title: [title, *(f"    {file}: {', '.join(names)}" for file, names in grouped(rows, "file", "symbol").items())] if (rows := [g for g in gaps if g["type"] == kind]) else []
    section("Schema Drift", [*drift("missing_in_schema", "  Exported but not in schema:"), *drift("stale_in_schema", "  In schema but not exported (stale):")])
    if result.schema_audit is not None:
        audit = rows_of(result.schema_audit)
        total = {r["item"]: r["detail"] for r in audit if r["kind"] == "total"}
        section("Schema Audit", [f"  Definitions: {total['definitions']}", f"  Properties:  {total['properties']}", f"  $ref edges:  {total['refs']}", *audit_lines(audit)])
    section("False Positives (name collisions)", [f"  {file}: {', '.join(names)}" for file, names in grouped(supposed, "defined_in", "fn").items()])
    advice = rows_of(result.advice)
    lines = []
    for kind, title in ADVICE_HEADINGS.items():
        if items := [r for r in advice if r["type"] == kind]:
            lines += [f"  {SEVERE.get(items[0]['severity'], '  ')} {title} ({len(items)})"]
            lines += [x for r in items for x in (f"     {r['file']}", f"       {r['message']}", *([f"       {r['detail']}"] if r["detail"] else []))]
    section("Recommendations", lines)
    return "\n".join(out) + "\n"


def file_lines(result, confirmed: list[dict], boxes: bool) -> list[str]:
    """Files, the deepest first, with the marks V<violations> and O (no edge touches it), and the violations of each again."""
    orphans = {r.path for r in C.orphans(result.files, result.graph.edges).collect()}
    rows = sorted(rows_of(result.complexity), key=lambda r: -r["depth"])
    broken = Counter(r["defined_in"] for r in confirmed)
    notes = {r["file"]: " ".join([*([f"V{broken[r['file']]}"] if broken[r["file"]] else []), *(["O"] if r["file"] in orphans else [])]) for r in rows}
    if boxes:
        out = table([{"file": r["file"], **{name: r[key] for name, key, _ in FILE_COLUMNS}, "notes": notes[r["file"]]} for r in rows], widest=PATH_WIDTH).split("\n")
    else:
        out = [f"  {'file'.ljust(PATH_WIDTH)} " + " ".join(name.rjust(n) for name, _, n in FILE_COLUMNS), f"  {'─' * PATH_WIDTH} " + " ".join("─" * n for _, _, n in FILE_COLUMNS)]
        out += [(f"  {r['file'].ljust(PATH_WIDTH)} " + " ".join(str(r[key]).rjust(n) for _, key, n in FILE_COLUMNS) + f" {notes[r['file']]}").rstrip() for r in rows]
    again = [f"  !! {r['file']}: {v['fn']}() ← {v['called_from']}" for r in rows for v in confirmed if v["defined_in"] == r["file"]]
    return [*out, *(["", *again] if again else [])]


# op: K4
def as_table_text(result) -> str:
    return as_text(result, boxes=True)


# op: K12
def map_text(rows: list[dict]) -> str:
    """Of the rows of an architecture map: each file with its degrees, exports with signatures, and calls into other files."""
    out = ["# Architecture Map", "", f"  {len(rows)} files, {sum(len(r['exports'] or ()) + len(r['internals'] or ()) for r in rows)} functions and classes", ""]
    for r in rows:
        out.append(f"  {r['file']}  [in:{r['fan_in']} out:{r['fan_out']}] {len(r['exports'] or ())} exp, {len(r['internals'] or ())} int")
        out += [f"    {x}" for x in r["exports"] or ()]
        if r["calls_out"]:
            out.append("    calls→ " + ", ".join(r["calls_out"]))
    return "\n".join(out)


# op: Q12
def as_tsv(df: DataFrame) -> tuple[str, int]:
    """Rows without a header, by the columns of the first, and their number."""
    rows = df.collect()
    return "\n".join("\t".join("" if v is None else str(v) for v in r) for r in rows), len(rows)


# op: K13
def impact_text(target: str, rows: list[dict]) -> str:
    tier = lambda d: "WILL BREAK" if d == 1 else "LIKELY AFFECTED" if d == 2 else "MAY NEED TESTING"
    out = [f"Impact of {target}: {len(rows)}"]
    for d in sorted({r["depth"] for r in rows}):
        out.append(f"depth {d} — {tier(d)}")
        out += [f"  {r['id']}" for r in sorted(rows, key=lambda r: r["id"]) if r["depth"] == d]
    return "\n".join(out)


def context_text(target: str, rows: list[dict], symbols: list[dict]) -> str:
    """rows: part, id, other, label; symbols: the nodes of the targets."""
    if not rows:
        return f"context({target})\n  target not found in graph"
    out = [f"context({target})", f"  symbols: {len(symbols)}"]
    out += [f"    {r['file']}:{r['name']} [{r['label']}{', exported' if r['exported'] else ''}]" for r in symbols]
    into, away = ([r for r in rows if r["part"].endswith(end)] for end in ("_caller", "_callee"))
    out += [f"  callers (d=1): {len(into)}", *(f"    {r['other']} →({r['label']})→" for r in into)]
    return "\n".join([*out, f"  callees (d=1): {len(away)}", *(f"    →({r['label']})→ {r['other']}" for r in away)])


def clusters_text(rows: list[dict]) -> str:
    return "\n".join([f"clusters: {len(rows)}", *(x for r in rows for x in (f"  [{r['size']}] {r['community']}", *(f"    {m}" for m in r["members"])))])


def audit_text(rows: list[dict]) -> str:
    total = {r["item"]: r["detail"] for r in rows if r["kind"] == "total"}
    return "\n".join([f"schema-audit: {total['definitions']} definitions, {total['refs']} refs, {total['properties']} properties", *audit_lines(rows, wide=False)])


def blocks_text(rows: list[dict], files: list[dict], blocks: list[dict], definitions: int, refs: int) -> str:
    """rows: of schema_blocks; files and blocks: the clusters' alignments."""
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    out = ["# Schema Block Analysis", "", f"  {definitions} definitions, {refs} $ref edges", "", "## Suggested Blocks (Louvain clusters)", ""]
    out += [x for r in of("cluster") for x in (f"  [{int(r['score'])}] cluster {r['item']}", *(f"    {m}" for m in r["members"]))]
    if bridges := of("bridge"):
        out += ["", "## Bridge Definitions (high betweenness — block public interfaces)", "", *(f"  {r['score']:.4f}  {r['item']}" for r in bridges)]
    out += ["", "## $ref Cycles", *([f"  {' → '.join(r['members'])}" for r in of("cycle")] or ["  (none)"])]
    for title, found, all_well, what, part in (
        ("File Alignment", files, "All clusters align with schema files", "files", lambda x: x.rsplit(":", 1)[0]),
        ("Code Block Alignment", blocks, "All clusters map to single code blocks", "code blocks", lambda x: "{}({})".format(*x.rsplit(":", 1))),
    ):
        spread = [r for r in found if not r["aligned"]]
        out += ["", f"## {title}", ""]
        out += [f"  {len(spread)} clusters span multiple {what}:", *(f"    cluster {r['cluster']} ({r['size']}): {', '.join(map(part, r['parts']))}" for r in spread)] if spread else [f"  {all_well}"]
    return "\n".join(out)


def processes_text(rows: list[dict], threshold: float) -> str:
    out = [f"processes: {len(rows)} (threshold={threshold})"]
    for r in rows:
        out += ["", f"  entry: {r['entry']}  depth={r['depth']}  steps={len(r['steps'])}", *([f"  terminals: {', '.join(r['terminals'])}"] if r["terminals"] else [])]
    return "\n".join(out)
