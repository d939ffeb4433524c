"""The report: statistics from Spark, a few dozen rows at most, laid out as text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..config import DEFAULT

NUMERAL = re.compile(r"\d")
RATIO, LEAST = 0.6, 0.61


@dataclass(frozen=True)
class Row:
    name: str
    section: str
    line: str
    n: int = 0
    sessions: int = 0
    direction: str | None = None
    quote: str | None = None


def plan_folds(rows: list[Row], vectors: list[list[float]]) -> list[list[int]]:
    """Groups of rows of a section that are near each other, by complete linkage, until so few are left.

    Two groups merge only if each pair of their members is near enough; ties go to the smaller names.
    """
    if len(rows) != len(vectors) or len(rows) <= 2:
        return []
    sim = [[sum(x * y for x, y in zip(a, b)) for b in vectors] for a in vectors]
    groups = [[i] for i in range(len(rows))]
    target = -(-len(rows) * 6 // 10)
    while len(groups) > target:
        best = None
        for i, a in enumerate(groups):
            for j in range(i + 1, len(groups)):
                b = groups[j]
                if rows[a[0]].section != rows[b[0]].section:
                    continue
                link = min(sim[x][y] for x in a for y in b)
                names = tuple(sorted(min(rows[x].name for x in g) for g in (a, b)))
                if link >= LEAST and (best is None or (-link, names) < best[:2]):
                    best = (-link, names, i, j)
        if best is None:
            break
        groups[best[2]] = groups[best[2]] + groups.pop(best[3])
    return sorted((sorted(g, key=lambda i: rows[i].name) for g in groups if len(g) > 1), key=lambda g: rows[g[0]].name)


def receipts(row: Row) -> str:
    trend = f", {row.direction}" if row.direction else ""
    return f"{row.n}× across {row.sessions} conversations{trend}"


@dataclass(frozen=True)
class Fold:
    """Rows of a section under one line, each with what sets it apart (facets: name to text)."""

    section: str
    line: str
    facets: dict[str, str]


@dataclass(frozen=True)
class Clause:
    text: str
    slip: int
    trend: str | None = None


@dataclass(frozen=True)
class Provenance:
    sessions: int
    moments: int
    first_day: str
    last_day: str


WHEN = re.compile(r"^when\s+([^,]+),\s*(.+)$", re.IGNORECASE)


def _line(row: Row, clause: Clause | None) -> str:
    words = row.line
    if clause:
        words += f" and {clause.text.rstrip('. ')}"
    slips = f", slipped {clause.slip}×{f', {clause.trend}' if clause.trend else ''}" if clause else ""
    return f"- {words} ({receipts(row)}{slips})" + (f'\n  "{row.quote}"' if row.quote else "")


def _blocks(own: list[Row], folds: list[Fold], clauses: dict[str, Clause]) -> list[tuple[int, str]]:
    """(members, text) of a section's rows and folds, the most frequent first.

    A fold takes only rows that print in this section and carry no clause; with fewer than two it is
    disbanded. Members keep their own counts, in order of those; a sum would be no one's.
    """
    left, found = {r.name: r for r in own}, []
    for fold in folds:
        members = sorted((left[n] for n in fold.facets if n in left and n not in clauses), key=lambda r: (-r.n, r.name))
        if len(members) < 2:
            continue
        for row in members:
            del left[row.name]
        below = "\n".join(f"  - {fold.facets[r.name].rstrip('. ')} ({r.n}×{f', {r.direction}' if r.direction else ''})" for r in members)
        found.append((-members[0].n, members[0].name, len(members), f"- {fold.line.rstrip('.: ')}:\n{below}"))
    found += [(-r.n, r.name, 1, _line(r, clauses.get(r.name))) for r in left.values()]
    return [(members, text) for _, _, members, text in sorted(found)]


def assemble(
    rows: list[Row], sections: list[str], signatures: dict[str, list[str]] | None = None, budget: int = DEFAULT.budget_chars, *,
    provenance: Provenance | None = None, folds: list[Fold] = [], clauses: dict[str, Clause] = {}, key_lines: list[str] = [], built: str | None = None,  # noqa: B006
) -> str:
    """The report: where it comes from, the key, then sections in order, rows by count.

    The last section stops where the budget ends. A clause shows only on a row that prints; if it says when
    to do what, the key has it too. rows are a few dozen: those of the project are left out before.
    """
    words = [r.line for r in rows] + [f.line for f in folds] + [x for f in folds for x in f.facets.values()] + [c.text for c in clauses.values()]
    if any(NUMERAL.search(w) for w in words):
        raise ValueError("words must not carry numbers; numbers are counted")
    shown = {n: c for n, c in clauses.items() if any(r.name == n and r.section in sections for r in rows)}
    out = ["# Report", *([f"# built {built}"] if built else []), ""]
    if provenance:
        out += [f"From {provenance.sessions} conversations, {provenance.first_day} to {provenance.last_day}; {provenance.moments} moments. Each line has the count behind it.", ""]
    situations = [m for m in (WHEN.match(c.text) for c in shown.values()) if m]
    key = [f"- {m[1].strip()} → {m[2].strip().rstrip('. ')}" for m in situations] + [f"- {x}" for x in key_lines]
    if signatures:
        key = [f"- {', '.join(p)} → {name}" for name, p in sorted(signatures.items())] + key
    if key:
        out += ["## Shorthand", *key, ""]
    for section in sections:
        own = [r for r in rows if r.section == section]
        if not own:
            continue
        out.append(f"## {section}")
        for _, block in _blocks(own, [f for f in folds if f.section == section], shown):
            if section == sections[-1] and sum(len(x) + 1 for x in out) + len(block) > budget:
                break
            out.append(block)
        out.append("")
    return "\n".join(out)


def looks_like_report(text: str) -> bool:
    return text.startswith("# Report") and re.search(r"(?m)^## ", text) is not None
