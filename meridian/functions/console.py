"""Driver-side lines of text for a terminal: cells of a set width, badges, marks, tables, a progress bar, a throttle."""

from __future__ import annotations

import time
import unicodedata

from meridian.plans.sql_compare import severity

MARKS = {"none": "✔", "soft": "~", "hard": "✘", "unknown": "?"}


def width(line: str) -> int:
    """Terminal cells that a line takes: none for colour codes and combining characters, two for wide ones."""
    cells, code = 0, False
    for c in line:
        if code:
            code = c != "m"
        elif c == "\x1b":
            code = True
        elif not unicodedata.combining(c):
            cells += 1 + (unicodedata.east_asian_width(c) in "WF")
    return cells


def padded(line: str, to: int) -> str:
    missing = to - width(line)
    return line if missing <= 0 else line.ljust(len(line) + missing)


def badge(ok: bool | None) -> str:
    return "n/a" if ok is None else "yes" if ok else "no"


def marked(label: str) -> str:
    return f"{MARKS[severity(label)]} {label}"


def failures_line(labels: list[str]) -> str:
    """All labels of a pair with their marks."""
    return "Failures: " + ("  ".join(map(marked, labels)) or "none")


def components_table(components: dict[str, dict]) -> str:
    """A row for each clause: whether it matches, and its Jaccard index."""
    rows = [("clause", "match", "jaccard"), *((k, badge(c["match"]), f"{c['jaccard']:.4f}") for k, c in components.items())]
    sizes = [max(width(r[i]) for r in rows) for i in range(3)]
    return "\n".join("  ".join(padded(cell, size) for cell, size in zip(r, sizes, strict=True)).rstrip() for r in rows)


def table(rows: list[dict], columns: list[str]) -> str:
    """Rows under their columns' names, numbers with four places."""
    shown = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    cells = [columns, *([shown(r.get(c)) for c in columns] for r in rows)]
    sizes = [max(width(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(padded(x, size) for x, size in zip(r, sizes, strict=True)).rstrip() for r in cells)


def progress_bar(share: float, cells: int = 24) -> str:
    full = round(min(1.0, max(0.0, share)) * cells)
    return "#" * full + "." * (cells - full)


class Throttle:
    """Says whether a line is due: the first, the last, and otherwise one in `seconds`."""

    def __init__(self, seconds: float = 1.0):
        self.seconds, self.next = seconds, 0.0

    def due(self, done: int, total: int) -> bool:
        now = time.monotonic()
        if now < self.next and done < total:
            return False
        self.next = now + self.seconds
        return True


def banner(title: str, to: int = 60) -> str:
    line = "=" * to
    return f"{line}\n{title.center(to).rstrip()}\n{line}"
