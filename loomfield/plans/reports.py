"""Markdown reports of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A report is read by people; longer tables are refused.
MOST_ROWS = 10_000


def table(df: DataFrame, digits: int = 4) -> str:
    """A table of all rows of df, which must be few."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("this table is too long for a report")

    def cell(v) -> str:
        text = "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
        return text.replace("|", "\\|").replace("\n", " ")

    lines = [df.columns, ["---:" if t in ("double", "bigint", "int") else "---" for _, t in df.dtypes], *([cell(v) for v in r] for r in rows)]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def report(title: str, sections: dict[str, DataFrame | str], digits: int = 4) -> str:
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else table(body, digits)]
    return "\n\n".join(parts) + "\n"
