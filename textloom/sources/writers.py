"""Writers of small results as one JSON, CSV or HTML file; large ones are written with ``df.write``."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from textloom.operators.evaluation import FLOOR_COLUMNS

#: Rows that a single file may hold at most.
MOST_ROWS = 100_000


def _rows(df: DataFrame) -> list[dict]:
    got = [r.asDict(recursive=True) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(got) > MOST_ROWS:
        raise ValueError("too many rows for one file; use df.write")
    return got


def json_file(value, path: str) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def model_file(cues: DataFrame, thresholds: DataFrame, metrics: DataFrame, path: str) -> None:
    """(category, cues), (category, threshold) and metric rows, in the form that ``readers.model`` reads."""
    json_file({"thresholds": {r["category"]: r["threshold"] for r in _rows(thresholds)}, "cues": {r["category"]: r["cues"] for r in _rows(cues)}, "test": _rows(metrics)}, path)


def calibration_file(fitted: DataFrame, edges: tuple[float, ...], path: str) -> None:
    json_file({r["category"]: {"bins": {str(k): v for k, v in sorted(r["bins"].items())}, "fallback": r["fallback"], "edges": list(edges)} for r in _rows(fitted)}, path)


def categories_files(table: DataFrame, folder: str) -> None:
    """The category table as JSON with all its columns, and as CSV with the main ones."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    rows = _rows(table)
    json_file([{k: v for k, v in r.items() if v is not None or k in ("format", "group")} for r in rows], f"{folder}/categories.json")
    csv_file(table.select("category", "format", "group", "bucket", "closes_alone"), f"{folder}/categories.csv")


def csv_file(df: DataFrame, path: str) -> None:
    import csv

    with Path(path).open("w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, fieldnames=df.columns)
        writer.writeheader()
        writer.writerows(_rows(df))


def floor_file(report: DataFrame, path: str) -> None:
    """The floor report (``evaluation.floor_report``) as CSV."""
    csv_file(report.select(*FLOOR_COLUMNS), path)


def sheet_file(rows: DataFrame, name: str, path: str) -> None:
    """The sheet of one document."""
    json_file({"contract": name, "rows": [{k: v for k, v in r.items() if k != "name"} for r in _rows(rows.where(rows["name"] == name))]}, path)


def page_file(template: str, path: str, **parts) -> None:
    """An HTML page: each part replaces its marker ``{{name}}``, as JSON unless it's text; a missing marker raises ValueError."""
    page = template
    for name, value in parts.items():
        marker = "{{" + name + "}}"
        if marker not in page:
            raise ValueError(f"the template has no {marker}")
        page = page.replace(marker, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False).replace("</", "<\\/"))
    Path(path).write_text(page, encoding="utf-8")
