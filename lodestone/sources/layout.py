"""Layout cells from a page model's answer, and pages as Markdown."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import formats

CELLS = "array<struct<bbox:array<double>,category:string,text:string>>"


def _cell(raw: dict) -> dict | None:
    box, category = raw.get("bbox"), str(raw.get("category") or "").strip()
    if not isinstance(box, list) or len(box) != 4 or not category:
        return None
    return {"bbox": [float(v) for v in box], "category": category, "text": str(raw.get("text") or "")}


def layout_cells(answer: str | None) -> list[dict] | None:
    """The cells in an answer: its JSON without fences, else from the first [ to the last ]; a bad number spoils the whole. None if neither parses."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", (answer or "").strip())
    for candidate in (bare, bare[bare.find("[") : bare.rfind("]") + 1]):
        try:
            data = json.loads(candidate)
            if isinstance(data, dict):
                data = next((v for v in data.values() if isinstance(v, list)), None)
            if isinstance(data, list) and all(isinstance(c, dict) for c in data):
                return [c for c in map(_cell, data) if c]
        except (ValueError, TypeError):
            pass
    return None


def cells(answer: Column | str) -> Column:
    """layout_cells of a column; an Arrow-batched UDF."""
    return F.pandas_udf(lambda s: pd.Series([layout_cells(a) for a in s], dtype=object), CELLS)(answer)


def page_markdown(found: Column, page: Column, page_edges: bool = False) -> Column:
    """Cells as Markdown: titles with # and ##, pictures by number on the page, formulas as blocks; headers and footers only with page_edges.

    Null is empty. `found` must be a column of the input, as lambdas can't hold the UDF that finds cells.
    """
    body = found if page_edges else F.filter(found, lambda c: ~c["category"].isin("Page-header", "Page-footer"))
    body = F.coalesce(body, F.array().cast(CELLS))
    earlier = lambda i: F.size(F.filter(F.slice(body, 1, i), lambda c: c["category"] == "Picture"))

    def line(c: Column, i: Column) -> Column:
        text = F.trim(F.coalesce(c["text"], F.lit("")))
        flat = F.trim(F.regexp_replace(text, r"\s+", " "))
        picture = F.concat(F.lit("![image](image_p"), page.cast("string"), F.lit("_"), earlier(i).cast("string"), F.lit(".jpg)"))
        return (
            F.when(c["category"] == "Picture", picture)
            .when(c["category"] == "Formula", formats.formula(text))
            .when(text == "", None)
            .when(c["category"] == "Title", F.concat(F.lit("# "), flat))
            .when(c["category"] == "Section-header", F.concat(F.lit("## "), flat))
            .otherwise(text)
        )

    return F.array_join(F.array_compact(F.transform(body, line)), "\n\n")
