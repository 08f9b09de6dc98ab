"""Cutting texts into retrieval chunks; sequential within one text, so an Arrow-batched UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = 1500
OVERLAP = 220
LEAST = 300
PIECE = 3000

_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
CHUNK = T.StructType([T.StructField("text", T.StringType()), T.StructField("path", T.ArrayType(T.StringType()))])


def pieces(text: str, limit: int = PIECE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most `limit` characters on sentence ends where possible; each but the first begins with the end of the one before."""
    out, held = [], ""
    for sentence in _SENTENCE.split(text.strip()):
        while sentence:
            join = f"{held} {sentence}" if held else sentence
            if len(join) <= limit:
                held, sentence = join, ""
            elif held and len(held) > overlap:
                out.append(held)
                held = held[-overlap:].lstrip() if overlap else ""
                if held and len(held) + 1 + len(sentence) > limit:
                    room = limit - len(held) - 1
                    if len(sentence) > limit and room > 0:
                        out.append(f"{held} {sentence[:room]}")
                        sentence = sentence[room:]
                    held = ""
            else:
                out.append(join[:limit])
                held, sentence = "", join[limit:].lstrip()
    return [*out, held] if held else out


def chunks(text: str | None, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[dict]:
    """Paragraphs gathered to about `target` characters; a heading ends a chunk and sets the path; a short chunk joins the one before of the same path."""
    found: list[dict] = []
    path: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            found.append({"text": "\n\n".join(held), "path": list(path)})
            held.clear()

    for block in re.split(r"\n\s*\n", text or ""):
        block = block.strip()
        heading = _HEADING.match(block)
        if heading:
            flush()
            path[len(heading[1]) - 1 :] = [heading[2].strip()]
            continue
        for part in [block] if len(block) <= target else pieces(block, target, 0):
            if not part:
                continue
            if held and sum(map(len, held)) + len(part) > target:
                last = held[-1]
                flush()
                if len(last) <= overlap:
                    held.append(last)
            held.append(part)
    flush()
    merged: list[dict] = []
    for chunk in found:
        if merged and len(chunk["text"]) < least and merged[-1]["path"] == chunk["path"]:
            merged[-1]["text"] += "\n\n" + chunk["text"]
        else:
            merged.append(chunk)
    return merged


def retrieval_chunks(text: Column) -> Column:
    """array<struct<text, path>> of a text column; null gives an empty array."""
    return F.pandas_udf(lambda s: s.map(chunks), T.ArrayType(CHUNK))(text)


def embedding_pieces(text: Column, limit: int = PIECE, overlap: int = OVERLAP) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pieces(t, limit, overlap) if t else [])

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(text)
