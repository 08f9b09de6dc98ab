"""Files of several types and encodings as rows of text; what can't be read becomes a row with its error."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.html import visible

#: The types that are read here, those that need a reader that isn't, and the encodings tried for JSON, in order.
TYPES = ("txt", "html", "htm", "docx")
SEAMS = ("pdf",)
JSON_ENCODINGS = ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "gbk")
_MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

SCHEMA = "path string, file_type string, success boolean, error string, text string, encoding string, char_count long, file_size long"


def files_under(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of the files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def encoding_of(raw: bytes) -> str:
    """The likeliest encoding, told by marks, validity and the statistics of bytes.

    A mark at the beginning decides; else zero bytes on one side of each pair mean UTF-16; what
    is valid UTF-8 is that; what is valid GB18030 or Big5 is the one of these in which more
    pairs begin as its common characters do, if half of them do; the rest has a Western
    alphabet, and so has what looks like GB18030 but reads as Western words.
    """
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name
    data = np.frombuffer(raw[: len(raw) // 2 * 2], np.uint8)
    if len(data):
        even, odd = (data[0::2] == 0).mean(), (data[1::2] == 0).mean()
        if max(even, odd) > 0.2 and min(even, odd) < 0.05:
            return "utf-16-le" if odd > even else "utf-16-be"
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    else:
        return "utf-8"
    scores = {"gb18030": _common(raw, "gb18030", 0xB0, 0xD7), "big5": _common(raw, "big5", 0xA4, 0xC6)}
    best = max(scores, key=scores.get)
    if scores[best] >= 0.5 and not (best == "gb18030" and _western(raw)):
        return best
    return "latin-1" if re.search(rb"[\x81\x8d\x8f\x90\x9d]", raw) else "cp1252"


def _western(raw: bytes) -> bool:
    """Whether valid GB18030 reads as Western words.

    Bytes above 127 stand alone in over a quarter of their runs, where common characters have
    two. Or all runs are one or two accented letters in words of plain case, and most stand by
    a plain letter or begin as no common character does.
    """
    text = raw.decode("latin-1")
    runs = [m.span() for m in re.finditer("[\x80-\xff]+", text)]
    if sum(b - a == 1 for a, b in runs) > 0.25 * len(runs):
        return True
    if not all(b - a <= 2 and text[a:b].isalpha() and text[a] >= "\xc0" and text[b - 1] >= "\xc0" for a, b in runs):
        return False
    words = set(re.findall("[A-Za-z\x80-\xff]*[\x80-\xff][A-Za-z\x80-\xff]*", text))
    if not all(w[1:].islower() or len(w) == 1 or (w.replace("ß", "").isupper() and re.search("[A-Z]", w)) for w in words):
        return False
    beside = sum(text[a] >= "\xe0" or bool(re.search("[A-Za-z]", text[max(0, a - 1) : a] + text[b : b + 1])) for a, b in runs)
    return beside > 0.5 * len(runs)


def _common(raw: bytes, encoding: str, low: int, high: int) -> float:
    """Share of a text's pairs of bytes that begin as the encoding's common characters do; -1 if it isn't that encoding."""
    try:
        text = raw.decode(encoding)
    except UnicodeDecodeError:
        return -1.0
    pairs = [c for c in (ch.encode(encoding) for ch in set(text)) if len(c) == 2]
    return sum(low <= c[0] <= high for c in pairs) / max(1, len(pairs))


def cleaned(text: str) -> str:
    lines = (line.strip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return "\n".join(line for line in lines if line)


def _docx(raw: bytes) -> str:
    """Paragraphs, then the rows of tables with cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(raw)) as packed:
        body = ElementTree.fromstring(packed.read("word/document.xml")).find(f"{_WORD}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    lines = [words(p) for p in body.findall(f"{_WORD}p")]
    for row in (r for table in body.findall(f"{_WORD}tbl") for r in table.findall(f"{_WORD}tr")):
        cells = [words(cell).strip() for cell in row.findall(f"{_WORD}tc")]
        lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines)


def parse(path: str | None, raw: bytes | None, file_type: str | None) -> tuple:
    """A row of SCHEMA."""
    kind = (file_type or (path or "").rpartition(".")[2]).lower().replace(".", "").strip()
    failed = lambda error: (path, kind, False, error, None, None, None, len(raw or b""))
    if raw is None:
        return failed("no content")
    if kind not in TYPES:
        return failed("needs a reader of its own" if kind in SEAMS else f"not one of {', '.join(TYPES)}")
    encoding = None
    try:
        if kind == "docx":
            text = _docx(raw)
        else:
            encoding = encoding_of(raw)
            text = raw.decode(encoding, "ignore")
            text = visible(text) if kind != "txt" else text
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as error:
        return failed(f"can't be read: {type(error).__name__}")
    clean = cleaned(text)
    return (path, kind, True, None, clean, encoding, len(clean), len(raw)) if clean else failed("empty")


def parsed(files: DataFrame) -> DataFrame:
    """files(path, content, and perhaps file_type) -> SCHEMA, a row for each file; the type is the path's ending unless given."""
    given = F.col("file_type") if "file_type" in files.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in batches:
            rows = [parse(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "file_type")), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "file_type", "success", "error", "text", "encoding", "char_count", "file_size"])

    return files.select("path", "content", given.alias("file_type")).mapInArrow(run, SCHEMA)


def json_text(raw: bytes) -> tuple[str | None, str | None]:
    """(text, encoding) by the first of JSON_ENCODINGS in which the bytes are JSON."""
    for encoding in JSON_ENCODINGS:
        try:
            text = raw.decode(encoding)
            json.loads(text)
        except ValueError:
            continue
        return text, encoding
    return None, None


def json_files(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, json (null if it is none in any encoding), encoding."""

    def run(batches):
        for batch in batches:
            found = [json_text(raw or b"") for raw in batch.column("content").to_pylist()]
            yield pa.record_batch([batch.column("path"), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "json", "encoding"])

    return files.select("path", "content").mapInArrow(run, "path string, json string, encoding string")
