"""WARC records, and revisits of type "not modified" resolved to what they stand for.

A revisit holds the headers of a 304 answer and no payload. It stands for the latest earlier
full response of its canonical URL, provided its validators agree with that response's; the
stored headers, updated by those that a 304 may update, and the stored payload make the result.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.asof import latest_earlier
from lodestone.llm.staging import BATCH_BYTES, Staged, in_small_batches, without_repeats

#: Headers that a 304 answer may update in a stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only say where a visitor came from.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid|session"

#: End of the profile of revisits that say "not modified", in any version of the format.
NOT_MODIFIED = "/revisit/server-not-modified"
RECORDS = "record_id string, kind string, url string, time string, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host and path in one spelling: no scheme, fragment, www, default port, tracking parameters or final slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"(?i)^[a-z][a-z0-9+.-]*://", "")
    address, query = F.regexp_extract(bare, r"^[^?]*", 0), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(address, r"^[^/]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(address, r"/.*$", 0), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def read_records(files: DataFrame) -> DataFrame:
    """files(path, content) of WARC, plain or gzipped -> RECORDS of responses and revisits.

    Header names are lower-case; a response's payload is its HTTP body, its headers are those
    of HTTP, with a revisit's WARC-Profile as `warc-profile`. Null contents and damaged records
    give no rows; of a file whose compression breaks off the records before that are read.
    Records leave in batches of about BATCH_BYTES, a file is never unpacked whole.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows, size = [], 0
                for row in parse(content or b""):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return in_small_batches(files.select("content"), run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


_NAMES = ["record_id", "kind", "url", "time", "headers", "payload"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]


def _headers(block: bytes) -> dict[str, str]:
    """Names in lower case; the values of a name that comes several times are joined by commas, folded lines unfolded."""
    found: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", block.decode("utf-8", "replace")).split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            key = name.strip().lower()
            found[key] = f"{found[key]}, {value.strip()}" if key in found else value.strip()
    return found


def parse(content: bytes) -> Iterator[tuple]:
    """Responses and revisits of a file, one after another; what is damaged is passed over."""
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = []
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                head.append(line)
            record = _record(_headers(b"".join(head)), stream)
            if record:
                yield record
    except (EOFError, OSError, zlib.error):
        return


def _record(warc: dict[str, str], stream: io.BufferedIOBase) -> tuple | None:
    length = warc.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    body = stream.read(int(length))
    if len(body) < int(length) or warc.get("warc-type") not in ("response", "revisit"):
        return None
    first, _, payload = body.partition(b"\r\n\r\n")
    http = _headers(first.partition(b"\r\n")[2])
    if "warc-profile" in warc:
        http["warc-profile"] = warc["warc-profile"]
    revisit = warc["warc-type"] == "revisit"
    return warc.get("warc-record-id"), warc["warc-type"], warc.get("warc-target-uri"), warc.get("warc-date"), list(http.items()), None if revisit else payload


def write_record(record_id: str | None, kind: str, url: str | None, time: str | None, headers: dict[str, str], payload: bytes | None) -> bytes:
    profile = headers.get("warc-profile")
    status = "304 Not Modified" if kind == "revisit" else "200 OK"
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items() if k != "warc-profile") + "\r\n"
    body = http.encode() + (payload or b"")
    warc = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": url, "WARC-Date": time, "Content-Length": str(len(body))}
    if profile:
        warc["WARC-Profile"] = profile
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in warc.items() if v is not None).encode() + b"\r\n" + body + b"\r\n\r\n"


def archived(records: DataFrame) -> DataFrame:
    """records as in RECORDS -> files(content): WARC records, compressed one by one, about BATCH_BYTES of them in a file."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True)
            packed = b"".join(gzip.compress(write_record(i, kind, url, time, dict(headers or ()), payload), 1) for i, kind, url, time, headers, payload in rows)
            yield pa.record_batch([pa.array([packed], pa.binary())], names=["content"])

    return in_small_batches(records.select(*_NAMES[:-1], F.col("payload").cast("binary").alias("payload")), run, "content binary")


def instant(records: DataFrame) -> Column:
    """The column `time` as a long to order by: numbers as they are, timestamps and ISO 8601 texts in microseconds; texts that are neither give null."""
    kind = records.schema["time"].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col("time").cast("timestamp"))
    if kind != "string":
        return F.col("time").cast("long")
    return F.coalesce(F.col("time").try_cast("long"), F.unix_micros(F.try_to_timestamp("time")))


def resolve(records: DataFrame) -> DataFrame:
    """Revisits of records(record_id, url, time, kind, headers, payload) with what they stand for; time as in instant().

    record_id, canonical_url, refers_to, status, headers, payload. status is `resolved`;
    `changed` if a validator (etag, last-modified) that both carry differs; `unvalidated` if they
    share none; `missing` if no earlier full response of the URL exists; `other` if the revisit's
    profile says anything else than "not modified" (none says that). Unless resolved, refers_to, headers and payload are null. Header names are lower-case. Null URLs and times
    are `missing`; a response at a revisit's own time is not earlier; of several at one time the
    one of the greatest record_id counts. Repeated revisits are resolved each; responses that share
    a record_id, which repeated files bring, count once. Other columns
    are ignored, an empty table gives an empty result.
    """
    full, revisit = F.col("kind") == "response", F.col("kind") == "revisit"
    validators = [F.col("headers")[h] for h in ("etag", "last-modified")]
    stored = F.struct("record_id", validators[0].alias("etag"), validators[1].alias("modified"))
    events = Staged(
        records.filter(full | revisit).select(
            "record_id", canonical_url(F.col("url")).alias("canonical_url"), instant(records).alias("time"), "kind",
            F.when(revisit, F.col("headers")).alias("headers"), validators[0].alias("etag"), validators[1].alias("modified"), F.when(full, stored).alias("stored"),
        )
    )
    found = latest_earlier(events.df, "canonical_url", "time", "stored").filter(revisit)
    agree = [(F.col(c), F.col("latest")[c]) for c in ("etag", "modified")]
    differs = [F.coalesce(a != b, F.lit(False)) for a, b in agree]
    same = [F.coalesce(a == b, F.lit(False)) for a, b in agree]
    other = F.coalesce(~F.col("headers")["warc-profile"].endswith(NOT_MODIFIED), F.lit(False))
    status = F.when(other, "other").when(F.col("latest").isNull(), "missing").when(differs[0] | differs[1], "changed").when(same[0] | same[1], "resolved").otherwise("unvalidated")
    judged = found.withColumn("status", status).select(
        "record_id", "canonical_url", "status", F.col("headers").alias("fresh"), F.when(F.col("status") == "resolved", F.col("latest")["record_id"]).alias("refers_to")
    )
    once = without_repeats(records.filter(full & F.col("record_id").isNotNull()).select("record_id", "headers", "payload").withColumn("headers", F.array_sort(F.map_entries("headers"))), ["record_id"])
    sources = once.withColumn("headers", F.map_from_entries("headers")).select(F.col("record_id").alias("source_id"), F.col("headers").alias("stored_headers"), F.col("payload").alias("source_payload"))
    joined = judged.join(sources, F.col("refers_to") == F.col("source_id"), "left")
    update = F.map_filter("fresh", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("stored_headers", lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(update, F.create_map().cast("map<string,string>"))), k))
    merged = F.when(F.col("refers_to").isNotNull(), F.map_concat(kept, F.coalesce(update, F.create_map().cast("map<string,string>"))))
    return joined.select("record_id", "canonical_url", "refers_to", "status", merged.alias("headers"), F.col("source_payload").alias("payload"))


#: Captures by which the second visit of a page comes later.
LATER = 1000


def captures(pages: DataFrame) -> DataFrame:
    """The capture log that pages(page_id, url, html) stand for, as records for resolve().

    Page n is fetched whole at time 2n, with a validator made of its content, and asked for
    again at time 2(n + LATER) + 1, when the server says "not modified" and names the validator.
    Null html is an empty page, a null page_id has no time.
    """
    etag = F.md5(F.coalesce("html", F.lit("")))
    texts = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    at, again = F.col("page_id") * 2, (F.col("page_id") + LATER) * 2 + 1
    first = F.struct(
        F.concat(F.lit("f"), F.lpad(F.col("page_id").cast("string"), 19, "0")).alias("record_id"), at.alias("time"), F.lit("response").alias("kind"),
        texts(("content-type", F.lit("text/html")), ("content-length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), ("date", at.cast("string")), ("etag", etag)).alias("headers"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    second = F.struct(
        F.concat(F.lit("r"), F.lpad(F.col("page_id").cast("string"), 19, "0")).alias("record_id"), again.alias("time"), F.lit("revisit").alias("kind"),
        texts(("content-length", F.lit("0")), ("date", again.cast("string")), ("etag", etag), ("server", F.lit("cache"))).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return pages.select("url", F.explode(F.array(first, second)).alias("r")).select("url", "r.*")
