"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: payload digests are grouped (pre-aggregated; hot payloads are joined by broadcast). Payloads stay in their
scan: only ids and digests of rows that may repeat are joined, and of those only the payloads of responses move. Every
record becomes one string that ends in the format's empty lines; tasks cut what they have into archives by summed
bytes, which Spark's text writer makes in the shared folder.

Reading: `WARC/1.` may also stand inside a payload, so it proves nothing. Each task lists all candidates of its
archive with the offset at which their declared length says the next record begins; pointer jumping from offset 0
(doubling the step each round, so a logarithmic number of rounds) keeps the candidates that the chain reaches, and
only those are parsed. Archives are unpacked and read whole by one task each, which the bounded file size allows.

Edge cases: a null payload counts as empty; rows that repeat a page_id are records of their own, and all rows of the
smallest page_id of equal payloads are responses, as are rows without a page_id; ids may be integers or strings without
line ends; addresses are stored without line ends; an empty table gives no archive and no rows; other columns are not
read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payload bytes that one archive is meant to hold.
FILE_BYTES = 16 << 20
_MAGIC, _END, _LENGTH = re.compile(rb"WARC/1\."), re.compile(rb"\r\n(?=\r\n)"), re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.I)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: each 40 bits of it are eight digits."""
    digest = F.sha1(payload)
    out = []
    for group in range(4):
        bits = F.conv(F.substring(digest, 10 * group + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*out)


def _cut(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the archive, by the summed bytes of this task's records."""
    before = 0
    for batch in batches:
        total = before + np.cumsum(pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False).astype(np.int64))
        part = (total - 1) // limit
        before = int(total[-1]) if len(total) else before
        yield pa.RecordBatch.from_pydict({"value": batch.column("value"), "part": pa.array(part.astype(np.int32))})


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", page: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Equal payloads of at least min_bytes bytes are one response, of the smallest page_id, and revisits of it."""
    C.tune(pages.sparkSession)
    own = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), F.coalesce(pages[page], F.lit("")).alias("payload"))
    own = own.withColumns({"url": F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "), "digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload")})
    own = own.withColumns({"same": F.xxhash64("digest"), "row": F.xxhash64("digest", "page_id")})
    # only the digest and the length leave the scan here
    facts = C.scratch(own.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("size")), "digests")
    total = facts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = C.scratch(facts.filter((F.col("size") > 1) & (F.col("bytes") >= min_bytes)).select("digest", "first", "size", F.xxhash64("digest").alias("same")), "repeated")
    split = C.maybe_in(own, groups, "same")
    names = ["page_id", "url", "digest", "bytes", "row"]
    light = C.join_groups(split.filter("_maybe").select(*names), groups.drop("same"), ["digest"], "size", "row", total)
    light = C.scratch(light.withColumn("revisit", F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))), "decided")
    answers = light.filter("not revisit").select("digest", "row").distinct()
    kept = C.maybe_in(split.filter("_maybe").drop("_maybe"), answers, "row").filter("_maybe")
    # what repeats an answer's id and payload is an answer too: a semi join keeps every such row
    kept = kept.join(answers, ["digest", "row"], "left_semi").select("page_id", "url", "digest", "bytes", "payload")
    responses = split.filter("not _maybe").select("page_id", "url", "digest", "bytes", "payload").union(kept)
    none = F.lit(None).cast(dict(own.dtypes)["page_id"])
    rows = responses.withColumns({"first": none, "revisit": F.lit(False)}).unionByName(light.filter("revisit").select("page_id", "url", "digest", "bytes", F.lit("").alias("payload"), "first", "revisit"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.col("payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    revisit = F.col("revisit")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Target-URI", F.when(F.col("url") != "", F.col("url"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\n")),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
        body,
    )
    cut = rows.select(record.alias("value")).mapInArrow(lambda it: _cut(file_bytes, it), "value string, part int")
    cut.write.partitionBy("part").option("lineSep", "\r\n\r\n").option("compression", "gzip").mode("errorifexists").text(path)
    C.discard(facts, groups, light)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets at which a record may begin, those of their blocks, and those at which the next record would.

    Three passes over the bytes find the marks, the ends of headers and the lengths; the rest looks them up.
    """
    at = np.array([m.start() for m in _MAGIC.finditer(data)], np.int64)
    ends = np.array([m.start() for m in _END.finditer(data)], np.int64)
    lengths = [(m.start(), int(m[1])) for m in _LENGTH.finditer(data)]
    begins, sizes = (np.array(x, np.int64) for x in zip(*lengths, strict=True)) if lengths else (np.empty(0, np.int64),) * 2
    if not (len(at) and len(ends) and len(begins)):
        return (np.empty(0, np.int64),) * 3
    end, length = np.searchsorted(ends, at), np.searchsorted(begins, at)
    ok = (end < len(ends)) & (length < len(begins))
    at, end, length = at[ok], ends[end[ok]], length[ok]
    ok = begins[length] < end
    at, block = at[ok], end[ok] + 4
    return at, block, block + sizes[length[ok]] + 4


def reachable(offsets: np.ndarray, successors: np.ndarray, start: int = 0) -> np.ndarray:
    """Which candidates the chain from `start` reaches, by pointer jumping; a successor that is no candidate ends it."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    jump = np.append(np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n), n) if n else np.zeros(1, np.int64)
    seen = np.zeros(n + 1, bool)
    first = np.searchsorted(offsets, start)
    if first < n and offsets[first] == start:
        seen[first] = True
    step = 1
    while step <= n:
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
        step *= 2
    return seen[:n]


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


def _page(urn: str | None) -> str | None:
    return (urn or "").removeprefix("<urn:page:").removesuffix(">") or None


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and payload of every record that the chain from the file's start reaches."""
    at, block, after = candidates(data)
    for k in np.flatnonzero(reachable(at, after)):
        body = data[block[k] : after[k] - 4]
        _, _, payload = body.partition(b"\r\n\r\n")
        http = fields(body[: len(body) - len(payload)])
        yield fields(data[at[k] : block[k]]) | {f"http-{n}": v for n, v in http.items()}, payload


def read(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; with payloads also url and payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, payload in records(gzip.decompress(content.as_buffer())):
                    kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
                    size = int(f["http-content-length"])
                    if kind == "response":
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest or len(payload) != size:
                            raise ValueError(f"record {f.get('warc-record-id')} is damaged")
                    more = (f.get("warc-target-uri"), payload if kind == "response" else None) if payloads else ()
                    rows.append((_page(f.get("warc-record-id")), size, digest, kind, _page(f.get("warc-refers-to")), *more))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *([pa.string(), pa.binary()] * payloads)]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] * payloads)]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    C.tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").option("recursiveFileLookup", True).load(path).select("content")
    out = files.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", url string, payload binary" * payloads)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    path = C.scratch_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path, id_type=dict(pages.dtypes)[options.get("page_id", "page_id")])


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(C.load(spark, sf_dir, "pages"))


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lo FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', ((CAST('0x' || substr(h, (i // 8) * 10 + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN lo = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN lo <> page_id THEN lo END AS refers_to
FROM p
"""
