"""WARC archives: written with Spark's text sink, read back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, scratch_path, stored

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in a file at most, and payload bytes in a file on average: a file is read in one piece, and chains of n
#: records take log2(n) rounds.
RECORDS_PER_FILE = 1000
BYTES_PER_FILE = 32 << 20
#: A record can only start where a file does or behind a blank line.
_MAGIC = re.compile(rb"(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*$", re.M)


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 40-digit hex string: four letters for each five hex digits."""
    letters = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.lit(_BASE32).substr(F.shiftright(v, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE, compression: str = "gzip") -> None:
    """One record a row, in WARC 1.1 files under `path`, gzipped as wholes unless compression is "none".

    Records are dealt to files by the digest of their payload, as many files as make bytes_per_file on average; copies
    of a payload meet in one file without it, as revisits.

    Among rows with equal payloads of at least min_bytes bytes, the one with the largest id is a response and the others
    are revisits of it. Null payload: empty. Null url: urn:none; blanks and control characters in a url are escaped.
    A null id is written as `none` and ranks lowest; rows that tie on the largest id are all responses. Only the digest
    and the largest id of each payload are shuffled to decide, pre-aggregated where the pages are read.
    """
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), F.coalesce(pages[url_col].cast("string"), F.lit("urn:none")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    top = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("id").alias("top"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_per_file))
    met = rows.repartition(files, "digest", "size").join(top, ["digest", "size"], "left").withColumn("again", (F.col("size") >= min_bytes) & F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    line = lambda name, v: F.concat(F.lit(name + ": "), v, F.lit("\r\n"))
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("top"))), line("X-Payload-Length", F.col("size").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(F.col("again"), F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
        body,
    )
    met.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def _page(urn: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", urn or b"")
    return int(m[1]) if m else None


def plain(content: bytes) -> bytes:
    """The bytes of a file as they are, or unpacked, gzip members in a row; up to where a damaged or cut one breaks."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            for at in range(0, len(content), 1 << 20):
                out.append(member.decompress(content[at : at + (1 << 20)]))
                if member.eof:
                    break
        except zlib.error:
            return b"".join(out)
        if not member.eof:
            return b"".join(out)
        content = member.unused_data + content[at + (1 << 20) :]
    return b"".join(out) if out else content


def candidates(content: bytes):
    """(offset, successor, fields, payload span) wherever a record could start: magic, header, length and end fit.

    A header holds no blank line, so the headers of two candidates never overlap and are read once.
    """
    for m in _MAGIC.finditer(content):
        end = content.find(b"\r\n\r\n", m.end() - 2)
        if end < 0:
            continue
        fields = {k.lower(): v for k, v in _FIELD.findall(content[m.end() : end].replace(b"\r\n", b"\n"))}
        size = fields.get(b"content-length", b"")
        if not size.isdigit():
            continue
        start = end + 4
        past = start + int(size)
        if content[past : past + 4] == b"\r\n\r\n":
            yield m.start(), past + 4, fields, (start, past)


_COLUMNS = "file string, offset long, successor long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, intact boolean"


def _candidate_rows(with_payload: bool):
    def rows(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                content = plain(content.as_py())
                out = []
                for at, after, f, (s, e) in candidates(content):
                    kind = f.get(b"warc-type", b"").decode("utf-8", "replace")
                    stated = f.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
                    digest = base64.b32encode(hashlib.sha1(content[s:e]).digest()).decode()
                    again = kind == "revisit"
                    size = f.get(b"x-payload-length", b"")
                    out.append((path, at, after, kind, _page(f.get(b"warc-record-id")), f.get(b"warc-target-uri", b"").decode("utf-8", "replace"), stated if again else digest, (int(size) if size.isdigit() else None) if again else e - s, _page(f.get(b"warc-refers-to")), again or digest == stated, content[s:e] if with_payload else None))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                names = [x.split()[0] for x in _COLUMNS.split(", ")] + ["payload"]
                n = len(names) if with_payload else len(names) - 1
                for i in range(0, len(out), 200):
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out[i : i + 200]], kinds[j]) for j in range(n)], names[:n])

    return rows


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the records on the chain from offset 0 of each file, by pointer jumping.

    links: (file, offset, successor). In round r each pointer leads 2^r records on and the records known to be on the
    chain mark the ones they point to, so a chain of n records takes about log2(n) rounds; each round is stored.
    """
    now = stored(links.select("file", "offset", F.col("successor").alias("jump"), (F.col("offset") == 0).alias("real")), "warc-chain")
    n = now.where("real").count()
    while True:
        marks = now.where("real and jump is not null").select("file", F.col("jump").alias("offset"), F.lit(True).alias("mark")).distinct()
        ahead = now.select("file", F.col("offset").alias("jump"), F.col("jump").alias("far"))
        new = now.join(ahead, ["file", "jump"], "left").join(marks, ["file", "offset"], "left")
        new = stored(new.select("file", "offset", F.col("far").alias("jump"), (F.col("real") | F.col("mark").isNotNull()).alias("real")), "warc-chain")
        drop_stored(now)
        now, was, n = new, n, new.where("real").count()
        if n == was:
            return now.where("real").select("file", "offset")


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all files under `path`: those that the chain of boundaries reaches from the start of a file.

    Magic inside a payload is a candidate like any other, but nothing on the chain leads to it. payload_bytes and
    payload_digest are of the payload as read (of a revisit: as its record states); intact tells if a response's
    payload has its stated digest. A file that does not open with a record gives none; after a damaged record the rest
    of its file is not told, while other files are whole. A gzipped file that is cut or damaged gives what comes before
    the break. Files, gzipped or not, are read in one piece each; offsets are in the plain bytes.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = stored(files.mapInArrow(_candidate_rows(with_payload), _COLUMNS + (", payload binary" if with_payload else "")), "warc-candidates")
    return found.join(reachable(found), ["file", "offset"], "left_semi")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back. No rows: no rows.

    Other columns of the pages are not read. Payloads of any length are one record each.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, id_col, url_col, payload_col, min_bytes)
    return read_archive(pages.sparkSession, path, with_payload)
