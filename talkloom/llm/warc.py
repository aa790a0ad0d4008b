"""Legacy ARC archives to WARC: conversion, writing and reading back."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.llm.support import cut, join_by_key, new_folder, small_batches, stored, table

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Repeated payloads up to this number are broadcast (about 150 bytes each); beyond, they are joined by a shuffle.
BROADCAST_REPEATED = 200_000
#: Bytes after which a new ARC archive, and a new WARC file, begins.
ARCHIVE_BYTES, FILE_BYTES = 4 << 20, 128 << 20
#: Bytes of payload after which records that are read go on as a batch.
BATCH_BYTES = 8 << 20
CAPTURED = "19970701120000"
#: Fields of a header line by version of the format; the address may hold spaces in old archives, the others don't.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def arc_header(version: int, url: str, date: str, content_type: str, length: int, ip: str = "0.0.0.0") -> bytes:
    values = {"url": url, "ip": ip, "date": date, "content_type": content_type, "length": length, "result": 200}
    return " ".join(str(values.get(f, "-")) for f in FIELDS[version]).encode() + b"\n"


def arc_archive(records: list[tuple[str, bytes]], version: int = 1, date: str = CAPTURED) -> bytes:
    """An archive of (url, block): the version block, then each record behind its header line."""
    names = {
        1: "URL IP-address Archive-date Content-type Archive-length",
        2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
    }
    about = f"{version} 0 talkloom\n{names[version]}\n".encode()
    parts = [arc_header(version, "filedesc://archive.arc", date, "text/plain", len(about)), about, b"\n"]
    for url, block in records:
        parts += [arc_header(version, url, date, "text/html", len(block)), block, b"\n"]
    return b"".join(parts)


def parse_arc(archive: bytes) -> Iterator[dict]:
    """The records of an archive behind its version block: the header line's fields, block and truncated.

    The version block says how many fields the lines have; the declared length says where a block ends. A block
    that the archive's end cuts off is returned as far as it goes. A header line that has too few fields or no
    length raises ValueError.
    """
    at, version = 0, None
    while at < len(archive):
        if archive[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = archive.find(b"\n", at)
        line = archive[at : end if end >= 0 else len(archive)].rstrip(b"\r")
        if version is None and not line.startswith(b"filedesc:"):
            raise ValueError(f"no version block at byte {at}")
        length = line.rsplit(b" ", 1)[-1]
        if end < 0 or not length.isdigit():
            raise ValueError(f"no header line at byte {at}")
        start = end + 1
        block = archive[start : start + int(length)]
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        else:
            values = line.rsplit(b" ", len(FIELDS[version]) - 1)
            if len(values) != len(FIELDS[version]):
                raise ValueError(f"{len(values)} fields at byte {at}")
            yield dict(zip(FIELDS[version], (v.decode("utf-8", "replace") for v in values))) | {
                "block": block, "truncated": len(block) < int(length), "position": at
            }
        at = start + int(length)


def _clean_url(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\s\x00-\x1f]", "%20")


def pages_to_arc(
    pages: DataFrame, version: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """archive (binary): the pages of each task as archives of a few MB, of one version or of both in turn.

    The page's id, URL-encoded, is a header of its response; a null id has none.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    named = F.coalesce(
        F.concat(F.lit("X-Page-Id: "), F.url_encode(F.col(f"`{id_col}`").cast("string")), F.lit("\r\n")), F.lit("")
    )
    head = F.concat(F.lit("HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), named, F.lit("\r\n"))
    rows = pages.select(
        _clean_url(F.col(f"`{url_col}`")).alias("url"), F.concat(head, html).cast("binary").alias("block")
    )

    small_batches(pages.sparkSession)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = made = 0

        def archive() -> pa.RecordBatch:
            nonlocal made
            made += 1
            whole = arc_archive(held, version or 1 + made % 2)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["archive"])

        for batch in batches:
            for url, block in zip(batch.column("url"), batch.column("block")):
                held.append((url.as_py(), block.as_py()))
                size += len(held[-1][1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return rows.mapInArrow(archives, "archive binary")


CONVERTED = "record_id string, uri string, date string, ip string, content_type string, truncated boolean, http_header binary, payload binary, payload_bytes long, payload_digest string, page_id string"
HTTP_END = b"\r\n\r\n"


def _page_id(header: bytes) -> str | None:
    for line in header.split(b"\r\n")[1:]:
        if line.lower().startswith(b"x-page-id:"):
            return unquote_plus(line.split(b":", 1)[1].strip().decode("utf-8", "replace"))
    return None


def _split_block(block: bytes) -> tuple[bytes, bytes]:
    """Header and payload; a block that doesn't start with an HTTP status line is payload."""
    at = block.find(HTTP_END) if block.startswith(b"HTTP/") else -1
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (b"", block)


def _batches_of(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES (or 4,096 rows)."""
    held: list[tuple] = []
    bytes_held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for row in rows:
        held.append(row)
        bytes_held += size(row)
        if bytes_held >= BATCH_BYTES or len(held) >= 4096:
            yield batch()
            held, bytes_held = [], 0
    if held:
        yield batch()


def convert_arc(archives: DataFrame, archive_col: str = "archive") -> DataFrame:
    """What a WARC record needs of each ARC record: identifier, date, type and digest are made from the old record.

    The identifier is a name-based UUID of the whole record (address, date, block) and of where it was met (task,
    archive, position), so it is unique, and a task that runs again gives the same one. A block that starts with an
    HTTP status line is header and payload; any other is payload.
    """
    names = [f.split()[0] for f in CONVERTED.split(", ")]

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            met = 0
            for batch in batches:
                for archive in batch.column(0):
                    if not archive.is_valid:
                        continue
                    met += 1
                    for r in parse_arc(archive.as_py()):
                        header, payload = _split_block(r["block"])
                        d = r["date"].ljust(14, "0")
                        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                        place = f"{task} {met} {r['position']} {r['url']}\n{r['date']}\n"
                        name = hashlib.sha256(place.encode() + r["block"]).hexdigest()
                        yield (
                            f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", r["url"], date, r["ip"], r["content_type"],
                            r["truncated"], header, payload, len(payload), hashlib.sha256(payload).hexdigest(), _page_id(header),
                        )

        yield from _batches_of(rows(), names, TYPES, lambda row: row[8])

    return archives.select(F.col(f"`{archive_col}`").alias("archive")).mapInArrow(converted, CONVERTED)


TYPES = [
    {
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()
    }[f.split()[1]] for f in CONVERTED.split(", ")
]


def with_revisits(records: DataFrame, least: int = LEAST_REVISIT, key: Column | None = None) -> DataFrame:
    """records with record_type and refers_to (the identifier of the response that a revisit repeats).

    Of records with equal payloads of at least so many bytes, the one of least key (then identifier) is the
    response. Records without a key come last.
    """
    key = F.col("page_id") if key is None else key
    rank = F.struct(key.isNull().alias("last"), key.alias("key"), F.col("record_id").alias("id"))
    long_enough = F.col("payload_bytes") >= least
    groups = records.where(long_enough).groupBy("payload_digest").agg(
        F.count("*").alias("__n"), F.min(rank).alias("first")
    ).where("__n > 1")
    groups = stored(groups.select("payload_digest", "__n", F.col("first.id").alias("__first")), "repeated")
    if groups.count() <= BROADCAST_REPEATED:
        met = records.where(long_enough).join(F.broadcast(groups.drop("__n")), "payload_digest", "left")
    else:
        met = join_by_key(records.where(long_enough), groups, ["payload_digest"], "__n", records.count(), "left")
    short = records.where(~long_enough).withColumn("__first", F.lit(None).cast("string"))
    joined = met.unionByName(short)
    again = F.col("__first").isNotNull() & (F.col("__first") != F.col("record_id"))
    kind = F.when(again, "revisit").otherwise("response")
    return joined.select(
        *records.columns, kind.alias("record_type"), F.when(again, F.col("__first")).alias("refers_to")
    )


def warc_record(columns: DataFrame) -> Column:
    """The bytes of a record up to the blank lines that end it; of a revisit, the block is the HTTP header alone."""
    block = F.when(
        F.col("record_type") == "revisit", F.col("http_header")
    ).otherwise(F.concat("http_header", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda shown, *x: F.when(shown, line(*x)).otherwise(F.lit(""))
    again = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")), line("WARC-IP-Address", F.col("ip")), line(
            "WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")
        ),
        optional(
            again, "WARC-Refers-To", F.coalesce("refers_to", F.lit(""))
        ), optional(again, "WARC-Profile", F.lit(PROFILE)), optional(
            F.col("truncated"), "WARC-Truncated", F.lit("unspecified")
        ),
        line(
            "Content-Type",
            F.when(
                F.octet_length("http_header") > 0, F.lit("application/http;msgtype=response")
            ).otherwise(F.col("content_type"))
        ),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), block)


def gzip_member(data: bytes) -> bytes:
    """data as a gzip member of its own, which standard readers can find and read alone.

    A member ends in the high byte of its length, which is zero below 16 MB; beyond, an empty member follows.
    """
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(data) + packer.flush()
    return member if member.endswith(b"\0") else member + gzip_member(b"")


def warc_info(name: str, date: str) -> bytes:
    about = b"software: talkloom\r\nformat: WARC File Format 1.1\r\n"
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: {date}\r\n"
    return head.encode() + f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n".encode() + about


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Archives *.warc.gz under path: a gzip member a record, files that end after so many bytes, each begun by a
    warcinfo record.

    Spark's text writer puts the members in files: its line end is the zero byte that each member ends in.
    """
    spark = records.sparkSession
    small_batches(spark)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    run = uuid.uuid4().hex

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            file, size, place = -1, file_bytes, 0
            for batch in batches:
                for record in batch.column(0):
                    if size >= file_bytes:
                        file, size = file + 1, 0
                        member = gzip_member(warc_info(f"{run} {task} {file}", date) + HTTP_END)
                        yield member[:-1], file, place
                    member = gzip_member(record.as_py() + HTTP_END)
                    size, place = size + len(member), place + 1
                    yield member[:-1], file, place

        yield from _batches_of(
            rows(), ["value", "file", "place"], [pa.binary(), pa.int32(), pa.int64()], lambda row: len(row[0])
        )

    members = records.select(warc_record(records).alias("record")).mapInArrow(
        packed, "value binary, file int, place long"
    )
    ordered = members.sortWithinPartitions("file", "place")
    ordered.select(
        F.col("value").cast("string").alias("value"), "file"
    ).write.partitionBy("file").option("lineSep", "\0").text(path)
    _name_archives(spark, path)


def _name_archives(spark: SparkSession, path: str) -> None:
    """Moves Spark's part files to path itself, under the names that archives have: a rename a file."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    folder = place(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for sub in files.listStatus(folder):
        if sub.isDirectory():
            for part in files.listStatus(sub.getPath()):
                if part.getPath().getName().startswith("part-"):
                    files.rename(part.getPath(), place(folder, f"talkloom-{n:06d}.warc.gz"))
                    n += 1
            files.delete(sub.getPath(), True)


def unpacked(content: bytes, fed: int = 1 << 14, most: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of gzip members, so many at most at once."""
    at, rest = 0, b""
    reader = zlib.decompressobj(31)
    while True:
        some = reader.unconsumed_tail or rest
        rest = b""
        if not some:
            if at >= len(content):
                break
            some = content[at : at + fed]
            at += len(some)
        data = reader.decompress(some, most)
        if data:
            yield data
        if reader.eof:
            rest = reader.unused_data
            reader = zlib.decompressobj(31)


class Pieces:
    """What a parser reads of a stream of pieces: lines and so many bytes. Only what is asked for is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held, self.at = self.held[self.at :] + piece, 0
        return bool(piece)

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0 and self._more():
            pass
        end = len(self.held) if end < 0 else end + 1
        line, self.at = self.held[self.at : end], end
        return line

    def read(self, n: int) -> bytes:
        parts = [self.held[self.at : self.at + n]]
        got, self.at = len(parts[0]), self.at + len(parts[0])
        while got < n and (piece := next(self.pieces, b"")):
            parts.append(piece[: n - got])
            self.held, self.at = piece, len(parts[-1])
            got += len(parts[-1])
        return b"".join(parts)


def parse_warc(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record: names in lower case; the block is as long as its record says."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        yield fields, file.read(int(fields["content-length"]))


READ = "page_id string, record_id string, record_type string, refers_to string, uri string, date string, payload_bytes long, payload_digest string"


def _read_record(fields: dict[str, str], block: bytes) -> tuple:
    header, payload = _split_block(block)
    whole = fields["warc-type"] != "revisit"
    digest = hashlib.sha256(payload).hexdigest() if whole else fields["warc-payload-digest"].removeprefix("sha256:")
    where = fields["warc-target-uri"], fields["warc-date"]
    return _page_id(header), fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), *where, len(payload) if whole else None, digest


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of *.warc.gz archives but for warcinfo: what their fields say, and length and digest of the payloads
    as stored. A task holds one packed file and one record of it."""
    names = [f.split()[0] for f in READ.split(", ")]
    types = [pa.int64() if f.endswith(" long") else pa.string() for f in READ.split(", ")]
    small_batches(spark)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(0):
                    for fields, block in parse_warc(Pieces(unpacked(content.as_py()))):
                        if fields["warc-type"] != "warcinfo":
                            yield _read_record(fields, block)

        yield from _batches_of(rows(), names, types, lambda row: 500)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(parsed, READ)


def warc_round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read from written archives.

    The pages go through ARC archives of both versions, their conversion, WARC files in the shared folder and back. A
    null html is an empty payload, a null address about:blank; rows without an id have none in the result either.
    Rows that repeat an id are records of their own: of equal ones, one is the response. Other columns are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    records = stored(convert_arc(pages_to_arc(pages, None, id_col, url_col, html_col)), "converted")
    path = new_folder(spark, "warc")
    write_warc(with_revisits(records, key=F.col("page_id").cast(kind)), path)
    back = stored(read_warc(spark, path), "read-back")
    again = back.where("record_type = 'revisit'").select(
        "page_id", "payload_digest", "record_type", F.col("refers_to").alias("record_id")
    )
    times = again.groupBy("record_id").agg(F.count("*").alias("n"))
    whole = back.where("record_type = 'response'")
    referred = cut(
        whole.join(times, "record_id").select("record_id", "n", "payload_bytes", F.col("page_id").alias("refers_to"))
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = join_by_key(again, referred, ["record_id"], "n", again.count()).select(*columns)
    both = whole.withColumn("refers_to", F.lit(None).cast("string")).select(*columns).union(again)
    return both.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first, row_number() OVER (PARTITION BY d ORDER BY page_id) AS place FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {LEAST_REVISIT} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_REVISIT} AND place > 1 THEN first END AS refers_to
FROM f
"""
