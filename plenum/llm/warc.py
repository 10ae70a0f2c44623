"""Legacy archive converter: ARC files to WARC files, and readers of both.

ARC, versions 1 and 2: a file opens with a ``filedesc`` record whose body names the version and its header fields; every
record is a header line, a body of the declared length and a line feed.  The converter reads the fields that the file's version
names and takes exactly the declared bytes, then synthesises what WARC wants and ARC lacks: a record id from a name-based UUID
of address, time and digest, an ISO time stamp, a record type and SHA-256 digests of payload and block.  Payloads of at least
MIN_REVISIT bytes that an earlier record (the smallest id) holds become revisits.

Spark's text sink writes the files, each as one string that ends with the sink's line separator, so files are committed
whole and survive lost executors.  A file is closed as soon as it has FILE_BYTES, so reading one whole takes memory for those
and one record, however page sizes cluster.
"""

import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.exact_dedup import FAN_IN, n_levels, tree_merge
from plenum.llm.scratch import shared_dir, stored

MIN_REVISIT = 100
FILE_BYTES = 8 << 20
# Header fields by ARC version, and the first archive date that pages get.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
EPOCH = datetime(1996, 1, 1, tzinfo=UTC)
PAGE_HEADER = "X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filed(record: Callable[[dict, int], bytes], opening: Callable[[int, int], bytes], separator: bytes, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to whole files, as one string each: a file is full when its bytes reach ``most``, so a large record ends one.

    ``record`` gets a row and the file's number in its task, ``opening`` the task and that number.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, n
            file, held, size, n = separator.join(held), [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([file], pa.binary()).view(pa.string())], ["value"])

        for batch in batches:
            for i in range(len(batch)):
                if not held:
                    held.append(opening(part, n))
                held.append(record(batch.slice(i, 1).to_pylist()[0], n))
                size += len(held[-1])
                if size >= most:
                    yield close()
        if held:
            yield close()

    return gather


def _write_files(files: DataFrame, separator: str, path: str) -> None:
    """Files (a row each, one column) by the text sink, from the partitions that they have: nothing is shuffled to write."""
    writer = files.write.option("lineSep", separator).option("maxRecordsPerFile", 1)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _version(n: int) -> int:
    return n % 2 + 1


def _filedesc(part: int, n: int) -> bytes:
    version = _version(n)
    text = f"{version} 0 plenum\n{ARC_FIELDS[version]}\n"
    more = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://pages-{part}-{n}.arc 0.0.0.0 {EPOCH:%Y%m%d%H%M%S} text/plain{more} {len(text)}\n{text}".encode()


def _arc_record(row: dict, n: int) -> bytes:
    body = row["body"]
    more = f" 200 - - 0 {n}.arc" if _version(n) == 2 else ""
    return f"{row['url']} 0.0.0.0 {row['date']} text/html{more} {len(body)}\n".encode() + body


def write_arc(pages: DataFrame, path: str) -> None:
    """Pages (page_id, url, html) as ARC files below ``path``, in turn in version 1 and 2.

    The body of a record is an HTTP response.  White space in an address is percent-encoded, a null one is ``unknown:``.
    """
    page = F.coalesce(F.concat(F.lit(f"{PAGE_HEADER}: "), F.col("page_id").cast("long").cast("string"), F.lit("\r\n")), F.lit(""))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), page, F.lit("\r\n"), F.coalesce("html", F.lit("")))
    seconds = F.coalesce(F.pmod(F.col("page_id").cast("long"), F.lit(20 * 365 * 86400)), F.lit(0))
    date = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + seconds).cast("timestamp_ntz"), "yyyyMMddHHmmss")
    url = F.coalesce(F.nullif(F.regexp_replace(F.col("url"), r"\s", "%20"), F.lit("")), F.lit("unknown:"))
    rows = pages.select(url.alias("url"), date.alias("date"), body.cast("binary").alias("body"))
    _write_files(rows.mapInArrow(_filed(_arc_record, _filedesc, b"\n", FILE_BYTES), "value string"), "\n", path)


# ---- reading ARC ----------------------------------------------------------------------------------------------------------

_PAGE = re.compile(rb"(?im)^" + PAGE_HEADER.encode() + rb":[ \t]*(-?\d+)")
ARC_KEY = "arc string, at long, page_id long, url string, date string, n_bytes long, digest string"


def arc_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place in the file, header fields by name, body) of every record but ``filedesc``, by declared lengths."""
    names, at = ARC_FIELDS[1].split(), 0
    while at < len(raw):
        end = raw.find(b"\n", at)
        line = raw[at : len(raw) if end < 0 else end]
        if not line.strip():
            at += len(line) + 1
            continue
        opening = line.startswith(b"filedesc://")
        length = int(line.rsplit(b" ", 1)[1])
        body = raw[end + 1 : end + 1 + length]
        if end < 0 or len(body) < length:
            raise ValueError(f"the record at {at} declares {length} bytes and has {len(body)}")
        if opening:
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            names = body.split(b"\n")[1].decode("ascii").split() or ARC_FIELDS[version].split()
        else:
            values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
            yield at, dict(zip(names, values, strict=True)), body
        at = end + 1 + length


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header block with its blank line, and payload; a body without an HTTP header is all payload."""
    head, blank, payload = body.partition(b"\r\n\r\n")
    return (head + blank, payload) if blank and head.startswith(b"HTTP/") else (b"", body)


def _page_id(head: bytes) -> int | None:
    m = _PAGE.search(head)
    return int(m[1]) if m else None


def _unzipped(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def read_arc(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """A row per ARC record: ARC_KEY, with ``bodies`` also the body."""
    schema = ARC_KEY + (", body binary" if bodies else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, fields, body in arc_records(_unzipped(content.as_py())):
                    head, payload = split_http(body)
                    row = (name.as_py(), at, _page_id(head), fields["URL"], fields["Archive-date"], len(payload), hashlib.sha256(payload).hexdigest())
                    rows.append((*row, body) if bodies else row)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, schema)


# ---- synthesising and reading WARC ----------------------------------------------------------------------------------------


def record_id(url: str, date: str, digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page_id}')}>"


def iso(date: str) -> str:
    """An ARC date of 14 digits, or its first 8 or 12, as WARC writes it."""
    return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def to_warc(url: str, date: str, body: bytes, refers: tuple[int, str, str] | None = None) -> bytes:
    """One WARC record up to its last line end; ``refers``: the response's page_id, address and date, of a revisit."""
    head, payload = split_http(body)
    digest = hashlib.sha256(payload).hexdigest()
    block = body if refers is None else head
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(url, date, digest, _page_id(head))}", f"WARC-Date: {iso(date)}", f"WARC-Target-URI: {url}"]
    if refers is not None:
        page, its_url, its_date = refers
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(its_url, its_date, digest, page)}", f"WARC-Refers-To-Target-URI: {its_url}", f"WARC-Refers-To-Date: {iso(its_date)}", f"Plenum-Refers-To-Page: {page}", f"Plenum-Payload-Length: {len(payload)}"]
    fields += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    kind = "application/http; msgtype=response" if head else "application/octet-stream"
    fields += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n"


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """The ARC files below ``arc`` as WARC files below ``warc``.

    Of equal payloads of MIN_REVISIT bytes or more the record with the smallest page id (null last, then place) is the
    response and the others revisit it; a third of all payloads may be equal, so they meet in a tree of runs.
    """
    keys = stored(read_arc(spark, arc), "arc")
    levels = n_levels(keys)
    first = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("arc"), F.col("at"), F.col("url"), F.col("date"))
    dealt = keys.filter(F.col("n_bytes") >= MIN_REVISIT).withColumn("place0", F.pmod(F.xxhash64("arc", "at"), F.lit(FAN_IN**levels)))
    won = tree_merge(dealt, ["digest"], first, levels)
    is_first = (F.col("first.arc") == F.col("arc")) & (F.col("first.at") == F.col("at"))
    # A revisit names its response by id; where no record of a group has one, all stay responses.
    revisits = dealt.join(won, ["place0", "digest"]).filter(~is_first & F.col("first.page_id").isNotNull())
    refers = revisits.select("arc", "at", F.struct("first.page_id", "first.url", "first.date").alias("refers"))

    bodies = read_arc(spark, arc, bodies=True).join(refers, ["arc", "at"], "left").select("url", "date", "body", "refers")
    _write_files(bodies.mapInArrow(_filed(_warc_record, _warcinfo, b"\r\n", FILE_BYTES), "value string"), "\r\n", warc)


def _warc_record(row: dict, n: int) -> bytes:
    refers = row["refers"]
    return to_warc(row["url"], row["date"], row["body"], refers and (refers["page_id"], refers["url"], refers["date"]))


def _warcinfo(part: int, n: int) -> bytes:
    """A file's first record, which says what made it."""
    name = f"pages-{part}-{n}.warc.gz"
    block = b"software: plenum\r\nformat: WARC File Format 1.1\r\n"
    fields = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Filename: {name}"]
    fields += ["Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n"


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of every record, by declared lengths."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"the record at {at} declares {length} bytes and has {len(block)}")
        yield fields, block
        at = end + 4 + length + 4


WARC_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, url string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per WARC record but ``warcinfo``; a response's payload digest is computed anew and must equal the one declared."""
    names = [x.split()[0] for x in WARC_ROW.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(_unzipped(content.as_py())):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    size = len(payload) if kind == "response" else int(fields["plenum-payload-length"])
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
                        raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                    refers = int(fields["plenum-refers-to-page"]) if kind == "revisit" else None
                    rows.append((_page_id(head), size, said, kind, refers, fields["warc-record-id"], fields["warc-date"], fields["warc-target-uri"]))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(parse, WARC_ROW)


def archived(pages: DataFrame) -> DataFrame:
    """Pages through ARC files, the converter and WARC files, read back: WARC_ROW, a row per page.

    Null html is an empty payload; a null url is ``unknown:``; null page ids come back null, repeated rows are records of
    their own (a revisit may then name its own id); an empty table gives no rows.  Other columns are not read.
    """
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write_arc(pages, f"{path}/arc")
    convert(spark, f"{path}/arc", f"{path}/warc")
    return read_warc(spark, f"{path}/warc")
