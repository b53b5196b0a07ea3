"""WARC archives and a capture index merged from sorted runs.

Writing: of records with equal payloads of at least ``REVISIT`` bytes the one with the largest id is a response, the others
are revisits that name it; smaller payloads are always responses.  Records are laid out by DataFrame expressions, and each is a gzip
member of its own, so that offset and length of the index lead to it; any file system of Spark's will do.

Reading: every archive is parsed on its own, digests are made anew from the payloads, and its captures are sorted by URL key
(host labels reversed, then path) and timestamp: one run per archive.  Sampled splitters deal the runs over ranges of about ``RANGE``
captures, as many as the captures need.  A range's task merges its share of the k runs with a loser tree; ranges are ordered, so all
of them together are the global order, and a URL with very many captures is cut between timestamps.

An archive holds about ``ARCHIVE`` bytes of payload and is parsed as a whole; one page may be up to 2 GB.  Null html is an empty payload.  Null URLs have no target and sort first.  Line ends in URLs are percent-encoded.  Null ids are
responses and no one's original; rows with equal ids and payloads are responses alike.  Pages have no time of
capture: it is ``EPOCH`` plus the id in seconds, in UTC; ids beyond the year 9999 start again at ``EPOCH``.  Columns beside page_id, url and
html are not read, whatever their names.  An empty table gives an empty archive and index.
"""

from __future__ import annotations

import gzip
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorloom.plans.recovery import settled, shared_folder

REVISIT = 1000
EPOCH = 1704067200
#: Seconds from EPOCH to the end of the year 9999.
PERIOD = 253402300800 - EPOCH
END = "\r\n"
#: Captures per range, bytes of payload per archive, gzip's level.
RANGE, ARCHIVE, LEVEL = 16384, 32 << 20, 3
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def captured(page_id: Column) -> Column:
    """WARC-Date of a page in UTC, whatever the session's zone: ``EPOCH`` and the id in seconds, around again after the year 9999."""
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)).cast("long"), F.lit(PERIOD))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86400)).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400)).cast("int")
    return F.format_string("%sT%02d:%02d:%02dZ", day, F.floor(rest / 3600).cast("int"), F.pmod(F.floor(rest / 60), F.lit(60)).cast("int"), F.pmod(rest, F.lit(60)))


def revisits(rows: DataFrame) -> DataFrame:
    """_page, _digest, _original: the captures (page_id, digest, size of the payload) that repeat another's payload."""
    heavy = rows.where((F.col("_size") >= REVISIT) & F.col("page_id").isNotNull()).select(F.col("page_id").alias("_page"), "_digest").distinct()
    originals = settled(heavy.groupBy("_digest").agg(F.max("_page").alias("_original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return heavy.join(originals, "_digest").where("_original <> _page")


def records(pages: DataFrame) -> DataFrame:
    """One column, value: a WARC record of each page (needs page_id, url, html) with its final line ends."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(F.encode(html, "UTF-8"))).alias("_digest"), F.octet_length(html).cast("long").alias("_size"))
    # Payloads meet the few bytes of a revisit by id and digest, so no payload of many pages meets in one key.
    rows = rows.join(revisits(rows).withColumnRenamed("_digest", "_same"), (F.col("page_id") == F.col("_page")) & (F.col("_digest") == F.col("_same")), "left")
    revisit = F.col("_original").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("_size"), F.lit(END + END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "), name(F.col("page_id")), F.lit(f"{END}WARC-Date: "), captured(F.col("page_id")),
        F.coalesce(F.concat(F.lit(f"{END}WARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.lower(F.hex("_digest")),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Refers-To: "), name(F.col("_original")), F.lit(f"{END}WARC-Profile: {_PROFILE}"))).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "), F.octet_length(block), F.lit(END + END),
    )
    return rows.select(F.concat(head, block, F.lit(END + END)).alias("value"))


def member(raw: bytes) -> bytes:
    """``raw`` as a gzip member whose last byte is 0, that of its length; an empty member follows one of 16 MB or more."""
    made = gzip.compress(raw, LEVEL, mtime=0)
    return made if made.endswith(b"\0") else made + gzip.compress(b"", LEVEL, mtime=0)


def write(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` below ``path``: every record is a gzip member of its own, so that it can be read alone.

    Spark's text writer ends each row with a separator, which is here the 0 that every member ends with.
    """

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_arrays([pa.array([member(x.as_buffer().to_pybytes())[:-1] for x in batch.column(0).slice(lo, 256)], pa.binary())], names=["value"])

    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    many = max(1, ARCHIVE * n // max(1, size or 0) if size else 1 << 16)
    records(pages).mapInArrow(compress, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", min(many, 1 << 16)).mode("error").text(path)


def members(raw: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members of an archive; empty members belong to the one before."""
    at, found = 0, None
    while at < len(raw):
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if end >= len(raw):
                raise ValueError(f"cut off record at {at}")
            parts.append(unpack.decompress(raw[end : end + (1 << 16)]))
            end = min(len(raw), end + (1 << 16))
        end -= len(unpack.unused_data)
        content = b"".join(parts)
        if content:
            if found:
                yield found
            found = at, end - at, content
        elif found:
            found = found[0], end - found[0], found[2]
        at = end
    if found:
        yield found


def parse(raw: memoryview) -> Iterator[dict]:
    """Captures of one archive, in its order; offset and length are those of its gzip member in the file."""
    for at, length, record in members(raw):
        end = record.index(b"\r\n\r\n")
        lines = record[:end].decode().split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        block = record[end + 4 : end + 4 + int(head["Content-Length"])]
        cut = block.index(b"\r\n\r\n") + 4
        kind = head["WARC-Type"]
        declared = int(re.search(rb"Content-Length: (\d+)", block[:cut])[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response":
            payload = block[cut:]
            if len(payload) != declared or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"damaged record at {at}")
        yield {
            "url": head.get("WARC-Target-URI"), "timestamp": head["WARC-Date"], "page_id": _id(head["WARC-Record-ID"]),
            "payload_bytes": declared, "payload_digest": digest, "record_type": kind,
            "refers_to": _id(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "offset": at, "length": length,
        }


def _id(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def url_key(url: str | None) -> str:
    """``http://b.a.example/x?y`` becomes ``example,a,b)/x?y``, A-Z of the host lower-cased; null is empty."""
    if url is None:
        return ""
    rest = url.partition("://")[2] or url
    cut = re.search(r"[/?#]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    return ",".join(reversed(host.lower().split("."))) + ")" + path


def _place(capture: dict) -> tuple:
    page = capture["page_id"]
    return url_key(capture["url"]), capture["timestamp"], page is not None, page or 0, capture["payload_digest"]


class LoserTree:
    """Merges sorted iterators of tuples: each step replays one path of a tournament whose inner nodes keep the losers."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes first; runs that ended go last, ties by run."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.tree[node]
            if other < 0:  # still being built: wait here for an opponent
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


_CAPTURE = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()),
])
_SCHEMA = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _CAPTURE)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below ``path`` with range and place: the global order by url_key and timestamp."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                name = posixpath.basename(file.as_py())
                run = sorted(((_place(c), c) for c in parse(memoryview(content.as_buffer()))), key=lambda p: p[0])
                for lo in range(0, len(run), 1 << 13):
                    part = [c | {"url_key": p[0], "file": name, "seq": lo + k} for k, (p, c) in enumerate(run[lo : lo + (1 << 13)])]
                    yield from pa.Table.from_pylist(part, _CAPTURE).combine_chunks().to_batches()

    captures = settled(files.mapInArrow(runs, _SCHEMA))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by([("file", "ascending"), ("seq", "ascending")])
        columns = [whole.column(c).to_pylist() for c in ("url_key", "timestamp", "page_id", "payload_digest", "file")]
        cuts = [k for k in range(whole.num_rows) if not k or columns[4][k] != columns[4][k - 1]] + [whole.num_rows]

        def walk(lo: int, hi: int) -> Iterator[tuple]:
            for k in range(lo, hi):
                page = columns[2][k]
                yield columns[0][k], columns[1][k], page is not None, page or 0, columns[3][k], k

        order = [x[5] for x in LoserTree([walk(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:])])]
        place = pa.table({"range": pa.array(np.full(len(order), TaskContext.get().partitionId())), "place": pa.array(np.arange(len(order)))})
        for c in _CAPTURE.names:
            if c != "seq":
                place = place.append_column(c, whole.column(c).take(pa.array(order, pa.int64())))
        yield from place.combine_chunks().to_batches(max_chunksize=1 << 13)

    # Spark samples the splitters of so many ranges itself; the number of ranges grows with that of captures.
    ranged = captures.repartitionByRange(1 + captures.count() // RANGE, "url_key", "timestamp", "page_id", "payload_digest")
    return ranged.mapInArrow(merge, "range long, place long, " + _SCHEMA.removesuffix(", seq long"))


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` below ``path`` (a new folder in the shared one by default) and gives the merged index of what was read back."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return index(spark, path)


#: DuckDB: what the archives must say.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s FROM p),
o AS (SELECT s, max(page_id) AS o FROM d WHERE n >= {REVISIT} GROUP BY s)
SELECT page_id, n AS payload_bytes, d.s AS payload_digest,
       CASE WHEN n >= {REVISIT} AND o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT} AND o <> page_id THEN o END AS refers_to
FROM d LEFT JOIN o ON o.s = d.s
"""
