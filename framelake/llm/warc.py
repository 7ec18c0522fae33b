"""WARC archives of pages: written with revisit records, read back, and indexed as globally ordered capture histories."""
from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import new_folder, partitions, written
from framelake.llm.url_filter import url_parts

#: Payload bytes aimed at for one archive file, and the most records of one.
FILE_BYTES, FILE_RECORDS = 16 << 20, 20_000
END = "\r\n"
#: Fixed values of RFC 4648: digits 0-9A-V of a number in base 32, and the alphabet that stands for them.
_DIGITS, _ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:page:"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 40-digit hexadecimal string: each ten digits are forty bits, eight letters."""
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _ALPHABET)


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages plus _payload, _bytes, _sha1 and _first: the largest key among the records with this payload (itself where the
    row is the response or the only one).

    Payloads are told apart by SHA-1 and length, counted before anything is joined; only digests and keys move to their
    groups, so a payload that a third of the rows share costs a few bytes a row. The pages themselves are dealt out once,
    evenly by key, to as many parts as their bytes ask for."""
    spark = pages.sparkSession
    full = (pages.withColumn("_payload", F.coalesce(F.col(html), F.lit(""))).withColumn("_bytes", F.octet_length("_payload").cast("long"))
            .withColumn("_sha1", F.sha1(F.col("_payload").cast("binary"))))
    slim = written(full.select(key, "_bytes", "_sha1"), "digests")
    groups = slim.groupBy("_sha1", "_bytes").agg(F.max(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    known = slim.join(groups, ["_sha1", "_bytes"]).select(F.col(key).alias("_k"), F.col("_sha1").alias("_s"), "_first").distinct()
    total = slim.agg(F.sum("_bytes")).first()[0] or 0
    n = max(partitions(spark), -(-total // FILE_BYTES))
    # null keys are one more value of the join, not a null
    joined = full.withColumn("_k", F.coalesce(F.col(key), F.lit(-1))).repartition(n, "_k", "_sha1")
    found = known.withColumn("_k", F.coalesce("_k", F.lit(-1))).distinct().repartition(n, "_k", "_s").hint("merge")
    return (joined.join(found, (joined["_k"] == found["_k"]) & (joined["_sha1"] == found["_s"]), "left")
            .select(joined["*"], F.coalesce("_first", F.col(key)).alias("_first")).drop("_k"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None) -> None:
    """One WARC/1.1 record per row in gzipped archive files of the folder, by Spark's text writer: a record is its header, an
    empty line and the block, and the writer's line end is the record's end. A response's block is an HTTP response with
    the UTF-8 html (null: empty); a revisit's block is empty. captured: the capture time, by default a second per key from
    2020-01-01 on. Line breaks in urls are percent-encoded; a null url has no target line; extra columns are not written."""
    rows = with_revisits(pages.select(key, url, html), key, html)
    when = F.timestamp_seconds(F.lit(1577836800) + F.coalesce(F.col(key), F.lit(0))) if captured is None else captured
    is_response = F.col(key).eqNullSafe(F.col("_first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("_bytes").cast("string"), F.lit(END * 2))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)  # noqa: E731  null where the value is
    head = F.concat_ws(
        END, F.lit("WARC/1.1"), line("WARC-Type", F.when(is_response, "response").otherwise("revisit")), line("WARC-Record-ID", urn(F.col(key))),
        line("WARC-Date", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("_sha1")))), line("WARC-Payload-Length", F.col("_bytes").cast("string")),
        F.when(~is_response, line("WARC-Refers-To", urn(F.col("_first")))),
        F.when(~is_response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.when(is_response, F.octet_length(http) + F.col("_bytes")).otherwise(F.lit(0)).cast("string")))
    record = F.concat(head, F.lit(END * 2), F.when(is_response, F.concat(http, F.col("_payload"))).otherwise(""))
    (rows.select(record.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder))


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed, then the rest without the scheme, so captures of a site stand together."""
    host, _ = url_parts(url)
    if not host:
        return url or ""
    at = url.find("://") + 3 + len(host)
    return ",".join(reversed(host.split("."))) + ")" + url[at:]


def records(stream):
    """(offset, header fields, block) of each record of an unpacked archive, read one by one by Content-Length."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        size, fields = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield at, fields, block
        at += size + 2 + n + 4


CAPTURE = ("url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "file string, position long")


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(digits) if digits else None


def _sort_key(row) -> tuple:
    return row[0], row[1], -(2 ** 63) if row[2] is None else row[2]


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record: each archive file is a run sorted by url key, capture time and page. Size and digest of a
    response are those of the payload read; a digest that differs from the header's is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")

    def parse(batches):
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                run = []
                for at, f, block in records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["warc-payload-length"])
                    if f["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest:
                            raise ValueError(f"damaged payload in {path} at byte {at}")
                    url = f.get("warc-target-uri")
                    run.append((url_key(url), f["warc-date"], _page(f["warc-record-id"]), url, size, digest, f["warc-type"], _page(f.get("warc-refers-to")), path.rsplit("/", 1)[-1], at))
                run.sort(key=_sort_key)
                yield _frame(run)

    return files.mapInPandas(parse, CAPTURE)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in CAPTURE.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.astype({n: "Int64" for n in ("page_id", "payload_bytes", "refers_to", "position")})


class LoserTree:
    """Merges k sorted runs: every inner node keeps the loser of its match, so the next smallest row costs log2 k matches."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(runs))
        self.rows: list = [None] * self.k
        self.keys: list = [None] * self.k                   # None: the run is used up
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i, filling=True)

    def _advance(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.rows[i], self.keys[i] = row, None if row is None else self.key(row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and x <= y

    def _replay(self, winner: int, filling: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            if filling and self.losers[node] < 0:
                self.losers[node] = winner                  # the first to arrive waits for its opponent
                return
            if not self._before(winner, self.losers[node]):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.keys[best := self.losers[0]] is not None:
            yield self.rows[best]
            self._advance(best)
            self._replay(best)


def merge_histories(captures: DataFrame) -> DataFrame:
    """The runs of all archives as one index, ordered by url key, capture time and page over all partitions.

    Rows are dealt out by ranges of that whole key, so a url with very many captures spans several tasks. Each task merges
    the parts of the runs that fall into its range with a loser tree; it holds the index rows of its range only."""
    n = partitions(captures.sparkSession)

    def merge(batches):
        runs: dict[str, list] = {}
        for frame in batches:
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                runs.setdefault(row[8], []).append(row)
        for r in runs.values():
            r.sort(key=_sort_key)                           # already in order, unless a task was run again
        out = []
        for row in LoserTree([runs[name] for name in sorted(runs)], _sort_key):
            out.append(row)
            if len(out) == 10_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return captures.repartitionByRange(n, "url_key", "captured", "page_id", "file", "position").mapInPandas(merge, CAPTURE)


def archive_and_index(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes pages as archives, reads them back and returns the merged capture index: page_id, url_key, captured, url,
    payload_bytes, payload_digest (bare base-32 SHA-1), record_type, refers_to, file, position.

    Of records with equal payloads (empty ones too) that with the largest page_id is the response and the others revisit
    it; rows with equal payload and that same largest page_id are responses both. A null page_id stays null; such rows
    revisit a row that has one, or are all responses. An empty table gives no rows."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder, **columns)
    return merge_histories(written(read_archives(spark, folder), "captures"))
