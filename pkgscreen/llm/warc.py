"""WARC archives and the external merge of their capture index.

``write`` puts one record per page into gzip-per-record archives in the shared
folder and returns the manifest of the files whose tasks succeeded (a repeated
task writes new files; what it left behind is in no manifest). Pages whose
payload equals that of a page with a smaller id become revisit records without
payload. ``read`` streams archives, checks and digests payloads and yields each
archive's captures as a run sorted by URL key, time and page. ``merge`` ranges the
key space over (URL key, time, page), so that one URL with a third of all
captures is split too, and merges the sorted runs that meet in a range with a
loser tree; (range, place) is the global order of the capture history.

Defined results: null html is an empty payload, null url a record without target
(its key is empty); payloads under ``min_bytes`` are never revisits; a null
page_id has a record of its own kind (always response); rows that repeat an id and
payload are recorded each, all of one kind; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgscreen.llm.base import scratch_path, written

ARCHIVE_BYTES = 256 << 20
MIN_BYTES = 0
EPOCH = dt.datetime(2024, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"
CAPTURE = ("page_id long, url string, url_key string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "archive string, at long")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, lower case, without scheme, www, default port and fragment."""
    if not url:
        return ""
    m = re.match(r"(?:([a-z][a-z0-9+.\-]*):)?//([^/?#]*)([^#]*)", url, re.I)
    if not m:
        return url.partition("#")[0].lower()
    scheme, host, rest = (m[1] or "").lower(), m[2].lower().rpartition("@")[2], m[3]
    host = re.sub(r":(80)$" if scheme == "http" else r":(443)$", "", host).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = _digest(payload)
    name = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    when = (EPOCH + dt.timedelta(seconds=(page or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    block = HEAD.format(len(payload)).encode() + (payload if refers_to is None else b"")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {when}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\r\n%]", lambda c: f"%{ord(c[0]):02X}", url))
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _writer(root: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = store = path = None
        done, size, count = [], 0, 0
        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, local = pafs.FileSystem.from_uri(path)
                    store.create_dir(local.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(local, compression=None)
                record = _record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                out.write(record)
                size, count = size + len(record), count + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            path, count, size = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(count, pa.int64()), pa.array(size, pa.int64())], ["archive", "records", "bytes"])

    return write


def write(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all pages in the shared folder; the manifest (archive, records, bytes)."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("_w_hash"))
    heads = (rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).where("page_id IS NOT NULL").groupBy("_w_hash")
             .agg(F.min("page_id").alias("_w_head"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("_w_hash").alias("_w_same"), "_w_head"))
    heads = written(heads, "heads")
    joined = rows.join(heads, F.col("_w_hash") == F.col("_w_same"), "left")
    refers = F.when(F.col("_w_head") < F.col("page_id"), F.col("_w_head"))
    root = scratch_path(spark, "warc")
    return written(joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_writer(root, archive_bytes), "archive string, records long, bytes long"), "manifest")


def records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records of a gzip-per-record archive."""
    at, data = 0, b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            return
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    raise OSError("archive ends within a record")
            parts.append(inflate.decompress(data))
            used += len(data) - len(inflate.unused_data)
            data = inflate.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
        yield at, fields, rest[:int(fields["Content-Length"])]
        at += used


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            store, local = pafs.FileSystem.from_uri(archive)
            run = []
            with store.open_input_stream(local, compression=None) as stream:
                for at, field, block in records(stream):
                    payload, said = block.partition(b"\r\n\r\n")[2], field["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = field["WARC-Type"] == "response"
                    if response and _digest(payload) != said:
                        raise OSError(f"payload of {field['WARC-Record-ID']} in {archive} does not match its digest")
                    url = field.get("WARC-Target-URI")
                    url = re.sub("%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url) if url is not None else None
                    run.append((_page(field["WARC-Record-ID"]), url, url_key(url), re.sub(r"\D", "", field["WARC-Date"]), field["WARC-Type"],
                                _page(field.get("WARC-Refers-To")), len(payload) if response else None, said, archive, at))
            run.sort(key=_order)
            for i in range(0, len(run), 10_000):
                yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r)) for r in run[i:i + 10_000]], _SCHEMA)


_FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]
_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in CAPTURE.split(", ")])


def _order(r: tuple) -> tuple:
    return r[2], r[3], -1 << 63 if r[0] is None else r[0], r[8], r[9]


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Captures of all archives, a task per archive; each archive's captures are a sorted run."""
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInArrow(_reader, CAPTURE)


class LoserTree:
    """k-way merge of sorted lists: inner nodes hold the losers of their matches, so each step replays one path."""

    def __init__(self, runs: list[list], key):
        self.k = max(1, len(runs))
        self.its = [iter(r) for r in runs] + [iter(())] * (self.k - len(runs))
        self.key, self.head, self.lost = key, [None] * self.k, [0] * self.k
        for i in range(self.k):
            self._pull(i)
        self.lost[0] = self._play(1) if self.k > 1 else 0

    def _pull(self, i: int) -> None:
        item = next(self.its[i], None)
        self.head[i] = None if item is None else (self.key(item), item)

    def _beats(self, i: int, j: int) -> bool:
        return self.head[i] is not None and (self.head[j] is None or (self.head[i][0], i) < (self.head[j][0], j))

    def _play(self, node: int) -> int:
        """Winner below ``node``; leaves are the numbers k to 2k-1."""
        winner: dict[int, int] = {}
        for n in range(2 * self.k - 1, node - 1, -1):
            if n >= self.k:
                winner[n] = n - self.k
            else:
                a, b = winner.pop(2 * n), winner.pop(2 * n + 1)
                winner[n], self.lost[n] = (a, b) if self._beats(a, b) else (b, a)
        return winner[node]

    def __iter__(self):
        while self.head[self.lost[0]] is not None:
            i = self.lost[0]
            yield self.head[i][1]
            self._pull(i)
            n = (i + self.k) // 2
            while n >= 1:
                if self._beats(self.lost[n], i):
                    self.lost[n], i = i, self.lost[n]
                n //= 2
            self.lost[0] = i


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the sorted runs that reach a range; a run is an ascending stretch of the rows as they come."""
    runs, last = [], None
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            key = _order(r)
            if last is None or key < last:
                runs.append([])
            runs[-1].append(r)
            last = key
    out, place = [], 0
    for r in LoserTree(runs, _order) if runs else ():
        out.append(dict(zip(_FIELDS, r)) | {"place": place})
        place += 1
        if len(out) == 10_000:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA.append(pa.field("place", pa.int64())))
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _SCHEMA.append(pa.field("place", pa.int64())))


def merge(captures: DataFrame) -> DataFrame:
    """The capture history: ``captures`` in global order of (range, place)."""
    keys = ["url_key", "captured", "page_id", "archive", "at"]
    return captures.repartitionByRange(*keys).mapInArrow(_merger, CAPTURE + ", place long").withColumn("range", F.spark_partition_id())


def resolved(history: DataFrame) -> DataFrame:
    """``history`` with the payload length of revisits taken from the response they refer to."""
    answers = history.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("_w_page"), F.col("payload_bytes").alias("_w_bytes")).dropDuplicates(["_w_page"])
    revisits = history.where("record_type = 'revisit'").join(written(answers, "answers"), F.col("refers_to") == F.col("_w_page"), "left")
    revisits = revisits.withColumn("payload_bytes", F.col("_w_bytes")).select(*history.columns)
    return history.where("record_type = 'response'").unionByName(revisits)


def archive_and_index(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write, read back and merge: the capture history of all pages."""
    captures = written(read(pages.sparkSession, write(pages, min_bytes)), "captures")
    return resolved(written(merge(captures), "history"))
