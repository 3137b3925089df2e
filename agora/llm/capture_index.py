"""WARC archives with a two-level capture index.

Writing: each task writes its rows into WARC files below a shared folder, a gzip
member per record, and hands back where each record lies. The captures are then
sorted by reversed-host URL key over all partitions; each partition writes one
shard: blocks of ``LINES`` sorted index lines, compressed one by one, and a sparse
directory with the first key and place of every block.

Reading: the shards' key ranges (a row per partition of the sort) say which shards
a key can be in. A task of a shard searches its directory by bisection, reads the
block by its byte range and scans it from the key on; sorted keys mean that a
block is read once. The records found are read by byte range as well, neighbours
in one range.

A payload of at least ``LEAST`` bytes that several captures share is written once,
in the response with the smallest key; the others become revisit records that
name it. Files of task attempts that Spark did not commit may stay in the folder;
nothing points at them.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.session import scratch_path, write_shared

LEAST, LINES = 100, 3000
#: Bytes after which a task goes on in a new file; bytes read at once.
FILE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Captures of one shard, about.
SHARD = 300_000
_SPLIT = 1000
_PLAIN = re.compile(r"[!-~]*")
_RECORD = "key string, page_id bigint, url string, type string, refers_to bigint, digest string, bytes bigint, file string, offset bigint, length bigint"
_READ = "page_id bigint, url string, type string, refers_to bigint, digest string, bytes bigint, sound boolean, payload binary"
_CRLF = b"\r\n"


def escaped(url: str) -> str:
    """Blanks, control characters and others than ASCII as percent codes."""
    return url if _PLAIN.fullmatch(url) else quote(url, safe="".join(map(chr, range(33, 127))), errors="surrogatepass")


def url_key(url: str | None) -> str:
    """Reversed-host key: ``https://www.Example.com:443/a?b#c`` is
    ``com,example)/a?b``. Scheme, fragment, a leading ``www.``, user and default
    ports go, the host is lower-cased; a null url has the key ``-``. Any string
    has a key."""
    if url is None:
        return "-"
    u = escaped(url.strip())
    scheme, mark, rest = u.partition("://")
    if not mark:
        scheme, rest = "", u
    rest = rest.partition("#")[0]
    host = re.match(r"[^/?]*", rest)[0]
    path = rest[len(host):]
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    host = host.removeprefix("www.").rstrip(".")
    if port and port != {"http": "80", "https": "443"}.get(scheme.lower()):
        port = ":" + port
    else:
        port = ""
    if not path.startswith("/"):
        path = "/" + path
    return ",".join(reversed(host.split("."))) + port + ")" + path


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _number(value: str | None) -> int | None:
    return None if value in (None, "null") else int(value)


# --------------------------------------------------------------------- records

def _record(row: dict, date: str) -> bytes:
    """One WARC record, uncompressed."""
    payload = row["payload"] or b""
    revisit = row["type"] == "revisit"
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["bytes"])
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <urn:x-capture:{_name(row['page_id'])}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{row['digest']}",
            "Content-Type: application/http; msgtype=response"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {escaped(row['url'])}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-capture:{_name(row['refers_to'])}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def _name(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """WARC fields, block, HTTP fields and payload of one record."""
    end = data.index(_CRLF * 2)
    lines = data[:end].decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = data[end + 4: end + 4 + int(fields["Content-Length"])]
    http, payload = {}, b""
    if fields["WARC-Type"] in ("response", "revisit"):
        cut = block.index(_CRLF * 2)
        http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:])
        payload = block[cut + 4:]
    return fields, block, http, payload


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write_records(folder: str, date: str, file_bytes: int):
    """Task: rows into WARC files; where each record lies."""
    def run(batches):
        store, top = _store(folder)
        out, name, place = None, "", 0
        try:
            for b in batches:
                found = []
                for row in b.to_pylist():
                    if out is None or place >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"warc-{uuid.uuid4().hex}.warc.gz"
                        store.create_dir(top, recursive=True)
                        out, place = store.open_output_stream(f"{top}/{name}", compression=None), 0
                        info = b"software: agora\r\nformat: WARC File Format 1.1\r\n"
                        first = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
                                        f"WARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\n"
                                        f"Content-Length: {len(info)}\r\n\r\n".encode() + info + _CRLF * 2)
                        out.write(first)
                        place = len(first)
                    data = _member(_record(row, date))
                    out.write(data)
                    found.append({**{c: row[c] for c in ("page_id", "url", "type", "refers_to", "digest", "bytes")},
                                  "key": url_key(row["url"]), "file": name, "offset": place, "length": len(data)})
                    place += len(data)
                yield pa.RecordBatch.from_pylist(found, pa.schema([
                    ("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()),
                    ("refers_to", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("file", pa.string()),
                    ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                out.close()
    return run


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (``page_id, url, payload``) with ``digest``, ``bytes``, ``type`` and
    ``refers_to``. Payloads that very many rows share (at most ``_SPLIT`` of them
    can have a thousandth of all rows) are matched by a broadcast, and their rows
    then spread; the others by a join on the digest."""
    body = F.coalesce("payload", F.lit(b""))
    rows = pages.withColumns({"digest": F.sha2(body, 256), "bytes": F.octet_length(body).cast("long")})
    counted = write_shared(rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")), "payloads")
    total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    shared = counted.filter((F.col("copies") > 1) & (F.col("bytes") >= least))
    heavy = shared.filter(F.col("copies") * _SPLIT >= total).select("digest", F.col("first").alias("heavy"))
    light = shared.filter(F.col("copies") * _SPLIT < total).select(F.col("digest").alias("other"), "first")
    rows = rows.join(F.broadcast(heavy), "digest", "left")
    other = F.when(F.col("heavy").isNull(), F.col("digest")).otherwise(F.concat_ws(":", "digest", "page_id"))
    rows = rows.withColumn("other", other).join(light, "other", "left").withColumn("first", F.coalesce("heavy", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", "bytes",
                       F.when(revisit, "revisit").otherwise("response").alias("type"),
                       F.when(revisit, F.col("first")).alias("refers_to"))


# ----------------------------------------------------------------------- index

@dataclass
class Archive:
    """``folder`` holds WARC files, index shards and their directories;
    ``shards``: ``(first key, last key, file)`` of every shard, in key order."""

    folder: str
    shards: list[tuple[str, str, str]]


def _write_shard(folder: str, lines: int):
    """Task: sorted captures into one shard and its directory of blocks."""
    def run(batches):
        store, top = _store(folder)
        name, out, place, held, blocks, last = f"index-{uuid.uuid4().hex}", None, 0, [], [], None

        def block():
            nonlocal place
            data = _member("\n".join(f"{k} {j}" for k, j in held).encode())
            out.write(data)
            blocks.append([held[0][0], place, len(data)])
            place += len(data)
            held.clear()

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))
            for key, *rest in zip(*columns):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                held.append((key, json.dumps(rest)))
                last = key
                if len(held) == lines:
                    block()
        if out is not None:
            if held:
                block()
            out.close()
            with store.open_output_stream(f"{top}/{name}.dir", compression=None) as d:
                d.write(_member(json.dumps(blocks).encode()))
            yield pa.RecordBatch.from_pydict({"first": [blocks[0][0]], "last": [last], "file": [name]})
    return run


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
                  least: int = LEAST, lines: int = LINES, shard: int = SHARD, file_bytes: int = FILE_BYTES,
                  date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> Archive:
    """Write ``pages`` (an integer id, a url, a text payload) as WARC files with
    their index, into ``folder`` or a new one in the shared checkpoint folder.

    A null payload is empty; a null url has no target field and the key ``-``. Of
    captures with equal payloads of at least ``least`` bytes the one with the
    smallest id is the response; rows that repeat that id (and payload) are
    responses as well, and so are all if no id is there. A null id beside others
    makes a revisit. Other columns are ignored; an empty table makes an archive
    without shards.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, f"agora-{uuid.uuid4().hex}")
    rows = decided(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                                F.col(payload).cast("binary").alias("payload")), least)
    kept = write_shared(rows.mapInArrow(_write_records(f"{folder}/warc", date, file_bytes), _RECORD), "captures")
    parts = max(1, -(-kept.count() // shard))
    ordered = (kept.select("key", "page_id", "file", "offset", "length")
               .repartitionByRange(parts, "key", "page_id", "file", "offset")
               .sortWithinPartitions("key", "page_id", "file", "offset"))
    made = write_shared(ordered.mapInArrow(_write_shard(f"{folder}/index", lines), "first string, last string, file string"), "shards")
    # a row per partition of the sort
    return Archive(folder, [tuple(r) for r in made.orderBy("first", "last").collect()])


class _Shard:
    """A shard's directory, and the block read last."""

    def __init__(self, folder: str, name: str):
        self.store, top = _store(f"{folder}/index")
        self.file = self.store.open_input_file(f"{top}/{name}")
        with self.store.open_input_stream(f"{top}/{name}.dir", compression=None) as d:
            self.blocks = json.loads(gzip.decompress(d.read()))
        self.first = [b[0] for b in self.blocks]
        self.at, self.lines = -1, []

    def _read(self, i: int) -> None:
        if i != self.at:
            _, offset, length = self.blocks[i]
            data = gzip.decompress(self.file.read_at(length, offset)).decode()
            self.at, self.lines = i, [line.split(" ", 1) for line in data.split("\n")]

    def find(self, key: str):
        """Every capture of the key: from the last block that begins below it on."""
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.blocks) and self.first[i] <= key:
            self._read(i)
            j = bisect.bisect_left(self.lines, key, key=lambda x: x[0])
            while j < len(self.lines) and self.lines[j][0] == key:
                yield json.loads(self.lines[j][1])
                j += 1
            i += 1


def url_keys(urls: DataFrame, url: str = "url") -> DataFrame:
    """The distinct ``key`` values of a table of urls."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])
    return urls.select(F.col(url).cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """``(key, page_id, file, offset, length)`` of every capture of the distinct
    ``keys``; keys that are not there give nothing."""
    kind = "key string, page_id bigint, file string, offset bigint, length bigint"
    shards = archive.shards
    if not shards:
        return keys.sparkSession.createDataFrame([], kind)
    first, last = [s[0] for s in shards], [s[1] for s in shards]

    def deal(batches):
        for b in batches:
            found_k, found_s = [], []
            for k in b.column("key").to_pylist():
                # ranges are in order and may share their ends
                for s in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k)):
                    found_k.append(k)
                    found_s.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(found_k, pa.string()), pa.array(found_s, pa.int32())], names=["key", "shard"])

    def search(batches):
        at, shard = -1, None
        for b in batches:
            out = []
            for k, s in zip(b.column("key").to_pylist(), b.column("shard").to_pylist()):
                if s != at:
                    at, shard = s, _Shard(archive.folder, shards[s][2])
                out += [(k, *x) for x in shard.find(k)]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["key", "page_id", "file", "offset", "length"])

    # a shard's keys may go to several tasks, so that no shard holds one up
    dealt = keys.mapInArrow(deal, "key string, shard int")
    return (dealt.repartitionByRange(max(2, 2 * len(shards)), "shard", "key").sortWithinPartitions("shard", "key")
            .mapInArrow(search, kind))


def fetch(archive: Archive, captures: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of ``captures`` (``file, offset, length``), read by byte range:
    ``(page_id, url, type, refers_to, digest, bytes, sound, payload)``. ``bytes`` and
    ``digest`` are of the full payload; a revisit has them from its fields.
    ``sound``: whether the payload read has the digest that its record names."""
    def run(batches):
        store, top = _store(f"{archive.folder}/warc")
        name, file = None, None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
            i = 0
            while i < len(rows):
                j = i + 1
                while (j < len(rows) and rows[j][0] == rows[i][0] and rows[j][1] == rows[j - 1][1] + rows[j - 1][2]
                       and rows[j][1] + rows[j][2] - rows[i][1] <= RANGE_BYTES):
                    j += 1
                if rows[i][0] != name:
                    name = rows[i][0]
                    file = store.open_input_file(f"{top}/{name}")
                start = rows[i][1]
                data = file.read_at(rows[j - 1][1] + rows[j - 1][2] - start, start)
                out = []
                for _, offset, length in rows[i:j]:
                    fields, _, http, payload = parse_record(gzip.decompress(data[offset - start: offset - start + length]))
                    revisit = fields["WARC-Type"] == "revisit"
                    said = fields["WARC-Payload-Digest"].partition(":")[2]
                    own = said if revisit else hashlib.sha256(payload).hexdigest()
                    refers = fields.get("WARC-Refers-To")
                    out.append({
                        "page_id": _number(fields["WARC-Record-ID"][15:-1]), "url": fields.get("WARC-Target-URI"),
                        "type": fields["WARC-Type"], "refers_to": _number(refers and refers[15:-1]), "digest": own,
                        "bytes": int(http["Content-Length"]) if revisit else len(payload), "sound": own == said,
                        "payload": payload if keep_payload and not revisit else None})
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()),
                    ("digest", pa.string()), ("bytes", pa.int64()), ("sound", pa.bool_()), ("payload", pa.binary())]))
                i = j

    return (captures.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / (8 * RANGE_BYTES)))
            .sortWithinPartitions("file", "offset").mapInArrow(run, _READ))
