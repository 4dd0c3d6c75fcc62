"""WARC archives as a Spark data source.

``spark.dataSource.register(WarcSource)`` adds the format ``warc``.  Writing makes
one archive per task, rolled over at ``roll_bytes``; only archives named in a
manifest that the driver commits are ever read, so a task that was lost or run twice
leaves nothing that counts.  Reading plans one partition per archive, takes equality
and IN predicates on the record type and on header columns, parses a record's header
first and seeks over its block when the header is not wanted or the payload was not
asked for (option ``payload`` = false).  Records are WARC/1.1; the payload lies
gzip-coded in an HTTP response, so that skipping a record inflates nothing.

Files are opened with pyarrow's file systems (local or mounted folders, S3, GCS,
HDFS where libhdfs is installed).
"""
from __future__ import annotations

import gzip
import io
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition,
                                    WriterCommitMessage)

from gatherlens.llm.common import shared_dir, staged

SCHEMA = ("warc_type string, record_id string, target_uri string, page_id long, refers_to long, "
          "payload_digest string, payload_bytes long, payload binary")
HEADER_COLUMNS = ("warc_type", "record_id", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes")
MIN_REVISIT_BYTES = 100
ROLL_BYTES = 256 << 20
BATCH_BYTES = 8 << 20


def _fs(path: str):
    from pyarrow import fs
    # 'file:/x' is how Hadoop prints a local path.
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _line(value: str) -> str:
    """A header value without line ends (they are percent-coded)."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if re.search("[\r\n%]", value) else value


def _unline(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record(row) -> bytes:
    """One WARC record of a row (page_id, url, payload, payload_digest, payload_bytes,
    refers_to); a row with ``refers_to`` is a revisit without payload."""
    revisit = row["refers_to"] is not None
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{row['page_id']}')}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
            ("X-Payload-Bytes", str(row["payload_bytes"]))]
    if row["page_id"] is not None:
        head.append(("X-Page-ID", str(row["page_id"])))
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _line(row["url"])))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        target = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{row['refers_to']}")
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:uuid:{target}>"), ("X-Refers-To-Page", str(row["refers_to"]))]
        block = http + b"\r\n"
    else:
        body = gzip.compress(bytes(row["payload"]), 1, mtime=0)
        block = http + b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode("utf-8") + block + b"\r\n\r\n"


class Archives(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, roll_bytes: int):
        self.path, self.roll_bytes = path, roll_bytes

    def write(self, rows):
        fs, root = _fs(self.path)
        files, out, name, size = [], None, "", 0
        for row in rows:
            if out is None:
                fs.create_dir(root, recursive=True)
                name, size = f"{uuid.uuid4().hex}.warc", 0
                out = fs.open_output_stream(f"{root}/{name}")
            size += out.write(data := record(row)) or len(data)
            if size >= self.roll_bytes:
                out.close()
                files.append([name, size])
                out = None
        if out is not None:
            out.close()
            files.append([name, size])
        return Archives(files)

    def commit(self, messages):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = _fs(self.path)
        for m in messages:
            for name, _ in (m.files if m is not None else []):
                fs.delete_file(f"{root}/{name}")


class Archive(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters):
        """Takes equality and IN on header columns; gives the others back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs
        fs, root = _fs(self.path)
        names = []
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path) as f:
                    names += [n for n, _ in json.loads(f.read())]
        return [Archive(n) for n in sorted(names)] or [Archive("")]

    def read(self, partition):
        if not partition.value:
            return
        fs, root = _fs(self.path)
        rows, held = [], 0
        with fs.open_input_file(f"{root}/{partition.value}") as f:
            for row in records(f, self.wanted, self.payload):
                rows.append(row)
                held += len(row["payload"] or b"") + 256
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
                   for n, t in (c.split() for c in SCHEMA.split(", "))])


def records(raw, wanted: dict, payload: bool):
    """Header columns (and payloads, if asked for) of the records whose header columns
    have the wanted values.  Blocks of other records are seeked over."""
    raw.seek(0, io.SEEK_END)
    end = raw.tell()
    raw.seek(0)
    f = io.BufferedReader(raw, 1 << 20)
    while f.tell() < end:
        line = f.readline()
        if not line.strip():
            continue
        head = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        number = {k: int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page", "x-payload-bytes")}
        row = {"warc_type": head.get("warc-type"), "record_id": head.get("warc-record-id", "").strip("<>"),
               "target_uri": _unline(head["warc-target-uri"]) if "warc-target-uri" in head else None,
               "page_id": number["x-page-id"], "refers_to": number["x-refers-to-page"],
               "payload_digest": head.get("warc-payload-digest", "").partition(":")[2] or None,
               "payload_bytes": number["x-payload-bytes"], "payload": None}
        length = int(head.get("content-length", 0))
        if any(row[k] not in values for k, values in wanted.items()):
            f.seek(length, io.SEEK_CUR)
            continue
        if payload and row["warc_type"] == "response":
            http, _, body = f.read(length).partition(b"\r\n\r\n")
            row["payload"] = gzip.decompress(body) if b"content-encoding: gzip" in http.lower() else body
        else:
            f.seek(length, io.SEEK_CUR)
        yield row


class WarcSource(DataSource):
    """``path``: folder of archives; ``payload``: false reads headers only;
    ``roll_bytes``: size at which a task starts another archive."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", ROLL_BYTES)))


def write_pages(pages: DataFrame, path: str, id_col="page_id", url="url", html="html") -> None:
    """One record per row.  The payload is the html in UTF-8 (null: empty).  Of rows
    with equal payloads of at least 100 bytes the smallest page_id is the response
    (every row with that page_id, if rows repeat); the others are revisits.  Null ids
    never become responses others refer to; a group of nulls only is all responses.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn(
        "payload_bytes", F.length("payload").cast("long"))
    # Only digests that occur twice; few or many, the planner sees the table's size.
    first = staged(rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where("n > 1").drop("n"), "first-pages")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", refers.alias("refers_to")
    ).write.format("warc").option("path", path).mode("append").save()


def read(spark, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back: page_id, payload_bytes and
    payload_digest (of responses computed from the payload that was read; of revisits
    from their headers), record_type, refers_to, target_uri."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    path = path or f"{shared_dir(spark)}/staged/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    full = read(spark, path).where(F.col("warc_type") == "response").select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), "refers_to", "target_uri")
    heads = read(spark, path, payload=False).where(F.col("warc_type") == "revisit").select(
        "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "target_uri")
    return full.unionByName(heads)
