"""Deterministic sharded WARC archives, written and read back.

Records are range-sorted by (page_id, url, digest), so the same table gives the same shards and files. A task writes
its shard record by record, each its own gzip member with headers and digests made afresh, and starts a new file when
the compressed size reaches ``roll_bytes``. Files are written under a temporary name that carries the attempt and
renamed when they are whole; then the shard's manifest (file, bytes, records, SHA-256 of the file) is renamed into
place. A task that is run again after a loss writes the same bytes to the same names. Readers take the files from the
manifest, check each file's digest and size, and check each payload's digest.

Of records with equal payloads of ``min_revisit`` bytes or more, the one with the smallest page_id is a response and
the others are revisits without a payload.

Defined cases: null html is an empty payload; a null url gives no target header; a record with a null page_id is a
response, and never an owner; rows that repeat page_id and payload are written once each and have the same type; an
empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, input_partitions, ship, table


@dataclass(frozen=True)
class WarcParams:
    roll_bytes: int = 64 << 20
    min_revisit: int = 100
    level: int = 6
    date: str = "2000-01-01T00:00:00Z"


_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:strandloom:warc")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}|{digest}')}>"


def header_value(text: str) -> str:
    """A value that fits on one header line: control characters and percent signs before hex digits are escaped."""
    return re.sub(r"[\x00-\x1f\x7f]|%(?=[0-9A-Fa-f]{2})", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    block = b"\r\n".join(http) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """Files of one shard; whole files only are ever under their final names."""

    def __init__(self, root: str, shard: int, attempt: str, roll: int):
        self.fs, self.dir = _place(root)
        self.fs.create_dir(self.dir, recursive=True)
        self.shard, self.attempt, self.roll, self.files, self.out = shard, attempt, roll, [], None

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{len(self.files):05d}.warc.gz"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.dir}/.{self.name}.{self.attempt}", compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.size += len(member)
        self.records += 1
        self.sha.update(member)
        if self.size >= self.roll:
            self.close_file()

    def close_file(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.commit(f".{self.name}.{self.attempt}", self.name)
            self.files.append({"shard": self.shard, "file": self.name, "bytes": self.size, "records": self.records, "sha256": self.sha.hexdigest()})

    def commit(self, temporary: str, name: str) -> None:
        try:
            self.fs.move(f"{self.dir}/{temporary}", f"{self.dir}/{name}")
        except OSError:  # some stores don't rename over a file that an earlier attempt left
            self.fs.delete_file(f"{self.dir}/{name}")
            self.fs.move(f"{self.dir}/{temporary}", f"{self.dir}/{name}")

    def finish(self) -> list[dict]:
        self.close_file()
        if self.files:
            name = f"manifest-{self.shard:06d}.json"
            with self.fs.open_output_stream(f"{self.dir}/.{name}.{self.attempt}") as f:
                f.write(json.dumps(self.files).encode())
            self.commit(f".{name}.{self.attempt}", name)
        return self.files


def _write(root: str, p: WarcParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get()
        shard = _Shard(root, at.partitionId(), f"{at.attemptNumber()}-{at.taskAttemptId()}", p.roll_bytes)
        for pdf in batches:
            for page, url, html, digest, refers in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["html"], pdf["digest"], pdf["refers_to"].astype("Int64")):
                raw = record(None if page is pd.NA else int(page), url, (html or "").encode("utf-8", "surrogatepass"), digest, None if refers is pd.NA else int(refers), p.date)
                z = zlib.compressobj(p.level, zlib.DEFLATED, 31)
                shard.write(z.compress(raw) + z.flush())
        if files := shard.finish():
            yield pd.DataFrame(files, columns=["shard", "file", "bytes", "records", "sha256"])

    return run


def members(stream, sha, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The contents of the gzip members of a stream; ``sha`` takes in what was read."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        if not rest:
            sha.update(data)
        rest = b""
        if not data:
            if out:
                raise ValueError("the archive ends within a record")
            return
        out.append(z.decompress(data))
        if z.eof:
            rest = z.unused_data
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parse(raw: bytes) -> dict:
    """A record's headers, and its payload for a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    of = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(of["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != of["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {of['WARC-Record-ID']}")
    if of["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if f"sha256:{hashlib.sha256(payload).hexdigest()}" != of["WARC-Payload-Digest"] or len(payload) != int(of["Payload-Length"]):
            raise ValueError(f"payload digest of {of['WARC-Record-ID']}")
        of["payload"] = payload
    return of


def _read(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _place(root)
        for pdf in batches:
            for f in pdf.itertuples():
                rows, sha = [], hashlib.sha256()
                with fs.open_input_stream(f"{top}/{f.file}", compression=None) as stream:
                    for raw in members(stream, sha):
                        of = parse(raw)
                        page, refers = of.get("Page-ID"), of.get("Refers-To-Page-ID")
                        rows.append((page and int(page), int(of["Payload-Length"]), of["WARC-Payload-Digest"].removeprefix("sha256:"), of["WARC-Type"], refers and int(refers)))
                if len(rows) != f.records or sha.hexdigest() != f.sha256:
                    raise ValueError(f"{f.file} isn't what its manifest says")
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def write_archives(pages: DataFrame, work: Workspace, params: WarcParams = WarcParams(), folder: str = "warc") -> tuple[DataFrame, str]:
    """Write (page_id, url, html); give the manifest (shard, file, bytes, records, sha256) and the archives' folder."""
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    # owners of payloads that several pages hold; only ids and digests travel here
    held = rows.filter(F.col("bytes") >= params.min_revisit).select("page_id", "digest")
    owners = held.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    again = work.save(held.join(owners, "digest").filter(F.col("page_id") > F.col("refers_to")).distinct(), f"{folder}-revisits")
    typed = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    shards = input_partitions(pages.sparkSession)
    root = f"{work.path}/{folder}"
    keys = ["page_id", "url", "digest"]
    ordered = typed.select("page_id", "url", "html", "digest", "refers_to").repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
    manifest = work.save(ordered.mapInPandas(_write(root, params), "shard int, file string, bytes long, records long, sha256 string"), f"{folder}-manifest")
    return manifest, root


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """What the archives of a manifest hold, every digest checked."""
    return manifest.repartition(input_partitions(manifest.sparkSession), "file").mapInPandas(_read(root), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(*write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), Workspace(spark, "op4")))
