"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary, then one frame
a record. Tasks write files of bounded size to the shared folder under a name of
their attempt and move them to their final name, so a lost or repeated task
leaves whole files only.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, shared_dir, small_batches
from .textkit import table

MAGIC = 0x184D2A5D  # the skippable frame that archives keep a dictionary in
SAMPLES, SAMPLE_CHARS, DICTIONARY = 512, 16_384, 65_536
FILE_BYTES = 32 << 20
LEAST = 100  # payloads below are never revisits
LEVEL = 3


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """Trained on records; where they are too few for training, their own bytes; empty without any."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; it names the digest, the length and the record it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[dict]:
    """Records of a decompressed archive, one at a time."""
    held = b""

    def until(mark: bytes) -> bytes | None:
        nonlocal held
        while mark not in held:
            more = stream.read(1 << 16)
            if not more:
                return None
            held += more
        out, _, held = held.partition(mark)
        return out

    def exactly(n: int) -> bytes:
        nonlocal held
        parts = [held[:n]]
        n -= len(parts[0])
        held = held[len(parts[0]) :]
        while n:
            more = stream.read(n)
            if not more:
                raise ValueError("archive ends inside a record")
            parts.append(more)
            n -= len(more)
        return b"".join(parts)

    while (head := until(b"\r\n\r\n")) is not None:
        fields = dict(x.split(": ", 1) if ": " in x else (x, "") for x in head.decode().split("\r\n")[1:])
        block = exactly(int(fields["Content-Length"]))
        if exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        yield {"fields": fields, "payload": payload, "size": size}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path.replace("file:", "file://", 1) if path.startswith("file:") else "file://" + path)


def _typed(pages: DataFrame) -> DataFrame:
    """pages with payload digest and length, and the page each revisit refers to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    facts = own.where(F.octet_length("payload") >= LEAST).where("page_id is not null").select("page_id", "digest")
    first = facts.groupBy("digest").agg(F.min("page_id").alias("refers"), F.max("page_id").alias("top")).where("refers < top").select("digest", "refers")
    again = facts.join(first, "digest").where("page_id > refers").distinct()
    # by page and digest, so a payload that very many pages share is dealt to many tasks
    return own.join(again, ["page_id", "digest"], "left")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives all pages below folder, once; (path, records, bytes) of each file."""
    typed = _typed(pages)
    # ids first: tasks then send few bytes, and the texts of the chosen ones alone follow
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.expr(f"cast(substring(coalesce(html, ''), 1, {SAMPLE_CHARS}) AS BINARY)").alias("payload"))
    ids = own.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLES)
    few = own.join(F.broadcast(ids), "page_id").withColumn("digest", F.sha2("payload", 256)).orderBy(F.xxhash64("page_id"), "page_id").limit(2 * SAMPLES)
    samples = [record("response", r.page_id, r.url, bytes(r.payload), r.digest, None) for r in few.collect()]
    raw = build_dictionary(samples)
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, attempt = TaskContext.get(), uuid.uuid4().hex
        store, root = _place(folder)
        made: list[tuple[str, int, int]] = []
        out, count, size, temp = None, 0, 0, ""
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_content_size=True)

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                # a second attempt may deal records to files differently, so no attempt writes over another's files
                final = f"{root}/part-{task.partitionId():06d}-{len(made):04d}-{attempt}.warc.zst"
                store.move(temp, final)
                made.append((f"{folder}/{final.rsplit('/', 1)[1]}", count, size))
                out = None

        store.create_dir(root, recursive=True)
        for b in batches:
            for page_id, digest, url, payload, refers in zip(*[b.column(c) for c in ("page_id", "digest", "url", "payload", "refers")]):
                if out is None:
                    temp = f"{root}/.{task.partitionId()}-{attempt}"
                    out, count = store.open_output_stream(temp, compression=None), 0
                    out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
                    size = 8 + len(raw)
                kind = "response" if refers.as_py() is None else "revisit"
                frame = writer.compress(record(kind, page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py()))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= FILE_BYTES:
                    close()
        close()
        yield table(schema, **{f.name: [m[i] for m in made] for i, f in enumerate(schema)})

    order = ["page_id", "digest", "url", "payload", "refers"]
    return cut(typed.select(*order).mapInArrow(run, "path string, records long, bytes long"))


def read(files: DataFrame) -> DataFrame:
    """Records of the archives named in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )
    number = lambda s: int(s[10:-1]) if len(s) > 11 else None  # noqa: E731  of <urn:page:N>

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = _place(path)
                with store.open_input_stream(at, compression=None) as f:
                    magic, n = struct.unpack("<II", f.read(8))
                    if magic != MAGIC:
                        raise ValueError(f"{path} does not begin with a dictionary frame")
                    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(f.read(n))).stream_reader(f, read_across_frames=True)
                    rows, held = [], 0
                    for r in parse(reader):
                        fields, kind = r["fields"], r["fields"]["WARC-Type"]
                        digest = hashlib.sha256(r["payload"]).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"][7:]
                        if digest != fields["WARC-Payload-Digest"][7:]:
                            raise ValueError(f"a payload in {path} does not have its digest")
                        rows.append((number(fields["WARC-Record-ID"]), r["size"], digest, kind, number(fields.get("WARC-Refers-To", "")), r["payload"] if kind == "response" else None))
                        held += len(r["payload"])
                        if held > 8 << 20:
                            yield table(schema, **{c.name: [x[i] for x in rows] for i, c in enumerate(schema)})
                            rows, held = [], 0
                    yield table(schema, **{c.name: [x[i] for x in rows] for i, c in enumerate(schema)})

    sql = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return files.select("path").repartition(parts, F.xxhash64("path")).mapInArrow(run, sql)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages, reads the archives back and returns their records (see :func:`read`).

    A null html is an empty payload. Equal payloads of ``LEAST`` bytes or more are
    kept once, with the smallest page_id; rows that repeat that id and payload are
    responses too. Pages with a null id are responses and nothing refers to them.
    An empty table makes no files.
    """
    small_batches(pages.sparkSession)
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder))
