"""Web archives whose records are compressed one by one against a shared dictionary.

An archive starts with a skippable frame that holds a Zstandard dictionary, built
from records of the very collection; each record then is a frame of its own, so
any record can be read from its offset. Of records with equal payloads, one is a
response and the others are revisits that name it and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import file_system, one_file_each, remember, with_columns, written
from foldwise.sources.tables import shared_path

#: Magic number of the skippable frame with the dictionary, from the published format for such archives.
FRAME = 0x184D2A5D
LEVEL, ARCHIVE_BYTES = 3, 1 << 28
#: The dictionary is trained on at most this many records, on at most so many bytes of each; its size.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 800, 8192, 112_640
LEAST_REVISIT = 1000


def train_dictionary(pages: DataFrame, payload: str = "html", sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A dictionary from a bounded sample: the distinct payloads whose hashes are smallest. Empty if there is too little to learn from."""
    import zstandard
    keyed = pages.select(F.encode(F.substring(payload, 1, SAMPLE_BYTES), "UTF-8").alias("p"), F.xxhash64(payload).alias("h")).where("length(p) > 0")
    # Hashes first, so that no task sends more than those to the driver.
    most = keyed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = keyed.where(F.col("h") <= most).groupBy("h").agg(F.first("p").alias("p")).orderBy("h", "p").collect() if most is not None else []
    samples = [bytes(r.p)[:SAMPLE_BYTES] for r in rows]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4 + 1024), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # samples too small or too alike
        return b""


def with_references(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """pages' key, url and payload with the payload's SHA-1 and refers_to, the key of the response that a revisit refers to.

    Of equal payloads of at least `least` bytes the largest key is the response; rows that share that key are all responses. Null keys are
    smaller than any; a group with null keys alone is all responses. Digests are grouped before the join, so that a payload is one row there,
    and payloads too small to refer to each other are dealt out by their keys.
    """
    p = pages.withColumn("payload", F.coalesce(F.encode(payload, "UTF-8"), F.lit(b""))).drop(payload)
    p = p.withColumn("digest", F.sha1("payload"))
    big = F.length("payload") >= least
    p = p.withColumn("by", F.when(big, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    groups = p.where(big).groupBy(F.col("by").alias("of")).agg(F.max(key).alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    j = p.join(groups, F.col("by") == F.col("of"), "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col(key)), F.col("response"))
    return j.select(key, "url", "payload", "digest", refers.alias("refers_to"))


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as it stands in the archive before compression."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {''.join((url or '').split())}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return fields | {"payload": rest[:n]}


class ArchiveWriter:
    """Memory: one record and what the stream buffers."""

    def __init__(self, stream, dictionary: bytes):
        import zstandard
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd, self.stream = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True), stream
        self.n, self.at = 0, 8 + len(dictionary)
        stream.write(struct.pack("<II", FRAME, len(dictionary)) + dictionary)

    def add(self, raw: bytes) -> int:
        """Returns the offset of the record."""
        frame, at = self.zstd.compress(raw), self.at
        self.stream.write(frame)
        self.n, self.at = self.n + 1, self.at + len(frame)
        return at


def read_archive(source, offset: int | None = None, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, all or the one at an offset, with memory for one record and a chunk."""
    import zstandard
    magic, n = struct.unpack("<II", source.read(8))
    if magic != FRAME:
        raise ValueError("the archive does not start with its dictionary")
    raw = source.read(n)
    d = zstandard.ZstdCompressionDict(raw) if raw else None
    if offset is not None:
        source.seek(offset)
    left = b""
    while True:
        left = left or source.read(chunk)
        if not left:
            return
        one, out = zstandard.ZstdDecompressor(dict_data=d).decompressobj(), io.BytesIO()
        while left:
            out.write(one.decompress(left))
            left = one.unused_data if one.eof else source.read(chunk)
            if one.eof:
                break
        if not one.eof:
            raise ValueError("the archive is cut off in a record")
        yield out.getvalue()
        if offset is not None:
            return


MANIFEST = "path string, n_records long"


def write_archives(rows: DataFrame, dictionary: bytes, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of with_references() to archives, one or more for each task; returns the table of archives.

    A task that is run again writes new files; only those of tasks that ended well are in the returned table. An empty table has none.
    """
    def run(batches):
        fs, root = file_system(folder)
        done, out, part = [], None, TaskContext.get().partitionId()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.zst"
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out = ArchiveWriter(stream, dictionary)
                out.add(record(*row))
                if out.at >= archive_bytes:
                    stream.close()
                    done.append((f"{folder}/{name}", out.n))
                    out = None
        if out is not None:
            stream.close()
            done.append((f"{folder}/{name}", out.n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])

    return written(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(archives: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per record: key, payload_bytes and payload_digest of the full payload, record_type, refers_to, url and the payload (null for revisits)."""
    names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def key_of(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and len(urn) > 11 else None

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = file_system(path)
                rows, held = [], 0
                with fs.open_input_file(at) as f:
                    for raw in read_archive(f):
                        r = parse(raw)
                        named = base64.b32decode(r["WARC-Payload-Digest"][5:]).hex()
                        kept = r["payload"] if r["WARC-Type"] == "response" else None
                        if kept is not None and (hashlib.sha1(kept).hexdigest() != named or len(kept) != int(r["X-Payload-Length"])):
                            raise ValueError(f"{path}: a payload does not match its digest")
                        rows.append((key_of(r["WARC-Record-ID"]), int(r["X-Payload-Length"]), named, r["WARC-Type"], key_of(r.get("WARC-Refers-To")),
                                     r["WARC-Target-URI"], kept))
                        held += len(raw)
                        if held > 1 << 22:
                            yield pack(rows)
                            rows, held = [], 0
                yield pack(rows)

    def pack(rows):
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    dealt = one_file_each(archives.select("path"), archives.count())
    return dealt.mapInArrow(run, with_columns(archives, [], f"{key} long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                                                            "url string, payload binary"))


def archived(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Write pages to archives in the shared folder and read them back. A null payload is empty, a null url too."""
    pages = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))
    folder = remember(shared_path(pages.sparkSession, "warc"))
    return read_archives(write_archives(with_references(pages), train_dictionary(pages), folder)).withColumnRenamed("page_id", key)
