"""Token counts from flat token files without an index.

A file is nothing but little-endian ids, one end-of-document id behind each
document. It is read in blocks by many tasks: each finds the separators of its
block in one vector comparison. A prefix scan over the blocks' counts and last
separators then says where the document that a block starts in began, and which
document of the file it is, so that documents which cross blocks, or span many,
come out whole.

Tokens are white-space words here and their ids hashes: no vocabulary is used, so
counts differ from those of the encoders.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import file_system, hashed_words, remember, text_blocks, written
from foldwise.sources.tables import shared_path

#: Bytes of an id; the id that ends a document; ids of a block.
WIDTH, END_ID, BLOCK = 2, 65535, 1 << 22


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", file_ids: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """Write each text's words as hashed 16-bit ids to flat files, and keep aside which document came in which place.

    Returns (files: path, n_ids) and (order: path, place, key). A task that is run again writes new files; only those of tasks that ended well are in
    the tables.
    """
    def run(batches):
        fs, root = file_system(folder)
        path, stream, n, keys, part = None, None, 0, [], TaskContext.get().partitionId()

        def close():
            stream.close()
            ids = np.array([k or 0 for k in keys], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                               pa.array([[k is None for k in keys]], pa.list_(pa.bool_()))], ["path", "n_ids", "keys", "empty"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, data, bounds in text_blocks(batch.column(1)):
                h, row = hashed_words(data, bounds)
                size = len(bounds) - 1
                ids = np.full(len(h) + size, END_ID, "<u2")
                ids[np.arange(len(h)) + row] = (h % np.uint64(END_ID)).astype("<u2")
                if stream is None:
                    name = f"tokens-{part:06d}-{uuid.uuid4().hex}.bin"
                    fs.create_dir(root, recursive=True)
                    path, stream, n, keys = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None), 0, []
                stream.write(ids.tobytes())
                n += len(ids)
                keys += own[first:first + size]
                if n >= file_ids:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    table = written(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(
        run, "path string, n_ids long, keys array<bigint>, empty array<boolean>"), "token-files")
    order = table.select("path", F.posexplode(F.arrays_zip("keys", "empty")).alias("place", "x"))
    return table.select("path", "n_ids"), order.select("path", F.col("place").cast("long").alias("place"), F.when(~F.col("x.empty"), F.col("x.keys")).alias(key))


def scan_separators(files: DataFrame, end_ids: tuple[int, ...] = (END_ID,), width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(path, place, start, n_tokens, ended) of every document of the files (path, n_ids), n_tokens without the separator.

    Any of end_ids ends a document; two in a row leave an empty one between them. Ids behind the last separator are a document that has not ended.
    """
    def run(batches):
        kind, marks = np.dtype(f"<u{width}"), np.array(end_ids)
        for batch in batches:
            for path, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    f.seek(first * width)
                    ids = np.frombuffer(f.read(n * width), kind)
                where = np.flatnonzero(ids == marks[0] if len(marks) == 1 else np.isin(ids, marks)) + first
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                                                  pa.array([where], pa.list_(pa.int64()))], ["path", "first", "n", "ends"])

    step = F.lit(block).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_ids") - 1, F.lit(0)), step))
    blocks = files.where("n_ids > 0").select("path", "n_ids", starts.alias("first"))
    blocks = blocks.select("path", "first", F.least(step, F.col("n_ids") - F.col("first")).alias("n")).repartition("path", "first")
    found = blocks.mapInArrow(run, "path string, first long, n long, ends array<bigint>")
    # The scan is over one row for each block of a file.
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("path").orderBy("first").rowsBetween(1, Window.unboundedFollowing)
    found = (found.withColumn("place", F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0)))
             .withColumn("last", F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1).cast("long")))
             .withColumn("final", F.count("*").over(after) == 0))
    docs = F.transform("ends", lambda e, i: F.struct((F.col("place") + i).alias("place"), (F.when(i == 0, F.col("last")).otherwise(F.get("ends", i - 1)) + 1).alias("start"),
                                                     e.alias("end"), F.lit(True).alias("ended")))
    tail_start = F.coalesce(F.array_max("ends"), F.col("last")) + 1
    stop = F.col("first") + F.col("n")
    tail = F.when(F.col("final") & (tail_start < stop), F.array(F.struct((F.col("place") + F.size("ends")).alias("place"), tail_start.alias("start"), stop.alias("end"),
                                                                         F.lit(False).alias("ended"))))
    rows = found.select("path", F.explode(F.concat(docs, F.coalesce(tail, F.slice(docs, 1, 0)))).alias("d"))
    return rows.select("path", "d.place", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.ended")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """key and n_tokens of every document, counted in the flat files that its words are written to.

    A null text counts as empty: no tokens. Repeated rows and null keys are documents of their own. An empty table gives an empty table.
    """
    folder = remember(shared_path(docs.sparkSession, "tokens"))
    files, order = write_token_files(docs, folder, key, text)
    # The order is packed small on disk, so an estimate by its file size would broadcast it.
    return scan_separators(files, block=block).join(order.hint("merge"), ["path", "place"]).select(key, "n_tokens")
