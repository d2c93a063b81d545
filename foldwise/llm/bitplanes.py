"""Token ids in files of shuffled bit or byte planes.

A file is a run of blocks of a fixed number of ids. In a block, bit (or byte) j
of all ids stands together as plane j, and each plane is compressed on its own;
high planes are nearly constant and shrink to nothing. A document index and a
chunk index follow, so that a reader can fetch any block without the others.

    "BPLN" version:u8 bits_per_plane:u8 0:u16 block_ids:u32
    planes of block 0, planes of block 1, ...
    zstd(doc ids: i64 each, flags: u8 each, lengths: u64 each)
    chunk index: for each block  offset:u64 n_ids:u32 plane sizes:u32 each
    n_docs:u64 n_blocks:u64 docs_offset:u64 chunks_offset:u64 "BPLN"
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.bpe_stream import PLAIN, splits_plainly
from foldwise.llm.common import file_system, one_file_each, remember, text_blocks, written
from foldwise.sources.tables import shared_path

MAGIC, HEAD, TAIL = b"BPLN", struct.Struct("<4sBBHI"), struct.Struct("<QQQQ4s")
BLOCK_IDS, FILE_IDS, LEVEL, REMEMBERED = 1 << 16, 1 << 25, 3, 500_000
#: Bytes of texts whose new pieces are encoded together.
ENCODED = 1 << 21
WHITE = re.compile("[^ \t\n\x0b\f\r]+")
#: What Python takes for white space and the library does not.
SEPARATOR = re.compile("[\x1c-\x1f]")
#: Punctuation that a run of letters before it cannot join; not the apostrophe.
ENDING = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Runs that are one word each between blanks, as most runs of letters are too (all have a word at least), and how many are encoded as one text.
ONE_WORD, JOINED = re.compile(r"[a-z]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+"), 200


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Plane j of a block: bit j (bits=1) or byte j (bits=8) of every id."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [p.tobytes() for p in rows.T]
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(np.unpackbits(rows, axis=1, bitorder="little").T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    rows = np.array([np.frombuffer(p, np.uint8) for p in planes])
    if bits == 1:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class PlaneWriter:
    """Writes one file. Memory: one block of ids, the indexes, and what the stream buffers."""

    def __init__(self, stream, bits: int = 8, block_ids: int = BLOCK_IDS):
        import zstandard
        self.stream, self.bits, self.block_ids, self.zstd = stream, bits, block_ids, zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.held, self.n_ids = HEAD.size, bytearray(), 0
        self.docs, self.null, self.lengths, self.chunks = [], bytearray(), [], []
        stream.write(HEAD.pack(MAGIC, 1, bits, 0, block_ids))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit, appended to what stands in the file."""
        self.docs.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held += ids
        full = len(self.held) // (4 * self.block_ids) * 4 * self.block_ids
        for k in range(0, full, 4 * self.block_ids):
            self._block(self.held[k:k + 4 * self.block_ids])
        del self.held[:full]

    def _block(self, raw: bytes) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(np.frombuffer(bytes(raw), "<u4"), self.bits)]
        self.chunks.append(struct.pack(f"<QI{len(planes)}I", self.at, len(raw) // 4, *map(len, planes)))
        for p in planes:
            self.stream.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._block(self.held)
        index = self.zstd.compress(np.array(self.docs, "<i8").tobytes() + bytes(self.null) + np.array(self.lengths, "<u8").tobytes())
        self.stream.write(index)
        self.stream.write(b"".join(self.chunks))
        self.stream.write(TAIL.pack(len(self.docs), len(self.chunks), self.at, self.at + len(index), MAGIC))
        self.stream.close()


class PlaneReader:
    """Reads one file through its indexes."""

    def __init__(self, source):
        import zstandard
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n_docs, n_blocks, docs_at, chunks_at, magic = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        first, version, self.bits, _, self.block_ids = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC or first != MAGIC or version != 1:
            raise ValueError("not a file of planes, or cut off")
        raw = self.zstd.decompress(self._at(docs_at, chunks_at - docs_at))
        ids, null = np.frombuffer(raw, "<i8", n_docs).tolist(), raw[8 * n_docs:9 * n_docs]
        self.docs = [None if x else i for i, x in zip(ids, null)]
        self.lengths = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        entry = struct.Struct(f"<QI{32 // self.bits}I")
        index = self._at(chunks_at, entry.size * n_blocks)
        self.chunks = list(entry.iter_unpack(index))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        offset, n, *sizes = self.chunks[k]
        raw, planes = self._at(offset, sum(sizes)), []
        for s in sizes:
            planes.append(self.zstd.decompress(raw[:s]))
            raw = raw[s:]
        return from_planes(planes, n, self.bits)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from position `start`, from the blocks that hold them."""
        parts = [self.block(k) for k in range(start // self.block_ids, -(-(start + n) // self.block_ids))]
        return np.concatenate(parts)[start % self.block_ids:][:n] if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc id, length, runs of its ids) in file order; each block is decoded once."""
        k, block = 0, np.zeros(0, "<u4")

        def runs(n: int) -> Iterator[np.ndarray]:
            nonlocal k, block
            while n:
                if not len(block):
                    block = self.block(k)
                    k += 1
                take, block = block[:n], block[n:]
                n -= len(take)
                yield take

        for doc, n in zip(self.docs, self.lengths.tolist()):
            yield doc, n, runs(n)


class LibraryEncoder:
    """Texts to packed ids with the tokenizers library.

    White space parts a text into pieces that are encoded alone, plain ones run by run; ids of pieces and runs are remembered, and what was not
    used for long is forgotten; long ones are forgotten at once. Only for vocabularies whose splitter drops white space. New plain runs are joined by
    blanks, and their ids are cut where tokens that end a word stand, if the vocabulary marks these.
    """

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise NotImplementedError("packed ids are little-endian 32-bit numbers of this machine")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.pack(" a b\t\n\x0bab  ") != self.pack("a") + self.pack("b") + self.pack("ab"):
            raise ValueError("this vocabulary keeps white space")
        self.plain = PLAIN if splits_plainly(self.library) else None
        blanks = [chr(c) for c in range(0x3001) if chr(c).isspace() and not SEPARATOR.match(chr(c))]
        # Python parts words at more characters; where the library drops them all, it can do the parting, which is faster.
        self.parts_alike = all(self.pack(f"a{c}b") == self.pack("a") + self.pack("b") for c in blanks)
        self.ends = self.word_ends() if self.plain else None
        self.known, self.older, self.runs = {}, {}, {}

    def pack(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word_ends(self) -> np.ndarray | None:
        """Which ids end a word; None if the vocabulary does not say, or has an added token that might show up in joined runs."""
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        if not suffix or not all("<" in t.content for t in self.library.get_added_tokens_decoder().values()):
            return None
        ids = self.library.get_vocab(with_added_tokens=False)
        ends = np.zeros(max(self.library.get_vocab(with_added_tokens=True).values()) + 1, bool)
        ends[[i for t, i in ids.items() if t.endswith(suffix)]] = True
        return ends

    def encode_runs(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Packed ids of runs, each as it is encoded alone."""
        joined, alone = [], []
        for u in units:
            (joined if self.ends is not None and (u.isalpha() or ONE_WORD.fullmatch(u)) else alone).append(u)
        parts = [joined[k:k + JOINED] for k in range(0, len(joined), JOINED)]
        for k in range(0, len(parts), 50):
            for part, e in zip(parts[k:k + 50], self.library.encode_batch_fast([" ".join(x) for x in parts[k:k + 50]], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                at = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
                if len(at) != len(part) + 1 or at[-1] != 4 * len(ids):  # a run has several words
                    alone = alone + part
                    continue
                ids = ids.tobytes()
                yield from zip(part, [ids[i:j] for i, j in zip(at, at[1:])])
        for k in range(0, len(alone), 10_000):
            for u, e in zip(alone[k:k + 10_000], self.library.encode_batch_fast(alone[k:k + 10_000], add_special_tokens=False)):
                yield u, array("I", e.ids).tobytes()

    def split(self, w: str) -> list[str]:
        """Runs of a piece that the library would encode as they stand alone."""
        if self.plain and "<" not in w and "'" not in w:
            if w.isascii():
                return self.plain.findall(w.lower()) if w.isprintable() else [w]
            core = w.rstrip(ENDING)
            if core is not w and core[-1:].isalpha():
                return [core, w[len(core):]]
        return [w]

    def learn(self, new: list[str]) -> None:
        """Remember the ids of pieces."""
        runs, older, split = self.runs, self.older, {}
        for w in new:
            ids = older.get(w)
            if ids is None:
                split[w] = self.split(w)
            else:
                self.known[w] = ids
        units = list(set(chain.from_iterable(split.values())).difference(runs))
        runs.update(self.encode_runs(units))
        for w, own in split.items():
            self.known[w] = runs[own[0]] if len(own) == 1 else b"".join([runs[u] for u in own])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        pieces = [t.split() if self.parts_alike and not SEPARATOR.search(t) else WHITE.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        if len(self.runs) > REMEMBERED:
            self.runs = {}
        new = [w for w in set().union(*pieces) if w not in self.known]  # long pieces always are
        self.learn(new)
        get = self.known.__getitem__
        for p in pieces:
            yield b"".join(map(get, p))
        for w in new:
            if len(w) > 64:
                del self.known[w]
                for u in self.split(w):
                    self.runs.pop(u, None)


@cache
def encoder(path: str) -> LibraryEncoder:
    """One per Python worker, so that remembered pieces serve all its tasks."""
    return LibraryEncoder(path)


MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def write_planes(docs: DataFrame, vocabulary: str, end_id: int, folder: str, bits: int = 8, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS,
                 text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every text, append end_id and write the ids to files in ascending order of key; returns the table of files.

    Rows are dealt out by ranges of (key, input position), so rows with one key, null keys too (first), can spread over many tasks; they keep
    their input order. A null text has the end id alone. An empty table gives no files. A task that is run again writes new files; only those
    of tasks that ended well are in the returned table, which alone names the files that count.
    """
    def run(batches):
        encode, part, seq, out, rows = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0, None, []
        fs, root = file_system(folder)
        end = struct.pack("<I", end_id)

        def close():
            nonlocal out
            out.close()
            rows.append((part, seq, f"{folder}/{name}", len(out.docs), out.n_ids))
            out = None

        for batch in batches:
            for first, data, bounds in text_blocks(batch.column(1), ENCODED):
                texts = [data[bounds[k]:bounds[k + 1]].tobytes().decode() for k in range(len(bounds) - 1)]
                for doc, ids in zip(batch.column(0).slice(first, len(texts)).to_pylist(), encode(texts)):
                    if out is None:
                        name = f"ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.bpln"
                        fs.create_dir(root, recursive=True)
                        out = PlaneWriter(fs.open_output_stream(f"{root}/{name}", compression=None), bits, block_ids)
                    out.add(doc, ids + end)
                    if out.n_ids >= file_ids:
                        close()
                        seq += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema(
            [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    names = ["part", "seq", "path", "n_docs", "n_ids"]
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("i"))
    rows = rows.repartitionByRange("k", "i").sortWithinPartitions("k", "i").select("k", "t")
    return written(rows.mapInArrow(run, MANIFEST), "planes-manifest")


def with_starts(files: DataFrame) -> DataFrame:
    """Add `start`: the ids in all files before. One row for each file, so the order of files fits one task."""
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read_planes(files: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and the unsigned crc32 of each document's ids."""
    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    rows = []
                    for doc, n, runs in PlaneReader(f).documents():
                        crc = 0
                        for r in runs:
                            crc = zlib.crc32(np.ascontiguousarray(r, "<u4"), crc)
                        rows.append((doc, start, n, crc))
                        start += n
                        if len(rows) == 10_000:
                            yield pack(rows)
                            rows = []
                    yield pack(rows)

    def pack(rows):
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = one_file_each(with_starts(files).select("path", "start"), files.count())
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shuffled_ids(docs: DataFrame, vocabulary: str, end_id: int, **options) -> DataFrame:
    """Write all texts as plane files to the shared folder and read them back."""
    folder = remember(shared_path(docs.sparkSession, "planes"))
    return read_planes(write_planes(docs, vocabulary, end_id, folder, **options))
