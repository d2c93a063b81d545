"""Byte-pair encoding as a bounded-lookahead transducer, and decoding as a byte-to-text state machine.

Applying merges in rank order, text that arrives later can change a token only
through a chain of merges that walks left, each of a later rank than the one
before it, whose right part begins with what the one before had on its left.
The longest such chain, in bytes, is found once from the merge list. A token
that ends further than that from the end of what has been read is stable and is
emitted; only the rest is held. Memory is constant however long a run is.

Normalising and splitting follow the vocabulary file's own rules, through the
library's normaliser and splitter; merging, emitting and decoding are done here.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.llm.common import quoted, text_blocks, with_columns

#: Characters of a text that are normalised and split at once, and pieces whose ids are remembered in a Python worker.
CHUNK, REMEMBERED = 1 << 14, 500_000
WHITE, BLANK = re.compile("[^ \t\n\x0b\f\r]+"), re.compile("[ \t\n\x0b\f\r]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: How vocabularies of this kind split printable ASCII, once it is lowered.
PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def splits_plainly(library) -> bool:
    """Whether the library splits printable ASCII as PLAIN does; held against every pair of characters and the contractions."""
    if not library.normalizer or not library.pre_tokenizer:
        return False
    chars = [chr(c) for c in range(33, 127)]
    probes = [a + b for a in chars for b in chars] + [f"{a}'{c}{b}" for a in "a1!'" for b in "a1!'" for c in ("s", "t", "re", "ve", "m", "ll", "d", "RE", "x")]
    split, normalise = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
    return all([w for w, _ in split(normalise(p))] == PLAIN.findall(p.lower()) for p in probes)


class Merges:
    """The merge list with its sufficient lookahead in letters. Each letter stands for one byte."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        if len({a + b for a, b in merges}) != len(merges):
            raise ValueError("a token has two merges, so rank order is not the library's order")
        self.suffix, self.n_letters = suffix, len(vocab)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.token = {i: t for t, i in vocab.items()}
        self.letter = {c: i for c, i in vocab.items() if len(c) == 1}
        self.last = {c[:-len(suffix)]: i for c, i in vocab.items() if suffix and c.endswith(suffix) and len(c) == len(suffix) + 1} if suffix else self.letter
        self.length = {i: len(t.removesuffix(suffix)) if suffix else len(t) for t, i in vocab.items()}
        self.lookahead = self._lookahead(merges)

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        reach: dict[str, int] = {}  # of chains that end with this token on the left
        first: dict[str, str] = {}  # the left part of a merged token
        most = 0
        for a, b in merges:
            begins, before = b, reach.get(b, 0)
            while begins in first:
                begins = first[begins]
                before = max(before, reach.get(begins, 0))
            here = before + len(a.removesuffix(self.suffix) if self.suffix else a)
            reach[a], first[a + b], most = max(reach.get(a, 0), here), a, max(most, here)
        return most

    def apply(self, ids: list[int]) -> list[int]:
        """Merge in rank order, leftmost first."""
        rank = self.rank
        if len(ids) <= 48:
            get, none = rank.get, (self.n_letters, 0)
            pairs = [get(p, none) for p in zip(ids, ids[1:])]
            while pairs and (best := min(pairs)) is not none:
                k = pairs.index(best)
                ids[k:k + 2] = [best[1]]
                del pairs[k]
                if k:
                    pairs[k - 1] = get((ids[k - 1], ids[k]), none)
                if k < len(pairs):
                    pairs[k] = get((ids[k], ids[k + 1]), none)
            return ids
        right, left, heap = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), []
        for k in range(len(ids) - 1):
            if (r := rank.get((ids[k], ids[k + 1]))) is not None:
                heap.append((r, k, k + 1))
        heapq.heapify(heap)
        while heap:
            r, k, nxt = heapq.heappop(heap)
            if ids[k] < 0 or right[k] != nxt or nxt >= len(ids) or rank.get((ids[k], ids[nxt])) != r:
                continue
            ids[k], ids[nxt], right[k] = r[1], -1, right[nxt]
            if right[k] < len(ids):
                left[right[k]] = k
                if (q := rank.get((ids[k], ids[right[k]]))) is not None:
                    heapq.heappush(heap, (q, k, right[k]))
            if left[k] >= 0 and (q := rank.get((ids[left[k]], ids[k]))) is not None:
                heapq.heappush(heap, (q, left[k], k))
        return [i for i in ids if i >= 0]


class Transducer:
    """One run of letters, fed in parts: push() returns the ids that no later letter can change, close() the rest."""

    def __init__(self, merges: Merges, step: int = 2048):
        self.merges, self.held, self.most = merges, "", merges.lookahead + step

    def push(self, letters: str) -> list[int]:
        m, out, self.held = self.merges, [], self.held + letters
        while len(self.held) > self.most:
            part = self.held[:self.most]
            ids, at, stable = m.apply([m.letter[c] for c in part]), 0, len(part) - 1 - m.lookahead
            for i in ids:
                if at + m.length[i] > stable:
                    break
                out.append(i)
                at += m.length[i]
            self.held = self.held[at:]
            if not at:
                raise ValueError("a token is longer than the lookahead and the step")
        return out

    def close(self) -> list[int]:
        m, held, self.held = self.merges, self.held, ""
        return m.apply([m.letter[c] for c in held[:-1]] + [m.last[held[-1]]]) if held else []


@cache
def _joins_backward() -> frozenset[str]:
    """Characters that can change with what stands before them when a text is composed."""
    out = set()
    for cp in range(0x110000):
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and len(parts := d.split()) == 2:
            out.add(chr(int(parts[1], 16)))
    return frozenset(out | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _safe_cut(text: str, at: int) -> bool:
    """Whether text can be normalised and split apart before position `at`, but for runs that go on."""
    c = text[at]
    if ord(c) > 127 and (unicodedata.combining(c) or c in _joins_backward() or unicodedata.normalize("NFC", c) != c):
        return False
    return text[at:at + 2] == "''" if c == "'" else "'" not in text[max(0, at - 3):at]


class Tokenizer:
    """A vocabulary file of the tokenizers library with plain BPE, encoded by the transducer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        for key in ("dropout", "unk_token", "continuing_subword_prefix"):
            if model.get(key):
                raise ValueError(f"{key} is not supported")
        if spec.get("truncation") or spec.get("padding"):
            raise ValueError("truncation and padding are not supported")
        self.merges = Merges(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        library = Library.from_file(path)
        self.normalise: Callable[[str], str] = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]):
                raise ValueError(f"added token {t['content']!r} is not supported")
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.token = self.merges.token | {i: t for t, i in self.added.items()}
        self.tokens = [self.token[i] for i in range(len(self.token))]
        self.joined = spec.get("decoder") is None
        self.known, self.older, self.words = {}, {}, {}
        # A short run of plain characters is lowered and split here; the library does it for all others.
        self.plain = PLAIN if splits_plainly(library) else None

    # -- encoding

    def word(self, letters: str) -> bytes:
        """Packed ids of a whole run of letters; those of short runs are remembered."""
        packed = self.words.get(letters)
        if packed is None:
            m = self.merges
            packed = pack(m.apply([m.letter[c] for c in letters[:-1]] + [m.last[letters[-1]]]))
            if len(letters) <= 64:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[letters] = packed
        return packed

    def stream(self, text: str, chunk: int = CHUNK) -> Iterator[bytes]:
        """Packed ids of a text that holds no added token, a part at a time."""
        at, open_run, last = 0, None, ""
        while at < len(text):
            end = min(len(text), at + chunk)
            while end < len(text) and not _safe_cut(text, end):
                end += 1
            part, at = self.normalise(text[at:end]), end
            runs = self.split(part)
            for k, (letters, (first, stop)) in enumerate(runs):
                goes_on = open_run is not None and k == 0 and first == 0 and len(self.split(last + part[0])) == 1
                if open_run is not None and not goes_on:
                    yield pack(open_run.close())
                    open_run = None
                if k == len(runs) - 1 and stop == len(part) and at < len(text):
                    open_run = open_run or Transducer(self.merges)
                    yield pack(open_run.push(letters))
                elif open_run is not None:
                    yield pack(open_run.push(letters) + open_run.close())
                    open_run = None
                else:
                    yield self.word(letters)
            if open_run is not None and not runs and part:
                yield pack(open_run.close())
                open_run = None
            last = part[-1:] or last
        if open_run is not None:
            yield pack(open_run.close())

    def piece(self, text: str) -> Iterator[bytes]:
        """Packed ids of a piece between white space, which may hold added tokens."""
        at = 0
        for m in self.find_added.finditer(text) if self.find_added else ():
            yield from self.stream(text[at:m.start()])
            yield pack([self.added[m[0]]])
            at = m.end()
        yield from self.stream(text[at:])

    def short_piece(self, w: str) -> bytes:
        """Packed ids of a piece of at most 64 characters, remembered. What was not used for long is forgotten."""
        ids = self.older.get(w)
        if ids is None:
            if self.plain and w.isascii() and w.isprintable() and not (self.find_added and "<" in w):
                ids = b"".join(map(self.word, self.plain.findall(w.lower())))
            else:
                ids = b"".join(self.piece(w))
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        self.known[w] = ids
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed little-endian ids of a whole text, some thousand pieces or a stable part of a long piece at a time."""
        at = 0
        while at < len(text):
            gap = BLANK.search(text, min(at + CHUNK, len(text)))
            end = gap.start() if gap else len(text)
            pieces, at, done = WHITE.findall(text, at, end), end, []
            for w, ids in zip(pieces, map(self.known.get, pieces)):
                if ids is None:
                    if len(w) > 64:
                        yield b"".join(done)
                        done = []
                        yield from self.piece(w)
                        continue
                    ids = self.short_piece(w)
                done.append(ids)
            yield b"".join(done)


class Decoder:
    """Ids back to text, fed in parts.

    joined: as the library does for a file without a decoder, tokens parted by
    one blank. Else the letters go back to bytes, the end of a word becomes a
    blank, and bytes become characters as soon as they are whole; broken
    sequences become U+FFFD.
    """

    def __init__(self, tokenizer: Tokenizer, joined: bool | None = None):
        self.token = tokenizer.tokens
        self.joined = tokenizer.joined if joined is None else joined
        self.begun = False
        if not self.joined:
            byte = {c: b for b, c in enumerate(byte_letters())}
            suffix = tokenizer.merges.suffix
            self.state = codecs.getincrementaldecoder("utf-8")("replace")
            self.bytes = {}
            for i, t in enumerate(self.token):
                if i in tokenizer.added.values():
                    self.bytes[i] = t.encode()
                else:
                    ends = bool(suffix) and t.endswith(suffix)
                    self.bytes[i] = bytes(byte[c] for c in (t[:-len(suffix)] if ends else t)) + b" " * ends

    def push(self, ids) -> str:
        if not len(ids):
            return ""
        if not self.joined:
            return self.state.decode(b"".join([self.bytes[i] for i in ids]))
        out = (" " if self.begun else "") + " ".join(map(self.token.__getitem__, ids))
        self.begun = True
        return out

    def close(self) -> str:
        return "" if self.joined else self.state.decode(b"", final=True)


@cache
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker, so that remembered pieces serve all its tasks."""
    return Tokenizer(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of each text and the text decoded from them. A null text counts as empty: no ids, empty text.

    Both new columns replace columns of docs that have their names. No shuffle; a lost task is simply run again.
    """
    keep = [c for c in docs.columns if c.lower() not in (ids.lower(), decoded.lower())]

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            for first, data, bounds in text_blocks(batch.column(text_at)):
                got, back = [], []
                for k in range(len(bounds) - 1):
                    own = np.frombuffer(b"".join(t.encode(data[bounds[k]:bounds[k + 1]].tobytes().decode())), "<u4")
                    d = Decoder(t)
                    got.append(own.astype(np.int32))
                    back.append(d.push(own.tolist()) + d.close())
                out = batch.slice(first, len(got)).select(at)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(got, pa.list_(pa.int32())), pa.array(back, pa.string())], names)

    names = [*keep, ids, decoded]
    at, text_at = [docs.columns.index(c) for c in keep], docs.columns.index(text)
    return docs.mapInArrow(run, with_columns(docs, keep, f"{quoted(ids)} array<int>, {quoted(decoded)} string"))


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each text; ids and decoded text are hashed part by part and never held whole."""
    cols = [key, text]

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            for first, data, bounds in text_blocks(batch.column(1)):
                n, ids_hex, text_hex = [], [], []
                for k in range(len(bounds) - 1):
                    count, of_ids, of_text, d = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t)
                    for part in t.encode(data[bounds[k]:bounds[k + 1]].tobytes().decode()):
                        count += len(part) // 4
                        of_ids.update(part)
                        of_text.update(d.push(np.frombuffer(part, "<u4").tolist()).encode())
                    of_text.update(d.close().encode())
                    n.append(count)
                    ids_hex.append(of_ids.hexdigest())
                    text_hex.append(of_text.hexdigest())
                out = batch.column(0).slice(first, len(n))
                yield pa.RecordBatch.from_arrays([out, pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(*cols)
    return picked.mapInArrow(run, with_columns(picked, [key], "n_tokens long, ids_sha256 string, decoded_sha256 string"))

