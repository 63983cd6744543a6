"""Tokenising whole texts with a file of the tokenizers library, piece by piece.

Both vocabularies in use never join text across the start of a run of white space, nor
between letters and a stop or comma after them, nor between a lone newline and a letter. A
text is cut there, every distinct piece of a block of texts is encoded once by the library,
and the ids of a text are those of its pieces in order.

A block is cut by Arrow: into units, each of which begins with the space or newline before
it, and each unit into letters and the stops after them. Only distinct units, and distinct
letters among them, reach Python; ids are then gathered by position in numpy. A text with
other white space than single spaces and newlines between its words is cut by ``PIECE``.
Memory is that of one block (``BLOCK_BYTES`` of text, or one longer text) and of the first
``MAX_KNOWN`` words, whose ids are kept for the next blocks of the task.

Pieces of Latin letters go straight to the library's merge model, spelled as its normaliser
and pre-tokenizer would spell them; at the start that spelling is tried on a few words, and
not used unless the whole library gives the same ids. All other pieces go the whole way.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Signs that may end a word. No apostrophe, for it joins letters; no angle bracket, for special tokens.
STOPS = ",.!?;:|*#$%&"
#: Pieces, in order of preference: a run of letters, with one space before it, up to a blank
#: or stop; stops up to a blank; a newline before a letter; or white space and what follows
#: it, up to a space or newline that begins the next run of white space. Other white space
#: never cuts: libraries differ in what they count as such.
PIECE = re.compile(rf" ?[{_LETTER}]+(?=[ \n{STOPS}]|\Z)|[{STOPS}]+(?=[ \n]|\Z)|\n(?=[{_LETTER}])|\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Units of letters and stops, as Arrow's expressions write them.
_PLAIN, _LETTERS = rf"^\n?[{_LETTER}]+[{STOPS}]*$", rf"^\n?[{_LETTER}]+"
BLOCK_BYTES, MAX_KNOWN = 4 << 20, 1 << 17


def byte_letters() -> dict[int, str]:
    """Byte-level spelling of the Latin-1 letters: UTF-8 bytes as printable characters, the
    unprintable ones (0 to 32, 127 to 160, 173) counted on from 256."""
    odd = [*range(33), *range(127, 161), 173]
    spell = {b: chr(256 + odd.index(b)) if b in odd else chr(b) for b in range(256)}
    return {c: "".join(spell[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Pool:
    """Ids of distinct pieces end to end, with each one's start and length; piece 0 is empty."""

    def __init__(self):
        self.pieces = [b""]

    def add(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of the pieces added."""
        first = len(self.pieces)
        self.pieces += pieces
        return np.arange(first, len(self.pieces))

    def gather(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of pieces, and each piece's number of ids."""
        length = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces)) // 2
        n = length[pieces]
        jump = (np.cumsum(length) - length)[pieces] - (np.cumsum(n) - n)
        at = np.repeat(jump, n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(self.pieces), np.uint16)[at], n


class Encoder:
    """Unsigned 16-bit ids (little-endian, as every platform that Spark supports) of texts."""

    _made: dict[str, "Encoder"] = {}
    latin = re.compile(rf" ?[{_LETTER}]+").fullmatch

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One for each Python worker and file."""
        if path not in cls._made:
            cls._made.clear()  # a worker serves one file at a time
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        # Spark runs a task per core: threads of the library's own would only spin
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spelling = Tokenizer.from_file(path), byte_letters()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.model = self.tokenizer.model
        self.space, self.lower = None, False
        probes = [s + w for s in ("", " ") for w in ("a", "The", "worthless", "ÀÉßÿ", "élévation", "Ähnlichkeitssätze", "ZZxq")]
        for space, lower in (("\u0120", False), ("", True)):
            if all(self._merged(p, space, lower) == self._whole(p) for p in probes):
                self.space, self.lower = space, lower
        self.newline = array("H", self._whole("\na")[: -len(self._whole("a"))]).tobytes()
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """At a task's end: the worker process lives on and needs the memory for other work."""
        self.known = {}
        pa.default_memory_pool().release_unused()

    def _whole(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _merged(self, piece: str, space: str, lower: bool) -> list[int]:
        letters = piece.removeprefix(" ")
        spelled = letters.lower() if lower else letters
        if not spelled.isascii():
            spelled = spelled.translate(self.spelling)
        return [t.id for t in self.model.tokenize(space + spelled if len(letters) < len(piece) else spelled)]

    def one(self, piece: str) -> bytes:
        ids = self._merged(piece, self.space, self.lower) if self.space is not None and self.latin(piece) else self._whole(piece)
        return array("H", ids).tobytes()

    def cut(self, text: str) -> bytes:
        """Ids of any text by its pieces."""
        pieces = PIECE.findall(text)
        known = {p: self.one(p) for p in set(pieces)}
        return b"".join(map(known.__getitem__, pieces))

    def words(self, units: list[str]) -> list[bytes]:
        """Ids of letters that follow a space or, where they begin with it, a newline."""
        out, known, room = [], self.known, MAX_KNOWN - len(self.known)
        merged = (lambda p: self._merged(p, self.space, self.lower)) if self.space is not None else self._whole
        for u in units:
            ids = known.get(u)
            if ids is None:
                ids = self.newline + array("H", merged(u[1:])).tobytes() if u[0] == "\n" else array("H", merged(" " + u)).tobytes()
                if room > 0:
                    known[u], room = ids, room - 1
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings without nulls) end to end, and each text's number of ids."""
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        units = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = units.offsets.to_numpy()[:-1] - units.offsets[0].as_py()
        coded = units.flatten().dictionary_encode()
        kind, distinct = coded.indices.to_numpy(), coded.dictionary
        pool, bad = Pool(), np.zeros(len(distinct), bool)
        head, tail = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)

        plain = pc.match_substring_regex(distinct, _PLAIN)
        on = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        words = distinct.filter(plain)
        letters, stops = pc.utf8_rtrim(words, STOPS).dictionary_encode(), pc.replace_substring_regex(words, _LETTERS, "").dictionary_encode()
        if len(on):
            head[on] = pool.add(self.words(letters.dictionary.to_pylist()))[letters.indices.to_numpy()]
            tail[on] = pool.add([self.one(x) if x else b"" for x in stops.dictionary.to_pylist()])[stops.indices.to_numpy()]
        others = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        found = []
        for i, x in zip(others, distinct.take(pa.array(others)).to_pylist(), strict=True):
            bad[i] = not x or x[-1].isspace()  # such white space doesn't cut
            found.append(b"" if bad[i] else self.cut(x if x[0] == "\n" else " " + x))
        head[others] = pool.add(found)

        pieces = np.stack([head[kind], tail[kind]], 1)
        broken = bad[kind]
        starts = distinct.take(pa.array(kind[first])).to_pylist()  # no space before a text's first unit
        broken[first] = [not x or x[-1].isspace() for x in starts]
        pieces[first, 0], pieces[first, 1] = pool.add([b"" if b else self.cut(x) for x, b in zip(starts, broken[first], strict=True)]), 0
        ids, n = pool.gather(pieces.ravel())
        n = np.add.reduceat(n.reshape(-1, 2).sum(1), first)
        again = np.flatnonzero(np.logical_or.reduceat(broken, first))
        if not len(again):
            return ids, n
        end, out, at = np.cumsum(n), [], 0
        for i, t in zip(again, texts.take(pa.array(again)).to_pylist(), strict=True):
            out += [ids[at : end[i] - n[i]], np.frombuffer(self.cut(t), np.uint16)]
            at, n[i] = end[i], len(out[-1])
        return np.concatenate([*out, ids[at:]]), n

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the end id after each text's own."""
        ids, n = self.encode(texts)
        return np.insert(ids, np.cumsum(n), end_id), n + 1


def as_binary(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """One binary value of 16-bit ids for each text."""
    ends = np.concatenate(([0], np.cumsum(2 * n))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])


def in_blocks(texts: pa.Array, size: int = BLOCK_BYTES):
    """Index ranges of ``texts`` of at most so many bytes each, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, to
        at, before = to, int(ends[to - 1])


def encoded(docs, vocabulary: str, end_id: int, add=None, schema: str = ""):
    """``docs`` (any columns and ``text``) with ``n`` and ``ids`` (16-bit, end id included) for
    the text, null being empty. ``add(batch, ids, n)`` makes the arrays of the columns of ``schema``."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        encoder = Encoder.of(vocabulary)
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            for a, z in in_blocks(texts):
                ids, n = encoder.ended(texts[a:z], end_id)
                part = b.slice(a, z - a)
                columns = [*(part.column(c) for c in kept), pa.array(n), as_binary(ids, n), *(add(part, ids, n) if add else [])]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.forget()

    fields = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    fields = T.StructType(fields.fields + T._parse_datatype_string(schema).fields) if schema else fields
    names = fields.names
    return docs.mapInArrow(run, fields)
