"""Cross-tokenizer alignment: token groups of two tokenizers that cover the same bytes.

Tokenizer A is a file of the tokenizers library with byte-level spelling, B a sentencepiece
model with byte fallback; both cut the same bytes, a space and then the text. Cumulative byte
ends go into one end-to-index dictionary a side; the ends in both, sorted, slice both id lists
into groups, and each slice is expanded into the links of tokens whose byte ranges overlap.

Neither tokenizer joins text across the cuts of ``PIECE``, so these are ends of both. The new
distinct pieces of a block of texts are laid end to end and aligned together, and a document's
groups are those of its pieces in order; tests compare this with the alignment of whole texts.
Memory is that of one block (``BLOCK_BYTES`` of text, or one longer text) and of ``MAX_PIECES``
aligned pieces that a worker keeps for its next blocks.

How many documents hold a pair linked is counted over all documents. Pairs with at least
1/``HEAD`` of all (document, pair) rows, so at most ``HEAD`` of them, go to the executors with
their counts; all others meet theirs in a join, which no frequent pair is then part of.

A null or empty text, and one that a tokenizer does not spell back byte for byte (for B a text
with U+2581, which it reads as a space), has no tokens: zeros, and empty groups. Repeated rows
are documents of their own in the counts. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.llm._common import discard, materialize, table
from panelscope.llm._tokenize import PIECE, Encoder, in_blocks
from panelscope.llm.records import vocabulary_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HEAD, MAX_PIECES = 1 << 18, 1 << 17
SUMS = ["n_a", "n_b", "n_groups", "n_links"]
_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def byte_of_letter() -> dict[str, int]:
    """Byte-level spelling read backwards: printable bytes stand for themselves, the others
    (0 to 32, 127 to 160, 173) for the characters from 256 on."""
    odd = [*range(33), *range(127, 161), 173]
    return {chr(256 + odd.index(b)) if b in odd else chr(b): b for b in range(256)}


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends in both lists, sorted, and behind which index of each list they lie: group g
    holds the tokens from those of end g - 1 to those of end g."""
    a_at, b_at = (dict(zip(e.tolist(), range(1, len(e) + 1), strict=True)) for e in (a_ends, b_ends))
    common = sorted(a_at.keys() & b_at.keys())
    return tuple(np.array(x, np.int64) for x in (common, list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))))


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all token pairs whose byte ranges overlap. No token passes a common end, so
    the run of B tokens over each A token lies in its slice."""
    first = np.searchsorted(b_ends, np.concatenate(([0], a_ends[:-1])), "right")
    n = np.searchsorted(b_ends, a_ends, "left") - first + 1
    a = np.repeat(np.arange(len(a_ends)), n)
    return a, np.arange(len(a)) + np.repeat(first - (np.cumsum(n) - n), n)


class Aligner:
    """Groups and links of pieces, remembered from block to block."""

    _made: dict[tuple[str, str], "Aligner"] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Aligner":
        """One for each Python worker and pair of files."""
        if (a_path, b_path) not in cls._made:
            cls._made.clear()
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = Encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.tokenizer.encode_special_tokens = True
        if self.b.get_piece_size() > 1 << 16:
            raise ValueError("ids of this model need more than 16 bits")
        letter = byte_of_letter()
        spelled = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(spelled.values()) + 1)
        for t, i in spelled.items():
            self.a_bytes[i] = bytes(map(letter.get, t)) if all(c in letter for c in t) else t.encode()
        spelled = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(spelled)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes)]
        self.digits = [str(i) for i in range(max(map(len, self.sizes)))]
        self.before = len(self.b.encode("\n"))
        self.known: dict[str, tuple] = {}

    def ids(self, pieces: list[str]) -> list[list]:
        """Both sides' ids of each piece. B puts a space of its own first, so a newline, which it never joins to anything, parts that from the piece."""
        return [[np.frombuffer(self.a.one(p), np.uint16) for p in pieces], [x[self.before :] for x in self.b.encode(["\n" + p for p in pieces])]]

    def align(self, pieces: list[str]) -> list[tuple]:
        """Of each piece: numbers of A tokens, B tokens, groups and links, whether both spell it,
        groups as text, linked pairs (a * 65536 + b). All pieces are laid end to end."""
        if not pieces:
            return []
        cut, want = self.ids(pieces), [p.encode() for p in pieces]
        a, b = (np.fromiter(chain.from_iterable(each), np.int64) for each in cut)
        good = [True] * len(pieces)
        if not all(b"".join(map(of.__getitem__, x.tolist())) == b"".join(want) for of, x in ((self.a_bytes, a), (self.b_bytes, b))):
            good = [all(b"".join(of[i] for i in x) == w for of, x in ((self.a_bytes, x), (self.b_bytes, y))) for x, y, w in zip(*cut, want, strict=True)]
            cut = [[x if ok else [] for x, ok in zip(each, good, strict=True)] for each in cut]
            a, b = (np.fromiter(chain.from_iterable(each), np.int64) for each in cut)
        n = [np.fromiter(map(len, each), np.int64, len(each)) for each in cut]
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        common, a_to, b_to = common_ends(a_ends, b_ends)
        la, lb = links(a_ends, b_ends)
        pairs = (a[la] << 16 | b[lb]).astype(np.uint32)

        a_said, b_said = ([*map(self.digits.__getitem__, x.tolist())] for x in (a, b))
        said, i, k = [], 0, 0
        for j, m in zip(a_to.tolist(), b_to.tolist(), strict=True):
            said.append(f"{a_said[i]}|{b_said[k]}" if j == i + 1 and m == k + 1 else f"{','.join(a_said[i:j])}|{','.join(b_said[k:m])}")
            i, k = j, m
        tokens = np.cumsum(n[0])
        groups, linked = np.searchsorted(a_to, tokens, "right"), np.searchsorted(la, tokens, "left")
        from_group, from_link = np.concatenate(([0], groups[:-1])), np.concatenate(([0], linked[:-1]))
        each = zip(*(x.tolist() for x in (*n, from_group, groups, from_link, linked)), good, strict=True)
        data = pairs.tobytes()
        return [(x, y, h - g, q - p, ok, ";".join(said[g:h]), data[4 * p : 4 * q]) for x, y, g, h, p, q, ok in each]

    def of_pieces(self, distinct: list[str]) -> list[tuple]:
        known = self.known
        new = [p for p in distinct if p not in known]
        got = dict(zip(new, self.align(new), strict=True))
        out = [got[p] if p in got else known[p] for p in distinct]
        for p in new[: max(0, MAX_PIECES - len(known))]:
            known[p] = got[p]
        return out

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The texts' pieces, each text after a space: numbers of pieces, one text after the other;
        each text's count of them; and the distinct pieces. Arrow cuts at spaces and newlines."""
        units = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        per_text = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = units.flatten().dictionary_encode()
        kind, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        bad = np.array([not u or u[-1].isspace() for u in distinct], bool)  # such white space doesn't cut
        index: dict[str, int] = {}
        parts = [[index.setdefault(p, len(index)) for p in PIECE.findall(u if u[0] == "\n" else " " + u)] if ok else [] for u, ok in zip(distinct, ~bad, strict=True)]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.int64)
        n = size[kind]
        codes = flat[np.repeat((np.cumsum(size) - size)[kind] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        unit_ends, run = np.cumsum(per_text), np.concatenate(([0], np.cumsum(n)))
        count = run[unit_ends] - run[unit_ends - per_text]
        again = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(bad[kind])))[np.concatenate(([0], unit_ends))]))
        out, at, ends = [], 0, np.cumsum(count)
        for i, t in zip(again.tolist(), texts.take(pa.array(again)).to_pylist(), strict=True):
            out += [codes[at : ends[i] - count[i]], np.array([index.setdefault(p, len(index)) for p in PIECE.findall(" " + t)] if t else [], np.int64)]
            at, count[i] = ends[i], len(out[-1])
        return np.concatenate([*out, codes[at:]]), count, [*index]

    def block(self, texts: pa.Array) -> list[pa.Array]:
        """The arrays of ``_COLUMNS`` for a block of texts (strings without nulls)."""
        codes, n, distinct = self.cut(texts)
        got = self.of_pieces(distinct)
        to = np.cumsum(n)
        at = to - n

        def summed(values: np.ndarray) -> np.ndarray:
            run = np.concatenate(([0], np.cumsum(values[codes])))
            return run[to] - run[at]

        good = summed(np.array([not g[4] for g in got], np.int64)) == 0
        size = [np.array([g[k] for g in got], np.int64) for k in range(len(SUMS))]
        said = [g[5] for g in got]
        groups = [";".join(map(said.__getitem__, codes[i:j].tolist())) if ok else "" for i, j, ok in zip(at, to, good, strict=True)]

        doc = np.repeat(np.arange(len(texts)), n)
        codes_of_good = codes[good[doc]]
        m = size[3][codes_of_good]
        start = (np.cumsum(size[3]) - size[3])[codes_of_good] - (np.cumsum(m) - m)
        pairs = np.frombuffer(b"".join(g[6] for g in got), np.uint32)[np.repeat(start, m) + np.arange(m.sum())]
        keys, times = np.unique(np.repeat(doc[good[doc]], m) << 32 | pairs, return_counts=True)
        parts = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
        return [*(pa.array(np.where(good, summed(s), 0)) for s in size), pa.array(groups, pa.string()), packed(keys & 0xFFFFFFFF, parts), packed(times, parts)]


def packed(values: np.ndarray, parts: np.ndarray) -> pa.Array:
    """Unsigned 32-bit numbers as one binary value a part."""
    return pa.Array.from_buffers(pa.binary(), len(parts) - 1, [None, pa.py_buffer((4 * parts).astype(np.int32)), pa.py_buffer(values.astype("<u4").tobytes())])


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` made: all numbers, and each row's count."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4


def token_groups(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the columns of ``_COLUMNS`` (in place of any of the same name): numbers, groups as text, and the distinct linked pairs with their number of links."""
    made = T._parse_datatype_string(_COLUMNS)
    kept = [c for c in docs.columns if c != text_col and c not in made.names]
    fields = T.StructType([docs.schema[c] for c in kept] + made.fields)
    names = fields.names

    def run(batches):
        aligner = Aligner.of(a_path, b_path)
        for b in batches:
            texts = pc.fill_null(b.column(text_col), "")
            for i, j in in_blocks(texts):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *aligner.block(texts[i:j])], names=names)

    return docs.mapInArrow(run, fields)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents a pair is linked; whether no pair of the same A id is in more."""

    def run(batches):
        for b in batches:
            keys, docs = np.unique(numbers(b.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], names=["pair", "docs"])

    counts = aligned.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", 16)), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` (a written table of ``token_groups``) with n_best and count_sum, without pairs and times."""
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    counts = materialize(pair_counts(aligned), "counts")
    frequent = F.col("docs") * head >= (counts.agg(F.sum("docs")).first()[0] or 0)
    rows = sorted((r["pair"], r["docs"], r["best"]) for r in counts.where(frequent).collect())  # at most ``head``
    known = aligned.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 3).T)
    fields = T.StructType([aligned.schema[c] for c in kept] + T._parse_datatype_string("n_best long, count_sum long, rest array<struct<pair:long,times:long>>").fields)

    def run(batches):
        keys, docs, best = known.value
        for b in batches:
            (pairs, n), (times, _) = numbers(b.column("pairs")), numbers(b.column("times"))
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            out = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
            for total, worth in zip(out, (best, docs), strict=True):
                np.add.at(total, row[found], times[found] * worth[at[found]])
            left = pa.StructArray.from_arrays([pa.array(pairs[~found]), pa.array(times[~found])], names=["pair", "times"])
            start = np.concatenate(([0], np.cumsum(np.bincount(row[~found], minlength=len(n))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, out), pa.ListArray.from_arrays(pa.array(start), left)], names=fields.names)

    scored = aligned.mapInArrow(run, fields).withColumn("_ps_row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    rest = scored.select("_ps_row", F.explode("rest").alias("x")).select("_ps_row", "x.pair", "x.times").join(counts.where(~frequent), "pair")
    rest = rest.groupBy("_ps_row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_ps_best"), F.sum(F.col("times") * F.col("docs")).alias("_ps_sum"))
    zero = F.lit(0).cast("long")
    return scored.join(rest, "_ps_row", "left").select(*kept, (F.col("n_best") + F.coalesce("_ps_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("_ps_sum", zero)).alias("count_sum"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = token_groups(docs, vocabulary_path(A_FILE), vocabulary_path(B_FILE))
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = materialize(aligned.select("doc_id", *SUMS, "pairs", "times", hashed), "aligned")
    found = with_counts(aligned)
    discard(aligned)
    return found.select("doc_id", *SUMS, "n_best", "count_sum", "groups_sha256")
