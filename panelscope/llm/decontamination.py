"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark.

A text is normalised to its lower-cased words with one space between. The automaton holds
each item's words once, in consecutive blocks of seven: any window of 13 words of an item
contains one whole block. One scan of the normalised text finds every block; each is then
compared with the item in place, six words to either side, and if the words that agree
around it, block included, are 13 or more, all of them are hit. Items of fewer than 13
words are one block, hit as a whole. Hits are kept as word ranges and mapped back to
character offsets of the original text.

The automaton takes about 50 bytes for a byte of benchmark text (measured). A benchmark of
more than ``SLICE_BYTES`` is dealt over several automata, which scan the texts one after the
other, each adding its hits to those found before: no worker ever holds more than one.

Nulls: a null text has no words; a null item text has no windows. A text without
words is never contaminated. Repeated documents are judged row by row; repeated item
ids count once. Extra columns of the inputs are never read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm._common import materialize, table

#: Words: digits, letters a-z and everything outside ASCII.
WORD_AFTER_LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: ASCII letters to lower case, separators to a space, all other bytes as they are.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
WINDOW = 13
#: Benchmark text in one automaton.
SLICE_BYTES = 4 << 20
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
#: What a scan adds up from slice to slice: items, and word ranges [first, last].
_FOUND = "items array<string>, first array<int>, last array<int>"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets of word ranges ``[first, last]`` of the original text."""
    wanted = {i for r in ranges for i in r}
    at = {i: m.span() for i, m in enumerate(_WORD.finditer(text)) if i in wanted}
    return [(at[a][0], at[b][1]) for a, b in ranges]


class Scanner:
    """The automaton of some items; built on first use, one at a time in each Python worker."""

    _built: dict[str, "Scanner"] = {}

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.items, self.size = items, size
        self.key = hashlib.sha256(repr((size, items)).encode("utf-8", "surrogatepass")).hexdigest()

    def ready(self) -> "Scanner":
        if self.key not in self._built:
            self._built.clear()
            self._built[self.key] = self
            self._build()
        return self._built[self.key]

    def _build(self) -> None:
        import ahocorasick

        size, block = self.size, (self.size + 1) // 2
        self.names = sorted({i for i, _ in self.items})
        number = {n: i for i, n in enumerate(self.names)}
        ids: dict[bytes, int] = {}
        every, owner, found = [np.full(size, -1, np.int32)], [np.zeros(size, np.int32)], {}  # -1 between items
        at = size
        for item, text in self.items:
            ws = words(text)
            if not ws:
                continue
            n = len(ws)
            for i in [0] if n < size else range(0, n - block + 1, block):
                part = ws if n < size else ws[i : i + block]
                found.setdefault(b" " + b" ".join(part) + b" ", (len(part), [], []))[1 if n < size else 2].append(at + i)
            every += [np.array([ids.setdefault(w, len(ids)) for w in ws], np.int32), np.full(size, -1, np.int32)]
            owner.append(np.full(n + size, number[item], np.int32))
            at += n + size
        self.ids, self.every, self.owner = ids, np.concatenate(every), np.concatenate(owner)
        # blocks: number of words, places of whole short items, places within longer items
        self.blocks, self.automaton = [], ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, (n, short, places) in found.items():
            self.automaton.add_word(text.decode("latin-1"), len(self.blocks))
            self.blocks.append((n, short, np.array(places, np.int64)))
        if found:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[str], list[tuple[int, int]]]:
        """Words, the items with an occurring window, and the word ranges [first, last] that are hit."""
        ws = words(text)
        if not ws or not self.blocks:
            return len(ws), [], []
        flat = b" " + b" ".join(ws) + b" "
        hits = list(self.automaton.iter(flat.decode("latin-1")))
        if not hits:
            return len(ws), [], []
        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
        ends = np.searchsorted(spaces, np.fromiter((e for e, _ in hits), np.int64, len(hits)))
        reach = self.size // 2
        steps = np.arange(1, reach + 1)
        around = np.full(len(ws) + 2 * reach, -2, np.int32)
        around[reach : reach + len(ws)] = [self.ids.get(w, -2) for w in ws]
        mark, items = np.zeros(len(ws) + 1, np.int64), set()
        for end, (_, k) in zip(ends, hits, strict=True):
            n, short, places = self.blocks[k]
            begin = int(end) - n
            spans = [np.array([[begin, begin + n]])] if short else []
            items.update(self.owner[short].tolist())
            if len(places):
                left = np.cumprod(self.every[places[:, None] - steps] == around[begin + reach - steps], axis=1).sum(1)
                right = np.cumprod(self.every[places[:, None] + n - 1 + steps] == around[begin + reach + n - 1 + steps], axis=1).sum(1)
                on = np.flatnonzero(left + n + right >= self.size)
                items.update(self.owner[places[on]].tolist())
                # each alignment by itself: what agrees to the left in one item and to the right in another is no window
                spans.append(np.unique(np.stack([begin - left[on], begin + n + right[on]], 1), axis=0))
            for span in spans:
                np.add.at(mark, span[:, 0], 1)
                np.add.at(mark, span[:, 1], -1)
        hit = np.concatenate(([0], np.cumsum(mark)[:-1] > 0, [0])).astype(np.int8)
        edge = np.flatnonzero(np.diff(hit))
        return len(ws), sorted(self.names[i] for i in items), [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [first, last] in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def benchmark_items(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("item_text")).where("item_text is not null")


def slices(items: list[tuple[str, str]], slice_bytes: int) -> list[list[tuple[str, str]]]:
    """Items in order, dealt into slices of about ``slice_bytes`` of text, or one longer item."""
    out, room = [[]], slice_bytes
    for item, text in items:
        size = len(text.encode("utf-8", "surrogatepass"))
        if size > room and out[-1]:
            out.append([])
            room = slice_bytes
        out[-1].append((item, text))
        room -= size
    return out


def with_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "contamination", size: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` plus the struct ``out`` (see ``RESULT``).

    The benchmark is read to the driver; the documents are never shuffled. Between the
    scans of two slices the rows are written, with what was found so far.
    """
    sc = docs.sparkSession.sparkContext
    items = sorted({(r["item"], r["item_text"]) for r in benchmark_items(benchmark).collect()})

    def scans(part, last: bool):
        held = sc.broadcast(Scanner(part, size))  # SLICE_BYTES of text

        def scan(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
            scanner, rows = held.value.ready(), []
            for t, names, first, to in zip(texts, before["items"], before["first"], before["last"], strict=True):
                n, found, ranges = scanner.scan(t)
                ranges = united([*ranges, *zip(first, to, strict=True)])
                found = sorted({*found, *names})
                if last:
                    spans = [{"start": a, "end": b} for a, b in (original_spans(t, ranges) if ranges else [])]
                    rows.append((n, sum(b - a + 1 for a, b in ranges), found, spans))
                else:
                    rows.append((found, [a for a, _ in ranges], [b for _, b in ranges]))
            return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"] if last else ["items", "first", "last"])

        return F.pandas_udf(scan, RESULT if last else _FOUND)

    found = docs.withColumn(out, F.from_json(F.lit('{"items": [], "first": [], "last": []}'), _FOUND))
    *parts, end = slices(items, slice_bytes)
    for part in parts:
        found = materialize(found.withColumn(out, scans(part, last=False)(text_col, out)), "scanned")
    return found.withColumn(out, scans(end, last=True)(text_col, out))


def contaminated(c: str = "contamination"):
    """The contract's rule: some word is hit, and at least a twentieth of all."""
    return (F.col(f"{c}.n_hit") > 0) & (20 * F.col(f"{c}.n_hit") >= F.col(f"{c}.n_words"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_contamination(docs, table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS win, least(13, len(w)) AS k FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
