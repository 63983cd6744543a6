"""Operators 11 to 13 against brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelscope.llm import alignment, exact_search, vector_codes
from panelscope.llm.records import vocabulary_path

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")
A, B = vocabulary_path(alignment.A_FILE), vocabulary_path(alignment.B_FILE)
ODD = [
    "a\n", "\n", " ", "  ", "\n\n x", " a  b ", "tab\tb \tc\t", "x;\r\n y\r\n", "</s><s><unk><|endoftext|> <0x0A>", "é ß　x y", "z\x00 \x1c a", "don't 12 3.5 😀 日本語 ", "é ́x", "▁", "a ▁b", "w" * 3000, "a  b \x85 c", "﻿ x", "x" + " " * 40 + "y",
]


def brute_ids(text):
    """Ids and tokens of the whole text by both libraries, or none."""
    al = alignment.Aligner.of(A, B)
    if not text:
        return [], [], [], []
    a, b = al.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    x, y = [al.a_bytes[i] for i in a], [al.b_bytes[i] for i in b]
    want = (" " + text).encode()
    return (a, x, b, y) if b"".join(x) == b"".join(y) == want else ([], [], [], [])


def ends(tokens):
    return np.cumsum([len(t) for t in tokens], dtype=int).tolist()


def brute_links(x, y):
    """Overlapping (i, j) of two cuts of the same bytes, by the tokens over each byte."""
    over = zip([i for i, t in enumerate(x) for _ in t], [j for j, t in enumerate(y) for _ in t], strict=True)
    return sorted(set(over))


def brute_alignment(rows):
    each, docs_of = [], Counter()
    for doc_id, text in rows:
        a, x, b, y = brute_ids(text)
        pairs = [(a[i], b[j]) for i, j in brute_links(x, y)]
        docs_of.update(set(pairs))
        ea, eb, groups, i, j = ends(x), ends(y), [], 0, 0
        for e in ea:
            if e in eb:
                p, q = ea.index(e) + 1, eb.index(e) + 1
                groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
                i, j = p, q
        each.append((doc_id, len(a), len(b), groups, pairs))
    most = defaultdict(int)
    for (a, _), n in docs_of.items():
        most[a] = max(most[a], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return Counter((d, m, n, len(g), len(p), sum(docs_of[x] == most[x[0]] for x in p), sum(docs_of[x] for x in p), sha(g)) for d, m, n, g, p in each)


def test_alignment_equals_brute_force(spark, sf):
    path, rows = sf
    short = [(r[0], r[1]) for r in rows if len(r[1] or "") < 5000]
    got = Counter(tuple(r) for r in alignment.op11_alignment(spark, path).collect() if r["n_links"] < 20_000)
    assert got == brute_alignment(short)


@pytest.mark.parametrize("head", [1, 50, 1 << 18])
def test_alignment_of_odd_texts_with_few_and_many_broadcast_pairs(spark, head):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice([*"ab éß.,'\n\t ", "\n", " ", "12", "日"]) for _ in range(60)) for _ in range(80)] + ODD[:5]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, n_a string")
    aligned = alignment.materialize(alignment.token_groups(docs, A, B), "t")
    got = alignment.with_counts(aligned, head).collect()
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert Counter((x["doc_id"], *(x[c] for c in alignment.SUMS), x["n_best"], x["count_sum"], sha(x["groups"])) for x in got) == brute_alignment(rows)
    assert sum(x["n_a"] == 0 for x in got) == 2 + 0  # the two with U+2581


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.randoms())
def test_slices_and_links_of_any_two_cuts(sizes, rand):
    total = sum(sizes)
    cuts = sorted(rand.sample(range(1, total), rand.randint(0, total - 1))) + [total]
    x, y = [b"." * n for n in sizes], [b"." * (j - i) for i, j in zip([0, *cuts], cuts, strict=False)]
    ea, eb = np.array(ends(x)), np.array(ends(y))
    assert list(zip(*alignment.links(ea, eb), strict=True)) == brute_links(x, y)
    common, a_to, b_to = alignment.common_ends(ea, eb)
    assert common.tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))
    assert (ea[a_to - 1] == common).all() and (eb[b_to - 1] == common).all()


# op12


def plain_integers(rows, scale):
    """(vec_id, label, integers) of the usable rows, padded to the longest."""
    kept = [(r["vec_id"], r["label"], r["embedding"]) for r in rows if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    width = max((len(v) for *_, v in kept), default=0)
    return [(i, n, [int(np.floor(scale * float(x))) for x in v] + [0] * (width - len(v))) for i, n, v in kept]


def brute_codes(rows):
    rows = plain_integers(rows, vector_codes.SCALE)
    d = len(rows[0][2]) // 16
    first = sorted((i, v) for i, _, v in rows if i is not None)[:64]
    books = [[v[p * d : p * d + d] for _, v in first] for p in range(16)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(v[p * d : p * d + d], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(16)] for *_, v in rows]

    for _ in range(2):
        got = assign()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [v[p * d : p * d + d] for (*_, v), g in zip(rows, got, strict=True) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = assign()
    error = [sum(x for x, _ in g) for g in got]
    by_label = Counter()
    for (_, n, _), e in zip(rows, error, strict=True):
        by_label[n] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in g), e, by_label[n], sha) for (i, n, _), g, e in zip(rows, got, error, strict=True))


def test_vector_codes_equal_plain_arithmetic(spark, sf):
    path, _ = sf
    got = Counter(tuple(r) for r in vector_codes.op12_vector_codes(spark, path).collect())
    assert got == brute_codes(spark.read.parquet(f"{path}/embeddings.parquet").collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_active_entries_give_the_codes_of_a_complete_comparison(seed):
    r = np.random.default_rng(seed)
    x, old = r.integers(-3, 4, (40, 2)), r.integers(-3, 4, (6, 2))  # small numbers, many ties
    new = np.where(r.random((6, 1)) < 0.5, old, r.integers(-3, 4, (6, 2)))
    got = vector_codes.reassign(x, new, (new != old).any(1), *vector_codes.assign(x, old))
    want = vector_codes.assign(x, new)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_vector_codes_refuse_what_64_bits_cannot_hold(spark):
    huge = spark.createDataFrame([(1, [1e30] * 16)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large|OVERFLOW"):
        vector_codes.compress(huge)


# op13


def brute_search(rows):
    rows, out = plain_integers(rows, exact_search.SCALE), Counter()
    for a, (i, _, v) in enumerate(rows):
        if i is not None and i % 100 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0) for b, (j, _, w) in enumerate(rows) if a != b))[:10]
            out.update((i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(scored))
    return out


@pytest.mark.parametrize("shape", [{}, {"pivots": 5, "block": 3, "chunk": 4, "widths": (1, 2, None)}, {"pivots": 1, "block": 50}])
def test_search_equals_brute_force(spark, sf, shape):
    path, _ = sf
    vectors = spark.read.parquet(f"{path}/embeddings.parquet")
    got = Counter(tuple(r) for r in exact_search.search(vectors, **shape).collect())
    assert got == brute_search(vectors.collect())


def test_annuli_hold_every_row_and_their_bounds_every_score(spark):
    vectors = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    rows, width, most = vector_codes.integers(vectors, exact_search.SCALE)
    kind, pivots = exact_search.Kind(width, most), exact_search.fit_pivots(rows, 8)
    index = exact_search.annuli(rows, pivots, kind, 20).toPandas()
    assert sorted(i for x in index["ids"] for i in x) == list(range(500)) and index["n"].max() <= 20
    every = np.concatenate([kind.read(v) for v in index["v"]])
    upper = exact_search.bounds(every, pivots, *(index[c].to_numpy() for c in ("pivot", "inner", "outer", "norm")))
    for j, v in enumerate(index["v"]):
        assert ((every @ kind.read(v).T).max(1) <= upper[:, j]).all()


@pytest.mark.parametrize("name, sql", [("op12_vector_codes", vector_codes.SQL), ("op13_exact_search", exact_search.SQL)])
def test_twins(spark, name, sql):
    from panelscope.llm.queries import QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/sf0.001/embeddings.parquet'")
    got, want = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).to_numpy())) == sorted(map(tuple, want[columns].astype(str).to_numpy()))
