import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from math import comb, log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelscope.llm import decontamination, hmm, packing, quality_cnn, quality_rules, records, sharding, simhash, toxicity, urls
from panelscope.llm._tokenize import PIECE, Encoder
from panelscope.llm.queries import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(t):
    return (t or "").translate(AZ)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_sf, name):
    assert QUERIES[name](spark, empty_sf).count() == 0


# op1


def brute_contamination(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ws = word.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        iw = word.findall(low(t))
        if not iw:
            continue
        wins = {tuple(iw[i : i + 13]) for i in range(max(1, len(iw) - 12))}
        for w in wins:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)


def test_decontamination(spark, sf):
    path, rows = sf
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = Counter(tuple(r) for r in decontamination.op1_decontamination(spark, path).collect())
    want = Counter((r[0], *brute_contamination(r[1], items)) for r in rows)
    assert got == want
    assert any(k[2] for k in got)


def test_decontamination_by_slices_and_spans(spark, sf):
    path, rows = sf
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    cols = ["doc_id", "text", "contamination"]
    one = decontamination.with_contamination(docs.drop("contamination"), bench).select(cols)
    many = decontamination.with_contamination(docs.drop("contamination"), bench, slice_bytes=30).select(cols)
    a, b = (sorted(map(str, x.collect())) for x in (one, many))
    assert a == b
    for r in one.where("contamination.n_hit > 0").collect():
        inside = " ".join(r["text"][s["start"] : s["end"]] for s in r["contamination"]["spans"])
        assert len(decontamination.words(inside)) == r["contamination"]["n_hit"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=4), st.lists(st.sampled_from("abcd"), max_size=60), st.integers(2, 8))
def test_scanner_finds_what_a_search_of_all_windows_finds(items, doc, size):
    named = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    _, found, ranges = decontamination.Scanner(named, size).ready().scan(" ".join(doc))
    hit, names = set(), set()
    for name, x in zip(map(str, range(len(items))), items, strict=True):
        for w in [x[i : i + size] for i in range(max(1, len(x) - size + 1))] if x else []:
            for i in range(len(doc) - len(w) + 1):
                if doc[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    names.add(name)
    assert found == sorted(names) and {j for a, b in ranges for j in range(a, b + 1)} == hit


# op2


def brute_fingerprint(text):
    ws = SPACE.findall(low(text))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    """Smallest id reachable by links of two bits or fewer."""
    parent = {f: f for f in set(fps.values())}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    each = list(parent)
    for i, a in enumerate(each):
        for b in each[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[top(a)] = top(b)
    least = {}
    for d, f in fps.items():
        least[top(f)] = min(d, least.get(top(f), d))
    return {d: least[top(f)] for d, f in fps.items()}


def test_simhash(spark, sf):
    path, rows = sf
    got = simhash.op2_simhash(spark, path).collect()
    assert len(got) == len(rows)
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = brute_classes(fps)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])


def test_simhash_links_on_planted_fingerprints(spark):
    r = np.random.default_rng(1)
    fps = [int(x) for x in r.integers(0, 1 << 63, 40)]
    for i in range(300):  # chains and hubs of one- and two-bit steps
        f = fps[int(r.integers(len(fps)))]
        for b in r.choice(64, int(r.integers(1, 4)), replace=False):
            f ^= 1 << int(b)
        fps.append(f)
    by_id = dict(enumerate(fps))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in by_id.items()]
    found = simhash.classes(spark.createDataFrame(signed, "doc_id long, fp long"))
    ids = {r["fp"]: r["component_id"] for r in found.collect()}
    assert {i: ids[f] for i, f in signed} == brute_classes(by_id)


def test_components_of_a_long_path_and_a_large_star(spark):
    path = [(i + 1, i) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(path + star, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 500)}


# op3


def test_language_model(spark, sf):
    path, rows = sf
    tokens = lambda t: [*SPACE.findall(low(t)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(x for r in rows if not held(r[0]) for x in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = {r[0]: (held(r[0]), len(tokens(r[1])), sum(c[x] > 0 for x in tokens(r[1])), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in tokens(r[1]))) for r in rows}
    got = hmm.op3_language_model(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], abs=1e-6)
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_forward_is_the_exact_likelihood_and_sums_to_one():
    from itertools import product

    m = hmm.HMM.initial(np.array([0.5, 0.3, 0.2]), states=3)
    total = 0.0
    for s in product(range(3), repeat=4):
        brute = sum(
            m.start[z[0]] * m.emit[s[0], z[0]] * np.prod([m.move[z[i - 1], z[i]] * m.emit[s[i], z[i]] for i in range(1, 4)]) for z in product(range(3), repeat=4)
        )
        got = 10 ** m.log10([np.array(s)])[0]
        assert got == pytest.approx(brute, rel=1e-9)
        total += got
    assert total == pytest.approx(1)


def test_baum_welch_raises_the_likelihood():
    r = np.random.default_rng(0)
    seqs = [r.integers(0, 5, int(r.integers(1, 60))) + 5 * (i % 2) for i in range(80)]
    prior = np.full(10, 0.1)
    m, last = hmm.HMM.initial(prior, states=2), -np.inf
    for _ in range(6):
        now = m.log10(seqs).sum()
        assert now > last - 1e-6
        last = now
        s, a, e = m.expected(seqs)
        assert s.sum() == pytest.approx(len(seqs), rel=1e-4) and e.sum() == pytest.approx(sum(map(len, seqs)), rel=1e-4)
        m = hmm.HMM(s / s.sum(), a / a.sum(1, keepdims=True), (e + 1e-9) / (e + 1e-9).sum(0))


def brute_expected(m, s):
    """Plain forward and backward sums over one whole sequence."""
    n, k = len(s), len(m.start)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = m.start * m.emit[s[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ m.move) * m.emit[s[t]]
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[s[t + 1]] * b[t + 1])
    p = a[-1].sum()
    moves = sum((np.outer(a[t], m.emit[s[t + 1]] * b[t + 1]) * m.move / p for t in range(n - 1)), np.zeros((k, k)))
    emits = np.zeros_like(m.emit)
    for t in range(n):
        emits[s[t]] += a[t] * b[t] / p
    return a[0] * b[0] / p, moves, emits


@pytest.mark.parametrize("length", [1, 3, 7, 64])
def test_expected_counts_are_of_whole_texts_wherever_they_are_cut(length):
    r = np.random.default_rng(3)
    m = hmm.HMM.initial(np.array([0.4, 0.3, 0.2, 0.1]), states=3)
    m.start = np.array([0.7, 0.2, 0.1])
    seqs = [r.integers(0, 4, n) for n in (1, 2, 3, 6, 7, 8, 21, 22, 60, 1, 40)]
    got = m.expected(seqs, length)
    want = [sum(x) for x in zip(*(brute_expected(m, s) for s in seqs), strict=True)]
    for x, y in zip(got, want, strict=True):
        np.testing.assert_allclose(x, y, rtol=2e-5, atol=1e-6)
    assert got[0].sum() == pytest.approx(len(seqs), rel=1e-5) and got[1].sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-5)


def test_expected_counts_over_many_groups_and_no_sequence(monkeypatch):
    monkeypatch.setattr(hmm, "_AT_ONCE", 4)
    r = np.random.default_rng(4)
    m = hmm.HMM.initial(np.array([0.5, 0.3, 0.2]), states=2)
    seqs = [r.integers(0, 3, int(n)) for n in r.integers(1, 30, 25)]
    for x, y in zip(m.expected(seqs, 5), m.expected(seqs, 1000), strict=True):
        np.testing.assert_allclose(x, y, rtol=2e-5, atol=1e-6)
    assert all(not x.any() for x in m.expected([], 5))


# op4


def brute_url(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = low(re.split(r"[/?#]", after)[0])
    path = re.split(r"[?#]", after[len(re.split(r"[/?#]", after)[0]) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, urls.DEFAULT))
    return host, path, best[1], best[2]


def test_urls(spark, sf):
    path, _ = sf
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    got = {r["page_id"]: tuple(r)[1:] for r in urls.op4_url_filter(spark, path).collect()}
    assert got == {r["page_id"]: brute_url(r["url"]) for r in pages}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/.*^", max_size=6), min_size=1, max_size=30), st.lists(st.text("ab/.", max_size=10), max_size=6))
def test_shift_and_matches_like_regular_expressions(globs, texts):
    rx = [re.compile("".join(".*" if c == "*" else "[^/]*" if c == "^" else re.escape(c) for c in g), re.S) for g in globs]
    got = urls.ShiftAnd(globs).match([t.encode() for t in texts])
    assert got.tolist() == [[bool(x.fullmatch(t)) for x in rx] for t in texts]


# op5 and op10


@pytest.mark.parametrize(("name", "label", "cut"), [("op5_toxicity", "toxic", 0.3), ("op10_quality", "quality", 0.7)])
def test_classifiers_on_awkward_rows(spark, sf, name, label, cut):
    path, rows = sf
    got = QUERIES[name](spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.9), ("op10_quality", "quality", 0.95)])
def test_classifiers_held_out_accuracy(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    right = got.selectExpr(f"avg(cast(predicted = {label} as int))", "avg(predicted)").first()
    assert right[0] >= least and 0 < right[1] < 1


def test_toxicity_recall_per_language(spark):
    """Words that begin alike for seven or eight bytes mark the texts that are not English."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = QUERIES["op5_toxicity"](spark, sf_dir).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    by = {r["lang"]: r for r in got.groupBy("lang").agg(*(F.expr(f"count_if({c})").alias(n) for n, c in (("toxic", "toxic = 1"), ("found", "toxic = 1 and predicted = 1"), ("clean", "toxic = 0"), ("wrong", "toxic = 0 and predicted = 1")))).collect()}
    print({k: (r["found"], r["toxic"], r["wrong"], r["clean"]) for k, r in by.items()})
    assert by["en"]["found"] >= 0.85 * by["en"]["toxic"]
    assert by["fr"]["found"] >= 0.8 * by["fr"]["toxic"] and by["de"]["found"] >= 0.6 * by["de"]["toxic"] and by["es"]["found"] > 0
    assert sum(r["wrong"] for r in by.values()) <= 0.03 * sum(r["clean"] for r in by.values())


def test_network_covers_every_byte_and_gradient_lowers_loss():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        c = quality_cnn.chunks("x" * n)
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        seen = np.zeros(len(c) * step + quality_cnn.CHUNK, int)
        for i, x in enumerate(c):
            seen[i * step : i * step + quality_cnn.CHUNK] |= x > 0
        assert seen.sum() == n
    docs = [(quality_cnn.chunks("ab cd " * 40 if i % 2 else "## $$ " * 40), i % 2) for i in range(40)]
    p = quality_cnn.start()
    for k in range(4):
        p = quality_cnn.train_shard(p, docs, (1, 1), k, 0.01)
    s = quality_cnn.score_texts(p, ["ab cd " * 300, "## $$ " * 300])
    assert s[0] > 0.8 > 0.2 > s[1]


def test_network_scores_like_plain_loops():
    q = quality_cnn
    p = {k: v.astype(np.float64) for k, v in q.start(3).items()}
    p["cb"][:], p["hb"][:], p["ob"][:] = 0.03, 0.1, -0.2
    for text in ("", "déjà vu, 12 bytes & more " * 60):
        raw, step, pools = (text or "").encode(), q.CHUNK - q.OVERLAP, []
        for at in range(0, max(1, len(raw) - q.OVERLAP), step):
            chunk = raw[at : at + q.CHUNK].ljust(q.CHUNK, b"\0")
            best = [max(sum(p["emb"][chunk[i + j]][d] * p["conv"][j * q.EMBED + d][f] for j in range(q.WIDTH) for d in range(q.EMBED)) for i in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE)) for f in range(q.FILTERS)]
            pools.append([max(0.0, b + p["cb"][f]) for f, b in enumerate(best)])
        mean = [sum(c) / len(pools) for c in zip(*pools, strict=True)]
        hid = [max(0.0, sum(m * p["h"][i][j] for i, m in enumerate(mean)) + p["hb"][j]) for j in range(q.HIDDEN)]
        z = sum(h * p["o"][j][0] for j, h in enumerate(hid)) + p["ob"][0]
        got = q.score_texts({k: v.astype(np.float32) for k, v in p.items()}, [text])[0]
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_network_gradient_does_not_depend_on_blocks(monkeypatch):
    docs = [(quality_cnn.chunks("ab cd " * (40 + 90 * i) if i % 2 else "## $$ " * (40 + 90 * i)), i % 2) for i in range(16)]
    whole = quality_cnn.train_shard(quality_cnn.start(), docs, (1, 1), 0, 0.01)
    monkeypatch.setattr(quality_cnn, "_BLOCK", 2)
    parts = quality_cnn.train_shard(quality_cnn.start(), docs, (1, 1), 0, 0.01)
    assert all(np.allclose(whole[k], parts[k], atol=2e-3) for k in whole)


def test_cells_are_those_of_the_character_ngrams():
    text, m = "Ärger  und\nÉté \U0001f600!", 1 << 64
    flat, want = f" {' '.join(text.lower().split())} ", set()
    for n in toxicity.SIZES:
        for i in range(len(flat) - n + 1):
            code = 0
            for c in flat[i : i + n]:
                code = (code * int(toxicity._STEP) + ord(c) + 1) % m
            want.add((code ^ code >> 31) * int(toxicity._MIX) % m >> 64 - toxicity.BITS)
    assert toxicity.cells(text).tolist() == sorted(want)


def test_toxicity_fit_against_plain_arithmetic(spark):
    """Ratios, weights and scores of a small fit, computed again without Spark."""
    r = np.random.default_rng(9)
    texts = [" ".join(r.choice(["calm", "river", "stone", "light"], 12)) + (" vermin" if i % 3 == 0 else "") for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    train = [(t, int(i % 3 == 0)) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    n1 = sum(y for _, y in train)
    n0, seen = len(train) - n1, defaultdict(lambda: [0, 0])
    for t, y in train:
        for c in set(toxicity.cells(t).tolist()):
            seen[c][y] += 1
    share = n1 / (n0 + n1)
    on = sorted(c for c, (a, b) in seen.items() if a + b >= 3 and abs(b - (a + b) * share) >= toxicity.EVIDENCE * ((a + b) * share * (1 - share)) ** 0.5)
    assert model.kept.on.tolist() == on and on
    scale = np.array([np.log((seen[c][1] + 1) / (n1 + 2)) - np.log((seen[c][0] + 1) / (n0 + 2)) for c in on])
    x = np.array([[c in set(toxicity.cells(t).tolist()) for c in on] for t, _ in train], float)
    y, w, bias, m = np.array([y for _, y in train]), np.zeros(len(on)), np.log(n1 / n0), np.zeros(len(on) + 1)
    for _ in range(toxicity.STEPS):
        e = 1 / (1 + np.exp(-(bias + x @ (scale * w)))) - y
        m = 0.9 * m + np.append(x.T @ e * scale / len(y) + toxicity.L2 * w, e.sum() / len(y))
        w, bias = w - toxicity.RATE * m[:-1], bias - toxicity.RATE * m[-1]
    assert np.allclose(model.weights, scale * w, atol=1e-3) and model.intercept == pytest.approx(bias, abs=1e-3)


def test_long_text_cells_do_not_depend_on_blocks(monkeypatch):
    t = "abc déf " * 500
    whole = toxicity.cells(t)
    monkeypatch.setattr(toxicity, "_BLOCK", 97)
    assert (toxicity.cells(t) == whole).all()


# op6 and op8


@cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(records.vocabulary_path(name))


def brute_ids(name, text, end):
    return [*tokenizer(name).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", [records.VOCABULARY, packing.VOCABULARY])
def test_pieces_encode_like_whole_texts(name):
    r = np.random.default_rng(2)
    alphabet = list("abZé1 \n \n\t\u00a0\u3000\x1c\x85.,!'*?|") + ["'s", "<|endoftext|>", "\u0301", "e\u0301", "  "]
    e = Encoder.of(records.vocabulary_path(name))
    texts = ["".join(r.choice(alphabet, int(r.integers(0, 30)))) for _ in range(3000)]
    texts += ["word " * 40 + t for t in texts[:300]]
    ids, n = e.encode(pa.array(texts))
    for t, x in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert "".join(PIECE.findall(t)) == t
        assert x.tolist() == brute_ids(name, t, 0)[:-1], repr(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("per_file", ["0", "5"])
def test_records(spark, sf, per_file):
    path, rows = sf
    spark.conf.set("spark.sql.files.maxRecordsPerFile", per_file)  # of the session; the files are not to follow it
    got = sorted(records.op6_token_records(spark, path).collect(), key=lambda r: r["start"])
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    ids = {(r[0], crc(x)): len(x) for r in rows for x in [brute_ids(records.VOCABULARY, r[1], 2)]}
    at = 0
    for r in got:
        assert r["start"] == at and ids[r["doc_id"], r["ids_crc32"]] == r["n_tokens"]
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order) == sorted(-1 if r[0] is None else r[0] for r in rows)


def test_record_files_allow_seeking_and_detect_damage(spark, sf):
    path, rows = sf
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    where, index = records.write_and_index(docs, records.vocabulary_path(records.VOCABULARY))
    from glob import glob

    files = {int(f.rsplit("/", 1)[1].split("-")[1]): open(f, "rb").read() for f in glob(where.removeprefix("file://") + "/part-*")}
    for r in index.collect():
        (at, payload), *_ = records.frames(files[r["part"]][r["offset"] : r["offset"] + r["length"]])
        doc_id, ids = records.unpack(payload)
        assert doc_id == (None if r["doc_id"] is None else str(r["doc_id"])) and len(ids) == r["n_tokens"] and crc(ids) == r["ids_crc32"]
    bad = bytearray(next(x for x in files.values() if x))
    bad[20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(records.frames(bytes(bad)))


def test_records_take_text_ids_and_spread_equal_rows_over_files(spark):
    rows = [("b", "x y " * 50)] * 40 + [("a", "first"), (None, "z"), ("c", "last"), ("b", "other")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    where = records.new_path(spark, "few")
    records.write(docs, where, records.vocabulary_path(records.VOCABULARY), file_text_bytes=1000)
    index = records.read_index(spark, where).orderBy("part", "record").collect()
    assert [r["doc_id"] for r in index] == [None, "a", *["b"] * 41, "c"]
    assert len({r["part"] for r in index if r["doc_id"] == "b"}) > 5


def test_packing_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    a, b = (Counter(map(tuple, packing.pack(docs.repartition(k), records.vocabulary_path(packing.VOCABULARY), with_ids=False).collect())) for k in (1, 5))
    assert a == b


def test_packing(spark, sf):
    path, rows = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = packing.pack(docs, records.vocabulary_path(packing.VOCABULARY), length=64).collect()
    want = Counter((r[0], crc(x), len(x)) for r in rows for x in [brute_ids(packing.VOCABULARY, r[1], 1)])
    seqs, whole = defaultdict(list), defaultdict(list)
    for r in got:
        assert crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["sequence_id"] * 64 + r["offset"] - r["start"], r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
    for s, parts in seqs.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 64 or s == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))
    back = Counter((d, zlib.crc32(b"".join(x[1] for x in sorted(p))), p[0][2]) for (_, d), p in whole.items())
    assert back == want


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_curve_is_a_walk_through_all_cells(dims):
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(side**dims))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# op7


def brute_stats(t):
    t = t or ""
    ws = SPACE.findall(t)
    wins = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    rep = {j for i in range(len(ws) - 2) if wins[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if SPACE.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(ws) < 50 or 100 * len(rep) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), failed


def test_quality_rules(spark, sf):
    path, rows = sf
    got = quality_rules.op7_quality_rules(spark, path).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r[0], *brute_stats(r[1])) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(ws):
    assert quality_rules.repeated_words(ws) == brute_stats(" ".join(ws))[4]


def test_bound_is_exact_and_cutoffs_stop_at_the_first_failure():
    for k, n, d in ((0, 50, 0.05), (3, 80, 0.01), (7, 20, 0.1)):
        p = quality_rules.upper_bound(k, n, d)
        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(d, rel=1e-6)
    assert quality_rules.upper_bound(0, 0, 0.05) == quality_rules.upper_bound(5, 5, 0.05) == 1
    assert quality_rules.passed([0, 0, 90], 3000, 0.01, 0.01) == 2
    assert quality_rules.passed([90, 90, 90], 3000, 0.01, 0.01) == 0
    assert quality_rules.passed([0], 20, 0.01, 0.01) == 0
    n = quality_rules.needed(0.01, 0.02)
    assert quality_rules.passed([0], n, 0.02, 0.01) == 1 and quality_rules.passed([0], n - 1, 0.02, 0.01) == 0


def test_cutoffs_keep_to_the_limit_and_stop_only_at_it(spark):
    """Kept rows against a plain recount from the cutoffs, and the cutoffs against the holdout."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(2400):
        poor, lang = i % 4 == 3, ["en", "de", "fr", None][i % 60 // 20 if i % 60 < 50 else 3]
        ws = [f"w{i}k{j}" for j in range(60)] + ["#"] * int(r.integers(4, 12) if poor else r.integers(0, 5))
        rows.append((i, " ".join(ws), lang, "junk", int(not poor)))
    docs = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, lang string, stratum string")
    labels = spark.createDataFrame([(x[0], x[4], 0) for x in rows], "doc_id long, quality int, toxic int")
    measured = docs.select("doc_id", quality_rules.stratum_of().alias("stratum"), quality_rules.with_stats().alias("_ps_stats"))
    cuts = {c["stratum"]: c for c in quality_rules.thresholds(measured, labels).collect()}
    assert quality_rules.POOL in cuts and len(cuts) > 1  # the small strata are one pool
    tuning = {x["doc_id"] for x in quality_rules.labelled(measured, labels).where("tuning").collect()}
    want, false = set(), Counter()
    for i, t, lang, _, good in rows:
        s = "null" if lang is None else "=" + lang
        s = s if s in cuts else quality_rules.POOL
        words, chars, symbols, dup, rep, lines = quality_rules.stats(t)
        shares = {"symbols": symbols / chars, "dup_lines": dup / lines, "repeats": rep / words, "long_words": chars / words}
        bad = any(cuts[s][k] is not None and v > cuts[s][k] for k, v in shares.items())
        want |= set() if bad or brute_stats(t)[5] else {i}
        if good and i not in tuning:
            false[s, bad] += 1
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == want
    for s, c in cuts.items():
        assert (c["n"], c["rejected"]) == (false[s, True] + false[s, False], false[s, True])
        assert quality_rules.upper_bound(c["rejected"], c["n"], quality_rules.DELTA / len(cuts)) <= quality_rules.ALPHA
        assert c["symbols"] is not None
    poor = {i for i, *_, good in rows if not good}
    assert len(poor - want) > 0.5 * len(poor)


def test_order_of_candidates_prefers_poor_documents_at_little_cost():
    tuned = {("symbols", 0.5): (10, 0), ("symbols", 0.2): (30, 1), ("repeats", 0.4): (1, 0), ("repeats", 0.3): (2, 40)}
    assert quality_rules.in_order(tuned) == [("symbols", 0.5), ("symbols", 0.2), ("repeats", 0.4)]


# op9


def test_sharding(spark, sf):
    path, rows = sf
    got = sharding.op9_sharding(spark, path).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.op9_sharding(spark, path).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_shard_and_slot_are_those_of_a_plain_network(spark, sf):
    path, rows = sf
    keyed = sorted(((r[0] is not None, r[0] or 0), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8, r[0]) for r in rows if r[0] is not None)
    keyed = [((False, 0), zlib.crc32(r[1].encode()), len(r[1].encode()) + 8, None) for r in rows if r[0] is None] + keyed
    n, f = len(keyed), sharding.Feistel(len(keyed))

    def walk(x):
        while True:
            left, right = x >> f.half, x & (2**f.half - 1)
            for a, b in f.keys:
                v = (right * a + b) % (2**31 - 1)
                left, right = right, left ^ ((v ^ (v >> 13)) & (2**f.half - 1))
            x = (left << f.half) | right
            if x < n:
                return x

    want = Counter((d, size, crc, walk(i) % 24, walk(i) // 24) for i, (_, crc, size, d) in enumerate(keyed))
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.op9_sharding(spark, path).collect())
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**31))
def test_feistel_is_a_permutation_with_an_inverse(n, key):
    f = sharding.Feistel(n, key)
    y = f.permute(np.arange(n))
    assert sorted(y) == list(range(n))
    assert (f.invert(y) == np.arange(n)).all()
