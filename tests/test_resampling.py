"""Hashed draws against draws by hand, and their cost."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from panelscope.functions import picks
from panelscope.operators import resampling


def number(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("length", [1, 40, 46, 47, 51, 63, 64, 130])  # one block of MD5, two, three
def test_first_words_are_those_of_md5(length):
    draws, slots = np.arange(998, 1000), np.arange(10, 40)
    got = picks.first_words(b"k" * length, draws, slots)
    assert got.tolist() == [[number("k" * length, d, s) for s in slots] for d in draws]


def by_hand(rows, draws, seed):
    """Means by (g, draw) of rows (g, s, c, v, n)."""
    out = {}
    for g in {r[0] for r in rows}:
        for d in range(1, draws + 1):
            v = n = 0
            for s in {r[1] for r in rows if r[0] == g}:
                own = sorted(r[2:] for r in rows if r[:2] == (g, s))
                for i in range(len(own)):
                    _, x, k = own[number(seed, g, s, d, i) % len(own)]
                    v, n = v + x, n + k
            out[g, d] = round(v / n, 9)
    return out


@pytest.mark.parametrize("block, piece, work, cuts", [(2**20, 4096, 2**24, 32), (8, 4, 60, 7)])
def test_draws_equal_draws_by_hand(spark, monkeypatch, block, piece, work, cuts):
    for name, value in (("BLOCK", block), ("PIECE", piece), ("WORK", work), ("CUTS", cuts)):
        monkeypatch.setattr(resampling, name, value)
    rows = [(g, s, c, float(c * c % 17 + s), c % 3 + 1) for g, sizes in (("a", (29, 1)), ("b" * 70, (12, 8))) for s, m in enumerate(sizes) for c in range(m)]
    df = spark.createDataFrame([*rows, (None, 0, 1, 1.0, 1)], "g string, s long, c long, v double, n long")
    got = {(r["g"], r["draw"]): r["means"] for r in resampled(df).collect()}
    want = by_hand(rows, 23, 5)
    assert got.keys() == want.keys()
    assert all(m == [pytest.approx(want[k], abs=2e-9)] for k, m in got.items())


def resampled(df):
    return resampling.resampled(df, ["g"], ["s"], "c", ["v"], "n", 23, 5)


def test_no_row_is_made_for_a_single_pick(spark):
    df = spark.range(500).selectExpr("'a' AS g", "0L AS s", "id AS c", "double(id) AS v", "1L AS n")
    plan = resampled(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_digits_of_slots_are_made_once_for_all_draws(monkeypatch):
    made = []
    monkeypatch.setattr(picks, "slot_words", lambda *a, of=picks.slot_words: made.append(len(a[2])) or of(*a))
    monkeypatch.setattr(picks, "TILE", 64)
    got = picks.drawn_sums(b"k", 10, 59, 300, 0, [np.arange(300.0)])
    assert sorted(made) == [10, *[45] * 2, *[50] * 4]  # tiles of one size between 0, 10, 100 and 300
    assert got[0].tolist() == [sum(number("k", d, i) % 300 for i in range(300)) for d in range(10, 60)]


def test_tiles_of_one_shape_share_their_arrays(monkeypatch):
    made = []
    monkeypatch.setattr(picks, "rooms", lambda shape, of=picks.rooms: made.append(shape) or of(shape))
    monkeypatch.setattr(picks, "TILE", 64)
    for length in (1, 60):  # one block of MD5, two
        made.clear()
        key = "k" * length
        got = picks.drawn_sums(key.encode(), 10, 59, 300, 0, [np.arange(300.0), np.ones(300)])
        assert got.tolist() == [[sum(number(key, d, i) % 300 for i in range(300)) for d in range(10, 60)], [300.0] * 50]
        assert len(made) <= 16 < 50  # two shapes at most for a range of slots, not one for every tile


@pytest.mark.parametrize("chunks", [1, 3, 64])
def test_pieces_of_a_stratum_are_not_copied_by_arrow(chunks):
    numbers = np.random.default_rng(1).permutation(64)
    pieces = [[float(k * 1000 + i) for i in range(300 if k < 63 else 30)] for k in numbers]
    cut = [pieces[i : i + 64 // chunks] for i in range(0, 64, 64 // chunks)]
    lists = pa.chunked_array([pa.array(x, pa.list_(pa.float64())) for x in cut])
    held = pa.total_allocated_bytes()
    most = pa.default_memory_pool().max_memory()
    got = resampling.columns_of(pa.chunked_array([numbers]), lists, 3)
    assert (pa.total_allocated_bytes(), pa.default_memory_pool().max_memory()) == (held, most)
    want = np.concatenate([pieces[k] for k in np.argsort(numbers)]).reshape(-1, 3)
    assert got.T.tolist() == want.tolist() and got[0].flags.c_contiguous


def test_many_strata_are_cut_into_few_tasks(spark, monkeypatch):
    rows = [(g, s, c, float(c * c % 17 + s), c % 3 + 1) for g, s in (("a", 0), ("b", 1)) for c in range(40)]
    df = spark.createDataFrame(rows, "g string, s long, c long, v double, n long")
    want = by_hand(rows, 23, 5)
    for name, value in (("WORK", 60), ("CUTS", 23)):
        monkeypatch.setattr(resampling, name, value)
    for limit, tasks in ((2, 2), (8, 10), (46, 46), (1000, 46)):  # whole draws to a task, and one at least
        monkeypatch.setattr(resampling, "TASKS", limit)
        got = resampled(df)
        assert f", {4 * tasks}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
        assert {(r["g"], r["draw"]): r["means"] for r in got.collect()} == {k: [pytest.approx(v, abs=2e-9)] for k, v in want.items()}
