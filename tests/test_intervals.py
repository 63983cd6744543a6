"""Cells and days of intervals: right by hand, and nothing exploded is broadcast or shuffled day by day."""

import datetime as dt

from panelscope.operators import results, studies

DAY = dt.date(1998, 1, 1)


def intervals(spark, rows):
    return spark.createDataFrame([(e, i, DAY + dt.timedelta(a), DAY + dt.timedelta(b)) for e, i, a, b in rows], "entity string, interval_id long, start_date date, end_date date")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_cells_are_not_broadcast(spark, tmp_path):
    intervals(spark, [("a", 1, 0, 9), ("a", 2, 5, 14), ("a", 3, 15, 15), ("b", 4, 0, 9)]).write.parquet(f"{tmp_path}/iv")
    cells = spark.read.parquet(f"{tmp_path}/iv").selectExpr("entity", "interval_id", "explode(sequence(start_date, end_date)) AS d")
    got = studies.cell_overlaps(cells, "interval_id", ["entity", "d"])
    assert "Broadcast" not in plan(got)
    assert [(r["interval_id"], r["other"], r["shared"], r["overlap"]) for r in got.collect()] == [(1, 2, 5, 0.5)]


def test_days_are_covered_as_by_hand(spark):
    rows = [("a", 10, 0, 3), ("a", 9, 2, 80), ("a", 9, 2, 2), ("a", 8, 99, 99), ("b", 7, 40, 40), ("b", 6, 44, 44)]
    got = results.date_coverage(intervals(spark, rows))
    want = {}
    for e, i, a, b in rows:
        for k in range(a, b + 1):
            want.setdefault((e, DAY + dt.timedelta(k)), []).append(i)
    assert {(r["entity"], r["day"]): (r["n"], r["ids"]) for r in got.collect()} == {k: (len(v), ",".join(map(str, sorted(set(v))))) for k, v in want.items()}
    lines = plan(got).split("\n")
    made, shuffled = (next(i for i, line in enumerate(lines) if w in line) for w in ("Generate explode(sequence(cast(greatest", "Exchange"))
    assert made < shuffled  # the plan is read from the result down


def overlaps_by_hand(cells):
    """(name, other, shared, jaccard, overlap, duplicate) of sets of cells by name."""
    out = set()
    for a in cells:
        for b in cells:
            if a < b and (k := len(cells[a] & cells[b])):
                n, m = len(cells[a]), len(cells[b])
                out.add((a, b, k, k / (n + m - k), k / min(n, m), k == n == m))
    return out


def test_overlaps_of_spans_and_of_cells_are_those_by_hand(spark):
    rows = [("a", 1, 0, 30), ("a", 2, 20, 50), ("a", 2, 45, 300), ("b", 2, 0, 0), ("b", 3, -20000, 9), ("b", 3, 5, 9), ("a", 4, 300, 300), ("a", 5, 9, 3)]
    rows += [("c", 6, -10300, -10213), ("c", 7, -10227, -10226), ("c", 8, -10227, -10226), ("a", 9, 63, 64), ("b", 10, -10227 - 64, -10227 - 1)]
    cells = {}
    for e, i, a, b in rows:
        cells.setdefault(i, set()).update((e, k) for k in range(a, b + 1))
    want = overlaps_by_hand(cells)
    assert len(want) > 5 and any(w[-1] for w in want)
    spans = intervals(spark, [*rows, (None, 1, 0, 9)])  # without an entity no cell
    assert {tuple(r) for r in studies.span_overlaps(spans, "interval_id", ["entity"]).collect()} == want
    days = spans.where("start_date <= end_date").selectExpr("entity", "interval_id", "explode(sequence(start_date, end_date)) AS d")
    assert {tuple(r) for r in studies.cell_overlaps(days, "interval_id", ["entity", "d"]).collect()} == want
    texts = days.selectExpr("entity", "interval_id", "string(d) AS d")  # no date: cell by cell
    assert {tuple(r) for r in studies.cell_overlaps(texts.unionByName(texts), "interval_id", ["entity", "d"]).collect()} == want


def shuffled_rows(df):
    """Rows that the exchanges of a run write; one that is read again counts once."""
    df.collect()
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name != "ReusedExchangeExec":
            if name == "ShuffleExchangeExec":
                seen += p.metrics().apply("shuffleRecordsWritten").value()
            todo.extend(p.children().apply(i) for i in range(p.children().size()))
    return seen


def test_days_of_sets_are_shuffled_as_words(spark, tmp_path):
    intervals(spark, [(str(i // 2), i, 7 * i, 7 * i + 30) for i in range(1000)]).write.parquet(f"{tmp_path}/iv")
    spans = spark.read.parquet(f"{tmp_path}/iv")
    assert 3000 <= shuffled_rows(studies.span_overlaps(spans, "interval_id", ["entity"])) <= 6000  # up to two words a set, by places and by names, and 500 pairs
    days = spans.selectExpr("entity", "interval_id", "explode(sequence(start_date, end_date)) AS d")
    assert 3000 <= shuffled_rows(studies.cell_overlaps(days, "interval_id", ["entity", "d"])) <= 8000
