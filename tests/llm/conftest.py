import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that clash with what operators add
        *(T.StructField(c, T.StringType()) for c in ("score", "fingerprint", "n_words", "shard", "key", "contamination")),
    ]
)
LABELS = "doc_id long, quality int, toxic int"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, code string"
BENCH = "item_id long, text string, n_hit string"
INSULTS = ["blockhead", "vermin", "imbecile"]


def make_docs(seed: int = 3):
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tu", "sol", "ve", "dan", "é", "ßu"]
    lexicon = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(120)]
    item = [f"q{i}x" for i in range(20)]
    texts: list[str | None] = [None, "", "   \n\t ", "one", "Two words", "!!! ??? ..."]
    for i in range(60):
        ws = [r.choice(lexicon).capitalize() if r.random() < 0.1 else r.choice(lexicon) for _ in range(r.randint(20, 150))]
        if i % 5 == 0:
            ws[5:5] = item[2 : 2 + 13 + i % 4]
        if i % 6 == 1:
            ws.insert(3, r.choice(INSULTS))
        if i % 7 == 2:
            ws = [x for w in ws for x in (w, "|")]
        texts.append(" ".join(ws).replace(" ka ", ".\nka ", 2))
    texts += [texts[10], texts[10], texts[11] + " extra", "x " * 30_000 + "end", "a\tb\u00a0c \u3000 d\x1c e\t\n f  \n\n g", "line\nline\nline\n\nother"]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 9 == 0 else f"s{i % 2}", None, *["junk"] * 6) for i, t in enumerate(texts)]
    return rows + [rows[12]] + [(None, "no id at all", "en", None, 1, *[None] * 6)], " ".join(item)


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """A folder of small tables with every awkward case, and the rows themselves."""
    rows, item = make_docs()
    r2 = random.Random(4)
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    bench = [(1, item, "z"), (1, item, "z"), (10, item.upper() + "!", None), (2, "two WORDS", None), (3, None, None), (4, "", None), (5, "?!", None)]
    spark.createDataFrame(bench, BENCH).write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], int("|" not in (r[1] or "")), int(any(w in (r[1] or "") for w in INSULTS))) for r in rows if r[0] is not None]
    labels += [labels[5], (7, 0, 1), (7, 1, 0), (None, 1, 1), (999_999, 1, 0), (8, None, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    pages = [(i, u, "<p>") for i, u in enumerate([None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://com/en/", "x://com/en", "x://acom/en/1", "x://b.net/de/8", "x://example.net/de/81", "x://a.example.net#/de/8", "x://org/es/", "x://h/x.com/en/", "x://é.org/es/ß?x", "x://" + "a." * 3000 + "com/en/" + "y" * 5000, "x://com/en/", "x://com://com/en/"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [r2.choice([0.0, 0.25, -0.5, 1.0, 0.3]) for _ in range(32)], i % 3 if i % 4 else None, "z") for i in range(150)]
    vectors += [(i, vectors[100][1], 9, None) for i in range(150, 420)]  # copies, more than an annulus holds
    vectors += [(420, None, 1, None), (421, [None] * 32, 1, None), (422, [float("nan")] + [0.0] * 31, 1, None), (423, [float("inf")] * 32, 1, None), (None, vectors[3][1], 1, None), (200, vectors[5][1], 1, None), (200, vectors[150][1], 9, None), (500, [], 2, None), (501, [0.5] * 20, 2, None)]
    spark.createDataFrame(vectors, EMBEDDINGS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path), rows


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCS), ("benchmark", BENCH), ("labels", LABELS), ("pages", "page_id long, url string, html string"), ("embeddings", EMBEDDINGS)):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)
