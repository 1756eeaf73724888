import random

from pyspark.sql import functions as F

from tagloom.llm.leaks import LEAST, RUN, TOLERANCE, WuManber, contained_items, words

VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("st", "rd", "ng", "lk", "mp")]


def brute(item, doc):
    """Longest passage on any alignment: every start and end tried."""
    best = 0
    for off in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -off), min(len(item), len(doc) - off)
        same = [item[p] == doc[p + off] for p in range(lo, hi)]
        for i in range(len(same)):
            miss = 0
            for j in range(i, len(same)):
                miss += not same[j]
                n = j - i + 1
                if n >= LEAST and TOLERANCE * miss <= n:
                    best = max(best, n)
    return best


def test_words_are_plain():
    assert words("<b>The</b> **Ｄｒｉｖｅ’s** dátásét &amp; co-\nre [x](http://y.z) Straße") == ["the", "drives", "dataset", "core", "x", "strasse"]
    assert words("  1: one two\n  2: three 7\n  3: four") == ["one", "two", "three", "7", "four"]
    assert words("of\n541. During the\n77 tests") == ["of", "541", "during", "the", "77", "tests"]
    assert words("> quoted\n> text") == ["quoted", "text"] and words(None) == [] and words("") == []


def test_search_equals_brute_force():
    rng = random.Random(11)
    items = [(i, [rng.choice(VOCAB) for _ in range(rng.randint(15, 45))]) for i in range(12)]
    items[3] = (3, items[2][1][:25] + items[3][1])  # a shared opening
    engine = WuManber(items)
    hits = 0
    for _ in range(250):
        doc = [rng.choice(VOCAB + ["other"]) for _ in range(rng.randint(0, 30))]
        src = rng.choice(items)[1]
        a = rng.randint(0, max(0, len(src) - 15))
        part = list(src[a : a + rng.randint(12, 40)])
        for k in rng.sample(range(len(part)), k=min(len(part), rng.randint(0, 5))):
            part[k] = "changed"
        doc = doc + part + [rng.choice(VOCAB) for _ in range(rng.randint(0, 20))]
        want = {i: n for i, ws in items if (n := brute(ws, doc))}
        got = {i: n for i, n, _, _ in engine.find(" ".join(doc))}
        assert got == want
        hits += len(want)
    assert hits > 60


def test_six_words_always_stay():
    """Of n words with n/8 different, the longest untouched run can't be under RUN."""
    for n in range(LEAST, 400):
        m = n // TOLERANCE
        assert -(-(n - m) // (m + 1)) >= RUN


def test_documents(spark):
    item = " ".join(f"w{i}" for i in range(30))
    changed = " ".join("zz" if i in (4, 13) else f"W{i}," for i in range(22))
    short = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"x {item} y"), (2, changed), (3, short), (4, None), (5, ""), (2, changed), (6, "pad " * 50000 + item), (None, item)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, item), (8, short), (9, None), (None, item), (10, item)], "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.item_id, r.n_words, r.n_different) for r in contained_items(df, items).collect())
    assert got == sorted((d, i, n, m) for d, n, m in (("1", 30, 0), ("2", 22, 2), ("2", 22, 2), ("6", 30, 0), ("None", 30, 0)) for i in (7, 10))
    assert sorted(contained_items(df, items, max_bytes=10).collect(), key=str) == sorted(contained_items(df, items).collect(), key=str)
    assert contained_items(df.limit(0), items).count() == 0 and contained_items(df, items.limit(0)).count() == 0


def test_joined_runs_give_the_same_rows(spark, sf):
    """The way beyond the broadcast's bound, on the corpus and on texts with words of few kinds, so that runs repeat."""
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(15, 60)))) for i in range(20)]
    docs = [(i, " ".join([*(rng.choice(VOCAB) for _ in range(20)), *rng.choice(items)[1].split()[rng.randint(0, 9) :]])) for i in range(200)]
    for d, e in ((spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")), (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"))):
        near, far = (sorted(map(tuple, contained_items(d, e, max_bytes=n).collect())) for n in (1 << 30, 0))
        assert near == far and near


def test_long_markup_and_sizes():
    assert words(f'<a href="{"x" * 500}">Word</a> 5 < 7 and 8 > 6') == ["word", "5", "7", "and", "8", "6"]
    assert words("a <b " + "c " * 300 + "> d")[1] == "b"  # no tag
