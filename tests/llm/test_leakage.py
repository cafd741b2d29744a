import random

from srcatlas.llm.leakage import leaks

RND = random.Random(3)
VOCAB = [f"{a}{b}" for a in "kiln loom silo barge anvil ferry quarry granary".split() for b in "spins holds turns weighs rings drains".split()]
OPEN = ["Read the text and answer.", "What follows from this?"]


def passage(n):
    return [RND.choice(VOCAB) for _ in range(n)]


def test_leaks(spark):
    ps = [passage(60) for _ in range(8)]
    items = [(i, f"{OPEN[i % 2]} {' '.join(p)}") for i, p in enumerate(ps)] + [(100, f"{OPEN[1]} {' '.join(ps[0])}"), (101, "tiny item"), (102, None), (None, "x"), (0, f"{OPEN[0]} {' '.join(ps[0])}")]
    filler = lambda n: " ".join(RND.choice(["the", "graph", "caches", "every", "route", "badge"]) for _ in range(n))
    edited = list(ps[2][10:50])
    for k in range(4, 40, 9):
        edited[k] = "exchanged"
    noted = ps[3][:15] + ["note", "inserted", "by", "someone", "else"] + ps[3][15:30]
    many = list(ps[4][:40])
    for k in range(0, 40, 4):
        many[k] = "swapped"
    docs = [
        (1, filler(50) + " " + " ".join(ps[1][20:40]) + " " + filler(30)),
        (2, filler(20) + "\n// " + "\n// ".join(w.upper() + "," for w in edited)),
        (3, filler(10) + " <b>" + " ".join(noted) + "</b>"),
        (4, filler(10) + " " + " ".join(many)),
        (5, filler(10) + " " + " ".join(ps[5][5:19]) + " " + filler(10)),
        (6, OPEN[0] + " " + filler(80)),
        (7, " ".join(ps[0])),
        (8, None), (9, ""), (None, "x"),
        (10, filler(20_000) + " " + " ".join(ps[6][:25]) + " " + filler(20_000)),
    ]
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").selectExpr("*", "1 AS item_id")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(spark, d, i).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (7, 0), (7, 100), (10, 6)]
    assert leaks(spark, d.limit(0), i).count() == 0 and leaks(spark, d, i.limit(0)).count() == 0


def test_any_number_of_insertions(spark):
    """Tags around single words, a remark after every two words, a long remark in the middle."""
    ps = [passage(60) for _ in range(4)]
    tagged = [f"<b>{w}</b>" if k % 3 == 1 else w for k, w in enumerate(ps[0][10:32])]
    tagged[4] = tagged[14] = "exchanged"
    noted = " ".join(w + (" (see note)" if k % 2 else "") for k, w in enumerate(ps[1][20:44]))
    split = ps[2][5:18] + ["remark"] * 180 + ps[2][18:31]
    less = ps[3][:17] + ["remark"] * 10
    d = spark.createDataFrame([(1, " ".join(tagged)), (2, noted), (3, " ".join(split)), (4, " ".join(less))], "doc_id long, text string")
    i = spark.createDataFrame([(n, f"{OPEN[n % 2]} {' '.join(p)}") for n, p in enumerate([*ps, *(passage(40) for _ in range(6))])], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(spark, d, i).collect()) == [(1, 0), (2, 1), (3, 2)]
