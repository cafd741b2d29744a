from collections import Counter

from srcatlas.llm.encoding import alphabet, restored

CLEAN = {
    "fr": "Le système vérifié est enregistré à côté du résumé dès que l’analyse est terminée",
    "de": "Während der Überprüfung bleibt der Schlüssel öffentlich und die Größe ändert sich später",
    "ru": "Переменная задаёт каталог где лежит новый отчёт и важный пропустит модуль",
    "pl": "Każda różnica działała następną ścieżka węzeł żeby określa usunąć",
    "en": "The “static role” label doesn’t fit here… use the naïve façade at ≤ 30 µs → done",
}


def test_restores(spark):
    docs = [(i, t) for i, t in enumerate(list(CLEAN.values()) * 12)]
    bad = {
        1000: ("fr", lambda t: t.encode().decode("cp1252", "ignore")),
        1001: ("de", lambda t: t.encode().decode("latin_1")),
        1002: ("ru", lambda t: t.encode().decode("cp1251", "ignore")),
        1003: ("pl", lambda t: t.encode().decode("mac_roman")),
        1004: ("de", lambda t: t.encode().decode("latin_1").encode().decode("latin_1")),
        1005: ("ru", lambda t: t.encode("koi8_r", "ignore").decode("cp1251", "ignore")),
        1006: ("de", lambda t: t.encode("latin_1").decode("utf-8", "replace")),
        1007: ("fr", lambda t: t.replace("’", "'").encode("cp850").decode("cp1252", "replace")),
        1008: ("en", lambda t: t.encode().decode("cp437")),
    }
    docs += [(d, "plain words first. " + f(CLEAN[k])) for d, (k, f) in bad.items()]
    docs += [(2000, "The reader shows `Ã©` or `�` when the charset is wrong."), (2001, None), (2002, ""), (2003, "ATENÇÃO: NÃO É 日本語 ├── a │ └── b"), (2004, "x" * 300_000 + " größe"), (2005, "Её ВСЁ — «да»…")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'u' AS unit", "0 AS n_damaged")
    got = {r["doc_id"]: r for r in restored(spark, df).collect()}
    assert set(got) == set(bad)
    for d, (k, _) in bad.items():
        want, have = CLEAN[k].split(), got[d]["restored_text"].split()[3:]
        same = sum(a == b for a, b in zip(want, have))
        assert same >= 0.7 * len(want), (d, have)
    assert restored(spark, df.limit(0)).count() == 0


def test_copies_of_a_garbled_text(spark):
    """A text repeated under very many ids is one text: its garbled words don't become known words by it."""
    clean = CLEAN["ru"]
    bad = clean.encode("koi8_r").decode("cp1251")
    docs = [(i, f"{clean} {i}") for i in range(40)] + [(1000 + i, bad) for i in range(60)] + [(2000, f"{clean} once more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["restored_text"] for r in restored(spark, df).collect()}
    assert set(got) == set(range(1000, 1060))
    want = clean.split()
    for have in set(got.values()):
        assert sum(a == b for a, b in zip(want, have.split())) >= 0.7 * len(want), have


def test_numeric_references(spark):
    """Garbling written as numeric references is found and restored as such; single valid references are clean."""
    clean = [(i, t) for i, t in enumerate(list(CLEAN.values()) * 12)]
    told = {3000: ("d&#195;&#169;plac&#195;&#169; vers", "d&#233;plac&#233; vers"), 3001: ("It&#226;&#8364;&#8482;s here", "It&#8217;s here"), 3002: ("done &#240;&#376;&#353;&#8364;", "done &#128640;"), 3003: ("v&#xc3;&#xa9;rifi&#xc3;&#xa9;", "v&#xe9;rifi&#xe9;"), 3004: ("vers&#65533;o", None)}
    fine = [(4000, "caf&#233; na&#239;ve &#8364;5 it&#39;s &#1055;&#1088;&#1080; &#99999999; &#x110000; &# &#;"), (4001, "`d&#195;&#169;j&#195;&#160;` as an example")]
    df = spark.createDataFrame(clean + [(d, a) for d, (a, _) in told.items()] + fine, "doc_id long, text string")
    got = {r["doc_id"]: r["restored_text"] for r in restored(spark, df).collect()}
    assert set(got) == set(told)
    for d, (_, want) in told.items():
        assert want is None or got[d] == want


def test_characters_the_corpus_does_not_know(spark):
    """Every valid UTF-8 sequence can be read, also of characters that stand nowhere else; one odd sequence alone is no evidence."""
    clean = [(i, t) for i, t in enumerate(list(CLEAN.values()) * 12)]
    told = {5000: "a robot 🤖 waits", 5001: "see 日本語の説明 below", 5002: "Ελληνικά κείμενα", 5003: "rated ☂☃ today"}
    df = spark.createDataFrame(clean + [(d, t.encode().decode("cp1252" if d != 5003 else "latin_1", "replace")) for d, t in told.items()] + [(6000, "“le résumé”… and «voilà»… ÄÖÜß Ångström FORÊT"), (6001, "удалить шаблон работа ВСЁ Её тандем")], "doc_id long, text string")
    got = {r["doc_id"]: r["restored_text"] for r in restored(spark, df).collect()}
    assert set(got) == set(told)
    assert got[5000] == told[5000] and got[5003] == told[5003]


def test_counts_characters_of_every_text(spark, monkeypatch):
    """The bigram model counts all texts, those without a non-ASCII character too, and a repeated text as often as its weight."""
    texts = ["déjà vu", "déjà vu", "zip zap", "plain words only", "caf&#233; in ASCII"]
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or broadcast(value))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert restored(spark, df).count() == 0
    pairs, counts, _ = next(v for v in sent if isinstance(v, tuple) and len(v) == 3)
    number, size = alphabet(), len(alphabet()) + 2
    want = Counter(number[a] * size + number[b] for t in texts for a, b in zip("\n" + t, t + "\n"))
    assert dict(zip(pairs.tolist(), counts.tolist())) == want
