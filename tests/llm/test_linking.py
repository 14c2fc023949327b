import numpy as np

from gridloom.llm import linking

CITIES = [(1, "Draskevik", "Norva"), (2, "Ulmöburg", "Norva"), (3, "Ulmöburg", "Sudria"), (4, "East Garten", "Sudria"), (5, "Šelčopol", "Norva"), (6, "Tarn", "Sudria")]
TYPED = [
    (1, "Draskevik", "Norva", None, 1), (2, "DRASKEVIK urban area", "norva", None, 1), (3, "Drskevikk", "Republic of Norva", None, 1), (4, "Ulmoeburg", "Sudria", None, 3), (5, "Ulmoburg", None, "NVA", 2),
    (6, "Ulmöburg", None, None, 0), (7, "Garten, East", "Sudria", None, 4), (8, "E. Garten", "S.D.R.", None, 4), (9, "Shelchopol", "Norva", None, 5), (10, "Draskevik", "Sudria", None, 0), (11, None, "Norva", None, 0),
    (12, "", "Norva", None, 0), (13, "my hometown", None, None, 0), (14, "Ｄｒａｓｋｅｖｉｋ", "Norvaa", None, 1), (15, "Draskevik (Norva)", None, None, 1), (16, "x" * 5000, "Norva", None, 0), (17, "Draskevik", "Atlantis", None, 0), (None, "Tarn", "Sudria", None, 6),
]


def test_link(spark):
    typed = spark.createDataFrame([t[:4] for t in TYPED] + [TYPED[0][:4]], "e long, n string, c string, i string").selectExpr("*", "1 AS v", "2 AS b", "3 AS id")
    cities = spark.createDataFrame(CITIES, "cid long, name string, land string")
    codes = spark.createDataFrame([("NVA", "Norva"), ("SDR", "Sudria"), (None, "Norva")], "alias string, country string")
    got = [(r.e, r.cid) for r in linking.link_places(typed, "e", "n", "c", "i", cities, "cid", "name", "land", codes).collect()]
    assert len(got) == len(TYPED) + 1 and got.count((1, 1)) == 2
    assert dict(got) == {t[0]: t[4] for t in TYPED}
    assert linking.link_places(typed.where("false"), "e", "n", "c", "i", cities, "cid", "name", "land", codes).count() == 0
    assert {r.cid for r in linking.link_places(typed, "e", "n", "c", "i", cities.where("false"), "cid", "name", "land", codes).collect()} == {0}


def test_prefix_of_rare_grams_loses_nothing():
    import random

    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(3, 9))) for _ in range(300)})
    index = linking.Index(list(range(len(names))), names, [None if i % 2 else "x" for i in range(len(names))], np.arange(linking.BUCKETS) % 40, 300)
    for floor in (0.1, 0.3, 0.6):
        for text in names[::7] + ["zzz", "abcabc def"]:
            mine = index.vector(text)
            for block in (None, "x"):
                score = {i: sum(x * index.vectors[i].get(g, 0) for g, x in mine.items()) for i in range(len(names)) if block is None or index.blocks[i] == block}
                want = sorted(((s, i) for i, s in score.items() if s >= floor), key=lambda t: (-t[0], t[1]))[:2]
                got = [(c, i) for c, i, _ in index.best(text, block, floor)]
                assert [i for _, i in got] == [i for _, i in want] and np.allclose([c for c, _ in got], [c for c, _ in want])


def test_parts_of_the_list_give_the_same(spark, monkeypatch):
    names = [f"{a}{b}" for a in ("drask", "ulmo", "tarn", "velvi", "osra") for b in ("vik", "burg", "grad", "pol", "dale")]
    entries = spark.createDataFrame([(i, w, None) for i, w in enumerate(names)], "id long, w string, b string")
    values = spark.createDataFrame([(w[:3] + w[4:], None) for w in names] + [(w, None) for w in names] + [("qqq", None), (None, None)], "v string, b string")
    whole = {(r.v, r.id) for r in linking.closest(values, entries).collect()}
    monkeypatch.setattr(linking, "PART", 7)
    monkeypatch.setattr(linking, "SHARD", 9)
    assert whole == {(r.v, r.id) for r in linking.closest(values, entries).collect()} and {(w, i) for i, w in enumerate(names)} <= whole
