from hypothesis import given, settings, strategies as st

from gridloom.operators import packed


def rows(df, id_="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[id_], {})[r.pos] = r.value
    return {k: [v for _, v in sorted(d.items())] for k, d in out.items()}


PLAIN = [f"{a}{b}" for a in ("Arn", "Bel", "Cor", "Dun", "Est") for b in ("dal", "mar", "port", "wick", "ham", "ford")]


def test_dialects(spark):
    fields = {
        1: "Arndal; Belmar; Corport", 2: "Arndal,Belmar,Corport", 3: 'Arndal;"Belmar; lower bank";Corport', 4: '["Arndal", "Belmar \\"Old\\" Town"]',
        5: "Arndal\\, Port of; Belmar", 6: "Arndal [Dunham; Dunford]", 7: "Arndal [Dunham; Dunford]; Belmar", 8: "«Arndal»; «Belmar»",
        9: " ; Arndal; ;Belmar;", 10: "NULL", 11: "", 12: None, 13: "Arndal;Arndal", 14: "Arndal / Belmar (1st)", 15: "Arndal;Belmar, Corport|Dunham", 16: '"Belmar, The"', 17: "Arndal\nBelmar", 18: "D'Arndal; L'Belmar",
        19: "Belmar\\, Port of, Dunford",
    }
    more = [(100 + i, n) for i, n in enumerate(PLAIN)] + [(200 + i, f"{a}; {b}") for i, (a, b) in enumerate(zip(PLAIN, PLAIN[1:]))] + [(300 + i, f"{a}\\, Port of; {b}") for i, (a, b) in enumerate(zip(PLAIN, PLAIN[3:]))]
    df = spark.createDataFrame([(k, v) for k, v in fields.items()] + more, "id long, f string")
    got = rows(packed.unpack(df, "f"))
    want = {
        1: ["Arndal", "Belmar", "Corport"], 2: ["Arndal", "Belmar", "Corport"], 3: ["Arndal", "Belmar; lower bank", "Corport"], 4: ["Arndal", 'Belmar "Old" Town'],
        5: ["Arndal, Port of", "Belmar"], 6: ["Arndal [Dunham; Dunford]"], 7: ["Arndal [Dunham; Dunford]", "Belmar"], 8: ["Arndal", "Belmar"],
        9: ["Arndal", "Belmar"], 13: ["Arndal", "Arndal"], 14: ["Arndal", "Belmar (1st)"], 15: ["Arndal", "Belmar", "Corport", "Dunham"], 16: ["Belmar, The"], 17: ["Arndal", "Belmar"], 18: ["D'Arndal", "L'Belmar"], 19: ["Belmar, Port of", "Dunford"],
    }
    assert {k: got.get(k) for k in want} == want
    assert not {10, 11, 12} & set(got)


def test_empty_repeated_long_and_clashing(spark):
    df = spark.createDataFrame([(1, "A;B", 7, "x"), (1, "A;B", 7, "x"), (2, None, None, None), (3, "; ".join(PLAIN * 400), 1, "y")], "id long, f string, pos int, value string")
    out = packed.unpack(df, "f")
    assert {"_pos", "_value", "pos", "value"} <= set(out.columns)
    assert out.where("id = 1").count() == 4 and out.where("id = 3").count() == len(PLAIN) * 400
    assert packed.unpack(df.where("id < 0"), "f").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PLAIN), min_size=1, max_size=6), st.sampled_from([";", ",", "|", "\t", "、"]), st.sampled_from(['"', ""]))
def test_the_parse_that_was_meant_is_a_candidate(names, sep, quote):
    field = sep.join(quote + n + quote for n in names)
    assert names in [c["names"] for c in packed.candidate_parses(field)]
