from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.llm.confusables import canonical, findings, look_alikes, look_classes


def test_forms():
    base = "Role of Pde35 in the fine façade"
    for same in ("Ｒole of Pde35 in the ﬁne façade ", "Rоlе of Pde35 in the fine façade", "Role of P​de35 in  the fi­ne façade", " Role of Рԁе35 in the fine façade"):
        assert canonical(same) == base
    for other in ("role of Pde35 in the fine façade", "Role of Pde35 in the fine facade", "Role of Pde35 in the fine façade."):
        assert canonical(other) != base
    assert canonical("Ca²⁺") != canonical("Ca2+")
    assert canonical("a‐b a‑b") == "a-b a-b" and canonical("a–b") != "a-b"
    assert canonical("Pоль белка о Pde35") == canonical("Роль белка о Pde35")
    assert canonical("µM") == canonical("μM")
    assert canonical(None) is None and canonical("") == "" and canonical("​  ") == ""


def test_findings():
    assert findings("ѕalamander tiѕѕue сор") == [("ѕalamander", "mixed"), ("tiѕѕue", "mixed"), ("сор", "whole")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aаcсeеxбд жФФü̈​ ﬁ１-‑μµΜMο", max_size=30))
def test_idempotent(t):
    assert canonical(canonical(t)) == canonical(t)


def brute(rows, within):
    return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] is not None and b[2] is not None and a[2] != b[2] and canonical(a[2]) == canonical(b[2]) and (not within or a[1] is not None and a[1] == b[1])}


def test_against_brute_force(spark):
    texts = ["Role of x", "Rоle of x", "Role  of x", "role of x", None, "", " ", "Role of x", "long " * 20_000, "lоng " * 20_000]
    rows = [(i, "s" if i % 3 else None, texts[i % len(texts)], i) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "id bigint, g string, t string, _k int")
    for within in (None, "g"):
        got = look_alikes(df, "id", "t", within).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, within)
    assert look_alikes(df.limit(0), "id", "t").count() == 0


def test_letters_of_further_scripts_and_styles():
    for a, b in [
        ("Rօd vision", "Rod vision"), ("Ꮢod vision", "Rod vision"), ("𝐑od 𝑣ision", "Rod vision"), ("ρaper on υse", "paper on use"), ("siɡnal", "signal"), ("Type Ⅳ", "Type IV"),
        ("ꓡens ꓐ", "Lens B"), ("Ⲣlan", "Plan"),
    ]:
        assert canonical(a) == canonical(b) == b, a
    for a, b in [("ρ = 1", "p = 1"), ("α-actin", "a-actin"), ("β-catenin", "B-catenin"), ("ılık", "ilik"), ("10²", "102"), ("հայ", "huj")]:
        assert canonical(a) != canonical(b), a
    for t in ("ρaper օ", "Привет мир", "Λόγος ρ", "հայերեն օ", "ᏣᎳᎩ Ꭰ"):
        assert canonical(canonical(t)) == canonical(t)
    assert canonical("Привет мир") == "Привет мир" and canonical("հայերեն") == "հայերեն"


def test_classes(spark):
    rows = [(1, "Rod vision", "g"), (2, "Rоd vision", "g"), (2, "Rоd vision", "g"), (3, "Rod vision", "g"), (4, "Rod vision", "h"), (5, None, "g"), (6, "other", "g")]
    df = spark.createDataFrame(rows, "id bigint, t string, class string")
    assert sorted(tuple(r) for r in look_classes(df, "id", "t", "class").collect()) == [(1, 1), (2, 1), (3, 1)]
    assert look_classes(df.limit(0), "id", "t").count() == 0
