import pytest

from foliograph.operators.packed import ISSN, rule_of, split_packed

CASES = {
    1: ("9900-0008", ["9900-0008"]),
    2: ("9900-0008; 9900-0016,99000024", ["9900-0008", "9900-0016", "9900-0024"]),
    3: ("['9900–044x', \"9900-0458\"]", ["9900-044X", "9900-0458"]),
    4: ("p-ISSN: 9900-0008 / e-ISSN:9900-0016;;", ["9900-0008", "9900-0016"]),
    5: ("9900-0008 (Print)\r\n9900-0008 (Online)", ["9900-0008", "9900-0008"]),
    6: (None, []),
    7: ("", []),
    8: (" ;, ", []),
    9: ("９９００－０００８，9900-0016", ["9900-0008", "9900-0016"]),
    10: ("n/a 12", []),
    11: ("; ".join(["9900-0008"] * 3000), ["9900-0008"] * 3000),
}


def _rows(spark, **kw):
    rows = [(k, v[0], "x", 1) for k, v in CASES.items()] * 2  # every row delivered twice
    df = spark.createDataFrame(rows, "id bigint, f string, value string, pos int")
    out = {}
    for r in sorted(split_packed(df, "f", ["id"], shape=ISSN, **kw).collect(), key=lambda r: (r["id"], r["pos"])):
        out.setdefault(r["id"], []).append((r["pos"], r["value"]))
    return out


def test_values_and_positions(spark):
    got = _rows(spark)
    for k, (_, want) in CASES.items():
        assert got.get(k, []) == list(enumerate(want, 1)), k


def test_at_least_two(spark):
    got = _rows(spark, at_least=2)
    assert set(got) == {k for k, v in CASES.items() if len(v[1]) > 1}


def test_empty_table(spark):
    assert split_packed(spark.createDataFrame([], "id bigint, f string"), "f", ["id"], shape=ISSN).collect() == []


@pytest.mark.parametrize(
    "skeleton, shape, want",
    [
        ("9999D9999;9999999x", ISSN, [[0, 9], [10, 8]]), ("9999 999x", ISSN, [[0, 9]]), ("9999;9999", ISSN, []), ("a a", ISSN, []), ("99;9999D9999 (a)", ISSN, [[3, 9]]),
        ("['9999D9999', 9999D9999]", ISSN, [[2, 9], [14, 9]]), ('"a, a";a', None, [[1, 4], [7, 1]]), ("a, a c a", None, [[0, 1], [3, 1], [7, 1]]), ("[a; ; a]", None, [[1, 1], [6, 1]]),
    ],
)
def test_rules(skeleton, shape, want):
    assert rule_of(skeleton, shape) == want


def test_names_and_keywords(spark):
    """Fields without a shape: delimiters, quotes and brackets alone decide."""
    rows = [
        (1, 'lens; "retina, rods and cones"; glia (Müller, rat)'), (2, "Doe, A.; O'Neil, B. and Öz-Ünal, C."), (3, "\"all, one\""), (4, "[a | b]"), (5, " ; ;"), (6, None),
        (7, 'he said ""x"", y'), (8, "un\"closed, b"),
    ]
    df = spark.createDataFrame(rows, "id bigint, f string")
    got = {}
    for r in sorted(split_packed(df, "f", ["id"], delimiters=";|").collect(), key=lambda r: (r["id"], r["pos"])):
        got.setdefault(r["id"], []).append(r["value"])
    assert got == {
        1: ["lens", "retina, rods and cones", "glia (Müller, rat)"], 2: ["Doe, A.", "O'Neil, B.", "Öz-Ünal, C."], 3: ["all, one"], 4: ["a", "b"],
        7: ['he said "x", y'], 8: ['un"closed, b'],
    }
