import random

from foliograph.operators import identity, places, references

A, B = "0000-0002-1825-0097", "0000-0001-5109-3700"


def row(paper, team=(), orcid=None, affils=(), email=None, words="retinal development"):
    return dict(paper=paper, pos=0, name="li wei", orcid=orcid, email=email, affils=frozenset(affils), team=frozenset({"li wei", *team}), words=frozenset(words.split()))


def test_teams_part_homonyms():
    rows = [row("a1", ("green", "field")), row("a2", ("green", "field")), row("b1", ("white", "lake"), words="x"), row("b2", ("white", "lake"), words="x")]
    got = identity.resolve_block(rows)
    assert got[0] == got[1] != got[2] == got[3] and got[0][1] == "coauthor-evidence"


def test_conflicting_orcids_leave_the_middle_unresolved():
    t = ("green", "field")
    got = identity.resolve_block([row("a", t, A), row("b", t), row("c", t, B)])
    assert [k for _, k in got] == ["orcid", "unresolved", "orcid"] and len({a for a, _ in got}) == 3


def test_affiliations_resolve_and_order_does_not_matter():
    rows = [row("a", orcid=A, affils=("university of a",)), row("b", orcid=B, affils=("university of b",)), row("u1", affils=("university of a",)), row("u2", affils=("university of b",))]
    got = identity.resolve_block(rows)
    assert got[2][0].endswith(A) and got[3][0].endswith(B)
    order = list(range(4))
    random.Random(1).shuffle(order)
    again = identity.resolve_block([rows[i] for i in order])
    assert [again[order.index(i)] for i in range(4)] == got


def test_one_paper_never_twice():
    got = identity.resolve_block([row("a", ("x", "y")), dict(row("a", ("x", "y")), pos=1)])
    assert got[0][0] != got[1][0]


def test_references():
    p = references.parse("4. Olnetal P, Darberg MM, Polmarik S (2011) Circadian control of lens fibres. Zoology Letters 27: 118–126.")
    assert (p["number"], p["authors"], p["year"], p["title"], p["journal"], p["volume"], p["pages"]) == (4, ["Olnetal P", "Darberg MM", "Polmarik S"], 2011, "Circadian control of lens fibres", "Zoology Letters", "27", "118–126")
    p = references.parse("61. Ben-Tovan, R. & Merentes, L. Foldmap: fast assignment of protein folds. Biobank Genet. 8, 205 (2016).")
    assert p["title"].startswith("Foldmap:") and p["journal"].startswith("Biobank Genet") and p["year"] == 2016
    p = references.parse("Talques, B., Ngai, Y. T., 1996. Is Pde3 required in the retina? Deep study in mouse. Progress in Biobank Genetics 235, 586-595. doi:10.1234/ab")
    assert p["title"] == "Is Pde3 required in the retina? Deep study in mouse" and p["doi"] == "10.1234/ab" and p["authors"][0] == "Talques, B."
    assert references.parse(None)["title"] is None and references.parse("  ")["year"] is None and references.parse("x" * 100_000)["title"] is None


def test_parse_table(spark):
    df = spark.createDataFrame([(1, None), (2, "Li W (2001) A short title here. Journal X 1: 2-3."), (2, "Li W (2001) A short title here. Journal X 1: 2-3.")], "ref_id bigint, raw string")
    got = {r["ref_id"]: r["title"] for r in references.parse_references(df).collect()}
    assert got == {1: None, 2: "A short title here"}


def test_places(spark):
    pts = spark.createDataFrame([("p", 5), ("p", 300), ("q", 5)], "page string, at int")
    spans = spark.createDataFrame([("p", 0, 6), ("p", 250, 10_000), ("p", 9, 9)], "page string, start int, `end` int")
    assert sorted((r["page"], r["at"], r["start"]) for r in places.within(pts, spans, "page").collect()) == [("p", 5, 0), ("p", 300, 250)]
    g = spark.createDataFrame([("p", 0.0, 0.0, 100.0, 10.0), ("p", 50.0, 50.0, 60.0, 60.0)], "page string, left double, top double, right double, bottom double")
    m = spark.createDataFrame([("p", 99.0, 5.0), ("p", 55.0, 55.0), ("p", 200.0, 5.0)], "page string, x double, y double")
    assert sorted(r["left"] for r in places.under_pointer(m, g).collect()) == [0.0, 50.0]


def test_anchor_far_off_and_shared_orcids():
    """An anchor beyond the window counts, and so do ORCIDs that two papers share."""
    def one(paper, orcid=None, team=(), words=("lens",), oids=(), affils=()):
        return dict(paper=paper, pos=0, name="n", orcid=orcid, email=None, affils=frozenset(affils), team=frozenset(team), words=frozenset(words), oids=frozenset(oids))

    far = [one("a", "O1", affils=["institute of optics"])] + [one(f"b{k:03}", affils=["institute of optics"], words=[f"w{k}"]) for k in range(40)] + [one("c", affils=["institute of optics"])]
    assert identity.resolve_block(far)[-1] == ("author:orcid:O1", "orcid")
    shared = [one("a", "O1", oids=["O1", "O9"]), one("b", oids=["O9"])]
    assert identity.resolve_block(shared)[1] == ("author:orcid:O1", "orcid")
