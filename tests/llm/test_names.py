from foliograph.llm import names as N

NS = "name_id bigint, first_name string, last_name string, entity int"
PS = "item_id bigint, title string, doi string, creators array<struct<name_id:bigint,orcid:string,affiliations:array<string>,email:string>>"
RS = "author_name_id bigint, title string, doi string, raw string"
O1, O2 = "0000-0002-1825-0097", "0000-0001-5109-3700"


def groups(spark, names, papers, refs):
    r = N.resolve(spark.createDataFrame(names, NS), spark.createDataFrame(papers, PS), spark.createDataFrame(refs, RS)).collect()
    out = {}
    for x in r:
        out.setdefault(x["entity"], set()).add(x["n"])
    return sorted(map(sorted, out.values()))


def c(n, orcid=None, aff=None, email=None):
    return (n, orcid, aff, email)


def test_links(spark):
    names = [
        (1, "Ewa A.", "Jarnemire", 0), (2, None, "JARNEMIRE EA", 0), (3, "E.", "Jarnmire", 0), (4, "Wei", "Ligande", 0), (5, "Wei", "Ligande", 0),
        (6, None, "Dormont Circuit Consortium", 0), (7, None, "DCC (Dormont)", 0), (8, None, None, 0), (9, "Robert", "Polmarik", 0), (10, "Bob", "Polmarik", 0),
        (11, "Tae-Ho", "Dhao", 0), (12, "Yu-Ting", "Dhao", 0), (1, "Ewa A.", "Jarnemire", 0),
    ]
    t = "How Pde35 regulates the zebrafish retina under constant light after dark adaptation"
    papers = [
        (100, t, None, [c(1), c(9), c(6), c(11), c(12)]), (101, t.upper() + ".", None, [c(3), c(10), c(7)]), (102, "Other work on Gfr5 in mouse lens fibres", None, [c(4, O1)]), (103, "A third work on Kcn9 in cat lens fibres", None, [c(5, O2)]),
        (104, None, None, None),
    ]
    refs = [(2, None, None, f"1. JARNEMIRE EA, Polmarik R (2010) {t}. J. X 1: 1-2."), (None, t, None, None)]
    assert groups(spark, names, papers, refs) == [[1, 2, 3], [4], [5], [6, 7], [8], [9, 10], [11], [12]]


def test_empty(spark):
    assert groups(spark, [], [], []) == []


def test_compatible():
    p = lambda f, l: (lambda x: (x[0], tuple(x[1]), x[2]))(N.parse(f, l))
    same = [(("Ewa A.", "Jarnemire"), (None, "Jarnemire, E. A.")), (("Björn", "Méov"), (None, "Mévo B")), (("Jürgen", "Gelloquist"), ("Gelloquist", "Jürgen")), (("Milan", "de la Melvemann"), (None, "DE LA MELVEMANN M")), (("Jun-Wei", "Wenq"), (None, "Wenq JW"))]
    other = [(("Jana", "Méov"), ("Pedro", "Méov")), (("Ewa A.", "Jarnemire"), (None, "Jarnemire, E. B.")), (("Ewa", "Jarnemire"), (None, "Olnetal, E."))]
    assert all(N.compatible(p(*a), p(*b)) >= 2 for a, b in same)
    assert not any(N.compatible(p(*a), p(*b)) for a, b in other)


def test_slips_in_short_and_swapped_names_meet_at_large(spark):
    """Spellings that only fellow authors tie: slips across the length of 7, at both ends of a name, and swapped parts with a slip."""
    pairs = [("Anna", "Korpeska", "Anna", "Korpeka"), ("Jun", "Yoong", "Jun", "Yoogn"), ("Mina", "Darberg", "Mina", "Daarberg"), ("Ivo", "Xarnemirez", "Ivo", "Jarnemires"), ("Selmo", "Tovanik", "Tovanki", "Selmo"), ("Ugo", "Talvor-Merentes", "Ugo", "Merentez")]
    names, papers = [(1, "Ewa", "Olnetal", 0), (2, "Pedro", "Ligande", 0)], []
    for k, (fa, la, fb, lb) in enumerate(pairs):
        names += [(10 * k + 10, fa, la, 0), (10 * k + 11, fb, lb, 0)]
        papers += [(2 * k + i, f"Work {k} {i} on Gfr{k}{i} in mouse lens fibres", None, [c(10 * k + 10 + i), c(1), c(2)]) for i in (0, 1)]
    assert groups(spark, names, papers, []) == [[1], [2]] + [[10 * k + 10, 10 * k + 11] for k in range(len(pairs))]


def test_keys_meet_where_families_agree():
    import random

    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(2, 10)))
        b = list(a)
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(b)) if b else 0
            b[k : k + rng.randint(0, 2)] = rng.choice(["", "x", *b[k : k + 2][::-1]])
        b = "".join(b)
        if b and N._families(a, b):
            assert set(N.name_keys(a, [], "p")) & set(N.name_keys(b, [], "p")), (a, b)
        if b and N.close(a, b, 1):
            assert set(N.half_keys(a)) & set(N.half_keys(b)), (a, b)


def test_many_profiles_of_one_person(spark):
    """Forty profiles alike become one; two people who share initials stay two though one hub is the best match of both."""
    names = [(1, "Ewa", "Olnetal", 0), (2, "Pedro", "Ligande", 0)] + [(10 + k, "Anna", "Korpeska", 0) for k in range(40)]
    names += [(60, "E.", "Jarnemire", 0), (61, "Ewelina", "Jarnemire", 0), (62, "Emil", "Jarnemire", 0)]
    papers = [(n, f"Work {n} on Gfr{n} in mouse lens fibres", None, [c(n), c(1), c(2)]) for n, *_ in names[2:]]
    got = groups(spark, names, papers, [])
    assert list(range(10, 50)) in got
    assert not any({61, 62} <= set(g) for g in got) and any(60 in g and len(g) == 2 for g in got)


def test_slips_of_names_in_one_work(spark):
    """Copies of one work: a swap and another slip, swapped parts with a swap of letters, three umlauts, a nickname with another first letter."""
    pairs = [("Anna", "Korpeska", "Anna", "Okrpeskat"), ("Selmo", "Tovanik", "Tovanki", "Selmo"), ("Ivo", "Muelloesaek", "Ivo", "Mullosak"), ("Robert", "Polmarik", "Bob", "Bolmarik")]
    names, papers = [], []
    for k, (fa, la, fb, lb) in enumerate(pairs):
        names += [(2 * k + 10, fa, la, 0), (2 * k + 11, fb, lb, 0)]
        papers += [(2 * k + i, f"Work {k} on Gfr{k} and Kcn{k} in the lens fibres of mice", None, [c(2 * k + 10 + i)]) for i in (0, 1)]
    assert groups(spark, names, papers, []) == [[2 * k + 10, 2 * k + 11] for k in range(len(pairs))]


def test_no_link_over_a_third_name(spark):
    """Two ORCIDs, and two authors of one record, stay apart though one short form fits both; each name is in at most one of their entities."""
    t = "How Pde35 regulates the zebrafish retina under constant light after dark adaptation"
    names = [(1, "Ewa", "Jarnemire", 0), (2, "E.", "Jarnemire", 0), (3, "Ewa", "Jarnemire", 0)]
    got = groups(spark, names, [(100, t, None, [c(1, O1)]), (101, t, None, [c(2)]), (102, t, None, [c(3, O2)])], [])
    assert not any({1, 3} <= set(g) for g in got) and sorted(x for g in got for x in g) == [1, 2, 3] and len(got) == 2
    names = [(1, "Ewa", "Jarnemire", 0), (2, "Erik", "Jarnemire", 0), (3, "E.", "Jarnemire", 0)]
    got = groups(spark, names, [(100, t, None, [c(1), c(2)]), (101, t, None, [c(3)])], [])
    assert not any({1, 2} <= set(g) for g in got) and len(got) == 2
    # many copies, one wrong: the bound holds and the rest comes out whole
    names = [(k, "Ewa", "Jarnemire", 0) for k in range(20)] + [(20, "E.", "Jarnemire", 0), (21, "Erik", "Jarnemire", 0)]
    papers = [(100 + k, t, None, [c(k, O1 if k < 3 else None)]) for k in range(20)] + [(130, t, None, [c(20)]), (131, t, None, [c(21, O2)])]
    got = groups(spark, names, papers, [])
    assert any(set(range(20)) <= set(g) and 21 not in g for g in got)


def test_organisations_of_places_alike(spark):
    """A slip is one word's, and of two names both in use neither is a slip of the other; acronyms meet their places."""
    forms = ["{} Retina Foundation", "Retina Foundation of {}", "The {} Retina Foundation"]
    names = [(k, None, f.format(p), 0) for k, (p, f) in enumerate((p, f) for p in ("Casgavale", "Casmivale", "Tamvawick", "Tammawick") for f in forms)]
    names += [(50, None, "Casgvaale Retina Foundation", 0), (51, None, "Casgavale Retina Fdn", 0), (52, None, "CRF (Casmivale)", 0), (53, None, "Casmivale Retina Found.", 0)]
    assert groups(spark, names, [], []) == [[0, 1, 2, 50, 51], [3, 4, 5, 52, 53], [6, 7, 8], [9, 10, 11]]


def test_one_spelling_cited_by_very_many(spark):
    """A work whose references were all typed into the store: names of one spelling are not compared pair by pair."""
    t = "How Pde35 regulates the zebrafish retina under constant light after dark adaptation"
    names = [(k, None, "Jarnemire EA" if k % 2 else "Jarnemire, E.", 0) for k in range(400)]
    got = groups(spark, names, [(1000, t, None, [c(0)])], [(k, t, None, None) for k in range(400)])
    assert got == [list(range(400))]


def test_tables_are_released_once_used(spark):
    """What `resolve` leaves in the shared folder does not grow with the rounds of its loops: tables of each round go with it."""
    from pathlib import Path

    from foliograph.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://")) / f"tables-{spark.sparkContext.applicationId}"
    before = set(folder.iterdir()) if folder.exists() else set()
    names = [(k, "Ewa", f"Jarnemire{'x' * (k % 3)}", 0) for k in range(8)]
    papers = [(k, f"How Pde35 regulates the zebrafish retina under constant light in part {k // 2}", None, [c(k, O1 if k == 0 else O2 if k == 5 else None, ["Ulvale Centre for Vision Research"])]) for k in range(8)]
    assert N.resolve(spark.createDataFrame(names, NS), spark.createDataFrame(papers, PS), spark.createDataFrame([], RS)).count() == 8
    assert len(set(folder.iterdir()) - before) <= 20


def shuffled(spark, run) -> int:
    """Rows that a call shuffles."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(x := found.apply(k)).stageId(): x.shuffleWriteRecords() for k in range(found.size())}

    before = max(stages(), default=-1)
    run()
    return sum(n for k, n in stages().items() if k > before)


def test_families_alike_do_not_multiply_fellow_authors(spark):
    """Sixty families that all agree, ten fellow authors each: rows are shuffled for each fellow author, not for each of its keys too."""
    import random

    rng = random.Random(3)
    names = [(k, "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(9)).title(), f"Korpe{chr(98 + k // 10)}{chr(98 + k % 10)}ska", 0) for k in range(60)]
    papers = [(100 + k, f"Work {k} on Gfr{k} in mouse lens fibres", None, [c((k + i) % 60) for i in range(6)]) for k in range(60)]
    got = []
    assert shuffled(spark, lambda: got.append(groups(spark, names, papers, []))) < 30000
    assert got == [[[k] for k in range(60)]]


def test_titles_that_begin_alike_do_not_multiply_references(spark):
    """A reference meets the works that have both ends of its title, not all that begin as it does."""
    t = "How Pde35 regulates the zebrafish retina under constant light in part {0} after {0} days of dark adaptation number {0}"
    papers = spark.createDataFrame([(k, t.format(k), None) for k in range(150)], "item bigint, title string, doi string")
    refs = spark.createDataFrame([(k, None, None, f"Jarnemire E (2010) {t.format(k)}. J. X 1: 1-2.") for k in range(150)], "n bigint, title string, doi string, raw string")
    got = []
    assert shuffled(spark, lambda: got.extend(N._works(papers, refs)[1].distinct().collect())) < 20000
    assert sorted((x["n"], x["work"]) for x in got) == [(k, k) for k in range(150)]


def test_components_of_chains_stars_and_others(spark):
    import random

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(99, k) for k in range(50, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {k: k for k in range(300)}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = N.components(spark.createDataFrame([(k,) for k in label], "n bigint"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == 300 and {x["n"]: x["label"] for x in got} == label


def test_rounds_run_few_plans(spark):
    """The driver's memory follows the plans it has run, however small: rounds write tables of one schema together and count rows without a plan."""

    def last() -> int:
        spark.range(1).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    names = [(1, "Ewa", "Olnetal", 0), (2, "Pedro", "Ligande", 0), (3, "Anna", "Korpeska", 0), (4, "Anna", "Korpeka", 0), (5, "Ivo", "Polmarik", 0), (6, "I.", "Polmarik", 0), (7, "Ivo", "Polmarik", 0)]
    t = "How Pde35 regulates the zebrafish retina under constant light after dark adaptation"
    papers = [(n, f"Work {n} on Gfr{n} in mouse lens fibres", None, [c(n), c(1), c(2)]) for n in (3, 4)] + [(n, t, None, [c(n, o)]) for n, o in ((5, O1), (6, None), (7, O2))]
    before = last()
    got = groups(spark, names, papers, [])
    assert last() - before <= 75
    assert got[:3] == [[1], [2], [3, 4]] and len(got) == 5
