"""Typed names to registered persons."""

from palaver.llm import link_names, names

PEOPLE = [(1, 10, "Etsuko Kashimine", "樫峰 悦子"), (2, 10, "Tsubasa Kokemine", "苔峰 翼"), (3, 10, "Rikuo Kokemine", None), (4, 10, "Girish Ghoralkar", "गिरीश घोरलकर"), (5, 10, "Deborah Wexcombe", None), (6, 11, "Etsuko Kashimine", None), (7, 11, "Ryouhei Sagise", None), (8, 12, None, None)]
CASES = {
    (10, "Kashimine Etsuko"): {1}, (10, "KASHIMINE ETSUKO"): {1}, (10, "Kashimine-san"): {1}, (10, "E. Kashimine"): {1}, (10, "E.K."): {1}, (10, "EK"): {1}, (10, "樫峰様"): {1}, (10, "樫峰　悦子"): {1}, (10, "Kasimine Etuko"): {1},
    (10, "Etsuok Kashimine"): {1}, (10, "Kashimine, Etsuko"): {1}, (10, "Etsuko Kashimine (PM)"): {1}, (10, "Director Kashimine"): {1}, (10, "Ｋａｓｈｉｍｉｎｅ"): {1}, (10, "Kokemine"): set(), (10, "Tsubasa"): {2}, (10, "T. Kokemine"): {2},
    (10, "Etsuko Kashimine & Debbie Wexcombe"): {1, 5}, (10, "घोरलकर जी"): {4}, (10, "Japan side"): set(), (10, "TBD"): set(), (10, ""): set(), (10, None): set(), (10, "Etsuko Kashimori"): set(), (11, "Etsuko Kashimine"): {6},
    (10, "Kashimineさん / Rikuo Kokemine"): {1, 3}, (11, "Ryohei Sagise"): {7}, (11, "Rikuo Kokemine"): set(), (None, "Etsuko"): set(), (10, "Deborah Wexcommbe、苔峰 翼"): {2, 5}, (10, "—"): set(), (10, "Itssuko Kashimine"): set(),
}


def test_cells(spark):
    people = spark.createDataFrame(PEOPLE, "person_id long, account_id long, full_name string, name_native string")
    rows = [(f"i{n}", a, c, "x") for n, (a, c) in enumerate(CASES)]
    items = spark.createDataFrame(rows + rows[:3], "item_id string, account_id long, name string, person_note string")
    got: dict = {}
    for r in link_names.linked(items, people).collect():
        got.setdefault(r.item_id, set()).add(r.person_id)
    for (i, a, c, _), want in zip(rows, CASES.values(), strict=True):
        assert got.get(i, set()) == want, (a, c, got.get(i), want)
    assert link_names.linked(items.limit(0), people).count() == 0
    assert link_names.linked(items, people.limit(0)).count() == 0


def test_metric_join_misses_no_form_within_reach(spark):
    people = spark.createDataFrame([(i, i % 3, f"{g} {f}", None) for i, (g, f) in enumerate((g, f) for g in ("Haruto", "Mizuki", "Katherine", "Yashodhan") for f in ("Danesworth", "Solhani", "Kirihara"))], "person_id long, account_id long, full_name string, name_native string")
    forms = [(r.account_id, r.form) for r in link_names.person_forms(people).where("radius > 0").collect()]
    typed = [(a, f[:k] + c + f[k + 1 :]) for a, f in forms for k, c in ((2, "q"), (len(f) - 1, ""), (1, f[1] * 2)) if len(f) > 6]
    d = spark.createDataFrame(typed, "account_id long, name string")
    got = {(r.account_id, r.name) for r in link_names.resolve(d, people).collect()}
    vocabulary = {w for _, f in forms for w in f.split()}
    for a, t in typed:
        q = {x for _, x in names.parts(t)}
        near = [f for b, f in forms if b == a and any(names.edits(x, f, 1) <= 1 and not (set(x.split()) - set(f.split())) & vocabulary and all(len(w) > 2 for w in set(x.split()) - set(f.split())) for x in q)]
        assert not near or (a, t) in got, (a, t, near[:2])


def test_edits():
    assert names.edits("abcd", "abdc", 1) == 1 and names.edits("abcd", "abxdc", 1) == 2 and names.edits("", "a", 1) == 1 and names.edits("same", "same", 1) == 0


def test_short_and_long_names(spark):
    """A form under five characters means who is registered under it and no neighbour; names have any number of words."""
    rows = [(1, 1, "Ravi Oda", None), (2, 1, "Maria del Carmen Garcia Lopez", None), (3, 1, "Ito", "伊藤"), (4, 1, "Haruka Minamoto", None)]
    people = spark.createDataFrame(rows, "person_id long, account_id long, full_name string, name_native string")
    cases = {"Ravi": {1}, "Rami": set(), "Oda": {1}, "Ito": {3}, "Itu": set(), "MARIA DEL CARMEN GARCIA LOPEZ": {2}, "Maria del Carmen Garcia Lopes": {2}, "one of the new people over there": set(), "Harukq": {4}, "伊藤": {3}}
    d = spark.createDataFrame([(1, c) for c in cases], "account_id long, name string")
    got: dict = {}
    for r in link_names.resolve(d, people).collect():
        got.setdefault(r.name, set()).update(r.persons)
    assert {c: got.get(c, set()) for c in cases} == cases
