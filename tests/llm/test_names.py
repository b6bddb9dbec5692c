import random

import numpy as np
import pytest

from papyra.llm.names import _jaro, compare, given_match, jaro_winkler, link_names, name_pairs, jaro_winkler_pairs, near, phonetic, readings, block_keys


def test_jaro_winkler_known_values():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert _jaro("dixon", "dicksonx") == pytest.approx(0.7667, abs=1e-4)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("abc", "abc") == 1


def test_jaro_winkler_decides():
    assert all(near("winkarwaf", x) for x in ("winkarwaf", "winkarwa", "winkarwaff", "wimkarwaf", "wnikarwaf", "winkaarvaf"))
    assert not any(near("winkarwaf", x) for x in ("winkar", "wnkrwf", "fawrakniw")) and not near("martin", "martinek") and not near("john", "johnson")
    assert near("catherine", "ceatherine") and not near("wang", "weng")


def test_jaro_winkler_of_many_pairs():
    r = random.Random(1)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["zoe", "zoé"]
    i, j = np.triu_indices(len(words))
    for p, q, s in zip(i, j, jaro_winkler_pairs(words, i, j)):
        one = jaro_winkler(words[p], words[q])
        assert s == pytest.approx(one) or (s == 0 and not near(words[p], words[q]))


def test_codes_survive_a_slip():
    for a, b in (("Touhodnys", "Tophodnys"), ("Tydalbah", "Tyzdalbah"), ("Mrmwuwtyz", "Mumwuwtyz"), ("Winkarwaf", "Wnikarwaf")):
        assert block_keys(f"Oliver {a}") & block_keys(f"Oliver {b}")
    assert phonetic("aei") == "0"


@pytest.mark.parametrize("a,b", [("Tim", "Timothy"), ("Ron", "Ronald"), ("Greg", "Gregory"), ("Jenny", "Jennifer"), ("Paco", "Francisco"), ("Sasha", "Alexandra"), ("Meg", "Margaret"), ("Ilona", "Ilonka")])
def test_short_forms(a, b):
    x, y = f"{a} Kofwekmat", f"{b} Kofwekmat"
    assert compare(readings(x), readings(y))[0] == "strong" and block_keys(x) & block_keys(y)


def test_known_names_are_no_slips_of_each_other():
    for a, b in (("Alexander", "Alexandra"), ("Christian", "Christina"), ("Joanna", "Johann")):
        assert compare(readings(f"{a} Kofwekmat"), readings(f"{b} Kofwekmat")) is None


@pytest.mark.parametrize("name,surname,given", [("Sefrazkyn, P. W.", "sefrazkyn", ("p", "w")), ("PW Sefrazkyn", "sefrazkyn", ("p", "w")), ("R.Bovnystut", "bovnystut", ("r",)), ("Robert Bov-Nystut", "bovnystut", ("robert",)), ("ALEXANDER GOCRAZMID", "gocrazmid", ("alexander",)), ("Cöwwöswyç, Oliver", "cowwoswyc", ("oliver",))])
def test_readings(name, surname, given):
    assert (readings(name)[0].surname, readings(name)[0].given) == (surname, given)


def test_reordered_and_collaborations():
    assert compare(readings("Dudbahhiz Nicholas"), readings("Nicholas Dudbahhiz"))[0] == "strong"
    assert compare(readings("the Cenbirfiv collaboration"), readings("Cennbirfiv Collab."))[0] == "strong"
    assert compare(readings("Cenbirfiv Collaboration"), readings("Nicholas Cenbirfiv")) is None


def test_given_names():
    assert given_match(("bob",), ("robert",)) == "full"
    assert given_match(("r",), ("bob",)) == "initial"
    assert given_match(("robert", "a"), ("robert", "b")) is None
    assert given_match(("daniel",), ("patricia",)) is None


def test_linking(frame):
    groups = [["Patricia W. Sefrazkyn", "Sefrazkyn, P.", "PW Sefrazkyn", "Pat Sefrazkyn", "Patricia Sefrazkny"], ["Daniel Sefrazkyn", "D. Sefrazkyn"], ["The Mathymzuz Collaboration", "MATHYMZUZ collab."], ["D. R. Winkarwaf", "D.R. Winkarwaf", "Winkarwaf, D."], ["***"]]
    names = [(n, 1) for g in groups for n in g for _ in range(2)] + [(None, 1), (" ", 1)]
    got = {}
    for r in link_names(frame(names, "name string, entity int")).collect():
        got.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
    pairs = {(r.name_a, r.name_b) for r in name_pairs(link_names(frame(names, "name string, entity int"))).collect()}
    assert pairs == {(a, b) for g in groups for a in g for b in g if a < b}


def test_initials_that_fit_two_people_stay_alone(frame):
    got = {r.name: r.entity for r in link_names(frame([("Maria Kofwekmat",), ("Martin Kofwekmat",), ("M. Kofwekmat",)], "name string")).collect()}
    assert len(set(got.values())) == 3


def test_blocks_give_the_same_links(frame):
    names = [(f"{g} {s}",) for g in ("Robert", "Bob", "R.") for s in ("Bovnystut", "Bovnysstut", "Kofwekmat", "Winkarwaf")]
    a = sorted(tuple(r) for r in link_names(frame(names, "name string")).collect())
    assert a == sorted(tuple(r) for r in link_names(frame(names, "name string"), block_rows=2).collect())


def test_empty(frame):
    assert link_names(frame([], "name string")).count() == 0
