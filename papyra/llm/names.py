"""Link spellings of names: phonetic blocks, Jaro-Winkler with a nickname table, connected components.

A spelling is read as surname and given names in every order it allows. Spellings of one block of phonetic codes are compared;
surnames alike by Jaro-Winkler with full given names that agree (alike too, or short forms) make a strong link. Spellings with
initials only are then given to the one component of full names they fit, if it is one: best with equal middle initials, else
with the same surname, else with one that is alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.blocking import block_pairs
from papyra.operators.components import connected_components
from papyra.storage import stage

#: common given names with their everyday short forms, in several languages (fixed values)
NICKNAMES = {
    "aaron": "ron", "abigail": "abby gail", "abraham": "abe bram", "adalbert": "bert", "agnieszka": "aga", "albert": "al bert", "aleksandra": "ola sasha", "alexander": "alex sasha sandy xander lex alec", "alexandra": "alex sasha sandra sandy lexi", "alfonso": "poncho fonsi",
    "alfred": "al alf fred", "alice": "ali", "amanda": "mandy", "anastasia": "nastya stacy asya", "andrea": "andi", "andreas": "andi", "andrew": "andy drew", "angela": "angie", "anna": "annie anya ania", "anneliese": "anne liese",
    "anthony": "tony", "antonio": "toni tonio", "arthur": "art artie", "augustus": "gus", "barbara": "barb babs basia", "bartholomew": "bart", "beatrice": "bea trixie", "benjamin": "ben benny benji", "bernard": "bernie", "bradley": "brad",
    "bridget": "biddy", "calvin": "cal", "cameron": "cam", "carolina": "carol lina", "caroline": "carrie carol", "catherine": "cathy cate kitty kate katie", "cecilia": "celia cissy", "charles": "charlie chuck chas", "charlotte": "lottie charlie lotte", "christian": "chris",
    "christina": "chris tina chrissy", "christine": "chris chrissy", "christopher": "chris kit topher", "clara": "clare", "clifford": "cliff", "constance": "connie", "cornelius": "neil", "cynthia": "cindy", "daniel": "dan danny", "daniela": "dani",
    "danielle": "dani", "david": "dave davy", "deborah": "deb debbie", "dennis": "denny", "dmitri": "dima mitya", "dolores": "lola", "dominic": "dom nick", "donald": "don donnie", "dorothea": "dora thea", "dorothy": "dot dottie dolly",
    "douglas": "doug", "edith": "edie", "eduardo": "edu lalo", "edward": "ed eddie ted ned", "ekaterina": "katya", "eleanor": "ellie nell nora", "elena": "lena", "elizabeth": "beth liz lizzie betty eliza lisa libby elsie bess", "emily": "em emmy", "enrique": "quique kike",
    "ernest": "ernie", "eugene": "gene", "evelyn": "eve evie", "ferdinand": "ferdi", "fernando": "nando", "florence": "flo florrie", "frances": "fran frannie", "francisco": "paco pancho curro", "francis": "frank fran", "franciszek": "franek",
    "franklin": "frank", "frederick": "fred freddy fritz rick", "gabriel": "gabe gabi", "gabriela": "gabi gaby", "geoffrey": "geoff jeff", "george": "georgie", "gerald": "gerry jerry", "gertrude": "trudy gert", "gilbert": "gil bert", "giovanni": "gianni nino vanni",
    "giuseppe": "beppe peppe pino", "gregory": "greg", "guadalupe": "lupe", "guillermo": "memo", "gwendolyn": "gwen", "hannah": "nan", "harold": "hal harry", "harriet": "hattie", "heinrich": "heinz heiner", "helen": "nell nellie lena",
    "henrietta": "etta hettie hetty", "henry": "harry hank hal", "hermann": "harm", "hubert": "hugh bert", "ignacio": "nacho", "ignatius": "iggy", "irina": "ira", "isaac": "ike zac", "isabel": "bella izzy bel", "isabella": "bella izzy isa",
    "ivan": "vanya", "jacob": "jake", "jacqueline": "jackie", "jadwiga": "jadzia", "jakub": "kuba", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jenny jen", "jeremiah": "jerry",
    "jessica": "jess jessie", "joanna": "jo asia", "johann": "hans hannes", "johannes": "hans hannes jannes", "john": "jack johnny jock", "jonathan": "jon jonny nathan", "jose": "pepe", "joseph": "joe joey jo", "josephine": "jo josie", "joshua": "josh",
    "juan": "juanito", "judith": "judy", "julia": "jules", "katarzyna": "kasia", "katharina": "kathi kati", "katherine": "kate katie kathy kat kitty", "kenneth": "ken kenny", "konstantin": "kostya kosta", "krzysztof": "krzys krzysiek", "lawrence": "larry laurie",
    "leonard": "len lenny leo", "leonardo": "leo", "louis": "lou louie", "louise": "lou", "lucille": "lucy", "ludwig": "lutz", "malgorzata": "gosia", "manuel": "manolo manu", "margaret": "maggie peggy meg madge greta daisy marge", "maria": "mary masha mia",
    "martha": "marty patty", "martin": "marty", "mathilda": "tilly matty", "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey misha", "mikhail": "misha", "mildred": "millie", "nathaniel": "nate nat", "natalia": "natasha talia",
    "nicholas": "nick nicky nico klaus", "nikolai": "kolya", "oliver": "ollie noll", "pamela": "pam", "patricia": "pat patty tricia trish", "patrick": "pat paddy rick", "peter": "pete", "philip": "phil pip", "rafael": "rafa", "raymond": "ray",
    "rebecca": "becky becca", "richard": "dick rick rich richie", "robert": "bob rob bobby robbie bert", "roberto": "beto", "ronald": "ron ronnie", "rosemary": "rose rosie", "rudolf": "rudi", "samantha": "sam sammy", "samuel": "sam sammy", "sebastian": "seb basti",
    "stanislaw": "stas staszek", "stephen": "steve", "steven": "steve", "susan": "sue susie suzy", "sylvia": "sylvie", "teresa": "terry tess tracy", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "ursula": "uschi ulla",
    "victoria": "vicky tori vic", "vladimir": "vova volodya", "walter": "walt wally", "wilhelm": "willi helm", "william": "bill will billy liam willy", "yevgenia": "zhenya", "yevgeny": "zhenya",
}
#: endings of pet forms (fixed values)
PET_ENDINGS = ("y", "ie", "i", "ka", "ko", "zia", "sia", "ya", "ek", "ik", "ito", "ita", "chen", "cito", "cita")
_FULL: dict[str, set[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL.setdefault(_s, set()).add(_name)

#: words that mark a collaboration rather than a person (fixed values)
ORGANISATION = {"collaboration", "collab", "consortium", "team", "group", "project"}
_CLASS = {c: d for cs, d in (("bfpv", "1"), ("cgjkqsxz", "2"), ("dt", "3"), ("l", "4"), ("mn", "5"), ("r", "6")) for c in cs}
_TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Reading:
    """One way to read a spelling. ``given``: words, or single letters for initials."""

    surname: str
    given: tuple[str, ...]
    organisation: bool = False


def fold(text: str) -> str:
    """Lower case without marks; joined parts (hyphens, apostrophes) become one word."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"(?<=\w)['’‐‑-](?=\w)", "", plain)


def _parts(text: str) -> list[str]:
    """Folded words and single-letter initials, in order."""
    out = []
    plain = fold(text)
    shouting = plain.isupper()
    for t in _TOKEN.findall(plain):
        if 1 < len(t) <= 3 and t.isupper() and (not shouting or not re.search(r"[AEIOUY]", t)):
            out += list(t.lower())
        else:
            out.append(t.lower())
    return out


def readings(name: str) -> list[Reading]:
    whole = _parts(name)
    if not whole:
        return []
    if ORGANISATION & set(whole):
        core = [t for t in whole if t not in ORGANISATION and t != "the"]
        return [Reading(" ".join(core), (), True)] if core else []
    head, comma, tail = name.partition(",")
    if comma and _parts(head) and _parts(tail):
        return [Reading("".join(_parts(head)), tuple(_parts(tail)))]
    words = [t for t in whole if len(t) > 1]
    if not words:
        return []
    if len(words) == 1:
        return [Reading(words[0], tuple(t for t in whole if len(t) == 1))]
    if len(whole[-1]) == 1:  # surname first, initials last
        return [Reading(words[0], tuple(whole[1:]))] if whole[0] == words[0] else [Reading(words[-1], tuple(t for t in whole if t != words[-1]))]
    out = [Reading(whole[-1], tuple(whole[:-1]))]
    if len(whole[0]) > 1:
        out.append(Reading(whole[0], tuple(whole[1:])))
    return out


def _jaro(a: str, b: str) -> float:
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m = len(left)
    t = sum(x != y for x, y in zip(left, right)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity. Letters are matched from either end, whichever finds more in order: one letter typed too many
    would else take the place of its like and put all that follow out of order."""
    if a == b:
        return 1.0
    jaro = max(_jaro(a, b), _jaro(a[::-1], b[::-1]))
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: how alike two spellings of a surname, or of a given name, must be by Jaro-Winkler; given names differ by less between people
ALIKE, GIVEN_ALIKE = 0.87, 0.9
#: what a mistyped given name must reach to be taken for a known one
KNOWN_ALIKE = 0.92


def _slack(longer):
    """How many letters more the longer of two spellings may have: Jaro-Winkler alone is mild on endings."""
    return 1 + (longer > 8)


def near(a: str, b: str, least: float = ALIKE) -> bool:
    """A typing slip apart."""
    return abs(len(a) - len(b)) <= _slack(max(len(a), len(b))) and jaro_winkler(a, b) >= least


#: up to so many words pairs are compared one by one, and remembered; beyond, all at once
FEW = 24


@lru_cache(maxsize=500_000)
def _alike(a: str, b: str) -> float:
    """``jaro_winkler``, remembered; 0 where lengths or letters alone tell that the words aren't near."""
    la, lb = len(a), len(b)
    long = max(la, lb)
    if abs(la - lb) > _slack(long):
        return 0.0
    # a pair at the limit shares at least this many letters
    if len(set(a) & set(b)) * 3 < min(len(set(a)), len(set(b))):
        return 0.0
    return jaro_winkler(a, b)


def _letters(words: list[str]) -> np.ndarray:
    wide = max(1, max(map(len, words), default=1))
    codes = np.zeros((len(words), wide), np.uint32)
    for k, w in enumerate(words):
        codes[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    return codes


def _jaros(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    left, used = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    col = np.arange(a.shape[1])
    for c in range(a.shape[1]):
        ok = (b == a[:, c, None]) & ~used & (np.abs(col - c)[None] <= reach[:, None]) & (a[:, c, None] != 0)
        at = ok.argmax(1)
        rows = np.flatnonzero(ok.any(1))
        used[rows, at[rows]] = True
        left[rows, c] = True
    m = left.sum(1)
    x = np.take_along_axis(a, np.argsort(~left, axis=1, kind="stable"), 1)
    y = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), 1)
    swapped = ((x != y) & (col[None] < m[:, None])).sum(1) / 2
    return np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swapped) / np.maximum(m, 1)) / 3, 0.0)


def jaro_winkler_pairs(words: list[str], i: np.ndarray, j: np.ndarray, most: int = 100_000) -> np.ndarray:
    """``jaro_winkler`` of words[i] with words[j] for arrays of places; 0 where the lengths alone tell that they aren't near."""
    codes, back = _letters(words), _letters([w[::-1] for w in words])
    length = np.array([len(w) for w in words] or [0])
    out = np.zeros(len(i))
    # at best all letters of the shorter word match, in order, four of them at the beginning
    short, long = np.minimum(length[i], length[j]), np.maximum(length[i], length[j])
    top = (2 + short / np.maximum(long, 1)) / 3
    likely = np.flatnonzero((top + 0.4 * (1 - top) >= ALIKE) & (long - short <= _slack(long)))
    for lo in range(0, len(likely), most):
        at = likely[lo : lo + most]
        p, q = i[at], j[at]
        la, lb = length[p], length[q]
        w = max(1, int(max(la.max(initial=0), lb.max(initial=0))))
        a, b = codes[p, :w], codes[q, :w]
        jaro = np.maximum(_jaros(a, b, la, lb), _jaros(back[p, :w], back[q, :w], la, lb))
        prefix = np.cumprod((a[:, :4] == b[:, :4]) & (a[:, :4] != 0), axis=1).sum(1)
        jaro[(p == q) & (la > 0)] = 1.0
        out[at] = jaro + prefix * 0.1 * (1 - jaro)
    return out


@lru_cache(maxsize=100_000)
def _names(word: str) -> frozenset[str]:
    """The names a given name may stand for: itself, and what it is short for."""
    return frozenset({word} | _FULL.get(word, set()))


@lru_cache(maxsize=100_000)
def _canon(word: str) -> frozenset[str]:
    """The same, and for an unknown word the known names it is a slip of."""
    if len(word) < 5 or word in NICKNAMES or word in _FULL:
        return _names(word)
    return _names(word) | {n for n in NICKNAMES if (n[0] == word[0] or n[-2:] == word[-2:]) and near(word, n, KNOWN_ALIKE)}


@lru_cache(maxsize=100_000)
def _stems(word: str) -> tuple[str, ...]:
    """A pet form without its ending, and without the letter doubled before it; three letters are left at least."""
    out = []
    for e in PET_ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            stem = word[: -len(e)]
            out.append(stem)
            if len(stem) > 3 and stem[-1] == stem[-2]:
                out.append(stem[:-1])
    return tuple(out)


def shortened(short: str, name: str) -> bool:
    """Whether ``short`` is a part of a longer name people go by: its beginning or its end, or the stem of a pet form. A name
    that is known as a full one isn't."""
    if short in NICKNAMES:
        return False
    cut = 3 <= len(short) <= len(name) - 2 and (name.startswith(short) or name.endswith(short))
    return cut or any(len(name) > len(x) + 1 and name.startswith(x) for x in _stems(short))


def _slip_allowed(x: str, y: str) -> bool:
    """Two different names that both are known aren't spellings of each other."""
    return not ((x in NICKNAMES or x in _FULL) and (y in NICKNAMES or y in _FULL))


def first_match(x: str, y: str) -> str | None:
    """How two first given names agree: ``full``, ``slip``, ``initial`` (letter and word), ``letters``, or not at all."""
    if len(x) > 1 and len(y) > 1:
        if _names(x) & _names(y) or shortened(x, y) or shortened(y, x):
            return "full"
        return "slip" if _slip_allowed(x, y) and near(x, y, GIVEN_ALIKE) or _canon(x) & _canon(y) else None
    if len(x) == 1 and len(y) == 1:
        return "letters" if x == y else None
    letter, word = (x, y) if len(x) == 1 else (y, x)
    return "initial" if any(n[0] == letter for n in _canon(word)) else None


def middles_agree(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether the second given names, where both have one, don't contradict each other."""
    if not (a[1:] and b[1:]):
        return True
    p, q = a[1], b[1]
    return p == q or (p[0] == q[0] if 1 in (len(p), len(q)) else near(p, q, GIVEN_ALIKE))


def given_match(a: tuple[str, ...], b: tuple[str, ...]) -> str | None:
    """How two lists of given names agree, as ``first_match`` says of the first ones."""
    return first_match(a[0], b[0]) if a and b and middles_agree(a, b) else None


def _link(r: Reading, s: Reading, surname: float, how: str) -> tuple[int, int, str] | None:
    """The link of two readings whose surnames are so alike and whose first given names agree so; smaller is better."""
    same = surname == 1.0
    # a slip in both names: what they differ by together must not exceed what one may
    if how == "slip" and not same and (1 - surname) + (1 - jaro_winkler(r.given[0], s.given[0])) > 1 - ALIKE:
        return None
    if not middles_agree(r.given, s.given):
        return None
    middles = bool(r.given[1:] and s.given[1:]) or (same and r.given == s.given)
    tier = (0 if middles else 1) if same else 2
    kind = "strong" if how in ("full", "slip") or (how == "letters" and middles) else how
    return {"strong": 0, "initial": 1, "letters": 2}[kind], tier, kind


def compare(a: list[Reading], b: list[Reading]) -> tuple[str, int] | None:
    """(kind, tier) of the best link: kind ``strong``, ``initial`` or ``letters``; tier 0 is best."""
    best = None
    for r in a:
        for s in b:
            alike = jaro_winkler(r.surname, s.surname)
            if r.organisation != s.organisation or not near(r.surname, s.surname) or (r.surname != s.surname and not _slip_allowed(r.surname, s.surname)):
                continue
            if r.organisation:
                return "strong", 0
            how = first_match(r.given[0], s.given[0]) if r.given and s.given else None
            found = how and _link(r, s, alike, how)
            if found:
                best = min(best, found) if best else found
    return (best[2], best[1]) if best else None


@lru_cache(maxsize=200_000)
def phonetic(word: str) -> str:
    """The classes of a word's consonants in order; "0" where it has none. Neighbours of one class stay, so that a letter put
    between them changes one place only."""
    return "".join(_CLASS.get(x, "") for x in word) or "0"


@lru_cache(maxsize=200_000)
def _variants(word: str) -> tuple[str, ...]:
    """A word's code, and the code without each of its classes: words one slip apart share one of these."""
    c = phonetic(word)
    return tuple(sorted({c} | {c[:i] + c[i + 1 :] for i in range(len(c))})) if len(c) > 2 else (c,)


def block_keys(name: str) -> set[str]:
    """Codes of the words, sorted: each variant of one word's whole code with the initials (of the names it may stand for) and
    the ending of another. As codes are whole, the number of blocks grows with that of different words."""
    out = set()
    for r in readings(name):
        if r.organisation:
            out |= {f"org {v}" for v in _variants(r.surname.replace(" ", ""))}
            continue
        marks = {"-"}
        if r.given:
            marks = {n[0] for n in _canon(r.given[0])}
            if len(r.given[0]) > 1:
                marks |= {"*" + r.given[0][-2:]}
        out |= {" ".join(sorted((v, m))) for v in _variants(r.surname) for m in marks}
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, n) for n in b.column(0).to_pylist() for k in sorted(block_keys(n))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.string())], ["key", "name"])


def _agreeing(first: list[str]) -> dict[str, list[tuple[str, str]]]:
    """word -> (other word, how they agree), for all pairs of these first given names, found through shared keys."""
    words, letters = [w for w in first if len(w) > 1], {w for w in first if len(w) == 1}
    found: dict[tuple[str, str], str] = {(w, w): "full" if len(w) > 1 else "letters" for w in first}
    by_name: dict[str, set[str]] = {}
    for w in words:
        for n in _names(w):
            by_name.setdefault(n, set()).add(w)
    for group in by_name.values():
        for x in group:
            found.update(((x, y), "full") for y in group)
    by_stem: dict[str, list[str]] = {}
    for w in words:
        for x in {w, *_stems(w)}:
            by_stem.setdefault(x, []).append(w)
    for w in words:
        for part in {w[:k] for k in range(3, len(w) - 1)} | {w[-k:] for k in range(3, len(w) - 1)}:
            for x in by_stem.get(part, ()):
                if shortened(x, w):
                    found[x, w] = found[w, x] = "full"
        for x in letters & {n[0] for n in _canon(w)}:
            found[x, w] = found[w, x] = "initial"
    if len(words) > FEW:
        i, j = np.triu_indices(len(words), 1)
        near_ones = jaro_winkler_pairs(words, i, j) >= GIVEN_ALIKE
        slips = [(words[p], words[q]) for p, q in zip(i[near_ones], j[near_ones])]
    else:
        slips = [(x, y) for k, x in enumerate(words) for y in words[k + 1 :] if _alike(x, y) >= GIVEN_ALIKE]
    for x, y in slips:
        if (x, y) not in found and _slip_allowed(x, y):
            found[x, y] = found[y, x] = "slip"
    meant: dict[str, list[str]] = {}
    for w in words:
        for n in _canon(w):
            meant.setdefault(n, []).append(w)
    for group in meant.values():
        for x in group:
            found.update(((x, y), "slip") for y in group if (x, y) not in found)
    out: dict[str, list[tuple[str, str]]] = {}
    for (x, y), how in found.items():
        out.setdefault(x, []).append((y, how))
    return out


def _surname_pairs(surnames: list[str]) -> Iterator[tuple[int, int, float]]:
    """Places of surnames that are alike, each also with itself, and how much."""
    n = len(surnames)
    if n > FEW:
        i, j = np.triu_indices(n)
        alike = jaro_winkler_pairs(surnames, i, j)
        yield from zip(*(x[alike >= ALIKE].tolist() for x in (i, j, alike)))
        return
    for i in range(n):
        for j in range(i, n):
            if i == j or (z := _alike(surnames[i], surnames[j])) >= ALIKE:
                yield i, j, 1.0 if i == j else z


def _block_links(names: list[str], blk: list[int], same_block: bool) -> list[tuple[str, str, str, int, bool, bool]]:
    """All links of one block: surnames and first given names are compared once each, and only rows whose names agree meet."""
    read = [readings(n) for n in names]
    has = [any(len(r.given[0]) > 1 for r in x if r.given) or any(r.organisation for r in x) for x in read]
    # surname (of a kind) -> first given name -> rows
    places: dict[tuple[bool, str], dict[str, list[tuple[int, Reading]]]] = {}
    for i, rs in enumerate(read):
        for r in rs:
            if r.given or r.organisation:
                places.setdefault((r.organisation, r.surname), {}).setdefault(r.given[0] if r.given else "", []).append((i, r))
    surnames = sorted(places)
    pairs = list(_surname_pairs([s for _, s in surnames]))
    agreeing = _agreeing(sorted({g for x in places.values() for g in x if g}))
    best: dict[tuple[int, int], tuple[int, int, str]] = {}
    for p, q, z in pairs:
        (organisation, a), (other, b) = surnames[p], surnames[q]
        if organisation != other or (a != b and not _slip_allowed(a, b)):
            continue
        z = 1.0 if a == b else z
        for g, rows in places[surnames[p]].items():
            for h, how in [("", "full")] if organisation else agreeing.get(g, ()):
                for k, r in rows:
                    for m, s in places[surnames[q]].get(h, ()):
                        if names[k] == names[m] or (not same_block and blk[k] == blk[m]):
                            continue
                        found = (0, 0, "strong") if organisation else _link(r, s, z, how)
                        if found:
                            key = (k, m) if names[k] < names[m] else (m, k)
                            best[key] = min(best.get(key, found), found)
    return [(names[k], names[m], f[2], f[1], has[k], has[m]) for (k, m), f in best.items()]


LINKS = "a string, b string, kind string, tier int, full_a boolean, full_b boolean"


def _compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, bi, bj, name, blk) in order of their block -> the links of every block. A block is held until it ends."""

    def table(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["a", "b", "kind", "tier", "full_a", "full_b"])

    block, names, blk, out = None, [], [], []
    for b in batches:
        for key, bi, bj, name, at in zip(*(c.to_pylist() for c in b.columns)):
            if (key, bi, bj) != block:
                if len(names) > 1:
                    out += _block_links(names, blk, block[1] == block[2])
                block, names, blk = (key, bi, bj), [], []
            names.append(name)
            blk.append(at)
        yield table(out)
        out = []
    if len(names) > 1:
        yield table(_block_links(names, blk, block[1] == block[2]))


def _settle(links: DataFrame) -> DataFrame:
    """(u, v): of rows (u, v, tier) those of u's best tier, if all of them lead to one v."""
    best = links.groupBy("u").agg(F.min("tier").alias("tier"))
    kept = links.join(best, ["u", "tier"]).groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
    return kept.where("v = w").select("u", "v")


def link_names(names: DataFrame, block_rows: int = 1500) -> DataFrame:
    """``(name, entity)``: every distinct spelling of column ``name`` with the smallest spelling of its entity.

    Spellings are compared without case, marks, hyphens and punctuation. Persons are one entity if their surnames are
    equal or alike and their given names agree (equal, nickname, alike, initial), middle names not contradicting. A spelling
    with initials that fits two entities equally well stays alone. Collaborations match by the words left without "the" and
    "collaboration". Nulls and blanks are left out; repeated rows count once; a spelling without letters is its own entity.
    """
    distinct = stage(names.select("name").where("trim(name) <> ''").distinct(), "names")
    keyed = distinct.mapInArrow(_keys, "key string, name string")
    met = block_pairs(keyed, "key", "name", block_rows)
    runs = met.select("key", "bi", "bj", "name", "blk").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "name")
    found = runs.mapInArrow(_compare_runs, LINKS)
    links = stage(found.distinct(), "names-links")
    strong = links.where("kind = 'strong'").select("a", "b")
    part = stage(connected_components(strong, "a", "b"), "names-strong")
    whole = stage(distinct.join(part, F.col("name") == F.col("node"), "left").select("name", F.coalesce("component", "name").alias("c")), "names-parts")
    both = links.where("kind <> 'strong'")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", "tier", F.col("full_b").alias("full_a"), F.col("full_a").alias("full_b")))
    at = both.join(whole.select(F.col("name").alias("a"), F.col("c").alias("u")), "a").join(whole.select(F.col("name").alias("b"), F.col("c").alias("v")), "b").where("u <> v")
    at = stage(at, "names-weak")
    first = _settle(at.where("kind = 'initial' and not full_a").select("u", "v", "tier"))
    first = stage(first, "names-first")
    # initials without any full name: to the one other group of initials they fit, wherever that has gone
    lonely = at.where("kind = 'letters'").join(at.where("kind = 'initial' and not full_a").select("u").distinct(), "u", "left_anti")
    moved = lonely.select("u", "v", "tier").join(first.select(F.col("u").alias("v"), F.col("v").alias("to")), "v", "left").select("u", F.coalesce("to", "v").alias("v"), "tier")
    second = _settle(moved)
    every = strong.unionByName(first.unionByName(second).select(F.col("u").alias("a"), F.col("v").alias("b")))
    final = connected_components(every, "a", "b")
    return distinct.join(final, F.col("name") == F.col("node"), "left").select("name", F.coalesce("component", "name").alias("entity"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """``(name_a, name_b)``, name_a < name_b: all pairs of different spellings of one entity."""
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
