"""Parts of names as people write them, and whether two spellings can mean the same person or organisation."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

# Given names that have short forms which don't begin like them, or are names of their own (accents left
# out). Names without such forms are learned from the data, regular short forms come from a rule.
GIVEN = {
    "alejandro": "alex ale jandro", "anne": "annie nancy", "andrew": "drew", "antonio": "toni tono tonio", "anthony": "tony", "beatriz": "bea", "carlos": "charlie", "charles": "chuck",
    "christopher": "chris kit", "concepcion": "concha conchita conchi", "david": "dave", "dolores": "lola loli", "edward": "ed eddie ned ted teddy", "eleanor": "nora nell",
    "elizabeth": "liz beth betty eliza lizzie", "enrique": "quique kike", "francisco": "paco pancho fran curro kiko quico", "guadalupe": "lupe lupita", "henry": "hank harry", "ignacio": "nacho",
    "isabel": "isa chabela bel", "james": "jim jimmy", "jesus": "chus chucho suso", "joaquin": "quino ximo", "john": "jack johnny", "jose": "pepe pepito chepe", "joseph": "joe",
    "katherine": "kate kathy kat katie kitty", "lawrence": "larry", "lucia": "luci lucy", "luis": "lucho", "manuel": "manolo manu lolo", "margaret": "maggie meg peggy marge", "maria": "mari",
    "mary": "molly polly", "michael": "mike mick", "montserrat": "montse", "peter": "pete", "pilar": "pili", "rafael": "rafa", "ramon": "moncho", "rebecca": "becky", "richard": "dick rick rich richie",
    "robert": "bob rob bobby", "rosario": "charo", "santiago": "santi chago", "sarah": "sally", "sofia": "sofi", "steven": "steve", "teresa": "tere teresita", "thomas": "tom tommy",
    "vicente": "chente vicen", "victor": "vic", "william": "will bill billy willy", "ximena": "mena xime", "yolanda": "yoli",
}
# Kinds of organisation, words that carry no identity, and authors that are nobody.
KINDS = ["asociacion", "fundacion", "universidad", "instituto", "society", "association", "foundation", "university", "institute", "colectivo", "editorial"]
IDLE = {"de", "del", "la", "el", "los", "las", "para", "p", "y", "e", "and", "of", "the", "for", "por", "by", "autor", "autora", "author", "ltd", "inc", "dr", "dra", "prof", "sr", "sra", "don", "dona", "jr", "phd"}
ORG_IDLE = IDLE | {"lectores", "lectura", "reading", "estudios", "narrativos", "est"}
NOBODY = {"anonimo", "anonima", "anonymous", "desconocido", "desconocida", "unknown", "varios", "various", "autores", "authors", "sin", "aa", "vv", "aavv", "n", "a", "na", "none", "null", "autor", "author", "no", "disponible"}
# Letters that scanning confuses.
SCANNED = [("rn", "m"), ("ii", "u"), ("vv", "w"), ("c", "e"), ("h", "b")]

SELDOM = 0.1  # of a surname's spellings that a misspelling of it may have, if it has several

DOUBLED = re.compile(r"(\w{2,}([bcdfgklmnprstvz]))\2(?:y|ie)")

SHORT = {n: full for full, names in GIVEN.items() for n in names.split()}
DIGITS = str.maketrans("015", "ols")
TOKEN = re.compile(r"[^\W_]+\.?")
ROLE = re.compile(r"\((?:autor|autora|author|ed\.?|editor|trad\.?)\)", re.IGNORECASE)


class Name(NamedTuple):
    """Parts of a name; a part of one letter is an initial. `given` of an organisation is its kind."""

    surname: str
    given: str
    middle: str
    second: str
    organisation: bool


def fold(text: str) -> str:
    """Lower case without accents and compatibility forms."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of a machine word."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    ones = (1 << len(a)) - 1
    v = ones
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & ones
    return len(a) - v.bit_count()


def scanned(token: str) -> str:
    for a, b in SCANNED:
        token = token.replace(a, b)
    return token


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    """Longest-common-subsequence ratio of two tokens, scanning confusions set aside."""
    if a == b:
        return 1.0
    plain = 2 * lcs(a, b) / (len(a) + len(b))
    x, y = scanned(a), scanned(b)
    return max(plain, 0.98 * 2 * lcs(x, y) / (len(x) + len(y)))


def beginning(token: str) -> str:
    """The beginning of a name that a regular short form stands for: Jenny, Danny."""
    regular = DOUBLED.fullmatch(token)
    return regular[1] if regular else token


class Lexicon:
    """What the names at hand teach: `given` names, and `families`, surnames known to come second to many others."""

    def __init__(self, given: frozenset[str] = frozenset(), families: frozenset[str] = frozenset()):
        self.given, self.families = given, families
        self.names = set(GIVEN) | given
        self.beginnings = {n[:k] for n in self.names for k in range(1, 5)}
        self._ends, self._known = self._by_end(self.names), {}
        self._family_ends, self._second, self._read = self._by_end(families), {}, {}

    def read(self, name: str) -> list[Name]:
        """`readings`, kept for names that come again."""
        if name not in self._read:
            if len(self._read) > 1 << 16:
                self._read.clear()
            self._read[name] = readings(name, self)
        return self._read[name]

    def add(self, name: str) -> None:
        """One more given name."""
        self.names |= {name}
        self._ends["<" + name[:2]].append(name)
        self._ends[">" + name[-2:]].append(name)
        self._known.clear()

    def __reduce__(self):
        return lexicon, (self.given, self.families)

    @staticmethod
    def _by_end(names: Iterable[str]) -> dict[str, list[str]]:
        ends: dict[str, list[str]] = defaultdict(list)
        for n in names:
            ends["<" + n[:2]].append(n)
            ends[">" + n[-2:]].append(n)
        return ends

    @staticmethod
    def _likest(token: str, ends: dict[str, list[str]]) -> tuple[float, str]:
        """The likest of the names that share the first or last two letters with a token, one of which an error leaves."""
        near = {n for e in ("<" + token[:2], ">" + token[-2:]) for n in ends.get(e, ()) if abs(len(n) - len(token)) <= 2}
        return max(((ratio(token, n), n) for n in near), default=(0.0, token))

    def known(self, token: str) -> str | None:
        """The given name that a token is, short for, or a typing error of."""
        if token not in self._known:
            if len(self._known) > 1 << 16:
                self._known.clear()
            self._known[token] = self._look_up(token)
        return self._known[token]

    def _look_up(self, token: str) -> str | None:
        if token in self.names:
            return token
        if token in SHORT:
            return SHORT[token]
        if (regular := beginning(token)) in self.beginnings and regular != token:
            return regular
        if len(token) >= 3:
            alike, name = self._likest(token, self._ends)
            if alike >= (0.8 if len(token) > 3 else 0.85):
                return name
        return None

    def family(self, token: str) -> str | None:
        """The usual second surname that a token is or is a typing error of."""
        if token not in self._second:
            if len(self._second) > 1 << 16:
                self._second.clear()
            alike, name = self._likest(token, self._family_ends)
            self._second[token] = token if token in self.families else name if alike >= 0.8 else None
        return self._second[token]


@lru_cache(maxsize=4)
def lexicon(given: frozenset[str] = frozenset(), families: frozenset[str] = frozenset()) -> Lexicon:
    """The lexicon of these, made once a process."""
    return Lexicon(given, families)


def _initials(token: str, raw: str) -> bool:
    return len(token) == 1 or len(token) == 2 and raw.isupper()


def _kind(token: str) -> str | None:
    for k in KINDS:
        if k == token or len(token) >= 3 and k.startswith(token) or len(token) >= 5 and ratio(k, token) >= 0.85:
            return k
    return None


def _sides(name: str) -> list[list[tuple[str, str, bool]]]:
    """(folded, as written, dotted) of the tokens before and after the first comma."""
    text = ROLE.sub(" ", unicodedata.normalize("NFKC", name)).replace("_", " ").replace("(", " ").replace(")", " ")
    return [[(fold(t.strip(".")).translate(DIGITS) if not t.strip(".").isdigit() else t, t.strip("."), t.endswith(".")) for t in TOKEN.findall(side)] for side in text.split(",", 1)]


def slots(name: str | None) -> list[tuple[str, str, str]]:
    """(token, slot, partner): what a name's form tells of its ends: "g" where given names stand, "s" where surnames do."""
    whole = _sides(name or "")
    sides = [[t for t, _, dot in side if len(t) > 2 and not dot and t.isalpha() and t not in ORG_IDLE and t not in NOBODY] for side in whole]
    every = [t for side in sides for t in side]
    if not sides[0] or any(len(t) > 2 and t not in IDLE and _kind(t) for side in whole for t, _, _ in side):
        return []
    # What stands between the ends may be a middle name or a surname: only a middle name has many last names after it.
    given, surname = (sides[1], sides[0][0]) if len(sides) == 2 else (every[:-1], every[-1])
    return [(g, "g", surname) for g in given if g != surname] + [(surname, "s", g) for g in given[:1] if g != surname]


def parse(name: str | None, lex: Lexicon | None = None) -> Name | None:
    """Parts of a name, or None if it names nobody."""
    return next(iter(readings(name, lex)), None)


def readings(name: str | None, lex: Lexicon | None = None) -> list[Name]:
    """The ways to take a name apart, likeliest first: several if nothing tells given names from surnames; none for nobody."""
    if not name:
        return []
    lex = lex or lexicon()
    sides = _sides(name)
    every = [t for side in sides for t, _, _ in side]
    if not every or all(t in NOBODY or t.isdigit() for t in every):
        return []
    if len(every) > 2 and every[:2] == ["u", "de"]:
        every[0] = "universidad"
    kinds = [k for t in every if len(t) >= 3 and t not in IDLE and (k := _kind(t))]
    if kinds and lex.known(every[0]) is None:
        own = [t for t in every if t not in ORG_IDLE and len(t) > 2 and not _kind(t)]
        rest = [t for t in own if not any(w.startswith(t) or len(t) > 4 and ratio(w, t) >= 0.85 for w in ("lectores", "lectura", "reading", "estudios", "narrativos"))]
        if rest or own:
            return [Name(max(rest or own, key=len), kinds[0], "", "", True)]
    # A single capital or dotted letter is an initial, and so are two capitals (unless all is in capitals); a small "y"
    # or "e" joins, "Dr." is a title.
    mixed = not name.isupper()
    sides = [[x for x in side if x[0] not in IDLE or len(x[0]) == 1 and (x[2] or x[1].isupper()) or len(x[0]) == 2 and x[1].isupper() and not x[2] and mixed] for side in sides]
    if len(sides) == 2 and sides[1]:
        left, right = sides
        # "Given, Surname" also occurs: then only the left side holds given names.
        inverted = not (left and all(lex.known(t) or _initials(t, r) for t, r, _ in left) and not any(lex.known(t) or _initials(t, r) for t, r, _ in right))
        order = right + left if inverted else left + right
        ahead = len(right) if inverted else len(left)
    else:
        order, ahead = [x for side in sides for x in side], 0
    if not order:
        return []
    kind = []
    for t, r, _ in order:
        kind.append("i" if _initials(t, r) else "f" if t in lex.families else "g" if t in lex.names or t in SHORT else "r")
    if any(x in "rf" for x in kind[ahead:]):  # a comma tells the given names
        kind[:ahead] = ["g" if x == "r" else x for x in kind[:ahead]]
    told = ahead or set(kind) != {"r"}
    rare = [k for k, x in enumerate(kind) if x == "r"]
    if len(rare) > 1:  # a mistyped or shortened given name or second surname isn't the surname
        for k in list(rare):
            t, _, dot = order[k]
            before = not any(kind[j] == "r" for j in range(k))
            if len(rare) > 1 and (lex.known(t) or len(t) <= 4 and before and t in lex.beginnings):
                kind[k] = "g"
                rare.remove(k)
            elif len(rare) > 1 and not before and lex.family(t):
                kind[k] = "f"
                rare.remove(k)
    told = told or "g" in kind or "f" in kind
    if not rare:  # every part is a usual one
        rare = [max((k for k, x in enumerate(kind) if x == "f"), default=max((k for k, x in enumerate(kind) if x == "g"), default=0) if kind.count("g") > 1 else -1)]
        if rare == [-1]:
            return []
    at = rare[-1] if len(rare) > 1 and not any(x == "g" for x in kind[: rare[0]]) and not ahead else rare[0]
    firsts: list[str] = []
    second = ""
    for k, (t, _, dot) in enumerate(order):
        if k == at:
            continue
        if kind[k] == "i" and len(t) == 2 and k < at:
            firsts += list(t)
        elif kind[k] == "g" or kind[k] == "i" and (k < at or not firsts) or kind[k] == "r" and k < at:
            # "Vic." is the beginning of a name, "Vic" a short form of one.
            firsts.append(t if kind[k] == "i" or dot and len(t) <= 4 and t not in lex.names else lex.known(t) or beginning(t))
        elif not second:
            second = (lex.family(t) or t) if kind[k] == "r" else t
    found = [Name(order[at][0], firsts[0] if firsts else "", firsts[1] if len(firsts) > 1 else "", second, False)]
    t = [x[0] for x in order]
    if kind == ["g", "r", "r"] and not ahead and at == 1:  # a middle name, or a second surname
        found.append(Name(t[2], found[0].given, t[1], "", False))
    elif not told and len(order) in (2, 3):
        found.append(Name(t[0], beginning(t[1]), "", "", False) if len(t) == 2 else Name(t[1], t[0], "", t[2], False))
    return found


def is_weak(n: Name, lex: Lexicon | None = None) -> bool:
    """Whether the given name is only an initial or a beginning, which several given names share."""
    return not n.organisation and bool(n.given) and len(n.given) <= 4 and n.given not in (lex or lexicon()).names


def part_agrees(a: str, b: str) -> bool:
    """Equal parts, one missing, or one the initial or beginning of the other."""
    return not a or not b or a == b or a.startswith(b) and (len(b) <= 4) or b.startswith(a) and (len(a) <= 4)


def given_level(a: str, b: str) -> int:
    """2: the same given name; 1: one is the other's initial or beginning; 0: different, or one is missing."""
    if not a or not b:
        return 0
    if a == b:
        return 2
    return int(part_agrees(a, b))


def agreement(a: Name, b: Name, common_a: int = 1, common_b: int = 1) -> int:
    """2: the same person; 1: the same as far as an initial tells; 0: different.

    `common_*` says in how many spellings a surname occurs: two surnames that both occur in several are different
    names however alike, since a typing error seldom occurs twice, unless one is seldom beside the other, or they
    differ by scanning confusions only, which do recur.
    """
    if a.organisation != b.organisation:
        return 0
    if a.organisation and a.given != b.given:
        return 0
    alone = not a.given and not b.given  # people known by one name
    level = 2 if a.organisation or alone else given_level(a.given, b.given)
    if not level or not part_agrees(a.middle, b.middle) or not part_agrees(a.second, b.second):
        return 0
    if a.surname == b.surname:
        return level
    if min(len(a.surname), len(b.surname)) < 5:
        return 0
    few, many = sorted((common_a, common_b))
    if few >= 4 and few > SELDOM * many and scanned(a.surname) != scanned(b.surname):
        return 0
    alike = ratio(a.surname, b.surname)
    return level if alike >= (0.82 if level == 2 else 0.88) else 0
