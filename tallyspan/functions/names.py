"""Names of persons: folding to a comparable form and similarity of two spellings.

Folding of whole columns runs on the JVM (`fold_column`); the pairwise comparison is plain Python meant for
Arrow functions over distinct pairs.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that NFKD does not decompose.
SPECIAL_LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "þ": "th"}
# Particles of family names, and suffixes that tell relatives apart.
PARTICLES = frozenset("al bin da das de del della den der di do dos du el ibn la le ter van von".split())
SUFFIXES = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "2", "iii": "3", "iv": "4", "neto": "neto", "filho": "filho"}
# Given names that stand for one another, in folded spelling.
GIVEN_NAMES = (
    "agnieszka aga", "aleksandr aleksander alexander alexandre alejandro alessandro alex aleks sacha sandro sasha shura xander", "aleksandra alexandra aleks alex ola sandra sasha",
    "andre andrew andrei andrey andreas andy dede", "anthony anton antonio antonie tony toni tonho toninho", "aylin ayla", "benjamin ben benny benji", "bjorn bjoern", "caio cayo", "chiara clara",
    "christopher chris kit kris topher", "daniel dan danny dani danilo", "david dave davi davey", "dmitri dmitry dmitriy dimitri dima mitya", "edward ed eddie eddy ned ted teddy", "elizabeth beth betsy betty eliza elisabeth libby lis liz liza lizzie lizzy",
    "etienne stephane steve", "francisco chico cisco francis frank paco pancho kiko", "frederick fred freddie freddy fritz rick", "gabriela gabi gabriella gaby", "gregory greg gregor grisha", "guillermo billy guille memo will willy",
    "hye-jin hyejin", "ignacio iggy nacho", "ines agnes inez", "isabella bela bella belle isa isabel izzy", "ivan vanya vania", "jana janka", "jennifer jen jenna jenni jennie jenny", "jiri george jirka", "joao joaozinho", "jose josef joseph joe joey pepe ze zezinho", "karim kareem",
    "katarzyna kasia kate katherine katie kathy", "kenji ken", "larissa lara lari", "leonardo leo leon", "louis lou luis", "luca lucas luka lukas luke", "lukasz lucas lukas luka luke", "magnus mans", "marcos marc marco marcus mark marquinhos", "marek mark", "margaret greta madge maggie maggy marge margie meg meggie peg peggy", "matthew mat matt mateo matteo matthias matty",
    "maximilian max maxi maxim", "michael mick mickey mike mikey mikael michal", "mikhail michail mikhael misha mischa", "monica monika moni", "nadia nadja nadya nadezhda", "nicholas nic nick nicky nico nicolas nik nikolai niko", "nils niels", "patrick paddy pat patricio",
    "pawel paul pavel", "remi remy", "renato rene", "renee rene reni", "robert bob bobbie bobby rob robbie robby robin", "rustam rus", "samuel sam sammy", "sebastian bas seb", "sofia sophia sophie sonia sonya sofi", "soren soeren", "stefan stephan stephen steph stef steve steven stevie", "tatiana tanya tania tati",
    "theodore ted teddy theo", "thiago tiago thi", "thomas tom tommy tomas tomasz tomek", "tomas tom thomas tomek", "timothy tim timmy timo", "victoria tori vicki vicky vika viki", "vladimir vlad vladi volodya vova", "william bill billy liam wil will willie willy", "yuri iouri yura", "zachary zac zach zack zak", "zoe zoey",
)
_GIVEN: dict[str, int] = {}
for _i, _names in enumerate(GIVEN_NAMES):
    for _n in _names.split():
        _GIVEN[_n] = _GIVEN.get(_n, 0) | 1 << _i
_LOOKALIKE = str.maketrans("013457@$", "oieasTas".lower())
_NICK = re.compile(r"[\"“”„«»][^\"“”„«»]*[\"“”„«»]|\([^)]*\)|\[[^\]]*\]")
_SPLIT = re.compile(r"[^a-z]+")


def strip_marks(text: str) -> str:
    """Lower case without diacritics."""
    text = "".join(SPECIAL_LETTERS.get(c, c) for c in text.lower())
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 15)
def tokens(name: str) -> tuple[str, ...]:
    """Folded words of a name in the order given; quoted nicknames and bracketed remarks are left out."""
    text = strip_marks(_NICK.sub(" ", name))
    text = text.replace("'", "").replace("’", "").replace("`", "")
    text = "".join(w.translate(_LOOKALIKE) if any(c.isalpha() for c in w) else w for w in re.split(r"(\s+)", text))
    if "," in text:
        last, _, first = text.partition(",")
        text = f"{first} {last}"
    return tuple(t for t in _SPLIT.split(text) if t)


_SOUNDS = (("ph", "f"), ("th", "t"), ("kh", "k"), ("ck", "k"), ("ks", "x"), ("sh", "s"), ("ch", "c"), ("ie", "i"), ("ye", "e"), ("y", "i"), ("ou", "u"), ("j", "i"), ("w", "v"), ("f", "v"), ("q", "k"), ("c", "k"), ("z", "s"))


@lru_cache(maxsize=1 << 15)
def sound(token: str) -> str:
    """Coarse phonetic form: common respellings of one sound fall together, doubled letters are single."""
    for a, b in _SOUNDS:
        token = token.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", token)


@lru_cache(maxsize=1 << 14)
def letters(word: str) -> int:
    """The letters of a word as 64 bits, a second one of a kind apart: an edit takes one bit and adds one at most."""
    once = twice = 0
    for c in word:
        bit = 1 << (ord(c) & 31)
        twice |= once & bit
        once |= bit
    return once | twice << 32


def edits(a: str, b: str, most: int = 3) -> int:
    """Edits with transpositions of neighbours (optimal string alignment); more than ``most`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    la, lb = letters(a), letters(b)
    if (la & ~lb).bit_count() > most or (lb & ~la).bit_count() > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return old[-1]


@lru_cache(maxsize=1 << 16)
def token_similarity(a: str, b: str) -> float:
    """1 for equal words, less for nicknames, initials, respellings and typing errors, 0 for others."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.75 if a[0] == b[0] else 0.0
    if _GIVEN.get(a, 0) & _GIVEN.get(b, 0):
        return 0.92
    n = max(len(a), len(b))
    d = edits(a, b)
    score = 0.0
    if n >= 3 and d <= (1 if n < 7 else 2 if n < 11 else 3):
        score = 1 - 0.9 * d / (n + 1)
    if sound(a) == sound(b):
        score = max(score, 0.9)
    elif n >= 6 and edits(sound(a), sound(b)) == 1:
        score = max(score, 0.8)
    if score < 0.8 and min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)) and min(len(a), len(b)) < 5:
        score = max(score, 0.72)
    return score


def _parts(toks: tuple[str, ...]) -> tuple[list[str], frozenset[str]]:
    suffix = frozenset(SUFFIXES[t] for t in toks[1:] if t in SUFFIXES)
    core = [t for i, t in enumerate(toks) if not (i and t in SUFFIXES) and t not in PARTICLES]
    return core or list(toks), suffix


def family_at(core: list[str]) -> int:
    """Where the family name stands: last, unless only the last word is a usual given name."""
    return 0 if len(core) > 1 and core[-1] in _GIVEN and core[0] not in _GIVEN else len(core) - 1


@lru_cache(maxsize=1 << 14)
def similarity(typed: str | None, held: str | None) -> float:
    """How well two spellings fit one person, 0 to 1.

    Word order, particles and middle names don't matter much; a family name that finds no partner does, and
    so does a suffix that only one of them carries. Null or blank names fit nobody.
    """
    if typed is None or held is None:
        return 0.0
    a, b = tokens(typed), tokens(held)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    (ca, sa), (cb, sb) = _parts(a), _parts(b)
    whole = 0.0
    ja, jb = "".join(a), "".join(b)
    if sorted(a) == sorted(b):
        whole = 0.99
    elif ja == jb:
        whole = 0.98
    else:
        d = edits(ja, jb)
        if d <= 3 and len(jb) >= 8:
            whole = 1 - 0.9 * d / (len(jb) + 1) - 0.02
        elif sorted(ja) == sorted(jb) and len(jb) >= 8:
            whole = 0.85
    left = list(range(len(cb)))
    got = 0.0
    family = family_at(cb)
    family_hit, dropped = 0.0, 0.0
    for x in sorted(ca, key=len, reverse=True):
        best, at = 0.0, -1
        for j in left:
            s = token_similarity(x, cb[j])
            if s > best:
                best, at = s, j
        if at < 0 and len(x) >= 3:
            # An unlisted short form of a given name at least begins alike.
            at = next((j for j in left if j != family and cb[j][0] == x[0]), -1)
            best = 0.5
        if at >= 0:
            left.remove(at)
            got += best
            if at == family:
                family_hit = best if len(x) > 1 else 0.3
            elif at and x == ca[-1] and len(ca) > 1 and len(x) >= 4:
                dropped = best  # the last word typed is an earlier family name of a double one
    if family_hit == 0.0 and len(ca) < len(cb) + 1:
        glued = "".join(cb)
        for x in ca:
            if len(x) >= 6 and x in (glued, glued[::-1]):
                family_hit = 0.9
    need = min(len(ca), len(cb))
    if family_hit == 0.0 and len(ca) < len(cb) and got >= 0.9 * len(ca):
        family_hit = dropped
    score = got / max(need, 1) if need else 0.0
    extra = len(ca) - (len(cb) - len(left))
    score -= 0.2 * max(0, extra) + 0.03 * len(left)
    if family_hit < 0.7 and need > 1:
        score = min(score, 0.5 * score + 0.2 * family_hit)
    if need == 1 and len(cb) > 1:
        score = min(score, 0.8 if family_hit >= 0.7 else 0.55 if got >= 0.9 else 0.0)
    score = max(score, whole)
    if sa != sb:
        score -= 0.06
    return max(0.0, min(1.0, score))


# Letters of Latin scripts with marks, found once from the Unicode tables, for the JVM's translate.
def _latin_table() -> tuple[str, str]:
    pairs = []
    for cp in range(0xC0, 0x250):
        c = chr(cp).lower()
        base = SPECIAL_LETTERS.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(c) == len(base) == 1 and base != c and base.isascii():
            pairs.append((c, base))
    pairs = list(dict.fromkeys(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _latin_table()


def fold_column(name: Column) -> Column:
    """Lower case, Latin marks removed, hyphens as blanks, only ``[a-z0-9 ]`` kept, blanks squashed (JVM only)."""
    text = F.lower(F.regexp_replace(name, r"[\s\p{Z}]+", " "))
    for letter, plain in SPECIAL_LETTERS.items():
        if len(plain) > 1:
            text = F.replace(text, F.lit(letter), F.lit(plain))
    text = F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{M}+", "")
    text = F.regexp_replace(F.regexp_replace(text, "-", " "), r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(text, " +", " "))
