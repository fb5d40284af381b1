"""Parts of names of persons and firms, and a lexicon of given names and lines of business learned from the corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from actlens.llm.lookup import SortedWords

#: Frequent given names, a floor for corpora too small to learn from (fixed values).
COMMON_GIVEN = frozenset(
    """agnese alberto aldo alessandra alessandro alessia alice andrea angela angelo anna antonella antonia antonio barbara bartolomeo beatrice bruno camilla carla carlo carmela
    caterina cecilia cesare chiara claudia claudio concetta cristina daniela daniele dario davide diego domenico duilio elena eleonora elisa elisabetta elvira emanuele emma enrico
    ettore eugenia fabio federica federico ferdinando filippo flavio franca francesca francesco fulvio gabriele gabriella giacomo gianluca giorgia giorgio giovanna giovanni giulia
    giulio giuseppe giuseppina grazia guido irene ivana jose laura leonardo livia lorenzo loris luca lucia luciano luigi luisa maddalena manuela marco margherita maria marina mario
    marta martina massimo matteo maurizio mauro michela michele monica nicola nicolo noemi oreste ottavia paola paolo patrizia pietro raffaele renata renato riccardo roberta roberto
    rosa sabina salvatore sandra sara sergio silvia simona simone sofia stefania stefano susanna teodoro teresa tommaso tullio ubaldo umberto valentina valerio vincenzo vittoria
    vittorio walter zoe""".split()
)
#: Short forms that are no piece of the full name (fixed values).
NICKNAMES = {
    "mimmo": ("domenico",), "lele": ("emanuele", "gabriele", "raffaele", "daniele"), "pippo": ("filippo", "giuseppe"), "gigi": ("luigi",), "checco": ("francesco",), "franco": ("francesco",),
    "gianni": ("giovanni",), "nanni": ("giovanni",), "turi": ("salvatore",), "toto": ("salvatore", "antonio"), "nico": ("nicolo", "nicola", "domenico"), "toni": ("antonio",), "tony": ("antonio",), "beppe": ("giuseppe",),
    "peppe": ("giuseppe",), "pino": ("giuseppe",), "giusy": ("giuseppina", "giuseppa"), "tina": ("concetta", "caterina", "valentina", "martina"), "enzo": ("vincenzo", "lorenzo"), "nino": ("antonio", "giovanni"), "tonino": ("antonio",), "vanni": ("giovanni",), "pina": ("giuseppina",), "memo": ("guglielmo",),
    "lisa": ("elisabetta",), "maddi": ("maddalena",), "ele": ("elena", "eleonora"), "bea": ("beatrice",), "ciccio": ("francesco",), "memmo": ("guglielmo", "domenico"), "gege": ("eugenia",), "dodo": ("edoardo",), "teo": ("teodoro", "matteo"),
}
#: Titles before a name (fixed values).
TITLES = frozenset("dott dottssa dottoressa dottore dr drssa sig signor signora sigra sigg rag ragioniere geom geometra arch architetto avv avvocato ing ingegnere prof profssa professor professoressa per ind cav on".split())
#: Lines of business, a floor for small corpora (fixed values).
COMMON_TRADES = frozenset("assicurazioni edilizia segnaletica forniture impianti tipografia vivai manutenzioni costruzioni ambiente servizi informatica autolinee ristorazione trasporti pulizie".split())
#: Legal forms, each with its ways of writing (fixed values).
FORMS = (
    ("coop", r"soc(?:iet[aà])?\.?\s*coop(?:erativa)?\.?|coop(?:erativa)?\.?|s\s*\.?\s*c\s*\.?(?:\s*r\.?\s*l\.?)?"),
    ("srl", r"societ[aà] a responsabilit[aà] limitata|s\s*\.?\s*r\s*\.?\s*l\.?"),
    ("spa", r"societ[aà] per azioni|s\s*\.?\s*p\s*\.?\s*a\.?"),
    ("snc", r"societ[aà] in nome collettivo|s\s*\.?\s*n\s*\.?\s*c\.?"),
    ("sas", r"societ[aà] in accomandita(?: semplice)?|s\s*\.?\s*a\s*\.?\s*s\.?"),
    ("onlus", r"o\s*\.?\s*n\s*\.?\s*l\s*\.?\s*u\s*\.?\s*s\.?"),
)
_FORM = [(name, regex.compile(rf"(?i)(?<![\p{{L}}\p{{N}}.])(?:{p})(?![\p{{L}}\p{{N}}])")) for name, p in FORMS]
_NOISE = regex.compile(r"(?i)\([^)]*\)|\bin liquidazione\b|[-–,]?\s*\bsede operativa\b|\bspett(?:\.\s*le|abile)\b\.?|[\"“”«»]|[​-‏﻿]")
_DITTA = regex.compile(r"(?i)^\W*(?:ditta|impresa|società)\b")
_BROTHERS = regex.compile(r"(?i)(?<![\p{L}])(?:fratelli|f\.?\s?lli|fr\.|flli)(?![\p{L}])\.?")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SENTINELS = frozenset(("NON IDENTIFICATO", "DIVERSI/NON APPLICABILE", "NON APPLICABILE", "N/D", "ND", "N.D.", "DIVERSI", "NESSUNO", ""))


@lru_cache(maxsize=1 << 16)
def fold(word: str) -> str:
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def without_one(word: str) -> list[str]:
    """The word, and it without one of its letters: two words within one edit share one of these."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


@dataclass
class Lexicon:
    """Sets of words; large ones are sorted files, and then ``edits`` has each trade behind each of ``without_one`` and a null character."""

    given: frozenset | SortedWords = COMMON_GIVEN
    trades: frozenset | SortedWords = COMMON_TRADES
    edits: SortedWords | None = None

    def begins_trade(self, word: str) -> bool:
        if self.edits is None:
            return any(t.startswith(word) for t in self.trades)
        return next(self.trades.starting(word), None) is not None

    def near_trade(self, word: str) -> bool:
        """Whether a trade is one edit away."""
        if self.edits is None:
            return any(typo(word, t, 1) for t in self.trades)
        return any(typo(word, key.partition("\0")[2], 1) for part in without_one(word) for key in self.edits.starting(part + "\0"))


@dataclass
class Parts:
    firm: bool = False
    form: str = ""
    brothers: bool = False
    trades: list = field(default_factory=list)
    words: list = field(default_factory=list)
    initials: list = field(default_factory=list)


def parse(name: str, lexicon: Lexicon) -> Parts:
    """The parts of a name as typed; order and case play no role afterwards."""
    s = _NOISE.sub(" ", unicodedata.normalize("NFC", name))
    out = Parts(firm=bool(_DITTA.search(s)))
    s = _DITTA.sub(" ", s)
    for form, pattern in _FORM:
        m = None
        for m in pattern.finditer(s):
            pass
        if m and (m.end() >= len(s.rstrip(" .,-")) - 1 or form == "onlus" or m.start() == 0):
            out.form, out.firm, s = form, True, s[: m.start()] + " " + s[m.end() :]
            break
    brothers = _BROTHERS.sub(" ", s)
    if brothers != s:
        out.brothers, out.firm, s = True, True, brothers
    tokens = [(m.group(), s[m.end() : m.end() + 1] == ".") for m in _WORD.finditer(s.replace("'", "").replace("’", ""))]
    for word, dotted in tokens:
        w = fold(word)
        if w in TITLES or w == "ssa" and dotted is not None and len(tokens) > 2:
            continue
        if len(w) == 1:
            out.initials.append(w)
        elif w in lexicon.trades or (dotted and len(w) >= 2 and lexicon.begins_trade(w)):
            out.trades.append(w)
        else:
            out.words.append(w)
    if out.trades:
        out.firm = True
    if out.firm:
        for w in list(out.words):
            if len(out.words) > 1 and len(w) >= 5 and lexicon.near_trade(w):
                out.words.remove(w)
                out.trades.append(w)
    out.words = list(dict.fromkeys(out.words))
    return out


def typo(a: str, b: str, most: int = 2) -> int:
    """Restricted Damerau-Levenshtein distance if it lies in 1..most, else 0; equal words are 0 as well."""
    if a == b or abs(len(a) - len(b)) > most:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return 0
        before, last = last, row
    return last[-1] if last[-1] <= most else 0


def nickname(short: str, full: str) -> bool:
    if full in NICKNAMES.get(short, ()):
        return True
    return short not in COMMON_GIVEN and 3 <= len(short) < len(full) - 1 and (full.startswith(short) or full.endswith(short) or len(short) > 3 and short in full)


def learn(pairs: Iterable[tuple[str, int]], floor: Iterable[str], least: int) -> frozenset:
    """Words seen with at least ``least`` different partners, and the floor."""
    return frozenset(w for w, n in pairs if n >= least) | frozenset(floor)
