"""Personal information in free text, by what terms disclose.

E-mail addresses, telephone numbers, identity numbers and street addresses have forms of their own. Names are found by information: one pass
over the corpus counts in which company every capitalised term stands - after a mark of a person, in a firm, in a street, elsewhere - and turns
the counts into the information (in bits) that meeting the term gives about a person being named. Terms above the disclosure threshold are
given names, unless they mostly stand in a surname's place; a term of such a place, however frequent, or a rare term next to a given name, to an initial or after a mark is the surname it reveals. Spans are replaced by typed placeholders, and a
surname that a record discloses once is removed wherever that record repeats it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.lookup import SortedWords, word_set
from actlens.llm.persons import COMMON_GIVEN, COMMON_TRADES, TITLES, fold
from actlens.session import cut_lineage, ship

#: Bits of information about a person from which a term counts as a given name, and occurrences it needs.
DISCLOSURE_BITS, LEAST_OCCURRENCES = 1.5, 12
#: A word is common, and so no surname, from this share of the texts.
COMMON_SHARE = 0.001
#: Common words and given names held in memory at most; beyond it they are searched in sorted files.
COMMON_ROWS, GIVEN_ROWS = 200_000, 20_000
#: A frequent term is a surname if this share of its runs, and so many at least, have it in a surname's place.
SURNAME_SHARE, SURNAME_RUNS = 0.5, 3

EMAIL = regex.compile(
    r"(?i)(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*\s?(?:@|[\[(]\s?(?:at|chiocciola)\s?[\])]|\s(?:at|chiocciola)\s)\s?[\p{L}\p{N}-]+(?:(?:\.|\s?[\[(](?:dot|punto)[\])]\s?)[\p{L}\p{N}-]+)*(?:\.|\s?[\[(](?:dot|punto)[\])]\s?)\p{L}{2,}"
)
TAX_CODE = r"(?i:\p{L}{3}\s?\p{L}{3}\s?\d{2}[a-ehlmprst]\d{2}\s?\p{L}\d{3}\p{L})"
CARD = r"\p{Lu}{2}\s?\d{7}|\p{Lu}{2}\s?\d{5}\s?\p{Lu}{2}|(?i:c[a-z])\d{5}(?i:[a-z]{2})"
IDENTITY = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{TAX_CODE}|{CARD})(?![\p{{L}}\p{{N}}])")
#: What stands before numbers that look like an identity card and are none (fixed values).
_NOT_ID = regex.compile(r"(?i)(?:\bcig|\bcup|\bprot(?:ocollo)?\.?|\bfattura|\bbolla|\bpratica|\bfascicolo|\bp(?:artita)?\.?\s?iva|\brep\.?|\biban)\s*(?:n\.?\s*)?[:]?\s*$")
_SEP = r"[ .\-/]?"
PHONE = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}/.,+-])(?:(?:\+|00)\s?39{_SEP})?(?:3\d{{2}}(?:{_SEP}\d{{7}}|{_SEP}\d{{3}}{_SEP}\d{{4}}|{_SEP}\d{{2}}{_SEP}\d{{2}}{_SEP}\d{{3}}|{_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}|{_SEP}\d{{6}})"
    rf"|\(0\d{{1,3}}\)\s?\d{{2,4}}{_SEP}\d{{2,4}}{_SEP}\d{{0,3}}\d|0\d{{2,3}}[ /-]\d{{5,8}}|0\d{{2,3}}[ ./-]\d{{2,4}}[ .-]\d{{2,4}}(?:[ .-]\d{{2,3}})?|0[26][ /-]\d{{6,8}})(?![\p{{L}}\p{{N}}]|[/.,-]\d)"
)
STREET = r"(?:via|viale|v\.le|corso|c\.so|piazza|p\.za|p\.zza|piazzale|p\.le|piazzetta|vicolo|vic\.|largo|l\.go|strada|str\.|stradone|contrada|c\.da|c/da|località|loc\.|frazione|fraz\.|fr\.|borgo|salita|rione|lungomare|lungolago|traversa|galleria)"
_PARTICLE = r"(?:d[aei]|del|dell[aeo]?|de[gi]l?i|dei|dal|san|santa|santo|s\.)"
_STOP = r"(?i:cig|cup|dal|al|rif|prot|protocollo|fasc|fascicolo|pratica|lotto|foglio|mappale|n|nr|num|numero|civico|int|sede|settore|zona|frazione|piano|anno)(?![\p{L}\p{N}])"
_PLACE = rf"(?!{_STOP})(?:\p{{Lu}}[\p{{L}}'’]+|\p{{Lu}}\p{{L}}{{0,3}}\.)"
ADDRESS = regex.compile(
    rf"(?i:{STREET})\s+(?:(?i:{_PARTICLE})['’]?\s*)*(?:{_PLACE}|\d{{1,2}}\s\p{{L}}+)(?:\s(?:(?i:{_PARTICLE})['’]?\s*)*{_PLACE}){{0,4}}"
    rf"\s?,?\s?(?:(?i:numero|num\.|nr\.?|n\.?\s?°|n\.|n|civico|civ\.)\s?)?(?<![\p{{L}}\p{{N}}])\d{{1,4}}(?!\d|[./-]\d|\s(?i:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre))"
    rf"(?:\s?/\s?\p{{L}}(?!\p{{L}})|\s?/\s?(?i:bis|ter)\b|\s?(?i:bis|ter|quater)\b|\s?\p{{Lu}}(?![\p{{L}}\p{{N}}.])|\p{{Ll}}(?!\p{{L}}))?(?:\s?,?\s?(?i:int\.?|interno|scala|sc\.)\s?\d{{1,3}}(?!\d)(?:/?\p{{Lu}}(?!\p{{L}}))?)?"
)
#: Cheap finds that the patterns above are tried at.
_STREET_WORDS = tuple(w.replace("\\", "") for w in STREET[3:-1].split("|"))
_AT_ID = re.compile(r"(?<!\d)(?:\d\d[A-Za-z]\d\d|\d{5}(?:\d\d(?!\d)|\s?[A-Za-z]{2}(?!\w)))")
_AT_MAIL = re.compile(r"@|[\[(]\s?(?:at|chiocciola)\s?[\])]|\s(?:at|chiocciola)\s", re.IGNORECASE)


def _street_starts(text: str) -> list[int]:
    """Where a street word stands as a word of its own before white space."""
    low = text.lower()
    if len(low) != len(text):  # a letter that grows in lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out = []
    for w in _STREET_WORDS:
        at = low.find(w)
        while at >= 0:
            end = at + len(w)
            if end < len(low) and low[end].isspace() and (at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_")):
                out.append(at)
            at = low.find(w, at + 1)
    return sorted(out)


#: A capitalised word, also with a misread letter inside, and broken by a hyphen at the end of a line.
_WORD = r"\p{Lu}[\p{L}\p{M}'’]+(?:[0-9@]\p{Ll}[\p{L}\p{M}'’]*)*(?:[-\u2010\u00ac\u00ad]\n\p{Ll}+)?"
RUN = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._'’-])(?:{_WORD}|\p{{Lu}}\.)(?:(?:[ \t]+|(?<=\p{{Lu}}\.)|[ \t]*\n[ \t]*)(?:{_WORD}|\p{{Lu}}\.))+(?![\p{{L}}\p{{N}}@])")
_PART = regex.compile(rf"{_WORD}|\p{{Lu}}\.")
#: What stands before a person (fixed values).
MARK = regex.compile(
    r"(?i)(?:\bsig(?:\.\s?ra|\.ri|\.|ra|nor|nora)?|\bdott(?:\.\s?ssa|\.)?|\bdr\.|\bing\.|\barch\.|\bgeom\.|\bavv\.|\brag\.|\bprof(?:\.\s?ssa|\.)?|\bistanza di|\brichiesta di|\bintestat[oa] a|\brilasciata da|\bnotificato a"
    r"|\bcomunica a|\bminore|\bassistit[oa]|\bistante|\brichiedente|\bdipendente|\bfirmato|\bf\.to|\bsegretario|\bpresidente|\bsottoscritto:?|\bresponsabile|\bdirigente|\bsindaco|\bassessore|\ba carico di|\bnei confronti di|\bnato|\bnata|\bdomanda di|\bfavore di|\btitolare)\s*$"
)
_BEFORE_STREET = regex.compile(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{STREET})\s+(?:{_PARTICLE}['’]?\s*)*$")
_FIRM_AFTER = regex.compile(r"(?i)^[\s,]*(?:\p{L}+[\s,]+){0,2}(?:s\.?\s?r\.?\s?l|s\.?\s?p\.?\s?a|s\.?\s?n\.?\s?c|s\.?\s?a\.?\s?s|soc\.?\s?coop|società coop|onlus|o\.n\.l\.u\.s)\b")
_FIRM_BEFORE = regex.compile(r"(?i)(?:\bfratelli|\bf\.?lli|\bditta|\bimpresa|\bdi\s+ditta)\s*$")
_ANY = re.compile(r"[^\W\d_]{3,}").findall


_BROKEN = re.compile("[-\u2010\u00ac\u00ad]\n")
_ELIDED = re.compile(r"(?:l|un|al?l|dal?l|del?l|nel?l|sul?l|col?l|quel?l)['’]")


class Lexicon:
    def __init__(self, given: frozenset | SortedWords, common: frozenset | SortedWords):
        self.given, self.common = given, common


def _shouted(word: str) -> bool:
    return len(word) > 1 and word.isupper()


def _narrow(text: str) -> bool:
    """Whether lines break within sentences, so that a name may go on in the next line."""
    widths = sorted(len(x) for x in text.split("\n") if x.strip())
    return bool(widths) and widths[int(len(widths) * 0.9)] < 100


def _runs(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of capitalised words and initials; they cross a line's end in narrow texts only."""
    narrow = None
    for m in RUN.finditer(text):
        run = [(p.group(), m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m.group())]
        if "\n" in m.group():
            narrow = _narrow(text) if narrow is None else narrow
            if not narrow:
                a = 0
                for k in range(1, len(run)):
                    if "\n" in text[run[k - 1][2] : run[k][1]]:
                        yield run[a:k]
                        a = k
                run = run[a:]
        yield run


def name_spans(text: str, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Offsets of names of natural persons, without titles."""
    out: list[tuple[int, int]] = []
    given, common = lexicon.given, lexicon.common
    for run in _runs(text):
        n = len(run)
        if n < 2:
            continue
        kind = []
        for word, _, _ in run:
            w = fold(_BROKEN.sub("", word).rstrip("."))
            if len(w) == 1 and word.endswith("."):
                kind.append("i" if not (w == "c" and run[len(kind) + 1 : len(kind) + 2] and run[len(kind) + 1][0] == "F." or w == "f" and kind[-1:] == ["x"]) else "x")
            elif w in given or w.replace("'", "").replace("’", "") in given:
                kind.append("g")
            elif _ELIDED.match(w) or w in common or w in TITLES or w in COMMON_TRADES or len(w) < 4:
                kind.append("c")
            else:
                kind.append("r")
        for k in range(n - 2):
            if kind[k] == kind[k + 1] == kind[k + 2] == "i":
                kind[k] = kind[k + 1] = kind[k + 2] = "x"  # a legal form, not initials
        k = 0
        while k < n:
            taken = 0
            if kind[k] in "gi":
                j = k
                while j < n and kind[j] in "gi" and j - k < (3 if kind[k] == "g" else 2) and (kind[j] == kind[k] or kind[k] == "g" and j + 1 < n and kind[j + 1] == "r"):
                    j += 1
                if j < n and kind[j] == "r" and not (k and kind[k - 1] == "r" and "\n" in text[run[j - 1][2] : run[j][1]]):
                    taken = _take(text, run, k, j + 1, out)
                elif k and kind[k - 1] == "r" and (not out or out[-1][1] <= run[k - 1][1]) and (kind[k] == "g" or MARK.search(text, 0, run[k - 1][1])):
                    taken = _take(text, run, k - 1, j, out)
                    taken = max(taken - 1, 0)
                elif kind[k] == "g" and j > k + 1 and MARK.search(text[max(0, run[k][1] - 24) : run[k][1]]):
                    taken = _take(text, run, k, j, out)  # the surname is a given name too
            elif kind[k] == "r" and k + 1 < n and kind[k + 1] == "r" and (k == 0 or kind[k - 1] == "c") and (k + 2 == n or kind[k + 2] != "g") and MARK.search(text[max(0, run[k][1] - 24) : run[k][1]]):
                taken = _take(text, run, k, k + 2, out)
            k += max(taken, 1)
    return out


def _take(text: str, run: list[tuple[str, int, int]], a: int, b: int, out: list[tuple[int, int]]) -> int:
    """Adds run[a:b] unless it belongs to a street or a firm; the number of words taken."""
    begin, end = run[a][1], run[b - 1][2]
    left = text[max(0, begin - 30) : begin]
    if _BEFORE_STREET.search(left) or _FIRM_AFTER.match(text[end : end + 40]) or _FIRM_BEFORE.search(left):
        return b - a
    out.append((begin, end))
    return b - a


def find_spans(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of all personal information, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    for m in _AT_MAIL.finditer(text):
        for x in EMAIL.finditer(text, max(0, m.start() - 70), m.end() + 90):
            if x.start() <= m.start() < x.end():
                found.append((x.start(), x.end(), "EMAIL"))
    for m in _AT_ID.finditer(text):
        for x in IDENTITY.finditer(text, max(0, m.start() - 9), m.end() + 7):
            if x.start() < m.start() < x.end() and not _NOT_ID.search(text[max(0, x.start() - 20) : x.start()]):
                found.append((x.start(), x.end(), "ID"))
    found += [(m.start(), m.end(), "PHONE") for m in PHONE.finditer(text) if not _NOT_ID.search(text[max(0, m.start() - 20) : m.start()])]
    narrow = None
    for start in _street_starts(text):
        if x := ADDRESS.match(text, start):
            if "\n" in x.group():
                narrow = _narrow(text) if narrow is None else narrow
                x = x if narrow else ADDRESS.match(text, start, text.index("\n", start))
            if x:
                found.append((x.start(), x.end(), "ADDRESS"))
    found += [(b, e, "NAME") for b, e in name_spans(text, lexicon)]
    order = {"EMAIL": 0, "ID": 1, "ADDRESS": 2, "PHONE": 3, "NAME": 4}
    kept: list[tuple[int, int, str]] = []
    for b, e, kind in sorted(found, key=lambda s: order[s[2]]):
        if all(e <= x or b >= y for x, y, _ in kept):
            kept.append((b, e, kind))
    return sorted(kept)


def sanitise_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders; a surname disclosed by one of its spans goes wherever it is repeated."""
    parts, at = [], 0
    for b, e, kind in spans:
        parts += [text[at:b], f"[{kind}]"]
        at = e
    out = "".join([*parts, text[at:]])
    surnames = {w for b, e, kind in spans if kind == "NAME" for w in _PART.findall(text[b:e]) if len(w) > 4 and fold(w) not in COMMON_GIVEN}
    if surnames:
        out = regex.sub(r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(map(regex.escape, surnames))) + r")(?![\p{L}\p{N}])", "[NAME]", out)
    return out


# --- corpus statistics and the operators ----------------------------------------------------------------------------------------------------


def term_counts(texts: DataFrame) -> DataFrame:
    """(``term``, ``n`` texts' occurrences, ``person``, ``firm``, ``other``, ``surname``): the company of every capitalised term, and the frequency of every word.

    ``surname`` counts the runs, outside firms and streets, in which the term follows a common given name or an initial, or ends a short run after a mark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        company: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update({w if w.isascii() else fold(w) for w in set(_ANY(text.lower()))})
                for run in _runs(text):
                    if len(run) < 2 or len(run) > 5:
                        continue
                    begin, end = run[0][1], run[-1][2]
                    left = text[max(0, begin - 24) : begin]
                    street = _BEFORE_STREET.search(left)
                    what = 1 if _FIRM_AFTER.match(text[end : end + 30]) or _FIRM_BEFORE.search(left) else 2 if street else 0 if MARK.search(left) else 2
                    ended = what == 0 and len(run) < 4
                    given = False
                    for k, (word, _, _) in enumerate(run):
                        if len(word) > 2:
                            seen = company.setdefault(w := fold(word), [0, 0, 0, 0])
                            seen[what] += 1
                            seen[3] += what != 1 and not street and (given or ended and k == len(run) - 1)
                            given = w in COMMON_GIVEN
                        else:
                            given = word.endswith(".")
            if len(words) > 300_000:
                yield _stats(words, company)
                words, company = Counter(), {}
        yield _stats(words, company)

    ship(texts.sparkSession)
    found = texts.where(F.col(texts.columns[0]).isNotNull()).mapInArrow(count, "term string, n bigint, person bigint, firm bigint, other bigint, surname bigint")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("person").alias("person"), F.sum("firm").alias("firm"), F.sum("other").alias("other"), F.sum("surname").alias("surname"))


def _stats(words: Counter, company: dict[str, list[int]]) -> pa.RecordBatch:
    terms = list(words.keys() | company.keys())
    none = [0, 0, 0, 0]
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([words[t] for t in terms], pa.int64()), *(pa.array([company.get(t, none)[k] for t in terms], pa.int64()) for k in range(4))],
        names=["term", "n", "person", "firm", "other", "surname"],
    )


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Given names: terms whose company discloses a person by at least ``DISCLOSURE_BITS``; common words: those of many texts. Terms that mostly stand in a surname's place are neither.

    All of them are kept: tables beyond their bound go to sorted files.
    """
    counts = cut_lineage(term_counts(texts).where((F.col("n") >= 3) | (F.col("person") >= 3)))
    total = texts.count()
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("person", "firm", "other"))).first()
    every = max(sums["person"] + sums["firm"] + sums["other"], 1)
    prior = max(sums["person"], 1) / every
    seen = F.col("person") + F.col("firm") + F.col("other")
    bits = F.log2((F.col("person") + F.lit(0.5)) / (seen + F.lit(1.0)) / F.lit(prior))
    surname = (F.col("surname") >= SURNAME_RUNS) & (F.col("surname") >= seen * SURNAME_SHARE)
    revealing = ~surname & (seen >= LEAST_OCCURRENCES) & (bits >= min(DISCLOSURE_BITS, math.log2(1 / prior) * 0.6)) & (F.col("firm") * 4 < seen) & (F.length("term") > 2)
    revealing = F.coalesce(revealing, F.lit(False)) & ~F.col("term").isin(*COMMON_TRADES, *TITLES)
    known = F.col("term").isin(*COMMON_GIVEN)
    floor = texts.sparkSession.createDataFrame([(g,) for g in sorted(COMMON_GIVEN)], "term string")
    given = counts.where(revealing & ~known).select("term").unionByName(floor)
    common = counts.where((F.col("n") >= max(4.0, COMMON_SHARE * total)) & ~surname & ~revealing & ~known).select("term")
    return Lexicon(word_set(given, GIVEN_ROWS), word_set(common, COMMON_ROWS))


def _each(df: DataFrame, id_col: str, text_col: str, lexicon: Lexicon, schema: str, rows_of) -> DataFrame:
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    kind = rows.schema["_id"].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(lexicon)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *r) for k, text in enumerate(batch.column("_text").to_pylist()) for r in rows_of(text, held.value)]
            columns = list(zip(*out, strict=True)) if out else [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.string()) for c in columns[1:])], names=["_id", *names])

    return rows.mapInArrow(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)


def find_personal(df: DataFrame, id_col: str, text_col: str, *, lexicon: Lexicon | None = None) -> DataFrame:
    """(``id_col``, ``kind`` NAME/EMAIL/PHONE/ID/ADDRESS, ``span``): each different span of personal information, exactly as it stands in the text.

    Null, empty and blank texts have none. Rows that repeat an id and text repeat their spans. Numbers of firms and acts (VAT, CIG, CUP, protocol) are
    left alone. Without ``lexicon`` the corpus statistics come from the table itself.
    """
    lexicon = lexicon or learn_lexicon(df.select(F.col(text_col).cast("string")))
    return _each(df, id_col, text_col, lexicon, "kind string, span string", lambda t, lex: list(dict.fromkeys((k, t[b:e]) for b, e, k in find_spans(t, lex))))


def sanitise(df: DataFrame, id_col: str, text_col: str, *, lexicon: Lexicon | None = None) -> DataFrame:
    """(``id_col``, ``text_col``): the texts with typed placeholders for personal information; the rest stays as it is. Null texts stay null."""
    lexicon = lexicon or learn_lexicon(df.select(F.col(text_col).cast("string")))
    clean = _each(df, id_col, text_col, lexicon, f"{text_col} string", lambda t, lex: [(sanitise_text(t, find_spans(t, lex)),)])
    return clean.unionByName(df.where(F.col(text_col).isNull()).select(id_col, F.lit(None).cast("string").alias(text_col)))
