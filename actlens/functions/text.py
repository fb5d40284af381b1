"""String functions as column expressions. Patterns are portable between Java and RE2, so that each has an SQL counterpart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalized_for_model(c: Column) -> Column:
    """Null becomes empty; control characters become blanks; white space is collapsed."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", " "))


def chain_delete(c: Column, patterns: Sequence[str], to: str = "") -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, to)
    return c


#: Lines that pages of the portals add to an act (fixed values).
BOILERPLATE = (
    r"(?i)questo sito usa cookie tecnici[^\n]*",
    r"(?i)ultimo\s+aggiornamento\s+della\s+pagina[^\n]*",
    r"(?i)valuta da 1 a 5[^\n]*",
    r"(?i)condividi questa pagina[^\n]*",
    r"(?i)copia informatica per consultazione[^\n]*",
    r"(?i)pag(?:ina)?\.?\s*(?:n\.\s*)?\d+(?:\s*(?:di|/)\s*\d+)?\s*\n",
    r"[_-]{4,}",
)


def without_boilerplate(c: Column, patterns: Sequence[str] = BOILERPLATE) -> Column:
    """Deletes boilerplate, then collapses blanks within lines and runs of empty lines."""
    c = chain_delete(c, patterns)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n+", "\n"))


def semantic_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def slug(c: Column, longest: int = 120) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", "_"), r"[^A-Za-z0-9_.-]", "")
    return F.when(F.substring(s, 1, longest) == "", F.lit("file")).otherwise(F.substring(s, 1, longest))


def shorten(c: Column, longest: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit(mark))).otherwise(c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def count_matches(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


#: Stands around every sign that belongs to no word.
_EDGE = "\u0001"


def edged(c: Column) -> Column:
    """Lower-cased text in which every sign outside words is marked, so that ``has_words`` finds whole words by plain search."""
    return F.concat(F.lit(_EDGE), F.regexp_replace(F.lower(c), r"([^\p{L}\p{N}_])", f"{_EDGE}$1{_EDGE}"), F.lit(_EDGE))


def has_words(edged_text: Column, words: str) -> Column:
    """Whether the words occur, in any case, not as parts of other words."""
    marked = "".join(x if x.isalnum() or x == "_" else f"{_EDGE}{x}{_EDGE}" for x in words.lower())
    return edged_text.contains(f"{_EDGE}{marked}{_EDGE}")


def keyword_hits(c: Column, words: Sequence[str]) -> Column:
    """Those of ``words`` that occur as whole words."""
    return F.array_compact(F.array(*(F.when(has_words(c, w), F.lit(w)) for w in words)))


def first_label(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Column) -> Column:
    """The label of the first rule of which a needle occurs in ``c``."""
    out = None
    for label, needles in rules:
        out = F.when(contains_any(c, needles), label) if out is None else out.when(contains_any(c, needles), label)
    return out.otherwise(default)


def first_pattern(c: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    out = None
    for label, pattern in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(default)




def turtle_literal(c: Column) -> Column:
    """A quoted literal with backslash, quote and line ends escaped."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), c, F.lit('"'))


#: Sentinels of unknown and of many or inapplicable parties (fixed values).
UNKNOWN, MANY = "NON IDENTIFICATO", "DIVERSI/NON APPLICABILE"
#: Phrases that stand where a payee should (fixed values).
NO_PAYEE = ("MAGGIORMENTE QUALIFICAT", "CHE HA PRESENTATO", "IN REGOLA", "DIVERSI BENEFICIARI", "DIVERSE DITTE", "OPERATORE ECONOMICO", "APPALTATRICE", "AGGIUDICATARI", "DIVERSI")
#: Legal forms and titles without meaning for a payee's identity (fixed values).
PAYEE_AFFIXES = r"\b(PROFESSIONISTA|DITTA|IMPRESA|SOCIETA|S\.?R\.?L\.?S?|S\.?P\.?A|S\.?N\.?C|S\.?A\.?S|AVV|ING|ARCH|DOTT|GEOM)\b"
#: Titles and roles around an officer's name (fixed values).
OFFICER_AFFIXES = r"\b(DOTT|DR|SSA|IL RESPONSABILE|DEL SERVIZIO|F\.TO|IL SEGRETARIO|IL SINDACO|GEOM|ARCH|ING|AVV)\b"
#: Phrases that make a string no officer (fixed values).
NO_OFFICER = (
    "VISTO", "VISTA", "VISTI", "PREMESSO", "ACCERTATA", "SULLA BASE",
    "DECRETO", "FUNZIONI", "AI SENSI", "LA GIUNTA", "DI ADOTTARE", "IL CONSIGLIO",
    "HA ADOTTATO", "DELIBERAZIONE", "DETERMINAZIONE", "COMPETENZA", "MUNICIPIO",
    "URBANISTICO", "REGOLAMENTO", "PROMOZIONE", "FINANZIARIA", "NAZIONALE",
    "RIPRESA", "CENSIMENTO", "DIPENDENTE", "CONCESSO", "CHE CON", "PRO TEMPORE",
)


def _cleaned(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def payee(c: Column, no_payee: Sequence[str] = NO_PAYEE) -> Column:
    """One spelling per payee: sentinels for blank and collective strings, legal forms and titles removed."""
    up = F.upper(F.trim(c))
    name = _cleaned(F.regexp_replace(up, PAYEE_AFFIXES, ""))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", UNKNOWN).when(contains_any(up, no_payee), MANY).otherwise(F.when(name == "", UNKNOWN).otherwise(name))


def officer(c: Column, no_officer: Sequence[str] = NO_OFFICER) -> Column:
    up = F.upper(F.trim(c))
    name = _cleaned(F.regexp_replace(up, OFFICER_AFFIXES, ""))
    return F.when((F.coalesce(F.trim(c), F.lit("")) == "") | contains_any(up, no_officer) | (name == ""), UNKNOWN).otherwise(name)


def entity_key(c: Column) -> Column:
    """Key under which spellings of an entity meet: lower case, affixes removed as whole words, blanks collapsed."""
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(srl|spa|snc|sas|ditta|impresa|dott|ing|arch|geom|avv|di|del|della)\b", " "), r"\s+", " "))


def legal_urn(body: Column, organ: Column, kind: Column, day: Column, number: Column) -> Column:
    """urn:nir:body;organ:kind:date;number, null where date or number is missing."""
    date = F.date_format(F.coalesce(F.try_to_timestamp(day, F.lit("dd/MM/yyyy")), F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))), "yyyy-MM-dd")
    return F.when(date.isNotNull() & number.isNotNull(), F.concat(F.lit("urn:nir:"), body, F.lit(";"), organ, F.lit(":"), kind, F.lit(":"), date, F.lit(";"), number))
