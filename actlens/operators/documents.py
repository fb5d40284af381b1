"""The extraction record of a document in one projection: layout, the layout's parser, identifiers, amounts, confidence.

Every field is a column expression over the text; intermediate results are columns of their own, so that a text is searched once for each.
Amounts are whole cents. Patterns avoid lookaround, as elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.functions import text
from actlens.operators import extract

#: Legal forms, kinds of firms and titles that a party's clean name lacks (fixed values).
PARTY_AFFIXES = (
    r"\bS\.?R\.?L\.?S?\b", r"\bS\.?P\.?A\.?\b", r"\bS\.?N\.?C\.?\b", r"\bS\.?A\.?S\.?\b",
    r"\bS\.?C\.?A\.?R\.?L\.?\b", r"\bS\.?S\.?D\.?\b", r"\bO\.?N\.?L\.?U\.?S\b",
    r"\bSOCIET(?:A\b|[Àà])", r"\bDITTA\b", r"\bIMPRESA\b", r"\bCOOPERATIVA\b", r"\bCONSORTILE\b",
    r"\bSOCIALE\b", r"\bAZIENDA\b", r"\bGRUPPO\b",
    r"\bAVV\.?\b", r"\bING\.?\b", r"\bARCH\.?\b", r"\bDOTT\.?(?:SSA)?\b", r"\bGEOM\.?\b",
    r"\bRAG\.?\b", r"\bPROF\.?\b", r"\bDR\.?\b",
)
#: Where a party's fiscal data begin.
FISCAL = r"(?i)\b(?:P\.?\s*IVA|C\.?F\.?|CON\s+SEDE)\b"
GROUPED = r"(\d{1,3}(?:\.\d{3})*,\d{2})"
CREDITOR = r"(?i)Creditore Denominazione:\s*([^\n]+?)\s*-"
WINNER = r"(?i)(?:aggiudicatario|aggiudicazione all'operatore|affidatario)\s+([^.,;]+)"
FAVOURED = r"(?i)\b(?:liquidare a favore di|a favore di|all[’']|alla ditta|liquidare a(?:lla)?)\s+[“\"«]?([^\n,.;]+?)(?:\s+la somma|\s+l'importo|\s+per\b|\s+di\s*€|\s+di\s*euro|[,.;\n]|\z)"
ORDERS = r"(?i)\b(?:DETERMINA|ORDINA|DECIDE)\b"
#: Share of the layout's confidence that a parser's own result deserves (fixed values).
SHARES = {"ESITO_GARA": 0.85, "DELIBERAZIONE": 0.95, "BANDO_PURO": 0.95, "SCONOSCIUTO": 0.40}
FINANCIAL = ("VISTO_CONTABILE", "DETERMINAZIONE", "ESITO_GARA")
#: Cents below which and from which an amount is impossible, and above which it is flagged; confidence of a scan below which it is flagged (fixed values).
IMPOSSIBLE, HIGH, LOW_OCR = 100_000_000_000, 500_000_000, 0.60
#: Score of an extraction by the document's classification (fixed values).
CLASS_SCORES = {"high": 1.0, "high_ml": 0.9, "ml_predicted": 0.7, "ambiguous": 0.3, "<vuoto>": 0.1}


def party(c: Column) -> Column:
    """A party's name in capitals without fiscal data, legal forms, titles and punctuation; null if nothing is left."""
    bare = text.chain_delete(F.trim(F.element_at(F.split(c, FISCAL, 2), 1)), [f"(?i){p}" for p in PARTY_AFFIXES])
    return F.nullif(F.upper(text.collapse(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "))), F.lit(""))


def cents(number: Column) -> Column:
    """Cents of a number with grouping stops and two decimals."""
    return F.regexp_replace(number, "[.,]", "").try_cast("bigint")


def clauses(c: Column) -> Column:
    """Sentences of a disposition with their weight and place: array of (w, i, s)."""
    weight = lambda low: reduce(lambda a, b: a + b, [F.when(low.contains(n), w).otherwise(0) for w, needles in extract.CLAUSES for n in needles])
    return F.transform(F.split(c, r"\.\s|;|\n"), lambda s, i: F.struct(weight(F.lower(s)).alias("w"), i.alias("i"), s.alias("s")))


def parsed(documents: DataFrame, id_col: str, text_col: str, ocr_col: str) -> DataFrame:
    """(``id_col``, layout, payee_raw, payee, cents, enabled, confidence, scores, places, flags, action): what the parser of each document's layout reads.

    A visa names its creditor; a determination is read after its first order, in its three weightiest sentences; an award names the winner;
    deliberations and calls carry no payment; other layouts are only marked. A null text gives no layout; a null confidence of the scan counts as 1.
    """
    t, kind = F.col("_text"), F.col("layout")
    layout, sure = extract.layout(t)
    rows = documents.select(id_col, F.col(text_col).alias("_text"), F.coalesce(F.col(ocr_col), F.lit(1.0)).alias("_ocr"))
    rows = rows.withColumn("layout", F.when(t.isNotNull(), layout)).withColumn("_sure", sure)
    rows = rows.withColumn("_parts", F.split(t, ORDERS, 2)).withColumn("_order", F.coalesce(F.get("_parts", F.lit(1)), t))
    best = F.slice(F.array_sort(F.transform(F.filter(clauses(F.col("_order")), lambda c: c["w"] >= 3), lambda c: F.struct((-c["w"]).alias("w"), c["i"].alias("i"), c["s"].alias("s")))), 1, 3)
    rows = rows.withColumn("_top", F.when(kind == "DETERMINAZIONE", best))
    in_order = F.array_sort(F.transform("_top", lambda c: F.struct(c["i"].alias("i"), c["s"].alias("s"))))
    rows = rows.withColumn("_context", F.when(F.size("_top") > 0, F.array_join(F.transform(in_order, lambda c: c["s"]), " ")).otherwise(F.substring("_order", 1, 1000)))
    source = F.when(kind == "VISTO_CONTABILE", t).when(kind == "DETERMINAZIONE", F.col("_context"))
    raw = F.when(kind == "VISTO_CONTABILE", text.first_group(t, CREDITOR)).when(kind == "DETERMINAZIONE", text.first_group(F.col("_context"), FAVOURED)).when(kind == "ESITO_GARA", text.first_group(t, WINNER))
    rows = rows.withColumn("payee_raw", F.nullif(F.trim(raw), F.lit(""))).withColumn("_cents", cents(text.first_group(source, GROUPED)))
    possible = (F.col("_cents") > 0) & (F.col("_cents") < IMPOSSIBLE)
    rows = rows.withColumn("cents", F.when(possible, F.col("_cents")))
    has = F.col("cents").isNotNull()
    share = F.when(kind == "VISTO_CONTABILE", F.when(has, 0.95).otherwise(0.50)).when(kind == "DETERMINAZIONE", F.when(F.size("_top") > 0, 0.90).otherwise(0.40) - F.when(has, 0.0).otherwise(0.30))
    for name, value in SHARES.items():
        share = share.when(kind == name, value) if name == next(iter(SHARES)) else F.coalesce(share, F.when(kind == name, value))
    flags = F.array(
        F.when((kind == "DETERMINAZIONE") & (F.size("_parts") < 2), "NO_DISPOSITIVO"),
        F.when(kind.isin(*FINANCIAL) & F.col("payee_raw").isNull(), "BENEFICIARIO_ASSENTE"),
        F.when(F.col("_cents").isNotNull() & ~possible, "IMPORTO_INVALIDO"),
        F.when(F.col("cents") > HIGH, "HIGH_IMPORTO"),
        F.when((F.col("_ocr") < LOW_OCR) & (kind != "SCONOSCIUTO"), "LOW_OCR"),
        F.when(kind == "SCONOSCIUTO", "FALLBACK_LAYOUT"),
    )
    action = F.when(kind.isin("DELIBERAZIONE", "BANDO_PURO"), "financial_disabled").when(kind == "SCONOSCIUTO", "fallback_no_extract")
    return rows.select(
        id_col,
        "layout",
        "payee_raw",
        party(F.col("payee_raw")).alias("payee"),
        "cents",
        kind.isin(*FINANCIAL).alias("enabled"),
        F.round(F.col("_sure") * share * F.col("_ocr"), 6).alias("confidence"),
        F.array_join(F.transform("_top", lambda c: (-c["w"]).cast("string")), ",").alias("scores"),
        F.array_join(F.transform("_top", lambda c: c["i"].cast("string")), ",").alias("places"),
        F.when(kind.isNotNull(), F.concat_ws(" | ", flags)).alias("flags"),
        action.alias("action"),
    )


#: Ways in which acts write amounts, in order; the first group is the number (own wording of the required forms).
AMOUNT_FORMS = (
    r"€\s*(\d[\d.,]*)",
    r"(\d[\d.,]*)\s*(?:euro|€|eur)\b",
    r"(?i)\beuro\s+(\d[\d.,]*)",
    r"(?i)importo\s*(?:totale|complessivo|di\s+spesa|a\s+base\s+d'asta)\s*[:=]?\s*(\d[\d.,]*)",
    r"(?i)(?:impegno|liquidazione|accredito|pagamento)\s+(?:n\.?\s*\d+\s+)?(\d[\d.]*,\d{2})",
    r"(?i)iva\s+(?:inclusa|esclusa)\s*(\d[\d.,]*)",
)


def plain_cents(number: Column) -> Column:
    """Cents of a number as typed: stops group unless the last one stands before one or two final digits and no comma occurs."""
    n = F.regexp_replace(number, r"[.,]+\z", "")
    decimal = F.when(n.contains(","), F.regexp_replace(F.regexp_replace(n, r"\.", ""), ",", ".")).when(n.rlike(r"^\d+\.\d{1,2}\z"), n).otherwise(F.regexp_replace(n, r"\.", ""))
    return F.round(decimal.try_cast("decimal(24,4)") * 100, 0).try_cast("bigint")


def all_amounts(c: Column) -> Column:
    """Distinct amounts in cents, largest first, by any of ``AMOUNT_FORMS``, above 0 and below 100 million euros."""
    found = F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in AMOUNT_FORMS)))
    return F.sort_array(F.array_distinct(F.filter(F.transform(found, plain_cents), lambda v: (v > 0) & (v < 10_000_000_000))), asc=False)


#: Number with optional grouping and decimals, and the places of a document's first amount, in order (own wording of the required forms).
_NUMBER = r"(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)"
FIRST_FORMS = (rf"€\s*{_NUMBER}", rf"(?i){_NUMBER}\s*euro", rf"(?i)totale[\s:]*€?\s*{_NUMBER}", rf"(?i)importo[\s:]*€?\s*{_NUMBER}", rf"(?i)per\s+(?:un\s+)?importo\s+(?:complessivo\s+)?di\s+€?\s*{_NUMBER}", rf"(?i)si\s+(?:liquidano|impegnano|pagano)\s+€?\s*{_NUMBER}")
LABELLED_TOTAL = r"(?i)totale[\s:]*(?:€|euro)?\s*(\d{1,3}(?:\.\d{3})*,\d{2})"


def first_amount(c: Column) -> Column:
    """Cents of the first amount, by the first form that occurs; stops group, commas mark decimals."""
    n = F.coalesce(*(text.first_group(c, p) for p in FIRST_FORMS))
    return F.round(F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(24,4)") * 100, 0).try_cast("bigint")


def total_amount(c: Column) -> Column:
    """Cents of the labelled total, else the sum of the grouped amounts if there are several, else the only one."""
    listed = F.filter(F.transform(F.regexp_extract_all(c, F.lit(GROUPED), F.lit(1)), cents), lambda v: (v > 0) & (v < 5_000_000_000))
    return F.coalesce(cents(text.first_group(c, LABELLED_TOTAL)), F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0).cast("bigint"), lambda a, v: a + v)))


NUMBER_WITH_YEAR = r"(?i)n\.?\s*(\d+)\s*/\s*(\d{4})"
NUMBER_WITH_DATE = r"(?i)n\.?\s*(\d+)\s*del\s*\d{1,2}[/_.-]\d{1,2}[/_.-](\d{2,4})"
NUMBER_OF_KIND = r"(?i)(?:determinazione|delibera|ordinanza|avviso|bando)\s*n\.?\s*(\d+)"
NUMBER_ALONE = r"(?i)num\.?\s*(\d+)"


def document_number(c: Column, file_name: Column | None = None) -> Column:
    """number/year where the text gives both, else the number of a named kind; else from the file's name."""
    pair = lambda x, p: F.when(x.rlike(p), F.concat(F.regexp_extract(x, p, 1), F.lit("/"), F.regexp_extract(x, p, 2)))
    ways = [pair(c, NUMBER_WITH_YEAR), pair(c, NUMBER_WITH_DATE), text.first_group(c, NUMBER_OF_KIND), text.first_group(c, NUMBER_ALONE)]
    if file_name is not None:
        ways += [pair(file_name, r"(\d+)[/_-](\d{4})"), text.first_group(file_name, r"(?i)(?:determinazione|delibera|ordinanza)_(\d+)")]
    return F.coalesce(*ways)


def amounts_confidence(amounts: Column, length: Column, expects: Column) -> Column:
    """How plausible a document's amounts (cents) are: fine where none is expected, 0 without, low if unreasonable or crowded into a short text."""
    reasonable = F.exists(amounts, lambda v: (v >= 10_000) & (v <= 1_000_000_000))
    return F.when(~expects, 1.0).when(F.size(amounts) == 0, 0.0).when(~reasonable, 0.3).when((length < 500) & (F.size(amounts) > 3), 0.5).otherwise(1.0)


def overall_confidence(kind: Column, amounts: Column, classified: Column) -> Column:
    """0.4 of the type's, 0.3 of the amounts' and 0.3 of the classification's confidence."""
    score = F.lit(CLASS_SCORES["<vuoto>"])
    for name, value in CLASS_SCORES.items():
        score = F.when(classified == name, value).otherwise(score)
    return F.round(F.lit(0.4) * kind + F.lit(0.3) * amounts + F.lit(0.3) * score, 6)


ASSESSMENT = r"(?i)(?:accertamento\s+n\.|accertamento|N\.\s+Accertamento)\s*[:\s]*(\d+)"
SPENT_FROM = r"(?i)capitolo\s*[:\s]*(\d[\d.]*)"
PROGRAMME = r"(?i)\b((?:PEG|missione|programma)\b[^\n\r]*)"
ALL_DATES = r"\b(\d{2}/\d{2}/\d{4})\b"


def record(documents: DataFrame, id_col: str, text_col: str, ocr_col: str) -> DataFrame:
    """The full record of every document: what its parser reads, with codes, numbers, dates, amounts, type and relevance."""
    t = F.col(text_col)
    chapter = F.regexp_replace(text.first_group(t, SPENT_FROM), r"\.+\z", "")
    own = documents.where(t.isNotNull()).select(
        id_col,
        F.upper(text.first_group(t, extract.CIG)).alias("cig"),
        F.upper(text.first_group(t, extract.CUP)).alias("cup"),
        F.trim(text.first_group(t, extract.SUBJECT)).alias("subject"),
        document_number(t).alias("number"),
        F.array_distinct(F.regexp_extract_all(t, F.lit(ALL_DATES), F.lit(1))).alias("dates"),
        text.first_group(t, ASSESSMENT).alias("assessment"),
        # five digits are a postal code
        F.when(~chapter.rlike(r"^\d{5}\z"), chapter).alias("chapter"),
        F.trim(text.first_group(t, PROGRAMME)).alias("programme"),
        all_amounts(t).alias("amounts"),
        total_amount(t).alias("total"),
        extract.document_type(t).alias("kind"),
        F.length(t).alias("length"),
    )
    own = own.withColumn("kind_known", F.when(F.col("kind") == "unknown", 0.3).otherwise(1.0))
    own = own.withColumn("amounts_confidence", amounts_confidence(F.col("amounts"), F.col("length"), F.col("kind").isin("Determinazione", "Delibera", "VistoContabile")))
    return own.join(parsed(documents.where(t.isNotNull()), id_col, text_col, ocr_col), id_col)


def events(records: DataFrame, id_col: str) -> DataFrame:
    """Events of records: type, value and the parties that were identified, as one struct array."""
    actor = lambda name, kind: F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(kind).alias("actor_type")))
    return records.select(id_col, F.col("kind").alias("document_type"), "number", "subject", F.coalesce("cents", F.try_element_at("amounts", F.lit(1))).alias("value"), "cig", "cup", F.array_compact(F.array(actor(F.col("payee"), "BENEFICIARIO"))).alias("actors"))
