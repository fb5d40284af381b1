"""Template residue, filler and error pages by positive-unlabelled naive Bayes.

Two kinds of passages are scored: field-like spans (anything that is delimited, masked or worded as a place to fill in, with its context) and
lines. For each kind a naive Bayes model is fitted by expectation-maximisation: trusted residue is positive throughout, trusted
content negative, and every other sampled passage starts as unlabelled and gets its class re-estimated until the classes settle. The
models are fitted on a bounded sample; all documents are scored whole, and the passages' decisions are put together per record.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.session import cut_lineage, ship, stored

#: The fitting sample: documents looked at (about so many, with the least hashes), those taken of each kind, their passages that reach the driver, and features of a passage.
SCAN_DOCS, SAMPLE_DOCS, SAMPLE_PASSAGES, PASSAGE_FEATURES = 15_000, 1_500, 40_000, 200
EM_ROUNDS = 12
#: Chance of being residue, after the first round, below which an unlabelled line is reliable content.
RELIABLE = 0.01
#: Words that the record's feature counts for in each of its lines.
RECORD_WEIGHT = 4
#: First guess for unlabelled passages: field-like spans are rare in acts and mostly residue, lines are nearly always content.
FIELD_START, LINE_START = 0.7, 0.01
#: Log-odds of a field span and of a line from which it is residue.
FIELD_ODDS, LINE_ODDS = 0.0, 0.0
#: A record without a field left open is excluded if its residue lines outweigh its content lines by this factor, in words.
OUTWEIGH = 1.0

#: Phrases that nobody writes into an act: seeds of the line model (fixed values).
TRUSTED_LINES = regex.compile(
    r"(?i)lorem ipsum|\b(?:404|403|500|502|503)\b[^\n]{0,12}(?:not found|error|gateway|forbidden|internal|unavailable|non esiste|non trovat)|page not found|internal server error|bad gateway"
    r"|(?:abilitare|attiva\w*|enable|turn on|aktivieren|activer|required?)[^\n]{0,25}(?:javascript|script)|(?:javascript|script)\w*[^\n]{0,25}(?:required|enable|disabilitat|disattivat)"
    r"|traceback \(most recent|fatal error|stack trace|accesso negato|session\w* (?:scaduta|expired)|temporaneamente non disponibile|not a robot|non essere un robot"
)
#: Marks that only templates use: seeds of the field model (fixed values).
TRUSTED_FIELDS = regex.compile(r"\{\{|\$\{|\{%|<%|%%\w+%%|\[\[|@@\w+@@|(?i:\b(?:inserire|da completare|tbd|todo)\b)|\bXX/XX/XXXX\b|\[object ")
#: The same for whole texts, as the JVM reads them (fixed values).
TRUSTED_TEXTS = r"\{\{|\$\{|\{%|<%|%%\w+%%|\[\[|@@\w+@@|(?i)\b(?:inserire|da completare|tbd)\b|\bXX/XX/XXXX\b"
#: Delimited or blank spans that are content: omissions, addresses spelled out, blanks of a form (fixed values).
TRUSTED_CONTENT = regex.compile(r"(?i)^\[(?:omissis|at|chiocciola|dot|punto|sic|\.{3}|…)\]$|^[_.…]{3,}$")

FIELD = regex.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{0,80}%\}|<%[^<>\n]{0,80}%>|\$\{[^{}\n]{0,60}\}|\[\[[^\[\]\n]{0,60}\]\]|<<[^<>\n]{0,60}>>|\{[^{}\n]{0,60}\}|\[[^\[\]\n]{1,60}\]"
    r"|<[\p{L}_][\p{L}\p{N}_ .:-]{0,60}>|%%[\p{L}\p{N}_]{1,60}%%|(?<!\S)%[\p{L}](?![\p{L}\p{N}])|#[\p{L}\p{N}_/]{1,40}[#!?]|\$[\p{L}_][\p{L}\p{N}_]{0,60}\$|@@[\p{L}\p{N}_]{1,60}@@"
    r"|(?<![\p{L}\p{N}_])__[\p{L}\p{N}][\p{L}\p{N}_]{0,40}__(?![\p{L}\p{N}_])|\((?i:\p{L}{2,12}(?:are|ere|ire)\b)[^()\n]{0,60}\)|(?<![\p{L}\p{N}])X{2,}(?:[/.:-]X{2,})*(?![\p{L}\p{N}])|[_…]{3,}|\.{5,}"
    r"|(?<![\p{L}\p{N}])(?i:inserire|inserisci|indicare|completare|compilare|scrivere|specificare|sostituire|insert|einfügen|insérer)(?:\s+(?i:qui|here|hier|ici|il|la|lo|testo))+(?:\s+\p{L}+)?"
)
#: What a text must hold for any alternative of FIELD to match; spares the others the long pattern.
_TRIGGER = re.compile(r"[{\[<#$…]|__|%[^\W\d_]|%%|@@|XX|\.{5}|\([^\W\d_]{2,12}[aei]re\b|\b(?:[Ii]nser|INSER|[Ii]ndicare|INDICARE|[Cc]omp(?:let|il)are|COMP(?:LET|IL)ARE|[Ss]crivere|SCRIVERE|[Ss]pecificare|SPECIFICARE|[Ss]ostituire|SOSTITUIRE|[Ee]inf|EINF|[Ii]nsér|INSÉR)")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = regex.compile(r"[\p{L}\p{N}_]+")
_SPLIT = regex.compile(r"[\r\n]+|\s[|]\s")
_MASK = regex.compile(r"^X[X/.:-]*$")
_ROMAN = regex.compile(r"^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$")


def _shape(s: str) -> str:
    return regex.sub(r"\p{N}", "9", regex.sub(r"\p{Ll}+", "a", regex.sub(r"\p{Lu}+", "A", s)))


def field_spans(text: str) -> list[tuple[str, str, str]]:
    """(span, word before, word after) of everything that looks like a place to fill in."""
    out: list[tuple[str, str, str]] = []
    if not _TRIGGER.search(text):
        return out
    for line in text.split("\n"):
        if _TRIGGER.search(line):
            out += _spans_of(line)
    return out


def _spans_of(text: str) -> list[tuple[str, str, str]]:
    out = []
    for m in FIELD.finditer(text):
        before = _WORD.findall(text[max(0, m.start() - 30) : m.start()])
        after = _WORD.findall(text[m.end() : m.end() + 30])
        out.append((m.group(), before[-1].lower() if before else "^", after[0].lower() if after else "$"))
    return out


def field_features(span: str, before: str, after: str) -> list[str]:
    inner = span.strip("{}[]<>%$#@_()!?= -~")
    if _MASK.match(inner):
        roman = bool(_ROMAN.match(inner))
        return [f"{'roman' if roman else 'mask'}", f"{'roman' if roman else 'mask'}:{'of' if before in _NUMBERED else 'free'}"]
    marks = regex.sub(r"[\p{L}\p{N}\s]+", "~", span)
    return [f"m:{marks}|{_shape(inner)[:12]}", *(f"w:{w.lower()}" for w in _WORD.findall(inner)[:6])]


def record_feature(text: str) -> str:
    """How much of a record there is to judge by: its length, and whether it speaks like an act."""
    return ("<act>" if _looks_like_act(text) else "<other>") + str(min(len(text) // 120, 6))


def line_features(line: str, record: str) -> tuple[list[str], int]:
    """Features of a line and its number of words; a word counts once a line."""
    words = _LETTERS.findall(line.lower())
    distinct = dict.fromkeys(words)
    out = [record] * RECORD_WEIGHT + list(distinct)
    if len(words) >= 6 and len(distinct) <= 0.55 * len(words):
        out += ["<repeats>"] * (len(words) // 3)
    return out, len(words)


def lines_of(text: str) -> list[str]:
    return [x.strip() for x in _SPLIT.split(text) if x.strip()]


class _Odds(dict):
    unseen = 0.0

    def __missing__(self, feature: str) -> float:
        return self.unseen


class Bayes:
    """Multinomial naive Bayes with soft labels."""

    def __init__(self, odds: dict[str, float], prior: float, unseen: float):
        self.odds, self.prior = _Odds(odds), prior
        self.odds.unseen = unseen

    def score(self, features: list[str]) -> float:
        return self.prior + sum(map(self.odds.__getitem__, features))


def fit(counted: dict[tuple[tuple[str, ...], int], int], rounds: int = EM_ROUNDS, *, start: float, unseen: float, balanced: bool = False) -> Bayes:
    """``counted``: how often each passage was seen, as (features, 1 trusted residue / -1 trusted content / 0 unlabelled). Repeated passages count by the root of their number.

    ``balanced`` gives both classes the same mass and keeps the first guess as the prior, for passages of few features of which the trusted ones
    may be many or few.
    """
    rows, labels = [p for p, _ in counted], np.array([y for _, y in counted])
    weight = np.sqrt(np.array([counted[k] for k in counted], float))
    names: dict[str, int] = {}
    flat, owner = [], []
    for k, feats in enumerate(rows):
        for f in feats:
            flat.append(names.setdefault(f, len(names)))
            owner.append(k)
    flat_a, owner_a = np.array(flat, np.int64), np.array(owner, np.int64)
    size = max(len(names), 1)
    p = np.where(labels > 0, 1.0, np.where(labels < 0, 0.0, start))
    log_odds, prior, settled = np.zeros(size), 0.0, False
    for _ in range(rounds):
        pos = np.bincount(flat_a, (p * weight)[owner_a], size) if len(flat) else np.zeros(size)
        neg = np.bincount(flat_a, ((1 - p) * weight)[owner_a], size) if len(flat) else np.zeros(size)
        in_pos, in_neg = (1.0, 1.0) if balanced else (pos.sum() + 0.1 * size, neg.sum() + 0.1 * size)
        log_odds = np.log((pos + 0.1) / in_pos) - np.log((neg + 0.1) / in_neg)
        prior = math.log(start / (1 - start)) if balanced else math.log(((p * weight).sum() + 1) / (((1 - p) * weight).sum() + 1))
        z = prior + np.bincount(owner_a, log_odds[flat_a], len(rows)) if len(flat) else np.zeros(len(rows))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if not balanced and not settled:
            # what doesn't resemble the trusted residue at all is content from here on, so that rare kinds of content (other languages) don't drift
            labels, settled = np.where((labels == 0) & (new < RELIABLE), -1, labels), True
        p = np.where(labels > 0, 1.0, np.where(labels < 0, 0.0, new))
    return Bayes({n: float(log_odds[i]) for n, i in names.items()}, prior, unseen)


#: Words that a Roman number follows (fixed values).
_NUMBERED = ("capo", "titolo", "sezione", "parte", "libro", "allegato", "comma", "art", "articolo", "secolo")


def _label_field(span: str, before: str) -> int:
    if TRUSTED_CONTENT.search(span) or (span.strip("X") == "" and _ROMAN.match(span) and before in _NUMBERED):
        return -1
    return 1 if TRUSTED_FIELDS.search(span) else 0


def fit_models(docs: DataFrame, text_col: str, *, sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> tuple[Bayes, Bayes]:
    """The field and the line model from about ``sample_docs`` documents of trusted residue and as many others, by hash of their texts.

    Executors turn the sampled documents into passages and count equal ones; at most ``sample_passages`` of each kind, by hash, reach the driver, none
    of more than ``PASSAGE_FEATURES`` features. Only the fit rests on a sample of bounded size; the documents themselves are all scored.
    """
    steps = 1 << 20
    looked = int(min(1.0, SCAN_DOCS / max(docs.count(), 1)) * steps)
    rows = docs.select(F.col(text_col).cast("string").alias("_text")).where(F.length(F.trim("_text")) > 0)
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("_text"), F.lit(steps))).where(F.col("_h") < looked)
    trusted = F.col("_text").rlike(TRUSTED_LINES.pattern) | F.col("_text").rlike(TRUSTED_TEXTS)
    rows = stored(rows.withColumn("_trusted", trusted))  # about ``SCAN_DOCS`` texts, read twice
    known = {r["_trusted"]: r["count"] for r in rows.groupBy("_trusted").count().collect()}
    share = {k: int(min(1.0, sample_docs / max(known.get(k, 0), 1)) * looked) for k in (True, False)}
    picked = rows.where(F.col("_h") < F.when(F.col("_trusted"), share[True]).otherwise(share[False])).select("_text")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("_text").to_pylist():
                out += [(True, field_features(*s), _label_field(s[0], s[1])) for s in field_spans(t)]
                record = record_feature(t)
                for x in lines_of(t):
                    out.append((False, line_features(x, record)[0], _label_line(x, record)))
            out = [o for o in out if len(o[1]) <= PASSAGE_FEATURES]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.list_(pa.string())), pa.array([o[2] for o in out], pa.int32())], names=["field", "features", "label"])

    counted = picked.mapInArrow(passages, "field boolean, features array<string>, label int").groupBy("field", "features", "label").agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(counted.withColumn("_h", F.xxhash64("features", "label")))
    seen = [{(tuple(r["features"]), r["label"]): r["n"] for r in counted.where(c).orderBy("_h").limit(sample_passages).collect()} for c in (F.col("field"), ~F.col("field"))]
    return fit(seen[0], start=FIELD_START, unseen=0.0, balanced=True), fit(seen[1], start=LINE_START, unseen=-0.5)


def _label_line(line: str, record: str) -> int:
    """Trusted residue is what holds a trusted phrase outside acts; every other line is unlabelled."""
    return 1 if TRUSTED_LINES.search(line) and not record.startswith("<act>") else 0


#: What every act has: a heading with number and date, a subject, or a clause that disposes (fixed values).
_ACT = regex.compile(
    r"(?im)^\W*(?:oggetto|betreff|objet|subject)\b|\bn\.?\s*\d+[ /]+(?:del\s+)?\d|\b(?:determina|delibera|ordina|dispone|dato atto|premesso|considerato|visto|vista|richiamat[oa]|liquidare|impegnare)\b"
    r"|\b(?:euro|€)\s*\d|\d[\d.,]*\s*(?:euro|€)|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b"
)


def _looks_like_act(text: str) -> bool:
    return len(list(islice(_ACT.finditer(text), 2))) == 2


def decide(text: str, fields: Bayes, lines: Bayes) -> tuple[float, float, float]:
    """Best field log-odds (-inf without one), words of residue lines, words of content lines."""
    best = max((fields.score(field_features(*s)) for s in field_spans(text)), default=-math.inf)
    bad = good = 0.0
    record = record_feature(text)
    for line in lines_of(text):
        feats, n = line_features(line, record)
        z = lines.score(feats)
        if z > LINE_ODDS:
            bad += n
        else:
            good += n
    return best, bad, good


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(``id_col``, ``field_odds``, ``residue_words``, ``content_words``, ``excluded`` boolean) of every document.

    Excluded are documents with a field left open, and those whose residue lines (filler, error and portal messages) outweigh their content
    lines. Null, empty and blank texts hold neither and aren't excluded. Blanks of a form and ``[omissis]`` are content. Rows that repeat come out
    as often; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    fields, lines = fit_models(docs, text_col, sample_docs=sample_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((fields, lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_model, line_model = held.value
        for batch in batches:
            out = [decide(t, field_model, line_model) if t else (-math.inf, 0.0, 0.0) for t in batch.column("_text").to_pylist()]
            best, bad, good = (np.array([o[k] for o in out], float) for k in range(3))
            excluded = (best > FIELD_ODDS) | ((bad > 0) & (bad > OUTWEIGH * good))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(best), pa.array(bad), pa.array(good), pa.array(excluded)], names=["_id", "field_odds", "residue_words", "content_words", "excluded"])

    return rows.mapInArrow(run, f"_id {kind}, field_odds double, residue_words double, content_words double, excluded boolean").withColumnRenamed("_id", id_col)


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``find_residue`` doesn't exclude, with all their columns; a row without an id stays."""
    gone = find_residue(docs, id_col, text_col).where("excluded").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
