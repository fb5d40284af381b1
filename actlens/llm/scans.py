"""Repair of text from scanned pages.

Lines are freed of page furniture and laid end to end; the stream is decoded by one dynamic programme over a lattice of words. Its arcs keep a
token, correct misread characters, split a token into several words, join letters set apart, join up to ``MERGED`` fragments of a word and join
a word broken by a hyphen, each at a cost taken from word counts of the unscanned texts and, for names that no lexicon holds, from a letter
model; the cheapest path through the whole stream is the text. A second dynamic programme chooses the ends of paragraphs by punctuation,
capitals, blanks, line widths and the length of the open paragraph.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.lookup import SortedWords, word_counts
from actlens.session import cut_lineage, ship

#: Word counts are kept from this number of occurrences in unscanned texts.
LEAST_COUNT = 3
#: Words, and runs of letters in names, held in memory at most; beyond it they are searched in sorted files.
LEXICON_WORDS, NAME_GRAMS = 300_000, 60_000
#: What scanners read -> what was printed (fixed values).
MISREAD = (("0", "o"), ("1", "l"), ("1", "i"), ("2", "z"), ("5", "s"), ("6", "b"), ("9", "g"), ("@", "a"), ("|", "i"), ("|", "l"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("m", "rn"), ("c", "e"), ("f", "t"), ("l", "i"), ("i", "l"), ("ri", "n"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"))
#: Costs of the decoder: a misread sign, an unknown word, and splitting a token.
SIGN, UNKNOWN, SPLIT = 4.0, 20.0, 5.0
#: Costs of joining fragments, of letters that stay apart and of a hyphen that stays at the end of a line; fragments joined at most; and occurrences from which a word counts in splits and joins.
MERGE, APART, LEFT_HYPHEN, MERGED, FAMILIAR = 5.0, 12.0, 25.0, 3, 20
#: Letters beyond which a token is no word.
LONGEST = 60
#: Lines from which a paragraph is long.
LONG_PARAGRAPH = 12
#: Gain of the letter model (nats) from which a name counts as misread, and names from which the model is used.
NAME_GAIN, NAME_WORDS = 4.5, 300

#: Signs that end a line within a word (fixed values).
HYPHENS = "-\u2010\u00ad\u00ac"
_TOKEN = regex.compile(r"[\p{L}\p{N}@|]+(?:['’](?=\p{L}))?|[^\s\p{L}\p{N}@|]+")
_WORD = regex.compile(r"\p{L}+")
_APART = regex.compile(r"(?<![\p{L}\p{N}])\p{L}(?: \p{L}){2,}(?![\p{L}\p{N}'’.])")
_CODE = r"(?:\p{Lu}{1,2}-?\d{5,7}|\d{5,7}/\p{Lu})"
_STAMP = regex.compile(rf"^(?P<lead>.*?)(?P<stamp>\p{{Lu}}\p{{L}}+ {_CODE})(?:\s+(?:pag(?:ina)?\.?\s*)?(?:n\.\s*)?\d+(?:\s*(?:/|di)\s*\d+)?)?\s*$")
_LEAD = regex.compile(r"(?i)^\s*(?:comune di .{2,40}|città di .{2,40}|provincia di .{2,40}|unione .{2,40}|stampa|protocollo|fascicolo|.{2,60}\s[-–—/|]|.{0,60}fascicolo)\s*$")
_PAGE = regex.compile(r"(?i)^[\s\f]*(?:[-–—]\s*\d{1,4}\s*[-–—]|(?:pag(?:ina)?|page)\.?\s*(?:n\.?\s*)?\d{1,4}(?:\s*(?:/|di|of|su)\s*\d{1,4})?|\d{1,3}\s*/\s*\d{1,3})[\s\f]*$")
_NUMBER = regex.compile(r"^[\s\f]*(\d{1,3})[\s\f]*$")
_MIXED = regex.compile(r"^(?=.*\p{L})(?!.*\d\d)[\p{L}0-9@|]+$")
_LIGATURE = regex.compile("[ﬀ-ﬆ]")
_OPEN, _GOES_ON = regex.compile(r"[^;.:!?]\s*$"), regex.compile(r"[\p{Ll}\d(]")
_COMPOUND = regex.compile(r"(?<!\S)\p{L}{3,}-\p{Ll}{3,}(?=[\s;,.])")
_HEX = regex.compile(r"^[0-9a-f]{8,}$")


def lines_of(text: str) -> list[str]:
    return text.split("\n")


_PUT_BACK = str.maketrans("012569@|", "olzsbgai")


def _plain(line: str) -> str:
    """A line with letters set apart joined and digits inside words put back, for matching only."""
    line = _APART.sub(lambda m: m.group().replace(" ", ""), line.replace("\f", "").rstrip("\r"))
    return regex.sub(r"[\p{L}0-9@|]*\p{Ll}[\p{L}0-9@|]*", lambda m: m.group().translate(_PUT_BACK) if _MIXED.match(m.group()) else m.group(), line)


def _stamped(line: str) -> tuple[str, str] | None:
    """(what leads up to the stamp, stamp) of a line that ends with one."""
    m = _STAMP.match(_plain(line))
    return (m.group("lead"), m.group("stamp")) if m else None


def looks_scanned(lines: list[str]) -> bool:
    """Narrow lines of which several break within a sentence, or a page stamp."""
    full = [x for x in lines if x.strip()]
    widths = sorted(map(len, full))
    if not full or widths[int(len(widths) * 0.9)] >= 100:
        return False
    if any((m := _stamped(x)) and _LEAD.match(m[0]) for x in full):
        return True
    return len(full) >= 4 and sum(1 for a, b in zip(full, full[1:]) if _OPEN.search(a) and _GOES_ON.match(b)) >= 2


def furniture(lines: list[str]) -> dict[int, str]:
    """Index of each line that is a running header or footer, or a page number."""
    out: dict[int, str] = {}
    found = [_stamped(x) for x in lines]
    stamps = Counter(s[1] for s in found if s)
    for k, s in enumerate(found):
        if s and (_LEAD.match(s[0]) and not s[0].rstrip().endswith((",", ";")) or stamps[s[1]] > 1 and len(s[0]) < 60):
            out[k] = "HEADER"
    page, bare = 0, []
    full = [k for k, x in enumerate(lines) if x.strip()]
    for k in full:
        line = lines[k]
        if _PAGE.match(line):
            out[k] = "PAGENO"
            page += 1
        elif (m := _NUMBER.match(line)) and k not in out:
            at = full.index(k)
            edge = at == len(full) - 1 or "\f" in line or full[at + 1] in out or (at > 0 and full[at - 1] in out)
            if edge and abs(int(m.group(1)) - page - 1) <= 1:
                out[k] = "PAGENO"
                page += 1
            else:
                bare.append((k, int(m.group(1))))
    # numbers alone in their lines that count the pages one by one
    if bare and bare[0][1] <= 3 and all(b[1] == a[1] + 1 for a, b in zip(bare, bare[1:])):
        out |= dict.fromkeys((k for k, _ in bare), "PAGENO")
    return out


@dataclass
class Model:
    """Word counts of unscanned texts and letter statistics of names."""

    counts: dict | SortedWords = field(default_factory=dict)
    total: int = 1
    grams: dict | SortedWords = field(default_factory=dict)
    heads: dict | SortedWords = field(default_factory=dict)
    names: int = 0

    def cost(self, word: str) -> float:
        n = self.counts.get(word)
        return math.log(self.total / n) if n else math.inf

    def name_cost(self, word: str) -> float:
        s, out = f"^^{word}$", 0.0
        for i in range(len(s) - 2):
            out += math.log((self.heads.get(s[i : i + 2], 0) + 30) / (self.grams.get(s[i : i + 3], 0) + 0.1))
        return out


def corrections(word: str, most: int = 2) -> Iterator[tuple[str, int]]:
    """(word with signs put back, number of signs) for one and then two places."""
    places = [(i, seen, meant) for seen, meant in MISREAD for i in range(len(word)) if word.startswith(seen, i)]
    done = set()
    for i, seen, meant in places:
        fixed = word[:i] + meant + word[i + len(seen) :]
        if fixed not in done:
            done.add(fixed)
            yield fixed, 1
    if most > 1:
        for a, (i, seen, meant) in enumerate(places):
            for j, other, sense in places[a + 1 :]:
                lo, hi = ((i, seen, meant), (j, other, sense)) if i < j else ((j, other, sense), (i, seen, meant))
                if lo[0] + len(lo[1]) <= hi[0]:
                    fixed = word[: lo[0]] + lo[2] + word[lo[0] + len(lo[1]) : hi[0]] + hi[2] + word[hi[0] + len(hi[1]) :]
                    if fixed not in done:
                        done.add(fixed)
                        yield fixed, 2


def _like(word: str, fixed: str) -> str:
    if word.isupper() and len(word) > 1:
        return fixed.upper()
    return fixed[:1].upper() + fixed[1:] if word[:1].isupper() else fixed


def repair_token(token: str, model: Model, memo: dict) -> tuple[str, float, bool]:
    """(restored token, cost, whether it was damaged): the cheapest of keeping, correcting and splitting."""
    if token in memo:
        return memo[token]
    memo[token] = out = _repair(token, model)
    return out


def _repair(token: str, model: Model) -> tuple[str, float, bool]:
    if token[-1:] in "'’" and len(token) > 1:
        fixed, cost, damaged = _repair(token[:-1], model)
        return fixed + token[-1], cost, damaged
    low = token.lower()
    if not any(c.isalpha() for c in token) or _HEX.match(token):
        return token, 0.0, False
    if len(token) > LONGEST:
        return token, UNKNOWN, False
    letters = token.isalpha()
    if not letters and not _MIXED.match(token):
        return token, 0.0, False
    if letters and len(token) < 3 and model.counts.get(low, 0) == 0 and token.isupper():
        return token, 2.0, False
    known = model.cost(low)
    if _LIGATURE.search(token):
        return _like(token, unicodedata.normalize("NFKC", token)), SIGN, True
    if letters and known < 9.0:
        return token, known, False
    capital = token[:1].isupper()
    shout = token.isupper() and len(token) > 1
    if not letters and (shout or sum(c.isdigit() for c in token) > 2 or not any(c.islower() for c in token)):
        best = min(((model.cost(f) + SIGN * k, f) for f, k in corrections(low) if f in model.counts), default=(math.inf, ""))
        return (_like(token, best[1]), best[0], True) if best[0] < math.inf and (len(low) > 3 or "|" in low and len(low) > 1) and best[1].isalpha() else (token, 0.0, False)
    keep = min(known, UNKNOWN + (0 if letters else 12))
    best, word = keep, None
    for fixed, k in corrections(low):
        c = model.cost(fixed) + SIGN * k
        if c < best - 0.5 and model.counts.get(fixed, 0) > 500 * model.counts.get(low, 0) and (known == math.inf or len(low) > 3):
            best, word = c, fixed
    if word is None and letters and len(low) >= 6:
        c, parts = _split(low, model)
        if c < best and (not capital or len(parts) == 2 and len(parts[0]) > 3 and known == math.inf and low not in model.counts and model.counts[parts[0]] > 50 * FAMILIAR):
            best, word = c, " ".join(parts)
    if word is not None:
        return _like(token, word), best, True
    if (capital or not letters) and len(low) >= 4:
        if not letters:
            plain = [f for f, k in corrections(low) if f.isalpha()]
            if plain:
                return _like(token, min(plain, key=model.name_cost)), UNKNOWN + SIGN, True
            return token, UNKNOWN, False
        if model.names >= NAME_WORDS and known == math.inf:
            own = model.name_cost(low)
            gain, fixed = max(((own - model.name_cost(f) - (k - 1) * 3, f) for f, k in corrections(low, 1)), default=(0.0, ""))
            if gain > NAME_GAIN:
                return _like(token, fixed), UNKNOWN + SIGN, True
    elif not letters and len(low) >= 2 and any(c.islower() for c in token):
        plain = [f for f, _ in corrections(low) if f in model.counts]
        if plain:
            return _like(token, min(plain, key=model.cost)), UNKNOWN, True
    return token, keep, False


def _split(low: str, model: Model) -> tuple[float, list[str]]:
    """The cheapest way to write ``low`` as two familiar words or more, by dynamic programming; the last has three letters at least."""
    n = len(low)
    best: list[tuple[float, list[str]]] = [(0.0, [])] + [(math.inf, [])] * n
    for end in range(1, n + 1):
        for begin in range(max(0, end - 24), end):
            before, parts = best[begin]
            if before == math.inf or end == n and (begin == 0 or n - begin < 3):
                continue
            word = low[begin:end]
            if model.counts.get(word, 0) >= FAMILIAR and (len(word) > 2 or word in _SHORT):
                c = before + model.cost(word) + (SPLIT if begin else -6)
                if c < best[end][0]:
                    best[end] = (c, [*parts, word])
    return best[n]


_SHORT = frozenset("a e i o ad al da di del dei in il la le lo un su con per non che".split())


def _broken(left: str, right: str, model: Model, memo: dict) -> tuple[bool, str]:
    """Whether ``left-`` at the end of a line goes on in ``right``, and the word that results."""
    joined, kept = (left + right).lower(), f"{left}-{right}".lower()
    whole, compound = model.counts.get(joined, 0), model.counts.get(kept, 0)
    if compound > whole:
        return False, f"{left}-{right}"
    if not whole:
        if any(f in model.counts for f, _ in corrections(kept)):
            return False, f"{left}-{right}"
        return True, repair_token(left + right, model, memo)[0]
    return True, left + right


@dataclass
class Repaired:
    damage: list
    paragraphs: list


def repair(text: str, model: Model, memo: dict, *, with_text: bool = True) -> Repaired:
    """Damage of a scanned text as (line from 1, kind), and its continuous paragraphs."""
    lines = lines_of(text)
    skip = furniture(lines)
    damage = [(k + 1, kind) for k, kind in skip.items()]
    body = [k for k in range(len(lines)) if k not in skip]
    stream: list[tuple[int, str, str]] = []  # line, token, gap before it
    for k in body:
        line, at = lines[k].replace("\f", "").rstrip("\r"), 0
        for m in _APART.finditer(line):
            stream += [(k, t.group(), line[at : m.start()][t.start() - 1 : t.start()]) for t in _TOKEN.finditer(line[at : m.start()])]
            stream.append((k, m.group(), " "))
            at = m.end()
        rest = line[at:]
        stream += [(k, t.group(), rest[t.start() - 1 : t.start()] if t.start() else (" " if at == 0 else "")) for t in _TOKEN.finditer(rest)]
    last_of = {k: i for i, (k, _, _) in enumerate(stream)}
    address = {k for k in body if "@" in lines[k] and regex.search(r"[\p{L}\p{N}]@[\p{L}\p{N}-]+\.\p{L}|@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+", lines[k])}
    out: list[tuple[int, str, str]] = []
    bad: set[int] = set()
    for k, word, gap, hyphen, touched in _decode(stream, lines, last_of, address, model, memo):
        out.append((k, word, "\n" if not out or out[-1][0] != k else gap))
        bad.update(touched)
        if hyphen:
            damage.append((k + 1, "HYPHEN"))
    damage += [(k + 1, "CHAR") for k in sorted(bad)]
    return Repaired(sorted(set(damage)), _paragraphs(lines, out, skip) if with_text else [])


def _decode(stream: list, lines: list[str], last_of: dict, address: set[int], model: Model, memo: dict) -> list[tuple]:
    """The cheapest path through the lattice: (line, word, gap before it, whether it was broken by a hyphen, lines with misread signs) for each word."""
    n = len(stream)
    cost, back = [0.0] + [math.inf] * n, [(0, None)] * (n + 1)

    def arc(begin: int, end: int, more: float, *word) -> None:
        if cost[begin] + more < cost[end]:
            cost[end], back[end] = cost[begin] + more, (begin, word)

    for i, (k, token, gap) in enumerate(stream):
        apart = token.replace(" ", "") if " " in token else None
        if apart:
            fixed, _, damaged = repair_token(apart, model, memo)
            if damaged or len(apart) > 3 or model.counts.get(apart.lower(), 0):
                arc(i, i + 1, 0.0, k, fixed if damaged else apart, gap, False, (k,))
            word, more, damaged = token, APART * len(apart), False
        elif k in address and _in_address(lines[k], token):
            word, more, damaged = token, 0.0, False
        elif token == "@":
            word, more, damaged = "a", 0.0, True  # the letter between full stops of an abbreviation
        elif token in HYPHENS and last_of[k] == i and gap and gap.isalpha():
            word, more, damaged = token, LEFT_HYPHEN, False
        else:
            word, more, damaged = repair_token(token, model, memo)
        arc(i, i + 1, more, k, word, gap, False, (k,) if damaged else ())
        # a word broken by a hyphen at the end of its line
        if i + 2 < n and stream[i + 1][1] in HYPHENS and stream[i + 1][0] == k and last_of[k] == i + 1 and stream[i + 1][2] == token[-1:] and token[-1:].isalpha() and stream[i + 2][1][:1].isalpha():
            line2, right, _ = stream[i + 2]
            left, right, touched = apart or token, right.replace(" ", ""), [k] * (" " in token) + [line2] * (" " in right)
            joins, word = _broken(left, right, model, memo)
            if joins and word.lower() != (left + right).lower():
                changed = next((j for j, (a, b) in enumerate(zip((left + right).lower(), word.lower())) if a != b), 0)
                touched.append(k if changed < len(left) else line2)
            arc(i, i + 3, 0.0, k, word, gap, joins, tuple(touched))
        # fragments of one word, of which one at least is no word
        elif more >= UNKNOWN - 2 or i + 1 < n and stream[i + 1][1].islower() and stream[i + 1][1] not in model.counts:
            whole, strange = token, token.lower() not in model.counts
            for j in range(i + 1, min(i + MERGED, n)):
                line2, part, between = stream[j]
                if between != " " or not part.isalpha() or not part.islower() or not whole.isalpha() or line2 != k:
                    break
                whole, strange = whole + part, strange or part not in model.counts
                if strange and len(whole) > 4 and model.counts.get(whole.lower(), 0) >= FAMILIAR:
                    arc(i, j + 1, model.cost(whole.lower()) + MERGE, k, whole, gap, False, (k,))
    path = []
    while n:
        n, word = back[n]
        path.append(word)
    return path[::-1]


def _in_address(line: str, token: str) -> bool:
    return any(token in m.group() for m in regex.finditer(r"\S*@\S*", line))


def _paragraphs(lines: list[str], out: list[tuple[int, str, str]], skip: dict[int, str]) -> list[str]:
    """Paragraphs by dynamic programming: each gap between lines either continues or ends one, at costs from blanks, punctuation, capitals and how
    many lines the open paragraph has: fragments of one line that end within a sentence are rare, and so are very long ones."""
    by_line: dict[int, list[str]] = {}
    for k, word, gap in out:
        by_line.setdefault(k, []).append(word if gap in ("\n", "") else gap + word if gap.isspace() else word)
    order = list(by_line)
    texts = ["".join(by_line[k]) for k in order]
    width = max(map(len, texts), default=1)
    # state: lines of the open paragraph, up to LONG_PARAGRAPH; cost of ending it or going on after each line
    best = {1: (0.0, ())}
    for a in range(len(texts) - 1):
        blank = any(not lines[k].strip() for k in range(order[a] + 1, order[a + 1]) if k not in skip)
        paged = any(k in skip for k in range(order[a] + 1, order[a + 1]))
        ends, starts = texts[a].rstrip()[-1:] in ";.:!?", texts[a + 1][:1].isupper() or texts[a + 1].startswith(("di ", "- "))
        end = (0.0 if ends else 3.0) + (0.0 if starts else 4.0) - (2.0 if blank and not paged else 0.0)
        go = (2.5 if ends and starts else 0.0) + (2.0 if blank and not paged else 0.0) + (1.5 if starts and len(texts[a]) < 0.6 * width else 0.0)
        new: dict[int, tuple[float, tuple]] = {}
        for state, (cost, cuts) in best.items():
            fragment = 1.5 if state == 1 and not ends and not blank else 0.0
            endless = 1.0 if state == LONG_PARAGRAPH and starts else 0.0
            for nxt, extra, cut in ((1, end + fragment, (a,)), (min(state + 1, LONG_PARAGRAPH), go + endless, ())):
                c = (cost + extra, (cuts, cut[0]) if cut else cuts)
                if nxt not in new or c[0] < new[nxt][0]:
                    new[nxt] = c
        best = new
    chain, cuts = min(best.values(), key=lambda x: x[0], default=(0.0, ()))[1], set()
    while chain:
        chain, cut = chain
        cuts.add(cut)
    paragraphs, open_ = [], []
    for a, t in enumerate(texts):
        open_.append(t.strip())
        if a in cuts or a == len(texts) - 1:
            paragraphs.append(" ".join(open_))
            open_ = []
    return paragraphs


# --- corpus statistics and the operators --------------------------------------------------------------------------------------------------


def learn_model(texts: DataFrame) -> Model:
    """Word counts and letter statistics from all unscanned texts of ``texts`` (one string column). Words below the count never reach the driver; all
    others count, in sorted files where they are too many for memory."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = lines_of(text)
                if looks_scanned(lines):
                    _compounds(words, text)
                    continue
                words.update(_WORD.findall(text))
                _compounds(words, text)
            if len(words) > 200_000:
                yield _counted(words)
                words = Counter()
        yield _counted(words)

    found = cut_lineage(texts.where(F.col(texts.columns[0]).isNotNull()).mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    low = found.groupBy(F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    low = cut_lineage(low.where(F.col("n") >= LEAST_COUNT))
    shaped = found.where(F.col("w").rlike(r"^\p{Lu}\p{Ll}{3,}$")).select(F.lower("w").alias("w")).distinct().join(low.where(F.col("n") >= 30).select("w"), "w", "left_anti")
    grams = shaped.select(F.explode(F.expr("transform(sequence(1, length(w) + 1), i -> substring(concat('^^', w, '$'), i, 3))")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    grams = cut_lineage(grams)
    heads = cut_lineage(grams.groupBy(F.substring("g", 1, 2).alias("h")).agg(F.sum("n").alias("n")))
    found_heads = word_counts(heads, NAME_GRAMS)
    return Model(word_counts(low, LEXICON_WORDS), max(total, 1), word_counts(grams, NAME_GRAMS), found_heads, found_heads.get("^^", 0))


def _compounds(words: Counter, text: str) -> None:
    """Counts compounds that keep their hyphen, and their parts."""
    for w in _COMPOUND.findall(text):
        words[w.lower()] += 1
        words.update(w.lower().split("-"))


def _counted(words: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["w", "n"])


def _repairs(df: DataFrame, id_col: str, text_col: str, schema: str, rows_of) -> DataFrame:
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    kind = rows.schema["_id"].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(learn_model(rows.select("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            if len(memo) > 500_000:
                memo = {}
            out = [(k, *r) for k, text in enumerate(batch.column("_text").to_pylist()) for r in rows_of(text, held.value, memo)]
            at, a, b = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.string())], names=["_id", *(c.split()[0] for c in schema.split(", "))])

    return rows.mapInArrow(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)


def find_damage(df: DataFrame, id_col: str = "event_id", text_col: str = "raw_text") -> DataFrame:
    """(``id_col``, ``line_no`` bigint, ``kind``): HYPHEN, HEADER, PAGENO and CHAR damage of scanned texts; lines are split at ``\\n`` and numbered from 1.

    Null, empty and blank texts and texts that don't look scanned have none. Repeated rows repeat their damage; an empty table gives no rows.
    """

    def rows_of(text: str, model: Model, memo: dict) -> list:
        return repair(text, model, memo, with_text=False).damage if looks_scanned(lines_of(text)) else []

    return _repairs(df, id_col, text_col, "line_no bigint, kind string", rows_of)


def repaired_paragraphs(df: DataFrame, id_col: str = "event_id", text_col: str = "raw_text") -> DataFrame:
    """(``id_col``, ``paragraph_no`` bigint from 1, ``paragraph``): continuous paragraphs without page furniture.

    A text that doesn't look scanned gives its non-blank lines as they are; null and blank texts give none.
    """

    def rows_of(text: str, model: Model, memo: dict) -> list:
        lines = lines_of(text)
        parts = repair(text, model, memo).paragraphs if looks_scanned(lines) else [x.strip() for x in lines if x.strip()]
        return list(enumerate(parts, 1))

    return _repairs(df, id_col, text_col, "paragraph_no bigint, paragraph string", rows_of)
