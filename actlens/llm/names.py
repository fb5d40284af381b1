"""Variant spellings of names by a noisy channel.

Every distinct string is a typed observation. Frequent and complete spellings are candidate canonical forms; a variant is attached to the
candidate with the largest posterior: the logarithm of the candidate's frequency plus the log-likelihood of typing the variant when the
candidate is meant (typos, initials, short names, added or lost names, abbreviated or lost trades, legal forms). How likely each of these
operations is, is estimated from the corpus by expectation-maximisation: attachments under the present likelihoods, weighted by their
posteriors, give the operations' counts, and these the next likelihoods. What may be a variant at all is decided by the first guess, so the
estimate moves attachments and loses none. Candidates come from deletion neighbourhoods of the rare words, so nothing is compared pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.llm.lookup import SortedWords
from actlens.llm.persons import COMMON_GIVEN, COMMON_TRADES, NICKNAMES, SENTINELS, Lexicon, Parts, fold, nickname, parse, typo
from actlens.session import cut_lineage, ship

#: Different partners (by their first three letters) from which a word of person names is a given name, and names from which a word of firms is a trade.
GIVEN_PARTNERS, TRADE_PARTNERS = 8, 8
#: Operations of the channel and the first guess of their negative log-likelihoods.
INITIAL, NICK, TYPO, EXTRA, NO_FORM, NO_TRADE, SHORT_TRADE, BROTHERS = range(8)
FIRST_COSTS = (2.0, 2.5, 3.5, 3.0, 1.5, 2.5, 0.7, 2.5)
#: Cost by the first guess beyond which a string is no variant of another.
MOST = 8.0
#: Rounds of expectation-maximisation, and variants that the first guess counts for.
EM_ROUNDS, GUESS_WEIGHT = 3, 100
#: Letters from which a word may hold a typo.
TYPO_LETTERS = 4
#: Spellings of one block up to which all of them are compared; a larger block is split by what else the names hold.
BLOCK_SPELLINGS = 300
#: Given names and trades held in memory at most; beyond it they are searched in sorted files.
LEXICON_ROWS = 50_000

_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_FIRM = regex.compile(r"(?i)\b(?:s\.?\s?r\.?\s?l|s\.?\s?p\.?\s?a|s\.?\s?n\.?\s?c|s\.?\s?a\.?\s?s|o\.?n\.?l\.?u\.?s|soc(?:iet[aà])?|coop\p{L}*|ditta|impresa|fratelli|f\.?lli|flli)\b")


NEVER: tuple[float, int] = (math.inf, 0)


def _did(op: int, times: int = 1) -> tuple[float, int]:
    """Cost by the first guess and the operations, counted in a byte each."""
    return FIRST_COSTS[op] * times, times << 8 * op


def operations(code: int) -> list[int]:
    return [code >> 8 * k & 255 for k in range(len(FIRST_COSTS))]


def _word_cost(a: str, b: str, lexicon: Lexicon) -> tuple[float, int]:
    """Cost and operations of typing ``a`` for ``b``; infinite if one doesn't stand for the other."""
    if a == b:
        return 0.0, 0
    if len(a) == 1 or len(b) == 1:
        return _did(INITIAL) if a[0] == b[0] else NEVER
    known_a, known_b = a in lexicon.given, b in lexicon.given
    if known_a and known_b:
        return _did(NICK) if nickname(a, b) or nickname(b, a) else NEVER
    if known_b and nickname(a, b) or known_a and nickname(b, a):
        return _did(NICK)
    if min(len(a), len(b)) >= TYPO_LETTERS:
        d = typo(a, b, 2 if min(len(a), len(b)) >= 9 else 1)
        if d:
            return _did(TYPO, d)
    return NEVER


def _trade_cost(v: list, c: list, lexicon: Lexicon) -> tuple[float, int]:
    if not v or not c:
        return _did(NO_TRADE) if v or c else (0.0, 0)
    a, b = v[0], c[0]
    if a == b:
        return 0.0, 0
    if a.startswith(b) or b.startswith(a):
        return _did(SHORT_TRADE)
    return _did(TYPO) if (a not in lexicon.trades or b not in lexicon.trades) and typo(a, b, 1) else NEVER


def channel(v: Parts, c: Parts, lexicon: Lexicon) -> tuple[float, int]:
    """Cost by the first guess of typing v when c is meant, and the operations it takes."""
    if v.firm != c.firm:
        return NEVER
    if v.firm:
        if not v.words or not c.words:
            return NEVER
        steps = [min((_word_cost(w, x, lexicon) for x in c.words), default=NEVER) for w in v.words]
        steps.append(_did(EXTRA, min(abs(len(v.words) - len(c.words)), 255)))
        if v.form != c.form:
            steps.append(_did(NO_FORM) if not v.form or not c.form else NEVER)
        steps.append(_trade_cost(v.trades, c.trades, lexicon))
        steps.append(_did(BROTHERS, v.brothers != c.brothers))
        cost = sum(x for x, _ in steps)
        return (cost, sum(o for _, o in steps)) if cost <= MOST else NEVER
    mine, theirs = v.words + v.initials, c.words + c.initials
    if len(mine) < 2 or len(theirs) < 2:
        return (0.0, 0) if mine == theirs else NEVER
    few, many = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
    if (len(many) - len(few)) * FIRST_COSTS[EXTRA] > MOST:
        return NEVER
    # each word of the shorter name takes another of the longer; of equal sets of words taken the cheapest way is kept
    ways = {(0, False): (0.0, 0)}
    for a in few:
        longer: dict[tuple[int, bool], tuple[float, int]] = {}
        for (taken, surname), (cost, ops) in ways.items():
            for k, b in enumerate(many):
                if taken >> k & 1:
                    continue
                more, did = _word_cost(a, b, lexicon)
                if cost + more <= MOST:
                    family = len(a) > 1 and len(b) > 1 and not (a in lexicon.given or b in lexicon.given)
                    key = (taken | 1 << k, surname or family)
                    longer[key] = min(longer.get(key, NEVER), (cost + more, ops + did))
        ways = longer
    best = NEVER
    first = next((k for k, w in enumerate(many) if w in lexicon.given or len(w) == 1), 0)
    for (taken, surname), (cost, ops) in ways.items():
        left = [w for k, w in enumerate(many) if not taken >> k & 1]
        if surname and all(len(w) == 1 or w in lexicon.given for w in left):
            # a second given name is more often the one added than the first
            more, did = _did(EXTRA, len(left))
            best = min(best, (cost + more + (0.5 if left and not taken >> first & 1 else 0), ops + did))
    return best


def standing(p: Parts, n: int, lexicon: Lexicon) -> tuple:
    """How well a spelling serves as canonical form: complete ones with a known given name before frequent ones."""
    return (bool(p.form) + bool(p.trades) if p.firm else 2 * (not p.initials) + any(w in lexicon.given for w in p.words), n)


def block_keys(p: Parts, lexicon: Lexicon) -> list[str]:
    """Deletion neighbourhoods of the words that aren't given names; two words within one edit share one."""
    out = []
    for w in p.words:
        if w not in lexicon.given or len(p.words) == 1:
            head = "f" if p.firm else "p"
            out += [head + w] + [head + w[:i] + w[i + 1 :] for i in range(len(w))] if len(w) >= TYPO_LETTERS else [head + w]
    return list(dict.fromkeys(out))


def _meeting(values: list[str]) -> tuple[list[str], list[str]]:
    """Parts of two sides in which equal values meet, and a missing value meets every other."""
    return ([f"={v}" for v in values] + ["some"], [f"={v}" for v in values] + ["none"]) if values else (["=", "none"], ["=", "some"])


def block_parts(p: Parts) -> tuple[list[str], list[str]]:
    """What splits a crowded block, as one side and as the other: of persons letters with which the other words may begin (also after a transposition or as a
    short name); of firms the legal form with letters of the trade (two, for a typo in the first). Firms that ``channel`` accepts share a part: only other forms
    and trades of other letters separate them, a missing one meets all."""
    if p.firm:
        forms, trades = _meeting([p.form] if p.form else []), _meeting(list(dict.fromkeys(p.trades[0][:2])) if p.trades else [])
        mine, theirs = ([f"{f}|{t}" for f in forms[k] for t in trades[k]] for k in range(2))
        return mine, theirs
    out = [w[0] for w in p.words + p.initials] + [w[1] for w in p.words if len(w) > 1] + [full[0] for w in p.words for full in NICKNAMES.get(w, ())]
    out = list(dict.fromkeys(out)) or [""]
    return out, out


def spellings(columns: list[DataFrame]) -> DataFrame:
    """(``name``, ``n``): the distinct strings of several one-column tables and how often they occur; null, blank and sentinel strings are no names."""
    ship(columns[0].sparkSession)
    rows = reduce(DataFrame.unionAll, [c.toDF("name") for c in columns])
    rows = rows.where(F.col("name").isNotNull() & ~F.upper(F.trim("name")).isin(*SENTINELS))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def learn_lexicon(names: DataFrame) -> Lexicon:
    """Given names and trades: words with many different partners, and the floor for small corpora. Beyond ``LEXICON_ROWS`` all of them go to sorted files."""

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, word, mate = [], [], []
            for name in batch.column("name").to_pylist():
                words = list(dict.fromkeys(fold(w) for w in _TOKEN.findall(name) if len(w) > 3))
                if len(words) < 2:
                    continue
                firm = bool(_FIRM.search(name))
                for a in words:
                    for b in words:
                        if a != b and len(b) > 5:
                            kind.append(firm)
                            word.append(a)
                            mate.append(b[:3])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.bool_()), pa.array(word, pa.string()), pa.array(mate, pa.string())], names=["firm", "word", "mate"])

    found = names.select("name").mapInArrow(partners, "firm boolean, word string, mate string").distinct().groupBy("firm", "word").agg(F.count(F.lit(1)).alias("n"))
    found = found.where(F.col("n") >= F.when(F.col("firm"), TRADE_PARTNERS).otherwise(GIVEN_PARTNERS))
    skip = {"societa", "cooperativa", "fratelli", "ditta", "impresa", "onlus", "coop", "liquidazione", "capogruppo", "responsabilita", "limitata", "azioni", "spett", "sede", "operativa", "flli", "collettivo", "accomandita", "semplice", "nome", "dott", "arch", "geom", "prof"}
    learned = found.where(~F.col("word").isin(*skip)).groupBy("word").agg(F.max(F.struct("n", "firm"))["firm"].alias("trade"))
    floor = names.sparkSession.createDataFrame([(w, False) for w in sorted(COMMON_GIVEN)] + [(w, True) for w in sorted(COMMON_TRADES)], "word string, trade boolean")
    kinds = cut_lineage(learned.unionByName(floor).groupBy("word").agg(F.max("trade").alias("trade")))
    if kinds.count() <= LEXICON_ROWS:
        kept = kinds.collect()
        return Lexicon(*(frozenset(r["word"] for r in kept if r["trade"] == trade) for trade in (False, True)))
    given, trades = (kinds.where(F.col("trade") == trade).select("word", F.lit(1).alias("n")) for trade in (False, True))
    parts = F.expr("array_append(transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1))), word)")
    edits = trades.select(F.explode(F.array_distinct(parts)).alias("part"), "word").select(F.concat("part", F.lit("\0"), "word").alias("word"), F.lit(1).alias("n"))
    return Lexicon(SortedWords(given), SortedWords(trades), SortedWords(edits))


def attach(names: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(``name``, ``canonical``, ``cost``): each variant with the candidate of largest posterior; strings that attach to none are left out."""
    held = names.sparkSession.sparkContext.broadcast(lexicon)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(name, held.value) for name in batch.column("name").to_pylist()]
            rows = [(k, key, mine, theirs) for k, p in enumerate(parsed) for mine, theirs in [block_parts(p)] for key in block_keys(p, held.value)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string()), batch.column("name").take(at), batch.column("n").take(at), *(pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in (2, 3))], names=["key", "name", "n", "mine", "theirs"])

    blocks = cut_lineage(names.mapInArrow(keyed, "key string, name string, n bigint, mine array<string>, theirs array<string>"))
    sizes = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("_b")).where("_b > 1")
    blocks = cut_lineage(blocks.join(sizes, "key"))
    part = lambda side: F.when(F.col("_b") > BLOCK_SPELLINGS, F.transform(side, lambda x: F.concat_ws("|", F.col("key"), x))).otherwise(F.array("key"))
    keys = blocks.select(F.explode(part("mine")).alias("key"), "name", "n")
    other = blocks.select(F.explode(part("theirs")).alias("key"), F.col("name").alias("other"), F.col("n").alias("m"))
    pairs = keys.join(other, "key").where(F.col("name") != F.col("other")).select("name", "n", "other", "m").distinct()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Parts] = {}
        lex = held.value

        def parts(name: str) -> Parts:
            if name not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[name] = parse(name, lex)
            return memo[name]

        for batch in batches:
            out = []
            for a, n, b, m in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                pa_, pb = parts(a), parts(b)
                if (standing(pb, m, lex), b) > (standing(pa_, n, lex), a):
                    cost, ops = channel(pa_, pb, lex)
                    if cost <= MOST:
                        out.append((a, b, cost, math.log(m + 1), operations(ops)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "canonical", "cost", "prior", "ops"])

    ranked = cut_lineage(pairs.mapInArrow(scored, "name string, canonical string, cost double, prior double, ops array<int>"))
    costs = estimate(ranked)
    w = Window.partitionBy("name").orderBy(F.desc("posterior"), F.asc("cost"), F.asc("canonical"))
    return ranked.withColumn("posterior", _posterior(costs)).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "canonical", "cost")


def _posterior(costs: tuple[float, ...]) -> Column:
    """Logarithm of frequency times likelihood; what the first guess adds beside the operations (the place of an added name) stays."""
    learned = reduce(lambda a, b: a + b, [F.col("ops")[k] * F.lit(c) for k, c in enumerate(costs)])
    guessed = reduce(lambda a, b: a + b, [F.col("ops")[k] * F.lit(c) for k, c in enumerate(FIRST_COSTS)])
    return F.col("prior") - learned - (F.col("cost") - guessed)


def estimate(ranked: DataFrame) -> tuple[float, ...]:
    """Negative log-likelihoods of the operations by expectation-maximisation over all possible attachments (``name``, ``prior``, ``cost``, ``ops``)."""
    costs = FIRST_COSTS
    for _ in range(EM_ROUNDS):
        weighed = ranked.select("name", "ops", _posterior(costs).alias("_p"))
        best = weighed.groupBy("name").agg(F.max("_p").alias("_m"))
        shares = weighed.join(best, "name").withColumn("_w", F.exp(F.col("_p") - F.col("_m")))
        whole = shares.groupBy("name").agg(F.sum("_w").alias("_whole"))
        row = shares.join(whole, "name").withColumn("_w", F.col("_w") / F.col("_whole")).agg(F.sum("_w"), *(F.sum(F.col("_w") * F.col("ops")[k]) for k in range(len(costs)))).first()
        variants = row[0] or 0.0
        chance = [((row[k + 1] or 0.0) + GUESS_WEIGHT * math.exp(-c)) / (variants + GUESS_WEIGHT) for k, c in enumerate(FIRST_COSTS)]
        costs = tuple(-math.log(min(p, 0.95)) for p in chance)
    return costs


def entities(names: DataFrame) -> DataFrame:
    """(``name``, ``entity``): every string that has variants, with the canonical spelling at the end of its chain. A chain rises in standing, so it ends."""
    edges = cut_lineage(attach(names, learn_lexicon(names)).select("name", "canonical"))
    up, moved = edges, True
    while moved:
        step = up.join(up.select(F.col("name").alias("canonical"), F.col("canonical").alias("_far")), "canonical", "left")
        step = cut_lineage(step.select("name", F.coalesce("_far", "canonical").alias("canonical"), F.col("_far").isNotNull().alias("_moved")))
        up, moved = step.select("name", "canonical"), step.where("_moved").limit(1).count() > 0
    roots = up.select(F.col("canonical").alias("name"), "canonical").distinct()
    return up.unionByName(roots).select("name", F.col("canonical").alias("entity"))


def variant_pairs(columns: list[DataFrame]) -> DataFrame:
    """(``name_a``, ``name_b``), name_a < name_b by bytes: different strings, as stored, that name the same person or organisation.

    ``columns`` are one-column tables of strings. Null, blank and sentinel strings are no names. Equal strings are one spelling whatever their number.
    An empty table gives no rows.
    """
    found = cut_lineage(entities(cut_lineage(spellings(columns))))
    other = found.select("entity", F.col("name").alias("name_b"))
    return found.join(other, "entity").where(F.col("name") < F.col("name_b")).select(F.col("name").alias("name_a"), "name_b")
