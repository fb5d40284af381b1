import pytest

from actlens.llm import names
from actlens.llm.persons import Lexicon, parse, typo

L = Lexicon()
SAME = [
    ("Mario Zolbrecanti", "ZOLBRECANTI Mario"), ("Mario Zolbrecanti", "Zolbrecanti, Mario"), ("Mario Zolbrecanti", "M. Zolbrecanti"), ("Mario Zolbrecanti", "Dott. Mario Zolbrecanti"), ("Mario Zolbrecanti", "Mario Zolbercanti"),
    ("Domenico Zolbrecanti", "Mimmo Zolbrecanti"), ("Caterina Zolbrecanti", "Cate Zolbrecanti"), ("Mario Zolbrecanti", "Mairo Zolbrecanti"), ("Mario Zolbrecanti", "Mario Luigi Zolbrecanti"), ("Nicolò Zolbrecanti", "Nicolo' Zolbrecanti"),
    ("Zolbrecanti Edilizia S.r.l.", "Edilizia Zolbrecanti SRL"), ("Zolbrecanti Edilizia S.r.l.", "Ditta Zolbrecanti Edil. società a responsabilità limitata"), ("Zolbrecanti Edilizia Soc. Coop.", "Zolbrecanti Edilizia s.c."), ("Fratelli Zolbrecanti Vivai S.n.c.", "F.lli Zolbrecanti Vivai snc"),
    ("Zolbrecanti Vivai S.p.A.", "Zolbrecanti Vivai S.p.A. in liquidazione"),
]
OTHER = [("Mario Zolbrecanti", "Paola Zolbrecanti"), ("Paolo Zolbrecanti", "Paola Zolbrecanti"), ("Mario Zolbrecanti", "Mario Grendossi"), ("Zolbrecanti Edilizia S.r.l.", "Zolbrecanti Vivai S.n.c."), ("Mario Zolbrecanti", "Zolbrecanti Vivai S.n.c."), ("Mario Zolbrecanti", "P. Zolbrecanti"), ("Anna Zolbrecanti", "Giovanna Zolbrecanti")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_variants(a, b):
    assert names.channel(parse(b, L), parse(a, L), L)[0] <= names.MOST
    assert set(names.block_keys(parse(a, L), L)) & set(names.block_keys(parse(b, L), L))


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_entities(a, b):
    assert names.channel(parse(b, L), parse(a, L), L)[0] > names.MOST


def test_crowded_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK_SPELLINGS", 3)
    rows = [("Mario Zolbrecanti",)] * 3 + [(n,) for n in ("M. Zolbrecanti", "ZOLBRECANTI MARIO", "Maria Zolbrecanti", "Paola Zolbrecanti", "P. Zolbrecanti", "Domenico Zolbrecanti", "Mimmo Zolbrecanti", "Zolbrecanti Edilizia S.r.l.", "Edilizia Zolbrecanti SRL", "Zolbrecanti Vivai S.n.c.")]
    got = {tuple(r) for r in names.variant_pairs([spark.createDataFrame(rows, "x string")]).collect()}
    assert {("Mario Zolbrecanti", "ZOLBRECANTI MARIO"), ("Domenico Zolbrecanti", "Mimmo Zolbrecanti"), ("Edilizia Zolbrecanti SRL", "Zolbrecanti Edilizia S.r.l."), ("P. Zolbrecanti", "Paola Zolbrecanti")} <= got
    assert ("Mario Zolbrecanti", "Paola Zolbrecanti") not in got


def test_crowded_blocks_of_firms_lose_nothing(spark, monkeypatch):
    firms = ["Ditta Zolbrecanti", "Zolbrecanti Edilizia", "Ditta Zolbrecanti Edilizia", "Zolbrecanti S.r.l.", "Zolbrecanti Edilizia S.r.l.", "Zolbrecanti Dedilizia S.r.l.", "Zolbrecanti Vivai S.n.c.", "Zolbrecanti Snc"]
    parsed = {f: parse(f, L) for f in firms}
    for a in firms:
        for b in firms:
            if a != b and names.channel(parsed[a], parsed[b], L)[0] <= names.MOST:
                assert set(names.block_parts(parsed[a])[0]) & set(names.block_parts(parsed[b])[1]), (a, b)
    for some in (["Ditta Zolbrecanti", "Zolbrecanti Edilizia S.r.l."], ["Ditta Zolbrecanti Edilizia", "Zolbrecanti S.r.l."]):
        df = spark.createDataFrame([(x,) for x in some], "x string")
        monkeypatch.setattr(names, "BLOCK_SPELLINGS", 1)
        assert {tuple(r) for r in names.variant_pairs([df]).collect()} == {tuple(sorted(some))}


def test_distance():
    assert (typo("abcd", "abdc"), typo("abcd", "abc"), typo("abcd", "abcd"), typo("abcd", "wxyz")) == (1, 1, 0, 0)


def test_pairs(spark):
    rows = [("Mario Zolbrecanti",)] * 9 + [("M. Zolbrecanti",), ("Mario Zolbrecantti",), ("Mauro Zolbrecanti",), ("NON IDENTIFICATO",), (None,), ("",), (" ",), ("Mario Zolbrecanti ",)]
    got = {tuple(r) for r in names.variant_pairs([spark.createDataFrame(rows, "x string"), spark.createDataFrame([("ZOLBRECANTI MARIO",)], "y string")]).collect()}
    cluster = sorted(["Mario Zolbrecanti", "M. Zolbrecanti", "Mario Zolbrecantti", "Mario Zolbrecanti ", "ZOLBRECANTI MARIO"])
    assert got == {(a, b) for i, a in enumerate(cluster) for b in cluster[i + 1 :]}
    assert names.variant_pairs([spark.createDataFrame([], "x string")]).count() == 0


def test_channel_is_estimated_from_the_spellings(spark):
    """Variants that drop a name are made frequent and typos rare; the estimate follows."""
    rows = [(f"n{i}", 1.0, 3.0, [0, 0, 0, 1, 0, 0, 0, 0]) for i in range(900)] + [(f"t{i}", 1.0, 3.5, [0, 0, 1, 0, 0, 0, 0, 0]) for i in range(20)]
    costs = names.estimate(spark.createDataFrame(rows, "name string, prior double, cost double, ops array<int>"))
    assert costs[names.EXTRA] < 0.3 < 2.5 < costs[names.TYPO]
    assert names.estimate(spark.createDataFrame([], "name string, prior double, cost double, ops array<int>")) == pytest.approx(names.FIRST_COSTS)


def test_long_names_are_compared_too():
    lexicon = L
    long, typed = (parse(x, lexicon) for x in ("Maria Anna Lucia Paola Elena Vanderbrugghen", "Maria Anna Lucia Paola Elena Vanderbruggen"))
    cost, ops = names.channel(typed, long, lexicon)
    assert cost == names.FIRST_COSTS[names.TYPO] and names.operations(ops)[names.TYPO] == 1


def test_lexicons_beyond_the_bound_are_whole(spark, monkeypatch):
    """Words of few partners count too, whether the lexicon is held in memory or in files."""
    rows = [(f"{g} {s}adretti",) for g in ("Quirzio", "Zelmira") for s in ("Bol", "Car", "Dem", "Fas", "Gol", "Hur", "Mev", "Nir", "Pod")]
    rows += [(f"{s}adretti {t} S.r.l.",) for t in ("Ferramenta", "Lavanderie") for s in ("Bol", "Car", "Dem", "Fas", "Gol", "Hur", "Mev", "Nir", "Pod")]
    rows += [("Boladretti Ferramneta S.r.l.",), ("Boladretti Ferr. S.r.l.",), ("Boladretti Lavanderi",), ("Quir. Boladretti",), ("Zelmira Boladreti",), ("Boladretti S.r.l.",)]
    df = spark.createDataFrame(rows, "name string")
    held, before = names.learn_lexicon(df), {tuple(r) for r in names.variant_pairs([df]).collect()}
    assert {"quirzio", "zelmira"} <= held.given and {"ferramenta", "lavanderie"} <= held.trades and not held.given & held.trades
    monkeypatch.setattr(names, "LEXICON_ROWS", 3)
    filed = names.learn_lexicon(df)
    assert filed.given.size == len(held.given) and filed.trades.size == len(held.trades)
    words = {w for (n,) in rows for w in parse(n, held).words} | held.given | held.trades | {"ferramneta", "lavanderi", "ferramentaa", "feramenta", "x"}
    for w in words:
        assert (w in filed.given, w in filed.trades, filed.near_trade(w), filed.begins_trade(w[:4])) == (w in held.given, w in held.trades, held.near_trade(w), held.begins_trade(w[:4])), w
    assert {tuple(r) for r in names.variant_pairs([df]).collect()} == before and before
