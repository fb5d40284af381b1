import re
from collections import Counter, defaultdict

import regex
from hypothesis import given
from hypothesis import strategies as st

from actlens.llm import lines, split

SCHEMA = "event_id long, ente string, raw_text string, h int, docs string, _id int"


def brute(rows, share=0.05, docs=4, letters=15):
    per, total, where = defaultdict(Counter), Counter(), []
    for i, ente, t in rows:
        if t is None or not t.strip():
            continue
        total[ente] += 1
        keys = [regex.sub(r"[^\p{L}]+", "", x).lower() for x in t.split("\n")]
        for k in {k for k in keys if len(k) >= letters}:
            per[ente][k] += 1
        where += [(i, n, ente, k) for n, k in enumerate(keys, 1)]
    return {(i, n) for i, n, e, k in where if len(k) >= letters and per[e][k] >= docs and per[e][k] >= share * total[e] - 1e-9}


def test_on_the_events(spark, data):
    df = spark.read.parquet(f"{data}/admin_events.parquet")
    rows = [(r["event_id"], r["ente"], r["raw_text"]) for r in df.collect()]
    assert {tuple(r) for r in lines.repeated_lines(df).collect()} == brute(rows)


def test_edges(spark):
    legal = "Tutti i diritti sono riservati"
    rows = [(i, "a", f"atto {i}\n  {legal.upper()} {i}!\nfine") for i in range(5)] + [(9, "b", legal), (10, None, legal), (11, "a", None), (12, "a", "  \n"), (13, "a", "")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert {tuple(r) for r in lines.repeated_lines(df).collect()} == {(i, 2) for i in range(5)}
    cleaned = {r["event_id"]: (r["raw_text"], r["removed"]) for r in lines.without_repeated_lines(df).collect()}
    assert cleaned[3] == ("atto 3\nfine", 1)
    assert cleaned[11] == (None, 0)
    assert cleaned[12] == ("  \n", 0)
    assert cleaned[9] == (legal, 0)
    assert len(cleaned) == len(rows)
    assert lines.repeated_lines(df.limit(0)).count() == 0


@given(st.text(alphabet="ab \n.;\r", max_size=400), st.integers(10, 60))
def test_pieces_cover_the_text(text, limit):
    overlap = limit // 5
    pieces = split.cut_points(text, limit, overlap)
    assert pieces[0][0] == 0
    assert pieces[-1][1] == len(text)
    assert all(e - b <= limit for b, e in pieces)
    for (_, e), (b, f) in zip(pieces, pieces[1:]):
        assert f > e
        assert b == (e - overlap if e >= overlap else 0)


def test_pieces_end_at_boundaries(spark):
    text = "Prima frase lunga abbastanza. " * 150 + "\n\n" + "parola " * 600 + "x" * 7000
    df = spark.createDataFrame([(1, text), (2, "breve"), (3, None), (4, ""), (2, "breve")], "event_id long, raw_text string")
    rows = split.split_oversized(df).orderBy("event_id", "piece_no").collect()
    assert [r["piece"] for r in rows if r["event_id"] == 2] == ["breve", "breve"]
    assert not [r for r in rows if r["event_id"] == 3]
    assert [r["piece"] for r in rows if r["event_id"] == 4] == [""]
    mine = [r for r in rows if r["event_id"] == 1]
    assert "".join([mine[0]["piece"], *(r["piece"][300:] for r in mine[1:])]) == text
    assert all(len(r["piece"]) <= 3000 for r in mine)
    assert re.search(r"\. $", mine[0]["piece"])
    assert split.split_oversized(df.limit(0)).count() == 0
