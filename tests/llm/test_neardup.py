import random
from itertools import combinations

import regex

from actlens.llm import neardup, queries

WORDS = regex.compile(r"[\p{L}\p{Nd}]+").findall


def elements(text, run):
    w = WORDS(text.lower())
    return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}


def brute(rows, run, threshold, least):
    sets = {i: s for i, t in rows if t and len(s := elements(t, run)) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def found(df, ident, text, run, threshold, least, subset=2):
    return {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(df, ident, text, run=run, threshold=threshold, min_size=least, subset=subset).collect()}


def test_on_notices_and_events(spark, data):
    for name, ident, text, run, threshold, least, subset in (("notices", "notice_id", "oggetto", 1, 0.7, 10, 4), ("admin_events", "event_id", "raw_text", 3, 0.6, 30, 2)):
        df = spark.read.parquet(f"{data}/{name}.parquet").select(ident, text)
        assert found(df, ident, text, run, threshold, least, subset) == brute([tuple(r) for r in df.collect()], run, threshold, least)


def test_crowded_anchors_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ANCHOR_RECORDS", 3)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        base = vocabulary[: 25 + i % 7]
        rows.append((i, " ".join(w if rng.random() > 0.12 else rng.choice(vocabulary) for w in base)))
    df = spark.createDataFrame(rows, "i long, t string")
    for run, threshold, least, subset in ((1, 0.7, 10, 4), (1, 0.8, 10, 2), (3, 0.6, 10, 2)):
        assert found(df, "i", "t", run, threshold, least, subset) == brute(rows, run, threshold, least)


def test_long_texts_that_share_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ANCHOR_RECORDS", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(1400)]
    rows = []
    for i in range(6):
        changed = set(rng.sample(range(len(base)), 45))
        rows.append((i, " ".join(f"x{i}y{k}" if k in changed else w for k, w in enumerate(base))))
    df = spark.createDataFrame(rows, "i long, t string")
    expected = brute(rows, 3, 0.6, 30)
    assert len(expected) == 15
    for subset in (1, 2):
        assert found(df, "i", "t", 3, 0.6, 30, subset) == expected


def test_edges(spark, monkeypatch):
    long = " ".join(f"parola{i}" for i in range(40))
    rows = [(1, long), (2, long), (3, long.upper() + "!"), (4, None), (5, ""), (6, "corto"), (1, long), (None, long), (7, long * 200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "i long, t string, key int, _id string")
    assert found(df, "i", "t", 1, 0.8, 10) == brute([(i, t) for i, t in rows if i], 1, 0.8, 10)
    assert found(df.limit(0), "i", "t", 1, 0.8, 10) == set()
    monkeypatch.setattr(neardup, "CLASS_PAIRS", 2)
    star = found(df.where("i < 7"), "i", "t", 1, 0.8, 10)
    assert star == {(1, 2), (1, 3)}


def test_large_classes_come_out_whole(spark, tmp_path):
    words = [f"parola{i}" for i in range(20)]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(words, len(words)))) for i in range(103)]  # one set, different texts
    rows += [(200 + i, " ".join([*words, f"altra{i}"])) for i in range(2)]
    spark.createDataFrame(rows, "notice_id long, oggetto string").write.parquet(f"{tmp_path}/notices.parquet")
    spark.createDataFrame([], "event_id long, raw_text string").write.parquet(f"{tmp_path}/admin_events.parquet")
    expected = brute(rows, 1, 0.7, 10)
    assert len(expected) == 105 * 104 // 2
    assert {(r["id_a"], r["id_b"]) for r in queries.p4_found(spark, str(tmp_path)).collect()} == expected
    assert {r["links"] for r in queries.p4_groups(spark, str(tmp_path)).collect()} == {104}


def test_groups(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (5, 9)], "id_a long, id_b long")
    got = {r["record_id"]: (r["group_id"], r["links"]) for r in neardup.group_pairs(df).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 5: (5, 1), 9: (5, 1)}
    assert neardup.group_pairs(df.limit(0)).count() == 0
