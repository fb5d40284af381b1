import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.llm import redeliver

SCHEMA = "notice_id long, ente string, batch_no int, titolo string, numero string, tipologia string, dettaglio_url string, allegati array<string>, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_links_and_first_deliveries(spark):
    files = ["https://a.example/files/2023/atto_5_0.pdf"]
    rows = [
        (1, "e", 0, "Delibera 3/2023", "3/2023", "Delibera", "https://www.a.example:443/x?id=5&anno=2023#top", files),
        (2, "e", 1, "Delibera", None, None, "http://A.example/x?anno=2023&id=5&utm_source=feed", None),
        (3, "e", 2, "Delibera", None, None, None, ["https://cdn.a.example/f/atto_5_0.PDF.p7m"]),
        (4, "e", 3, "Delibera N.3/23", "N.3/23", None, "https://a.example/x?id=77", []),
        (5, "e", 3, "Delibera 3/2023 bis", "3/2023 bis", "Delibera", None, None),
        (6, "other", 3, "Delibera 3/2023", "3/2023", "Delibera", None, None),
        (7, "e", 1, None, None, None, None, None),
        (8, "e", 5, "Avviso n. 3 del 01/02/2023", "n. 3 del 01/02/2023", "Avviso", None, None),
        (9, None, 0, "Bando", "1-2024", "Bando", None, None),
        (10, None, 1, "Bando", "BAN/2024/1", "bando ", None, None),
        (4, "e", 3, "Delibera N.3/23", "N.3/23", None, "https://a.example/x?id=77", []),
    ]
    got = {tuple(r) for r in redeliver.redelivered(frame(spark, rows)).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (9, 10)}
    assert redeliver.redelivered(frame(spark, rows).limit(0)).count() == 0


def test_common_files_link_nothing(spark):
    rows = [(i, "e", i % 3, None, f"{i}/2023", "Delibera", None, ["https://a.example/modello.pdf"]) for i in range(6)]
    assert redeliver.redelivered(frame(spark, rows)).count() == 0


def test_every_shard_finds_nine_keys_in_ten_at_least(spark, data):
    """Recall of the beams that the operator itself tunes, against exhaustive comparison, on every shard of the sf0.1 history."""
    notices = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/notices.parquet").where("batch_no = 0")
    points = redeliver.key_rows(notices).withColumn("point", redeliver.point_key()).groupBy("point").agg(F.min("notice_id").alias("holder"))
    for row in redeliver.build_shards(points, 4).limit(2).collect():
        shard = redeliver.Shard(row["payload"])
        keys = shard.keys[:: max(1, len(shard.keys) // 1500)]
        at, holder = shard.links(keys, row["beam"])
        assert len(set(at.tolist())) >= 0.99 * len(keys) and row["beam"] < row["points"] / 4
        absent = np.array([k + "7" for k in keys[:200]], object)
        assert set(absent[shard.links(absent, row["beam"])[0]]) <= set(shard.keys)


def test_small_shards_and_odd_keys():
    for n in (1, 2, 5, 40):
        keys = [f"k{i}\n\ud800" for i in range(n)]
        payload, beam = redeliver.pack_shard(keys, np.arange(n))
        at, holder = redeliver.Shard(payload).links(np.array([*keys, "zz", ""], object), beam)
        assert sorted(zip(at.tolist(), holder.tolist())) == [(i, i) for i in range(n)]


def test_keys_that_differ_early_are_different_points():
    keys = [f"p|e|{i:06d}{'x' * 300}" for i in range(2000)]
    payload, beam = redeliver.pack_shard(sorted(keys), np.arange(2000))
    assert len(set(redeliver.Shard(payload).links(np.array(keys, object), beam)[0].tolist())) >= 1900


def test_one_by_one_equals_all_at_once(spark, data, tmp_path):
    notices = spark.read.parquet(f"{data}/notices.parquet")
    index = redeliver.ShardIndex(spark, str(tmp_path / "index"))
    for n in range(6):
        index.accept(notices.where(F.col("batch_no") == n), n)
    index.accept(notices.where(F.col("batch_no") == 5), 5)  # again
    assert sorted(index._segments()) == [(0, 0), (1, 4), (5, 5)]
    got = {tuple(r) for r in redeliver.first_deliveries(index.links()).collect()}
    want = {tuple(r) for r in redeliver.redelivered(notices.where("batch_no < 6")).collect()}
    assert got == want and got
    with pytest.raises(ValueError):
        index.accept(notices.where(F.col("batch_no") == 3), 3)


def test_files_that_become_common_later_link_nothing(spark, tmp_path):
    rows = [(i, "e", i, None, f"{i}/2023", "Delibera", None, ["https://a.example/modello.pdf"]) for i in range(1, 5)]
    rows += [(10 + i, "e", i, None, None, None, "https://a.example/x?id=9", ["https://a.example/modello.pdf"]) for i in (2, 4)]
    index = redeliver.ShardIndex(spark, str(tmp_path / "index"))
    for n in range(1, 5):
        index.accept(frame(spark, [r for r in rows if r[2] == n]), n)
    assert {tuple(r) for r in redeliver.first_deliveries(index.links()).collect()} == {(12, 14)}
    assert {tuple(r) for r in redeliver.redelivered(frame(spark, rows)).collect()} == {(12, 14)}


def test_a_third_of_all_rows_share_one_page(spark):
    rows = [(i, "e", i % 4, None, None, None, "https://a.example/x?id=0" if i % 3 == 0 else f"https://a.example/x?id={i}", None) for i in range(3000)]
    got = {tuple(r) for r in redeliver.redelivered(frame(spark, rows)).collect()}
    assert got == {(0, i) for i in range(3, 3000, 3)}
