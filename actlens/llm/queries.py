"""The training-data queries, by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm import lines, mix, names, neardup, oracle, pii, redeliver, residue, scans, split, tokenize
from actlens.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redeliver.redelivered(table(spark, sf_dir, "notices"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "admin_events"))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, sf_dir, "admin_events"))


def _typed_names(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events, extracted, nodes = (table(spark, sf_dir, n) for n in ("admin_events", "extracted_data", "graph_nodes"))
    return [extracted.select("beneficiario_raw"), events.select(F.explode("actors.name")), nodes.where(F.col("node_type") == "RUP").select("label")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(_typed_names(spark, sf_dir))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(names.spellings(_typed_names(spark, sf_dir)))


#: Limits of problem 4 per table: id, text, words in a run, similarity, least distinct runs; and the elements of anchors that replace crowded ones.
ALIKE = {"notices": ("notice_id", "oggetto", 1, 0.7, 10, 4), "admin_events": ("event_id", "raw_text", 3, 0.6, 30, 2)}


def _alike(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ident, text, run, threshold, least, subset = ALIKE[name]
    return neardup.similar_pairs(table(spark, sf_dir, name), ident, text, run=run, threshold=threshold, min_size=least, subset=subset, every=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [_alike(spark, sf_dir, n).select(F.lit(n).alias("tbl"), "id_a", "id_b") for n in ALIKE]
    return found[0].unionByName(found[1])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [neardup.group_pairs(_alike(spark, sf_dir, n)).select(F.lit(n).alias("tbl"), "record_id", "group_id", "links") for n in ALIKE]
    return found[0].unionByName(found[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "admin_events")).where(F.col("piece_no") == 2).select("event_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "admin_events"))


PERSONAL = {"admin_events": ("event_id", "raw_text"), "notices": ("notice_id", "oggetto")}


def _personal(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], pii.Lexicon]:
    tables = {n: table(spark, sf_dir, n).select(*c) for n, c in PERSONAL.items()}
    return tables, pii.learn_lexicon(tables["admin_events"].select("raw_text").unionAll(tables["notices"].select("oggetto")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, lexicon = _personal(spark, sf_dir)
    found = [pii.find_personal(tables[n], ident, text, lexicon=lexicon).select(F.lit(n).alias("tbl"), F.col(ident).alias("row_id"), "kind", "span") for n, (ident, text) in PERSONAL.items()]
    return found[0].unionByName(found[1]).distinct()


def p6_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, lexicon = _personal(spark, sf_dir)
    clean = [pii.sanitise(tables[n], ident, text, lexicon=lexicon).select(F.lit(n).alias("tbl"), F.col(ident).alias("row_id"), F.col(text).alias("text")) for n, (ident, text) in PERSONAL.items()]
    return clean[0].unionByName(clean[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.find_damage(table(spark, sf_dir, "admin_events")).distinct()


def p7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_paragraphs(table(spark, sf_dir, "admin_events"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mix.sized_documents(table(spark, sf_dir, "documents"))
    return mix.select_mix(sized, mix.mix_plan(sized, table(spark, sf_dir, "mix_targets")))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mix.sized_documents(table(spark, sf_dir, "documents"))
    plan = mix.mix_plan(sized, table(spark, sf_dir, "mix_targets"))
    return mix.mix_report(mix.select_mix(sized, plan), plan)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).where("excluded").select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p2_cleaned, p3_found, p3_entities, p4_found, p4_groups, p5_found, p5_pieces, p6_found, p6_sanitised, p7_found, p7_paragraphs, p8_ids, p9_selection, p9_report, p10_found, p10_scores)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLE)
