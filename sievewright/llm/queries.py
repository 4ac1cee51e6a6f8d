"""Registered queries of the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import garbled, languages, leak, packing, residue, sentences, truncated, unify, variants
from sievewright.session import arrow_map, cut, table


def _abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts of landed and parsed rows under one schema: src, row_key, source, text."""
    landed = table(spark, sf_dir, "delta").select(
        F.lit("delta").alias("src"), F.col("row_id").alias("row_key"), F.col("publisher_domain").alias("source"), F.col("abstract").alias("text")
    )
    parsed = table(spark, sf_dir, "parsed_rows").select(
        F.lit("parsed").alias("src"), F.col("parse_id").alias("row_key"), F.col("publisher_domain").alias("source"), F.col("parsed.abstract").alias("text")
    )
    return landed.unionByName(parsed)


def _languages(spark: SparkSession, sf_dir: str) -> languages.Network | None:
    """The language network of all labelled documents."""
    return languages.fitted(spark, table(spark, sf_dir, "documents"), "text", "lang")


def _letters(spark: SparkSession, sf_dir: str) -> garbled.Model:
    """The letter model of all labelled documents."""
    return garbled.counted(table(spark, sf_dir, "documents"), "text", "lang")


class _Spoilt:
    """Residue or garbled text: what the problems of real, readable text leave to their own operators."""

    def __init__(self, counts: dict[str, int], n: int, letters: garbled.Model) -> None:
        self.counts, self.n, self.letters, self.index = counts, n, letters, None

    def __call__(self, text: str) -> bool:
        if self.index is None:
            self.index = residue.Index(self.counts, self.n)
        return self.index.score(text) >= residue.COVERED or garbled.repair(text, self.letters)[0]

    def __getstate__(self):
        return {**self.__dict__, "index": None}


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every truncated abstract with its probability."""
    texts = _abstracts(spark, sf_dir)
    spoilt = _Spoilt(*residue.frequencies(texts, "text"), _letters(spark, sf_dir))
    return truncated.truncation_scores(texts, ["src", "row_key"], "text", "source", spoilt)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_scores(spark, sf_dir).select("src", "row_key")


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of truncated records per source, over all records that have an abstract."""
    real = _abstracts(spark, sf_dir).where(~F.coalesce(F.lower(F.trim("text")), F.lit("")).isin("", "n/a", "na", "none"))
    every = real.groupBy("source").agg(F.count("*").alias("n_records"))
    cut = p1_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_truncated"))
    joined = every.join(cut, every["source"].eqNullSafe(cut["source"]), "left").select(every["source"], "n_records", F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"))
    return joined.withColumn("share", F.col("n_truncated") / F.col("n_records"))


def _readable(df: DataFrame, text: str, spoilt: _Spoilt) -> DataFrame:
    """The rows whose text is neither residue nor garbled."""

    def kernel(batch):
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        return batch.take(pa.array([i for i, t in enumerate(texts) if not spoilt(t)], pa.int64()))

    return arrow_map(df, kernel, df.schema)


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language of every abstract, with its confidence."""
    rows = languages.label_texts(table(spark, sf_dir, "delta"), ["row_id"], "abstract", _languages(spark, sf_dir))
    parts = rows.select("row_id", F.posexplode("segments").alias("seg_no", "s"))
    return parts.select("row_id", "seg_no", "s.char_start", "s.char_end", "s.lang", "s.confidence")


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every abstract: that of its longest stretches, with their share of the text and their mean confidence."""
    rows = languages.label_texts(table(spark, sf_dir, "delta"), ["row_id"], "abstract", _languages(spark, sf_dir))
    parts = rows.select("row_id", F.explode("segments").alias("s")).withColumn("n", F.col("s.char_end") - F.col("s.char_start"))
    per = parts.groupBy("row_id", "s.lang").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("s.confidence")) / F.sum("n")).alias("confidence"))
    best = per.groupBy("row_id").agg(F.max(F.struct("n", "lang", "confidence")).alias("b"), F.sum("n").alias("all"))
    return best.select("row_id", "b.lang", (F.col("b.n") / F.col("all")).alias("share"), "b.confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the abstracts whose label is missing or wrong, or that mix languages."""
    delta = table(spark, sf_dir, "delta")
    rows = languages.label_texts(delta, ["row_id", "no_english"], "abstract", _languages(spark, sf_dir))
    label = F.lower(F.trim(F.coalesce("no_english", F.lit(""))))
    yes, no = label.isin("true", "yes", "y", "1", "t"), label.isin("false", "no", "n", "0", "f")
    english = F.array_contains("langs", "en")
    wrong = ~(yes | no) | (yes & english) | (no & ~english) | (F.size("langs") > 1)
    chosen = rows.where((F.size("langs") > 0) & wrong).select("row_id", "text", "langs")
    spoilt = _Spoilt(*residue.frequencies(delta, "abstract"), _letters(spark, sf_dir))
    return _readable(chosen, "text", spoilt).select("row_id", F.explode("langs").alias("lang"))


def _variants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return variants.linked(table(spark, sf_dir, "gold_rows"), table(spark, sf_dir, "orgs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries of one person, and the organisations that affiliation entries name."""
    members, places = _variants(spark, sf_dir)
    named = places.select(F.lit("organisation").alias("kind"), F.col("org").alias("id_a"), (F.col("key") * 10 + F.col("aff_pos")).alias("id_b"))
    return variants.person_pairs(members).select(F.lit("person").alias("kind"), "id_a", "id_b").unionByName(named)


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership instead of pairs: the person of every author entry that is linked, and the person's number of entries."""
    members, _ = _variants(spark, sf_dir)
    return members.join(members.groupBy("person").agg(F.count("*").alias("n_entries")), "person").select("person", F.col("key").alias("author_key"), "n_entries")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


def p3_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parsed abstract beside the gold one of its record: the same string, the same look, or really different.

    Only digests of the texts (128 bits of the whole text) go through the join, not the texts.
    """

    def side(df: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
        raw = F.md5(F.regexp_replace(F.col("t"), r"(?U)^\s+|\s+$", ""))
        chosen = df.select(*keys, F.col(text).alias("t")).where(F.col("t").isNotNull())
        forms = unify.unify(chosen.withColumn("raw", raw), [*keys, "raw"], "t")
        return forms.select(*keys, F.col("raw").alias(f"{name}_raw"), F.md5("skeleton").alias(f"{name}_look"), (F.col("skeleton") == "").alias(f"{name}_empty"))

    gold = side(table(spark, sf_dir, "gold_rows"), ["rec_no"], "abstract", "gold")
    parsed = side(table(spark, sf_dir, "parsed_rows"), ["rec_no", "parse_id"], "parsed.abstract", "parsed")
    verdict = (
        F.when(F.col("gold_raw") == F.col("parsed_raw"), "same")
        .when((F.col("gold_look") == F.col("parsed_look")) & ~F.col("gold_empty"), "same look")
        .otherwise("different")
    )
    return parsed.join(gold, "rec_no").select("rec_no", "parse_id", verdict.alias("verdict"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All abstracts of both sides in one consistent form."""
    gold = table(spark, sf_dir, "gold_rows").select(F.lit("gold").alias("src"), F.col("rec_no").alias("row_key"), F.col("abstract").alias("t"))
    parsed = table(spark, sf_dir, "parsed_rows").select(F.lit("parsed").alias("src"), F.col("parse_id").alias("row_key"), F.col("parsed.abstract").alias("t"))
    return unify.unify(gold.unionByName(parsed).where(F.col("t").isNotNull()), ["src", "row_key"], "t").select("src", "row_key", "canonical")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_compared(spark, sf_dir).where(F.col("verdict") == "same look").select("rec_no", "parse_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_scores(table(spark, sf_dir, "delta"), "row_id", "abstract").select("row_id")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed rows without the residue: how many are left out and kept, per has_bot_check."""
    rows = table(spark, sf_dir, "delta").select("row_id", F.col("has_bot_check"))
    bad = residue.residue_scores(table(spark, sf_dir, "delta"), "row_id", "abstract")
    flagged = rows.join(bad, "row_id", "left").withColumn("out", F.col("coverage").isNotNull())
    return flagged.groupBy("has_bot_check", "out").agg(F.count("*").alias("n_rows"))


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled cells of delta with the text given back and whether characters stay lost."""
    return garbled.repair_cells(table(spark, sf_dir, "delta"), "row_id", ["abstract", "authors"], _letters(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_repaired(spark, sf_dir).select("row_id", "col")


def _capacities(spark: SparkSession, sf_dir: str) -> list[int]:
    """The permitted capacities: a table of a few rows."""
    rows = table(spark, sf_dir, "pack_limits").select("capacity_tokens").distinct().limit(packing.MOST_CAPACITIES + 1).collect()
    if len(rows) > packing.MOST_CAPACITIES:
        raise ValueError("too many capacities")
    return sorted(r["capacity_tokens"] for r in rows)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of the permitted capacities, chosen jointly."""
    counts = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack_texts(cut(counts), "doc_id", _capacities(spark, sf_dir))


def p8_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of one capacity, for each permitted capacity by itself."""
    counts = cut(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    parts = [packing.pack_texts(counts, "doc_id", [c]) for c in _capacities(spark, sf_dir)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, items, tokens and fill of each capacity, jointly packed."""
    per = p8_packed(spark, sf_dir).groupBy("capacity", "container").agg(F.count("*").alias("k"), F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    out = per.groupBy("capacity").agg(F.count("*").alias("n_containers"), F.sum("k").alias("n_items"), F.sum("n").alias("n_tokens"))
    return out.withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))


def p9_alignments(spark: SparkSession, sf_dir: str, edited: bool = True) -> DataFrame:
    """Documents aligned with evaluation items, edited copies included."""
    return leak.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", edited)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose alignment with an item scores as much as a run of RUN words; the exact length of the run is checked last."""
    aligned = p9_alignments(spark, sf_dir, edited=False).where(F.col("score") >= leak.MATCH * leak.RUN)
    return aligned.where(F.col("longest_run") >= leak.RUN).select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_share": p1_share, "p2_found": p2_found, "p2_segments": p2_segments, "p2_languages": p2_languages, "p3_unified": p3_unified, "p10_found": p10_found, "p4_found": p4_found, "p4_members": p4_members, "p3_found": p3_found, "p3_compared": p3_compared, "p5_found": p5_found, "p5_kept": p5_kept, "p8_packed": p8_packed, "p8_each": p8_each, "p8_fill": p8_fill, "p9_found": p9_found, "p9_alignments": p9_alignments, "p9_leaked_items": p9_leaked_items, "p7_found": p7_found, "p7_repaired": p7_repaired}
_GRAMS = r"select {0} as k, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as g from (select {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from {1}) where len(w) > 11"
ORACLE: dict[str, str] = {
    "p9_found": f"select distinct d.k as doc_id, i.k as item_id from ({_GRAMS.format('doc_id', 'documents')}) d join ({_GRAMS.format('item_id', 'eval_items')}) i using (g)",
}
ORACLE["p9_leaked_items"] = f"select item_id, count(*) as n_documents from ({ORACLE['p9_found']}) group by 1"
