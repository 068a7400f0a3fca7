"""Claims checked over a table of texts: numbers without a source, and phrases that may not be said.

The table form of ``claims.validate``: sentences, numerals and words become rows with their places, sourced numbers are
taken out by an anti-join and phrases found by a join of word windows, so texts and facts may be of any number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.operators.claims import EXEMPT

DATE = r"\b\d{4}-\d{2}-\d{2}\b"
NUMERAL = r"(?<![\w.+-])[-+]?\d[\d,]*(?:\.\d+)?"


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def number_tokens(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, place, number): numerals in order, without sign and separators; dates and exempt literals are none."""
    scrubbed = F.regexp_replace(_text(text), DATE, " ")
    each = texts.select(F.col(id_).alias("id"), F.posexplode(F.regexp_extract_all(scrubbed, F.lit(NUMERAL), F.lit(0))).alias("place", "number"))
    plain = F.regexp_replace("number", "[+,-]", "")
    return each.withColumn("number", plain).where(~F.col("number").isin(*sorted(EXEMPT)))


def rendered(facts: DataFrame, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, number): the ways each value may be written: with 0 to 4 places, in full, and by 1e-5 and 1e-7, without sign."""
    scaled = F.explode(F.array(*[F.abs(F.col(value).cast("double")) * s for s in (1.0, 1e-5, 1e-7)]))
    each = facts.where(F.col(value).isNotNull()).select(*keep, scaled.alias("_v"))
    forms = [F.format_string(f"%.{p}f", F.col("_v")) for p in range(5)]
    short = [F.regexp_replace(F.regexp_replace(f, r"(\.\d*?)0+$", "$1"), r"\.$", "") for f in forms[1:]]
    return each.select(*keep, F.explode(F.array_distinct(F.array(*forms, *short))).alias("number")).distinct()


def unsourced(texts: DataFrame, facts: DataFrame, id_: str, text: str, value: str, own: bool = True) -> DataFrame:
    """(id, place, number) of numerals that no fact gives: the text's own facts (``facts`` has the id as well), or any."""
    tokens = number_tokens(texts, id_, text)
    if own:
        return tokens.join(rendered(facts.withColumnRenamed(id_, "id"), value, ["id"]), ["id", "number"], "left_anti")
    return tokens.join(rendered(facts, value), "number", "left_anti")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrase_hits(texts: DataFrame, phrases: DataFrame, id_: str, text: str, phrase: str) -> DataFrame:
    """(id, phrase, sentence, n): how often each phrase stands within each sentence of each text. Windows are made for the sizes that
    phrases have, and met by one join."""
    listed = phrases.select(words(F.col(phrase)).alias("_w")).where(F.size("_w") > 0).select(F.array_join("_w", " ").alias("phrase"), F.size("_w").alias("size")).distinct()
    sizes = sorted(r["size"] for r in listed.select("size").distinct().collect())
    sentences = F.split(_text(text), r"(?<=[.!?])\s+")
    rows = texts.select(F.col(id_).alias("id"), F.posexplode(sentences).alias("sentence", "_s")).withColumn("_w", words(F.col("_s")))
    windows = [
        F.expr(f"if(size(_w) >= {n}, transform(sequence(1, greatest(size(_w) - {n - 1}, 1)), i -> array_join(slice(_w, i, {n}), ' ')), CAST(array() AS array<string>))")
        for n in sizes
    ]
    if not windows:
        return rows.where("false").select("id", F.lit("").alias("phrase"), "sentence", F.lit(0).cast("long").alias("n"))
    each = rows.select("id", "sentence", F.explode(F.concat(*windows)).alias("phrase"))
    return each.join(listed.select("phrase"), "phrase").groupBy("id", "phrase", "sentence").agg(F.count("*").alias("n"))
