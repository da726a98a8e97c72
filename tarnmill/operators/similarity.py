"""TF-IDF similarity of short texts as sparse joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions.text import tokenize
from tarnmill.operators.pairs import collapsed, compared


def vectors(docs: DataFrame, id_col: str, text_col: str, extra: list[str] | None = None) -> DataFrame:
    """(id, extra, v) of texts with tokens; v: structs (df, term, weight) from rare to common terms, of unit length, by
    tf * (ln((n + 1) / (df + 1)) + 1). Terms are counted inside each text, so that the one shuffle of terms is for df."""
    keep = extra or []
    tokens = docs.select(F.col(id_col).alias("id"), *keep, tokenize(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    share = lambda t: F.size(F.filter("tokens", lambda x: x == t)) / F.size("tokens")
    terms = tokens.select("id", *keep, F.explode(F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), share(t).alias("tf")))).alias("t"))
    df = terms.groupBy("t.term").agg(F.count("*").alias("df"))
    n = F.broadcast(tokens.agg(F.count("*").alias("n")))
    idf = df.crossJoin(n).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = terms.select("id", *keep, F.col("t.term").alias("term"), F.col("t.tf").alias("tf")).join(idf, "term")
    grouped = raw.groupBy("id", *keep).agg(F.sort_array(F.collect_list(F.struct("df", "term", (F.col("tf") * F.col("idf")).alias("x")))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))
    scaled = grouped.withColumn("norm", norm)
    return scaled.select("id", *keep, F.transform("v", lambda e: F.struct(e["df"].alias("df"), e["term"].alias("term"), (e["x"] / F.col("norm")).alias("weight"))).alias("v"))


def term_weights(docs: DataFrame, id_col: str, text_col: str, extra: list[str] | None = None) -> DataFrame:
    """(id, extra, term, weight) of `vectors`."""
    v = vectors(docs, id_col, text_col, extra)
    return v.select("id", *(extra or []), F.explode("v").alias("e")).select("id", *(extra or []), "e.term", "e.weight")


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e4 + 0.5) / 1e4


def _compared(v: DataFrame, least: float, block: str, mine=None) -> DataFrame:
    held = v if mine is None else v.withColumn("mine", mine)
    rows = collapsed(held, block, ["v"] if mine is None else ["v", "mine"])
    rows = rows.select(block, "ids", *([] if mine is None else ["mine"]), F.transform("v", lambda e: e["term"]).alias("terms"), F.transform("v", lambda e: e["weight"]).alias("weights"))

    def judge(dot, n, m):
        score = _rounded(dot)
        return score, score >= least, score >= least

    return compared(rows, block, v.schema["id"].dataType.simpleString(), "double", judge, None if mine is None else F.col("mine"))


def similar_pairs(v: DataFrame, least: float, block: str) -> DataFrame:
    """(left_id, right_id, score) with left_id < right_id in one block and score, rounded to four places, of `least` and
    more, of `vectors`: a score that only reaches `least` by rounding counts."""
    return _compared(v, least, block)


def resembling(v: DataFrame, least: float, block: str, mine: Column) -> DataFrame:
    """(left_id), some more than once, of the ids that meet `mine` and whose text resembles one of those that don't, in
    one block, by a score rounded to four places of `least` and more. Partners aren't listed, so common texts make no product."""
    return _compared(v, least, block, mine)
