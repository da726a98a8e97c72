"""Joins with priorities, thresholds and fallbacks."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.operators.pairs import collapsed, compared

#: Rows of a dimension that may be broadcast for a join without an equality.
DIMENSION_ROWS = 10_000


def dimension(df: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """df marked for broadcast after its size was looked at; larger ones are left to the optimiser."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_duplicate_reason(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `duplicate_of`: the first of the keys, in order, whose value history holds; null keys never match.

    The history is reduced to distinct (key, value) pairs; rows are joined with them once for each key."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)])).alias("p")
    known = history.select(pairs).select("p.*").where("v is not null").distinct()
    names = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(i), F.lit(k))])
    out = rows
    for i, k in enumerate(keys):
        seen = known.where(F.col("i") == i).select(F.col("v").alias(f"__v{i}"), F.lit(i).alias(f"__i{i}"))
        out = out.join(seen, F.col(k).cast("string") == F.col(f"__v{i}"), "left")
    hit = F.coalesce(*[F.col(f"__i{i}") for i in range(len(keys))])
    return out.withColumn("duplicate_of", F.try_element_at(names, hit)).select(*rows.columns, "duplicate_of")


def semi_within(rows: DataFrame, registry: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """rows whose key the registry holds from at most `days` days before. Registry times of a key are reduced to the
    last one before by a union and a window, so a common key makes no product of matches."""
    a = rows.select("*", F.lit(1).alias("__mine"), F.lit(None).cast(registry.schema[at].dataType).alias("__seen"))
    b = registry.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.lit(0).alias("__mine"), F.col(at).alias("__seen"))
    w = Window.partitionBy(key).orderBy(at, "__mine").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("__seen").over(w)
    both = a.unionByName(b).withColumn("__last", last)
    return both.where((F.col("__mine") == 1) & F.col(key).isNotNull() & (F.col("__last") >= F.col(at) - F.expr(f"INTERVAL {days} DAYS"))).select(*rows.columns)


def lookup_last(rows: DataFrame, facts: DataFrame, keys: list[str], value: str, order: list[str], default=None, name: str | None = None) -> DataFrame:
    """rows with the last known value for their keys."""
    last = facts.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name or value))
    out = rows.join(last, keys, "left")
    return out.withColumn(name or value, F.coalesce(name or value, F.lit(default))) if default is not None else out


def prioritised(rows: DataFrame, facts: DataFrame, ways: list[tuple[str, str]], value: str) -> DataFrame:
    """rows with `value` and `matched_by` from facts by the first key, in order, that matches."""
    out = rows
    for i, (mine, theirs) in enumerate(ways):
        side = facts.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"__k{i}")).agg(F.min(value).alias(f"__x{i}"))
        out = out.join(side, F.col(mine) == F.col(f"__k{i}"), "left")
    values = F.coalesce(*[F.col(f"__x{i}") for i in range(len(ways))])
    by = reduce(lambda c, i: F.when(F.col(f"__x{i}").isNotNull(), ways[i][0]).otherwise(c), reversed(range(len(ways))), F.lit(None).cast("string"))
    return out.select(*rows.columns, values.alias(value), by.alias("matched_by"))


def nearest_string(rows: DataFrame, names: DataFrame, value: str, name: str, order: str, most: Column, on: list[str] | None = None) -> DataFrame:
    """rows with `nearest` and `edits`: the name of the fewest edits, at most `most`, ties to the first listed; with `on`,
    of the names that are equal there. Each distinct value is resolved once and rows are joined to what came of it, so
    repeated rows stay."""
    on = on or []
    wanted = rows.select(value, *on).where(F.col(value).isNotNull()).distinct()
    edits = F.levenshtein(F.lower(value), F.lower(name))
    listed = names.select(order, name, *on)
    pairs = wanted.join(F.broadcast(listed) if listed.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else listed, on) if on else wanted.crossJoin(dimension(listed))
    best = pairs.where(edits <= most).groupBy(value, *on).agg(F.min(F.struct(edits.alias("e"), F.col(order).alias("o"), F.col(name).alias("n"))).alias("b"))
    return rows.join(best, [value, *on], "left").select(*rows.columns, F.col("b.n").alias("nearest"), F.col("b.e").alias("edits"))


def whole_words(a: Column, b: Column) -> Column:
    """Whether two names are equal or one stands in the other as whole words, whatever their case."""
    quoted = lambda x: F.regexp_replace(F.lower(x), r"([^\w\s])", r"\\$1")
    inside = lambda x, y: F.regexp_like(F.lower(x), F.concat(F.lit(r"(?<![\w])"), quoted(y), F.lit(r"(?![\w])")))
    return (F.lower(a) == F.lower(b)) | inside(a, b) | inside(b, a)


def listed(rows: DataFrame, names: DataFrame, value: str, name: str, flag: str, least: int = 3) -> DataFrame:
    """rows with a flag: whether their value equals a name in lower case, or begins or ends with one of over `least`
    signs as words. The beginnings and ends of a value at its blanks are joined by equality: no product with the list."""
    words = F.split(F.lower(F.trim(value)), r"\s+")
    n = F.size(words)
    cut = lambda a, k: F.array_join(F.slice(words, a, k), " ")
    # parts of the value that begin or end it
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.array(cut(F.lit(1), k), cut(n - k + 1, k)))))
    wanted = rows.select(value).where(F.col(value).isNotNull()).distinct()
    keyed = wanted.select(value, F.explode(parts).alias("__part"))
    hits = keyed.join(names.select(F.lower(F.trim(name)).alias("__part")).distinct(), "__part").where((F.length("__part") > least) | (F.col("__part") == F.lower(F.trim(value)))).select(value).distinct()
    return rows.join(hits.withColumn(flag, F.lit(True)), value, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def word_overlap(rows: DataFrame, block: str, words: str, share: float = 0.5, least: int = 2) -> DataFrame:
    """(left_id, right_id, shared) with left_id < right_id of one block that have at least max(least, share * words of the
    left one) words in common. Equal sets of words are compared once."""
    sets = rows.where(F.col(words).isNotNull()).select("id", block, F.array_sort(F.array_distinct(words)).alias("terms"))
    one = F.transform("terms", lambda _: F.lit(1.0)).alias("weights")

    def judge(dot: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shared = np.rint(dot).astype(np.int64)
        return shared, (shared >= least) & (shared >= share * n), (shared >= least) & (shared >= share * m)

    pairs = compared(collapsed(sets, block, ["terms"]).select(block, "ids", "terms", one), block, rows.schema["id"].dataType.simpleString(), "long", judge)
    return pairs.withColumnRenamed("score", "shared")
