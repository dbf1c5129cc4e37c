"""Matching that never guesses: ambiguity comes out as a status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.names import fold_column, letters, similarity
from tallyspan.operators.identity import ratio
from tallyspan.session import stored


def tiered_pair_match(rows: DataFrame, facts: DataFrame, row_id: str, fact_id: str, pair: str, day: str, order: str, slack: int = 1) -> DataFrame:
    """(row_id, fact_id, status): rows matched to facts of the same pair on the day, else within ``slack`` days.

    status: exact, near, ambiguous, unmatched, or duplicate if an earlier row (by ``order``) took the fact.
    """
    # A fact stands under each day that it may match, so the join is on (pair, day) and a frequent pair isn't
    # compared with itself over all days.
    offsets = F.explode(F.array(*(F.lit(k) for k in range(-slack, slack + 1))))
    near = facts.select(pair, F.col(fact_id).alias("_f"), F.col(day).alias("_d"), offsets.alias("_k")).select(pair, "_f", F.date_add("_d", F.col("_k")).alias(day), F.abs("_k").alias("_gap"))
    j = rows.join(near, [pair, day], "left")
    ok = F.col("_gap").isNotNull()
    agg = j.groupBy(row_id).agg(
        F.first(order).alias("_o"),
        F.count_if(F.col("_gap") == 0).alias("_n0"),
        F.count_if(ok).alias("_n1"),
        F.min(F.when(F.col("_gap") == 0, F.col("_f"))).alias("_f0"),
        F.min("_f").alias("_f1"),
    )
    status = F.when(F.col("_n0") == 1, "exact").when(F.col("_n0") > 1, "ambiguous").when(F.col("_n1") == 1, "near").when(F.col("_n1") > 1, "ambiguous").otherwise("unmatched")
    hit = agg.withColumn("status", status).withColumn("_fact", F.when(F.col("status") == "exact", F.col("_f0")).when(F.col("status") == "near", F.col("_f1")))
    first = F.row_number().over(Window.partitionBy("_fact").orderBy("_o", row_id)) > 1
    return hit.select(row_id, F.col("_fact").alias(fact_id), F.when(F.col("_fact").isNotNull() & first, "duplicate").otherwise(F.col("status")).alias("status"))


def two_tier_match(rows: DataFrame, facts: DataFrame, row_id: str, fact_id: str, natural_id: str, pair: str, day: str) -> DataFrame:
    """By natural id, else by pair on day offsets 0, -1, +1 in this order: (row_id, fact_id, tier)."""
    by_id = rows.join(facts.select(natural_id, F.col(fact_id).alias("_a")).where(F.col(natural_id).isNotNull()).groupBy(natural_id).agg(F.min("_a").alias("_a")), natural_id, "left")
    tiers = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in ((0, 1), (1, 2), (-1, 3)))))
    near = facts.select(pair, F.col(fact_id).alias("_b"), F.col(day).alias("_d"), tiers.alias("_t")).select(pair, "_b", F.date_add("_d", F.col("_t.k")).alias(day), F.col("_t.t").alias("_tier"))
    pairs = rows.join(near, [pair, day]).groupBy(row_id).agg(F.min(F.struct("_tier", "_b")).alias("_m"))
    return by_id.join(pairs, row_id, "left").select(row_id, F.coalesce("_a", "_m._b").alias(fact_id), F.when(F.col("_a").isNotNull(), 0).otherwise(F.col("_m._tier")).alias("tier"))


def resolve_names(names: DataFrame, entities: DataFrame, aliases: DataFrame, activity: DataFrame, *, slack: int = 60) -> DataFrame:
    """(row_id, entity, status) of names: unique normalised name, then source-scoped alias, then activity.

    ``names``: row_id, source, name, day, weight_class; ``entities``: entity, name; ``aliases``: source, alias,
    entity; ``activity``: entity, weight_class, first_day, last_day. A name held by several is narrowed to those
    active (in any class) within ``slack`` days, if the day is known, and ever active in the class, if that is known;
    exactly one left is ``disambiguated``, otherwise ``ambiguous``. The primary name beats an alias.
    """
    keyed = names.withColumn("_k", fold_column(F.col("name"))).where("_k <> ''")
    held = entities.withColumn("_k", fold_column(F.col("name"))).select("_k", "entity").distinct()
    spans = activity.groupBy("entity").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.collect_set("weight_class").alias("_classes"))
    j = keyed.join(held, "_k", "left").join(spans, "entity", "left")
    on_day = F.col("day").isNull() | F.coalesce(F.col("day").between(F.date_sub("first_day", slack), F.date_add("last_day", slack)), F.lit(False))
    active = on_day & (F.col("weight_class").isNull() | F.coalesce(F.array_contains("_classes", F.col("weight_class")), F.lit(False)))
    by_name = j.groupBy("row_id").agg(F.count("entity").alias("_n"), F.min("entity").alias("_one"), F.count_if(active & F.col("entity").isNotNull()).alias("_na"), F.min(F.when(active, F.col("entity"))).alias("_act"))
    known = aliases.withColumn("_k", fold_column(F.col("alias"))).groupBy("source", "_k").agg(F.min("entity").alias("_alias"), F.countDistinct("entity").alias("_an"))
    full = keyed.select("row_id", "source", "_k").join(by_name, "row_id").join(known.where("_an = 1"), ["source", "_k"], "left")
    entity = F.when(F.col("_n") == 1, F.col("_one")).when((F.col("_n") > 1) & (F.col("_na") == 1), F.col("_act")).when(F.col("_n") == 0, F.col("_alias"))
    status = F.when(F.col("_n") == 1, "name").when((F.col("_n") > 1) & (F.col("_na") == 1), "disambiguated").when(F.col("_n") > 1, "ambiguous").when(F.col("_alias").isNotNull(), "alias").otherwise("unmatched")
    return full.select("row_id", entity.alias("entity"), status.alias("status"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Different, and one insertion, deletion, substitution or swap of neighbours apart."""
    la, lb = F.length(a), F.length(b)
    # A swap: equal lengths, exactly two differing positions next to each other, crossed.
    diff = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), la)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    first = F.try_element_at(diff, F.lit(1))
    crossed = (F.substr(a, first, F.lit(1)) == F.substr(b, first + 1, F.lit(1))) & (F.substr(a, first + 1, F.lit(1)) == F.substr(b, first, F.lit(1)))
    swap = (la == lb) & (F.size(diff) == 2) & (F.try_element_at(diff, F.lit(-1)) == first + 1) & crossed
    return (a != b) & ((F.levenshtein(a, b) == 1) | F.coalesce(swap, F.lit(False)))


def _indels(a: int, b: int) -> tuple[int, int]:
    """Letters left out of and put into a name of ``a`` letters at most, to get one of ``b``, no fewer, with a ratio of 0.9."""
    out = ((a + b) // 10 - (b - a)) // 2
    return out, out + b - a


def _pieces(n: str) -> list[str]:
    """For each length that a name as long or longer may have: this one in pieces, one of which is unchanged in such a name."""
    keys = []
    for size in range(len(n), 11 * len(n) // 9 + 1):
        out, put = _indels(len(n), size)
        k = out + put + 1
        keys += [f"{len(n)}|{size}|{i}|{n[len(n) * i // k : len(n) * (i + 1) // k]}" for i in range(k if out >= 0 and k > 1 else 0)]
    return keys


def _piece_places(n: str) -> list[str]:
    """The pieces that names as long or shorter may share with this one, within the shifts that the ratio allows."""
    keys = set()
    for size in range(-(-9 * len(n) // 11), len(n) + 1):
        out, put = _indels(size, len(n))
        k = out + put + 1
        for i in range(k if out >= 0 and k > 1 else 0):
            at, end = size * i // k, size * (i + 1) // k
            keys.update(f"{size}|{len(n)}|{i}|{n[at + s : end + s]}" for s in range(-out, put + 1) if at + s >= 0 and end + s <= len(n))
    return sorted(keys)


def duplicate_pairs(people: DataFrame, key: str, name: str) -> DataFrame:
    """(left, right, rule) of names that may be one person, by ordered rules over blocking keys.

    Rules: same_words, same_letters, one_edit, subset, surname_initial, similar (a ratio of 0.9 in either order). Blocks
    are the sorted words, the sorted letters, the glued name with one letter left out, surname with initial, a name's
    rarest word among the words of others (subset), and pieces of the name (similar; by lengths, with letters that fit): no pair of a rule is left out.
    """
    @F.pandas_udf("array<string>")
    def pieces(s: pd.Series) -> pd.Series:
        return s.map(_pieces)

    @F.pandas_udf("array<string>")
    def places(s: pd.Series) -> pd.Series:
        return s.map(_piece_places)

    @F.pandas_udf("long")
    def bits(s: pd.Series) -> pd.Series:
        return s.map(letters).astype("uint64").astype("int64")

    p = people.select(F.col(key).alias("id"), fold_column(F.col(name)).alias("n")).where("n <> ''")
    words = lambda n: F.array_sort(F.split(n, " "))
    glued = lambda n: F.replace(n, F.lit(" "), F.lit(""))
    sorted_letters = lambda n: F.array_join(F.array_sort(F.split(glued(n), "")), "")
    # Keys are shuffled as hashes; what meets by chance fits no rule.
    hashed = lambda keys: F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("k")
    n, g = F.col("n"), glued("n")
    last, head = F.element_at(F.split(n, " "), -1), F.substring(n, 1, 1)
    cuts = F.transform(F.sequence(F.lit(1), F.length(g)), lambda i: F.concat(F.lit("e"), F.substr(g, F.lit(1), i - 1), F.substr(g, i + 1)))
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("w"), F.array_join(words(n), " ")), F.concat(F.lit("l"), sorted_letters(n)), F.concat(F.lit("i"), head, last), F.concat(F.lit("e"), g)), cuts))
    b = p.select("id", hashed(keys))
    # Spark takes exploded keys to be as small as the names and would broadcast them; merge joins keep them off the driver.
    merged = lambda x, y: x.join(y.withColumnsRenamed({c: f"_{c}" for c in y.columns if c != "k"}).hint("merge"), "k")
    blocked = merged(b, b).where("id < _id").select(F.col("id").alias("a_id"), F.col("_id").alias("b_id"))
    word = p.select("id", F.explode(F.array_distinct(words(n))).alias("k"))
    rarest = word.join(word.groupBy("k").count().hint("merge"), "k").groupBy("id").agg(F.min(F.struct("count", "k"))["k"].alias("k"))
    # Pieces of given names are shared by a share of all names, whose pairs grow with the square; the letters tell most apart where
    # they meet, before anything is shuffled.
    sized = p.select("id", "n", F.length("n").alias("size"), bits("n").alias("bits"))
    near = merged(*(sized.select("id", "size", "bits", hashed(f("n"))) for f in (pieces, places)))
    lost, more = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("_bits"))), F.bit_count(F.col("_bits").bitwiseAND(F.bitwise_not("bits")))
    near = near.where(lost + more <= F.floor((F.col("size") + F.col("_size")) / 10)).where((lost <= F.floor((F.floor((F.col("size") + F.col("_size")) / 10) - F.col("_size") + F.col("size")) / 2)))
    for met in (merged(rarest, word), near):
        blocked = blocked.unionByName(met.where("id <> _id").select(F.least("id", "_id").alias("a_id"), F.greatest("id", "_id").alias("b_id")))
    whole = p.distinct()
    side = lambda s: whole.select(*(F.col(c).alias(f"{s}_{c}") for c in whole.columns))
    pairs = blocked.distinct().join(side("a").hint("merge"), "a_id").join(side("b").hint("merge"), "b_id")
    pairs = pairs.withColumns({f"{s}_{c}": f(f"{s}_n") for s in "ab" for c, f in (("w", words), ("g", glued), ("l", sorted_letters))})
    subset = (F.size(F.array_except("a_w", "b_w")) == 0) | (F.size(F.array_except("b_w", "a_w")) == 0)
    initial = (F.element_at(F.split("a_n", " "), -1) == F.element_at(F.split("b_n", " "), -1)) & (F.substring("a_n", 1, 1) == F.substring("b_n", 1, 1))
    rule = F.when(F.col("a_w") == F.col("b_w"), "same_words").when(F.col("a_l") == F.col("b_l"), "same_letters").when(within_one_edit(F.col("a_g"), F.col("b_g")), "one_edit").when(subset, "subset").when(initial, "surname_initial")
    near_enough = F.levenshtein("a_n", "b_n") * 10 <= F.length("a_n") + F.length("b_n")
    ruled = stored(pairs.withColumn("rule", rule).where(F.col("rule").isNotNull() | near_enough).select("a_id", "b_id", "a_n", "b_n", "rule"), "ruled")
    like = ruled.where("rule is null")
    like = like.where(F.greatest(ratio(F.col("a_n"), F.col("b_n")), ratio(F.col("b_n"), F.col("a_n"))) >= 0.9).withColumn("rule", F.lit("similar"))
    return ruled.where("rule is not null").unionByName(like).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), "rule")


def best_similarity(df: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """Adds the similarity of two name columns; an Arrow function, each distinct pair is compared once."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def sim(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return df.join(df.select(a, b).distinct().withColumn(name, sim(a, b)), [a, b])
