"""Differences between two copies of data, field by field (problem 2).

Both copies are cut into hash buckets by their key and cogrouped as Arrow tables. Within a bucket the keys are
aligned by sorted search, columns are compared through null-aware masks, and the cells under a mask come out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.names import similarity
from tallyspan.operators.cogrouped import by_bucket
from tallyspan.session import buckets_for

MISSING_LEFT, MISSING_RIGHT = "missing_left", "missing_right"
CELLS = "key long, field string, left_value string, right_value string"


def _text(column: pa.ChunkedArray, at: np.ndarray) -> pa.Array:
    taken = column.take(pa.array(at))
    taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
    return taken if pa.types.is_string(taken.type) else pc.cast(taken, pa.string())


def align(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs with equal keys (all of them, where keys repeat), and the rows of either side without partner."""
    r_order = np.argsort(right, kind="stable")
    r_sorted = right[r_order]
    lo, hi = np.searchsorted(r_sorted, left, "left"), np.searchsorted(r_sorted, left, "right")
    n = hi - lo
    li = np.repeat(np.arange(len(left)), n)
    ri = r_order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if n.sum() else np.zeros(0, np.int64)
    lone = np.ones(len(right), bool)
    lone[ri] = False
    return li, ri.astype(np.int64), np.flatnonzero(n == 0), np.flatnonzero(lone)


def _masked(keys: np.ndarray, field: str, mask: np.ndarray, left: pa.Array, right: pa.Array) -> pa.Table:
    at = np.flatnonzero(mask)
    take = pa.array(at)
    return pa.table({"key": pa.array(keys[at], pa.int64()), "field": pa.array([field] * len(at), pa.string()), "left_value": left.take(take), "right_value": right.take(take)})


def _one_sided(keys: np.ndarray, field: str) -> pa.Table:
    none = pa.nulls(len(keys), pa.string())
    return pa.table({"key": pa.array(keys, pa.int64()), "field": pa.array([field] * len(keys), pa.string()), "left_value": none, "right_value": none})


def column_masks(left: pa.Table, right: pa.Table, li: np.ndarray, ri: np.ndarray, fields: list[str], silent_nulls: bool) -> dict[str, tuple[np.ndarray, pa.Array, pa.Array]]:
    """For each field the mask of pairs that differ, and both values as text."""
    out = {}
    for f in fields:
        a, b = _text(left.column(f), li), _text(right.column(f), ri)
        na, nb = np.asarray(a.is_null()), np.asarray(b.is_null())
        unequal = ~np.asarray(pc.fill_null(pc.equal(a, b), False))
        out[f] = (unequal & ~na & ~nb if silent_nulls else unequal & ~(na & nb), a, b)
    return out


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], *, silent_nulls: bool = False, rows: int | None = None, extra: Callable | None = None) -> DataFrame:
    """Rows missing on either side and cells that differ: (key, field, left_value, right_value).

    ``field`` is ``missing_left``, ``missing_right`` or a column name; values are text. Two nulls are equal; a
    null and a value differ, unless ``silent_nulls``. Where a key repeats, each pair of its rows is compared;
    rows with a null key belong to no pair and are left out. Other columns, also of clashing names, don't
    matter; empty copies give the other side's rows as missing. ``extra(left, right, li, ri)`` may replace
    the comparison of aligned rows; it gets the Arrow tables and gives a table of cells.
    """
    n = buckets_for(left.sparkSession, rows if rows is not None else left.count() + right.count())
    cut = lambda d: d.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("long"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ka, kb = a.column(key).to_numpy(), b.column(key).to_numpy()
        li, ri, only_a, only_b = align(ka, kb)
        parts = [_one_sided(np.unique(kb[only_b]), MISSING_LEFT), _one_sided(np.unique(ka[only_a]), MISSING_RIGHT)]
        if extra is not None:
            parts.append(extra(a, b, li, ri))
        else:
            parts += [_masked(ka[li], f, m, x, y) for f, (m, x, y) in column_masks(a, b, li, ri, fields, silent_nulls).items()]
        return pa.concat_tables([p.cast(pa.schema([("key", pa.int64()), ("field", pa.string()), ("left_value", pa.string()), ("right_value", pa.string())])) for p in parts])

    keep = dict.fromkeys([key, *fields])
    a = left.select(*(F.col(c) for c in keep if c in left.columns))
    b = right.select(*(F.col(c) for c in keep if c in right.columns))
    if extra is not None:
        a, b = left, right
    return by_bucket(cut(a), cut(b), F.col(key), F.col(key), n, run, CELLS)


# Bouts: typed names of one copy against persons of the other.

PAIR = "_pair"
_NOBODY, _DRAW, _NO_CONTEST = -1, -2, -3


def _person_codes(a: pa.Table, b: pa.Table, li: np.ndarray, ri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the persons in the red and the blue corner of the typed rows; 0 unknown, -1 somebody else."""
    red, blue = a.column("red_name").take(pa.array(li)).to_pylist(), a.column("blue_name").take(pa.array(li)).to_pylist()
    name_a, name_b = b.column("name_a").take(pa.array(ri)).to_pylist(), b.column("name_b").take(pa.array(ri)).to_pylist()
    id_a, id_b = (pc.fill_null(b.column(c), 0).to_numpy()[ri] for c in ("a", "b"))
    order = np.empty(len(li), np.int8)
    for i, (r, u, x, y) in enumerate(zip(red, blue, name_a, name_b, strict=True)):
        if r is not None and r == x or u is not None and u == y:
            straight, crossed = 2.0, (r is not None and r == y) + (u is not None and u == x)
        elif r is not None and r == y or u is not None and u == x:
            straight, crossed = 0.0, 2.0
        else:
            straight, crossed = similarity(r, x) + similarity(u, y), similarity(r, y) + similarity(u, x)
        typed = bool(r and r.strip()) or bool(u and u.strip())
        order[i] = 1 if straight > crossed else 2 if crossed > straight else 3 if typed and x and y and straight == 0 else 0
    pick = lambda one, two: np.select([order == 1, order == 2, order == 3], [one, two, np.full(len(li), _NOBODY)], 0)
    return pick(id_a, id_b), pick(id_b, id_a)


def bout_cells(a: pa.Table, b: pa.Table, li: np.ndarray, ri: np.ndarray) -> pa.Table:
    """Cells ``red``, ``winner`` and ``event_date`` of bouts, and one cell ``_pair`` for each aligned row
    with the typed names, the held date and whether anything of the bout differs."""
    keys = a.column("fight_id").to_numpy()[li]
    red_id, blue_id = _person_codes(a, b, li, ri)
    ref_red = pc.fill_null(b.column("red"), 0).to_numpy()[ri]
    label = np.array(pc.fill_null(a.column("label"), "").to_pylist(), object)[li]
    typed_winner = np.select([label == "red", label == "blue", label == "draw", label == "no_contest"], [red_id, blue_id, np.full(len(li), _DRAW), np.full(len(li), _NO_CONTEST)], 0)
    outcome = np.array(pc.fill_null(b.column("outcome"), "").to_pylist(), object)[ri]
    ref_winner = np.select([outcome == "win", outcome == "draw", outcome == "no_contest"], [pc.fill_null(b.column("winner"), 0).to_numpy()[ri], np.full(len(li), _DRAW), np.full(len(li), _NO_CONTEST)], 0)
    (dates, day_a, day_b) = column_masks(a, b, li, ri, ["event_date"], True)["event_date"]
    masks = {"red": (red_id != ref_red) & (red_id != 0) & (ref_red != 0), "winner": (typed_winner != ref_winner) & (typed_winner != 0) & (ref_winner != 0), "event_date": dates}
    as_text = lambda x: pc.cast(pa.array(x, pa.int64()), pa.string())
    values = {"red": (as_text(red_id), as_text(ref_red)), "winner": (as_text(typed_winner), as_text(ref_winner)), "event_date": (day_a, day_b)}
    parts = [_masked(keys, f, m, *values[f]) for f, m in masks.items()]
    uniq, inverse = np.unique(keys, return_inverse=True)
    differs = np.zeros(len(uniq), bool)
    np.logical_or.at(differs, inverse, np.logical_or.reduce(list(masks.values())) if len(keys) else np.zeros(0, bool))
    # Only rows that a verdict names need the pair cell.
    named = np.asarray(pc.is_valid(a.column("verdict_kind")))[li]
    blames = np.array(a.column("verdict_kind").to_pylist(), object)[li] == "blame"
    same_day = np.asarray(pc.fill_null(pc.equal(_text(a.column("verdict_date"), li), day_b), False))
    wrong = named & same_day & (blames != differs[inverse])
    parts.append(_masked(keys, "verdict", wrong, _text(a.column("verdict_kind"), li), as_text(differs[inverse].astype(np.int64))))
    return pa.concat_tables(parts)


def _pair_key(x: Column, y: Column) -> Column:
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return F.array_join(F.array_sort(F.array(plain(x), plain(y))), "|")


def verdict_kind(verdict: Column) -> Column:
    """``blame`` or ``agree``; null if the verdict is null or leaves it open."""
    v = F.lower(F.trim(verdict))
    return F.when(v.rlike(r"no (disagreement|difference)|\b(agree|same|identical)\b|(not|neither|nothing)\b.*wrong"), "agree").when(v.rlike(r"wrong|incorrect|mistake|error|at fault"), "blame")


def winner_label(winner: Column) -> Column:
    """red, blue, draw or no_contest from a typed label; null for others."""
    w = F.regexp_replace(F.lower(F.trim(winner)), r"[\s_-]+", " ")
    return F.when(w.isin("red", "blue", "draw"), w).when(w.isin("no contest", "nc"), "no_contest")


def bout_differences(typed: DataFrame, held: DataFrame, fighters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Disagreements of typed bout rows with the held ones: distinct (fight_id, field).

    Fields: ``missing_mdabbert``, ``missing_fight_ref``, ``red``, ``winner``, ``event_date``, ``verdict``. Nulls,
    the outcome ``unknown`` and labels that mean nothing are silent. A repeated typed row counts as one; if
    repeats disagree, a field differs if it differs in one of them. Verdicts meet the typed row by its two
    names up to case and blanks, in any order, and the held date.
    """
    names = fighters.select("id", "name")
    held = held.select("fight_id", "a", "b", "event_date", "red", "winner", F.lower("outcome").alias("outcome"))
    held = held.join(names.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a", "left").join(names.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b", "left")
    typed = typed.where("fight_id is not null").select("fight_id", "red_name", "blue_name", F.col("bout_date").alias("event_date"), winner_label(F.col("winner")).alias("label")).distinct()
    said = verdicts.select(_pair_key(F.col("fighter_1"), F.col("fighter_2")).alias(PAIR), F.col("event_date").alias("verdict_date"), verdict_kind(F.col("verdict")).alias("verdict_kind")).where(f"verdict_kind is not null and {PAIR} is not null").distinct()
    typed = typed.withColumn(PAIR, _pair_key(F.col("red_name"), F.col("blue_name"))).join(said, PAIR, "left").drop(PAIR)
    cells = differences(typed, held, "fight_id", [], extra=bout_cells)
    field = F.when(F.col("field") == MISSING_LEFT, "missing_mdabbert").when(F.col("field") == MISSING_RIGHT, "missing_fight_ref").otherwise(F.col("field"))
    return cells.select(F.col("key").alias("fight_id"), field.alias("field")).distinct()
