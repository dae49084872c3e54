"""The N best rows of every group, by bisecting all groups at once.

Every row has a code: the words of its order columns, larger is better, the last one an identifier, so that no two rows of a group have
the same. For each group a cutoff is refined until exactly N codes lie at or above it. A round splits each group's interval at
``fan - 1`` midpoints and counts the rows between them; counts combine on the map side, so a group of any size costs a task at most ``fan``
rows of output. Where the interval shrinks to one value (a tie), the next word goes on. Intervals are tightened to the values that occur, so
a 64-bit word takes few rounds. After the first round only rows at or above the lower bounds are kept for the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seriate.session import materialize

#: Cutoffs of so many groups (under 100 bytes each) are broadcast. Of more groups those with the most rows are, at most this many; the rows of the
#: others, each with fewer than that share of all rows, are joined with theirs by a shuffle.
BROADCAST_GROUPS = 200_000
LEAST = -(2**63)


def double_code(x: Column) -> Column:
    """A long in the order of the doubles: their IEEE bits, computed from exponent and mantissa. NaN is above infinity, -0.0 equals 0.0."""
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    e = F.when(two(guess) > a, guess - 1).when(a / two(guess) >= 2, guess + 1).otherwise(guess)
    normal = (e.cast("long") + 1023) * F.lit(2**52) + ((a / two(e) - 1) * F.lit(float(2**52))).cast("long")
    # Below 2**-1021 the steps are even: whole multiples of the least positive double.
    small = (a * F.lit(float(2**537)) * F.lit(float(2**537))).cast("long")
    code = F.when(F.isnan(x), F.lit(2047 * 2**52 + 1)).when(a == float("inf"), F.lit(2047 * 2**52)).when(a < 2.0**-1021, small).otherwise(normal)
    return F.when(x < 0, -code).otherwise(code)


def order_word(df: DataFrame, col: str, descending: bool) -> Column:
    """The word of an order column: a long, larger is better. A null is the worst."""
    kind, c = df.schema[col].dataType.typeName(), F.col(col)
    if kind in ("double", "float"):
        word = double_code(c.cast("double"))
    elif kind in ("byte", "short", "integer", "long", "boolean"):
        word = c.cast("long")
    elif kind == "date":
        word = F.unix_date(c).cast("long")
    elif kind == "timestamp":
        word = F.unix_micros(c)
    elif kind == "timestamp_ntz":  # without the session's time zone
        second = F.expr(f"CAST(extract(SECOND FROM `{col}`) * 1000000 AS BIGINT)")
        word = F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second
    else:
        raise TypeError(f"{col}: a {kind} column can't be an order column")
    return F.coalesce(word if descending else F.bitwise_not(word), F.lit(LEAST))


def top_n(df: DataFrame, groups: list[str], order: list[tuple[str, bool]], n: int, fan: int = 256, unique: bool = False) -> DataFrame:
    """The ``n`` first rows of each group in the order of ``order``, pairs of a column and whether it descends; all rows of smaller groups.

    Columns of the result: ``groups``, then the order columns. The last order column should identify a row within its group; rows that agree
    on all order columns can't be told apart and count once; they are dropped first, unless the caller knows by ``unique`` that there are none. Rows with a null in a group column or in the first order column (the
    score) take no part; nulls in later order columns come last. Any other column is ignored. An empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [c for c, _ in order]
    last = len(order) - 1
    kept = df.select(*dict.fromkeys([*groups, *names]))
    for c in [*groups, names[0]]:
        kept = kept.where(F.col(c).isNotNull())
    if not unique:
        kept = kept.distinct()
    words = [f"__w{i}" for i in range(len(order))]
    coded = kept.select("*", *[order_word(kept, c, d).alias(w) for (c, d), w in zip(order, words)])
    rows = materialize(coded, "coded")

    # Groups and the range of their first word. A state row: level (the word being bisected), the fixed words before it, the interval
    # lo..hi of the level's word, and how many rows are needed from it.
    state = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.min("__w0").alias("__lo"), F.max("__w0").alias("__hi"))
    fixed = [f"__p{i}" for i in range(last)]
    state = state.select(
        *groups, F.lit(0).alias("__level"), *[F.lit(LEAST).alias(p) for p in fixed], F.col("__lo"), F.col("__hi"),
        F.lit(n).cast("long").alias("__need"), (F.col("__n") <= n).alias("__done"), F.col("__n").alias("__size"),
    )
    state = materialize(state, "cutoffs")
    n_groups, n_todo, n_rows = state.agg(F.count(F.lit(1)), F.count_if(~F.col("__done")), F.coalesce(F.sum("__size"), F.lit(0))).first()
    # At most BROADCAST_GROUPS groups can hold more than this.
    hot = n_rows / BROADCAST_GROUPS if n_groups > BROADCAST_GROUPS else None
    pool, first = rows, True
    while n_todo:
        state = materialize(_refine(pool, state, hot, groups, words, fixed, fan), "cutoffs")
        if first:
            pool, first = materialize(_at_or_above(pool, state, hot, groups, words, fixed).select(*rows.columns), "survivors"), False
        n_todo = state.where(~F.col("__done")).count()
    found = _at_or_above(pool, state, hot, groups, words, fixed)
    return found.select(*groups, *[c for c in names if c not in groups])


def _with_state(rows: DataFrame, state: DataFrame, hot: float | None, groups: list[str]) -> DataFrame:
    """Rows with the cutoffs of their groups. ``hot``: groups of more rows are looked up in a broadcast, others by a shuffle; None: all in a broadcast."""
    if hot is None:
        return rows.join(F.broadcast(state), groups)
    often = F.broadcast(state.where(F.col("__size") > hot))
    seldom = rows.join(often.select(*groups), groups, "left_anti").join(state.where(F.col("__size") <= hot), groups)
    return rows.join(often, groups).unionByName(seldom)


def _at_level(cols: list[str]) -> Column:
    out = F.col(cols[-1])
    for i in range(len(cols) - 2, -1, -1):
        out = F.when(F.col("__level") == i, F.col(cols[i])).otherwise(out)
    return out


def _at_or_above(rows: DataFrame, state: DataFrame, hot: float | None, groups: list[str], words: list[str], fixed: list[str]) -> DataFrame:
    """Rows at or above their group's lower bound."""
    joined = _with_state(rows, state, hot, groups)
    keep = F.col(words[-1]) >= F.col("__lo")
    for i in range(len(words) - 2, -1, -1):
        w = F.col(words[i])
        keep = F.when(F.col("__level") == i, w >= F.col("__lo")).otherwise((w > F.col(fixed[i])) | ((w == F.col(fixed[i])) & keep))
    return joined.where(keep)


def _refine(pool: DataFrame, state: DataFrame, hot: float | None, groups: list[str], words: list[str], fixed: list[str], fan: int) -> DataFrame:
    """One round: count the rows between the midpoints of every open interval and keep the part in which the n-th row lies."""
    todo = state.where(~F.col("__done"))
    joined = _with_state(pool, todo, hot, groups)
    w = _at_level(words)
    inside = (w >= F.col("__lo")) & (w <= F.col("__hi"))
    for i, p in enumerate(fixed):
        inside = inside & ((F.col("__level") <= i) | (F.col(words[i]) == F.col(p)))
    after = _at_level([*words[1:], words[-1]])
    lo, hi = F.col("__lo"), F.col("__hi")
    # Any function that never falls as w grows will do. Intervals wider than a long are measured in doubles.
    width = hi.cast("double") - lo.cast("double")
    share = F.when(width > 9e18, (w.cast("double") - lo.cast("double")) / width).otherwise(F.try_subtract(w, lo).cast("double") / (F.try_subtract(hi, lo).cast("double") + 1))
    part = F.least(F.floor(share * fan).cast("int"), F.lit(fan - 1))
    counted = joined.where(inside).select(*groups, w.alias("__w"), after.alias("__a"), part.alias("__part")).groupBy(*groups, "__part").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__w").alias("__min"), F.max("__w").alias("__max"), F.min("__a").alias("__amin"), F.max("__a").alias("__amax")
    )
    # At most `fan` rows a group.
    down = W.Window.partitionBy(*groups).orderBy(F.desc("__part")).rowsBetween(W.Window.unboundedPreceding, 0)
    upto = counted.withColumn("__upto", F.sum("__c").over(down)).join(todo, groups)
    need = F.col("__need") - (F.col("__upto") - F.col("__c"))
    hit = upto.where((F.col("__upto") >= F.col("__need")) & (need > 0))
    exact, tie = F.col("__c") == need, F.col("__min") == F.col("__max")
    deeper = tie & ~exact & (F.col("__level") < len(words) - 1)
    stuck = tie & (F.col("__level") == len(words) - 1)
    moved = hit.select(
        *groups, F.when(deeper, F.col("__level") + 1).otherwise(F.col("__level")).alias("__level"),
        *[F.when(deeper & (F.col("__level") == i), F.col("__min")).otherwise(F.col(p)).alias(p) for i, p in enumerate(fixed)],
        F.when(deeper, F.col("__amin")).otherwise(F.col("__min")).alias("__lo"), F.when(deeper, F.col("__amax")).otherwise(F.col("__max")).alias("__hi"),
        need.alias("__need"), (exact | stuck).alias("__done"), "__size",
    )
    return moved.unionByName(state.where("__done"))
