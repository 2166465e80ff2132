"""Joins and lookups: equality joins in which null equals null; Catalyst and adaptive execution choose how."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core.runtime import materialise, shuffle_partitions
from millrace.frame import Frame, Order
from millrace.registry import Context, Params, step

#: pairs of a multiway join that one task forms, and the most tasks that a join is shared by
PAIRS_A_TASK, MOST_TASKS = 4_000_000, 10_000


def _shifted(f: Frame, by: int, side: str) -> Frame:
    """Fields renamed to start at `by`, order columns to the side's own."""
    order = {o: f"__{side}{i}" for i, o in enumerate(f.keep())}
    df = f.df.select(*[F.col(f"c{i}").alias(f"c{by + i}") for i in range(f.width)], *[F.col(o).alias(n) for o, n in order.items()])
    return Frame(df, f.names, tuple(Order(order[o.column], o.descending) for o in f.order), f.text)


def _pair(left: Frame, right: Frame, on: list[tuple[int, int]], how: str, step_no: int = 0) -> Frame:
    """Fields of left, then of right. The order is left's, then right's; unmatched right rows come last."""
    a, b = left, _shifted(right, left.width, f"j{step_no}_")
    condition = reduce(Column.__and__, [F.col(f"c{i}").eqNullSafe(F.col(f"c{left.width + k}")) for i, k in on]) if on else None
    df = a.df.crossJoin(b.df) if condition is None else a.df.join(b.df, condition, how)
    return Frame(df, left.names + right.names, left.order + b.order, left.text)


@step("MergeJoin")
def merge_join(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Inputs need not be sorted; unmatched sides are null; an unknown joinType is a full outer join."""
    left, right = ins
    a = [left.index(x) for x in p.items_of("leftColumns")]
    b = [right.index(x) for x in p.items_of("rightColumns")]
    if not a or len(a) != len(b):
        raise ValueError("MergeJoin needs as many leftColumns as rightColumns, and at least one")
    how = {"INNER": "inner", "LEFT OUTER": "left", "RIGHT OUTER": "right"}.get(p.text("joinType", "INNER").upper(), "full")
    return _pair(left, right, list(zip(a, b, strict=True)), how)


@step("StreamLookup")
def stream_lookup(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Every row of the main input with the values of the first lookup row of its key, or nulls. Which side is sent
    where follows from its measured size."""
    at = p.integer("lookupInputIndex", 1)
    look, main = ins[at], ins[1 - at]
    keys = [main.index(x) for x in p.items_of("keyStreamCols")]
    own = [look.index(x) for x in p.items_of("keyLookupCols")]
    values = [look.index(x) for x in p.items_of("valueFieldCols")]
    names = p.items_of("valueRenames") or [look.names[v] for v in values]
    first, place = look.placed()
    picked = F.min_by(F.struct(*[first.col(v).alias(f"v{k}") for k, v in enumerate(values)]), place).alias("__v")
    table = first.df.groupBy(*[first.col(k).alias(f"__k{i}") for i, k in enumerate(own)]).agg(picked)
    if not own:
        table = table.where(F.col("__v").isNotNull())
        df = main.df.join(table, F.lit(True), "left")
    else:
        df = main.df.join(table, reduce(Column.__and__, [F.col(f"c{k}").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]), "left")
    return Frame(df, main.names, main.order, main.text).append(*[F.col("__v")[f"v{k}"] for k in range(len(values))], names=names)


def _hot(ins: list[Frame], at: list[int]) -> list[tuple[DataFrame, int]]:
    """For each join of the inputs before with the next: its keys of more than PAIRS_A_TASK pairs, and the pairs of those.

    Only counts by key are joined here, none of the inputs' rows. `pieces`: how many tasks are to share a key's pairs;
    `wide`: the rows before are more than the next input's.
    """
    counts = None
    for i, (f, k) in enumerate(zip(ins, at, strict=True)):
        n = f.df.groupBy(F.col(f"c{k}").alias(f"k{i}")).agg(F.count(F.lit(1)).cast("double").alias(f"n{i}"))
        counts = n if counts is None else counts.join(n, F.col("k0").eqNullSafe(F.col(f"k{i}"))).drop(f"k{i}")
        if i:
            counts = counts.withColumn(f"wide{i}", F.col("n") >= F.col(f"n{i}")).withColumn(f"most{i}", F.greatest("n", f"n{i}")).withColumn("n", F.col("n") * F.col(f"n{i}")).withColumn(f"pairs{i}", F.col("n"))
        else:
            counts = counts.withColumn("n", F.col("n0"))
    counts = materialise(counts)
    sums = counts.agg(*[F.sum(F.when(F.col(f"pairs{i}") > PAIRS_A_TASK, F.col(f"pairs{i}"))).alias(f"s{i}") for i in range(1, len(ins))]).first()
    pieces = lambda i: F.least(F.ceil(F.col(f"pairs{i}") / PAIRS_A_TASK), F.col(f"most{i}").cast("long"), F.lit(MOST_TASKS)).cast("int")
    return [(counts.where(F.col(f"pairs{i}") > PAIRS_A_TASK).select(F.col("k0").alias("__k"), pieces(i).alias("__pieces"), F.col(f"wide{i}").alias("__wide")), int(sums[f"s{i}"] or 0)) for i in range(1, len(ins))]


def _shared(left: Frame, right: Frame, a: int, b: int, hot: DataFrame, pairs: int, step_no: int) -> Frame:
    """The inner pair, with the pairs of a hot key shared by several tasks: each row of the side with more rows of that key
    goes to one of its pieces, each of the other side to all. Nulls in a struct equal each other."""
    r = _shifted(right, left.width, f"j{step_no}_")
    n = min(max(shuffle_partitions(left.df.sparkSession), -(-pairs // PAIRS_A_TASK)), MOST_TASKS)

    def side(f: Frame, k: int, spread: Column, to: str) -> DataFrame:
        own = f.df.columns
        df = f.df.join(hot, F.col(f"c{k}").eqNullSafe(F.col("__k")), "left")
        one = F.array(F.pmod(F.xxhash64(*[F.col(x) for x in own]), F.col("__pieces").cast("long")).cast("int"))
        piece = F.when(F.col("__pieces").isNull(), F.array(F.lit(0))).when(spread, one).otherwise(F.sequence(F.lit(0), F.col("__pieces") - 1))
        df = df.select(*own, F.explode(piece).alias("__piece"))
        return df.select(*own, F.struct(F.col(f"c{k}").alias("k"), F.col("__piece").alias("p")).alias(to)).repartition(n, to)

    one, other = side(left, a, F.col("__wide"), "__l"), side(r, left.width + b, ~F.col("__wide"), "__r")
    return Frame(one.join(other, F.col("__l") == F.col("__r")).drop("__l", "__r"), left.names + right.names, left.order + r.order, left.text)


@step("MultiwayMergeJoin")
def multiway_merge_join(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Inner joins on one key. The rows of each key are counted first, as a few rows an input can have so many pairs that
    the tasks, which follow from the inputs' sizes, would be too few for them."""
    key, out = p.text("keyColumn", "0"), ins[0]
    at = [f.index(key) for f in ins]
    kinds = {f.df.schema[f"c{k}"].dataType.simpleString() for f, k in zip(ins, at, strict=True)}
    hot = _hot(ins, at) if len(ins) > 1 and len(kinds) == 1 else [(None, 0)] * len(ins)
    for i, right in enumerate(ins[1:]):
        keys, pairs = hot[i]
        out = _shared(out, right, at[0], at[i + 1], keys, pairs, i) if pairs else _pair(out, right, [(at[0], at[i + 1])], "inner", i)
    return out


@step("JoinRows")
def join_rows(ins: list[Frame], p: Params, c: Context) -> Frame:
    """The product of all inputs, which is what this step is asked for."""
    out = ins[0]
    for i, right in enumerate(ins[1:]):
        out = _pair(out, right, [], "inner", i)
    return out


@step("MergeRows")
def merge_rows(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Rows of the second input flagged new, identical or changed against the first, then the first's that are gone,
    flagged deleted. Of reference rows with one key the last counts."""
    width = max(x.width for x in ins[:2])
    (ref, at), new = ins[0].padded(width).placed(), ins[1].padded(width)
    keys = [ref.index(x) for x in p.items_of("keyColumns") or ["0"]]
    last = ref.df.groupBy(*[F.col(f"c{k}").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*[F.col(f"c{k}").alias(f"r{k}") for k in range(width)]), at).alias("__r"), F.max(at).alias("__rp"))
    own = new.df.withColumn("__in", F.lit(1))
    df = own.join(last, reduce(Column.__and__, [F.col(f"c{k}").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]), "full")
    gone, fresh = F.col("__in").isNull(), F.col("__r").isNull()
    same = reduce(Column.__and__, [F.col(f"c{k}").eqNullSafe(F.col("__r")[f"r{k}"]) for k in range(width)])
    flag = F.when(gone, "deleted").when(fresh, "new").when(same, "identical").otherwise("changed")
    values = [F.when(gone, F.col("__r")[f"r{k}"]).otherwise(F.col(f"c{k}")) for k in range(width)]
    order = [(gone.cast("int"), False), *[(F.col(o.column), o.descending) for o in new.order], (F.col("__rp"), False)]
    got = df.select(*[v.alias(f"c{k}") for k, v in enumerate(values)], flag.alias(f"c{width}"), *[x.alias(f"__o{i}") for i, (x, _) in enumerate(order)])
    return Frame(got, (*new.names, "flag"), tuple(Order(f"__o{i}", d) for i, (_, d) in enumerate(order)), new.text)
