"""Frames: a DataFrame with positional fields, logical names, and an order that costs nothing until it is needed.

The order of a scan has no column at first: steps that keep rows in their place, or drop some, leave it as it is, so
filters reach the scan; the first step that moves rows has it written down by `ordered()`.

Fields are the physical columns c0, c1, ...; names may repeat, as joins concatenate. `order` names further physical
columns that define the row order. Steps that don't depend on the order carry them along; those that do ask for
`positioned()`, which numbers the rows without ever sorting all of them in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from millrace.core.runtime import materialise, shuffle_partitions
from millrace.functions.scalar import number

#: rows that one window task looks at when neighbours are compared
BLOCK = 1 << 18
#: the sums of at most so many blocks, a number each, are sent to all executors
FEW_BLOCKS = 1_000_000
POS = "__pos"


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False
    source: int | None = None  # the field it is a copy of, as long as fields keep their places

    def key(self) -> Column:
        return F.col(self.column).desc_nulls_first() if self.descending else F.col(self.column).asc_nulls_last()


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    names: tuple[str, ...]
    order: tuple[Order, ...] = ()
    text: bool = False  # string profile: every field is a string
    total: int | None = None  # number of rows, where `positioned` counted them
    scan: bool = False  # the order is that of df's partitions and rows, and has no column yet

    @classmethod
    def of(cls, df: DataFrame, order: list[str] | None = None, text: bool = False) -> Frame:
        """`order`: columns of df by which its rows are ordered; without, the order of the scan."""
        fields = [F.col(f"`{c}`").cast("string") if text else F.col(f"`{c}`") for c in df.columns]
        keys = [F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order or [])]
        out = df.select(*[f.alias(f"c{i}") for i, f in enumerate(fields)], *keys)
        return cls(out, tuple(df.columns), tuple(Order(f"__o{i}") for i in range(len(keys))), text, scan=order is None)

    def ordered(self) -> Frame:
        """The frame with its order in columns."""
        if not self.scan:
            return self
        return replace(self, df=self.df.withColumn("__o0", F.monotonically_increasing_id()), order=(Order("__o0"),), scan=False)

    def place(self) -> Column | None:
        """One column by which the rows are in order, ascending; None where there is none (a descending order)."""
        if any(o.descending for o in self.order) or not self.order:
            return None
        one = self.order[0].column
        if len(self.order) == 1 and not self.df.schema[one].nullable:
            return F.col(one)
        return F.struct(*[x for o in self.order for x in (F.col(o.column).isNull(), F.col(o.column))])

    def placed(self) -> tuple[Frame, Column]:
        """A frame with such a column, numbered only if need be."""
        f = self.ordered()
        if f.place() is None:
            f = f.positioned()
        return f, f.place()

    @property
    def width(self) -> int:
        return len(self.names)

    def index(self, field: int | str) -> int:
        """A position; a string may be a position or, as an extension, a name."""
        try:
            return int(field)
        except ValueError:
            if field in self.names:
                return self.names.index(field)
            raise ValueError(f"no field {field!r} in {list(self.names)}") from None

    def col(self, field: int | str) -> Column:
        """The field, or null where there is none."""
        i = self.index(field)
        return F.col(f"c{i}") if 0 <= i < self.width else F.lit(None).cast("string")

    def is_numeric(self, field: int | str) -> bool:
        i = self.index(field)
        return 0 <= i < self.width and isinstance(self.df.schema[f"c{i}"].dataType, NumericType)

    def number(self, field: int | str) -> Column:
        """The field as a double, null where it is none; a numeric column is not taken through text."""
        return self.col(field).cast("double") if self.is_numeric(field) else number(self.col(field))

    def fields(self) -> list[Column]:
        return [F.col(f"c{i}") for i in range(self.width)]

    def keep(self) -> list[str]:
        return list(dict.fromkeys(o.column for o in self.order))

    def put(self, columns: list[Column], names: list[str] | tuple[str, ...]) -> Frame:
        """The frame with these fields instead; order columns stay."""
        df = self.df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], *self.keep())
        return replace(self, df=df, names=tuple(names), order=tuple(replace(o, source=None) for o in self.order))

    def set(self, i: int, column: Column) -> Frame:
        return self.put([column if k == i else c for k, c in enumerate(self.fields())], self.names)

    def append(self, *columns: Column, names: list[str] | None = None) -> Frame:
        new = names or [f"f{self.width + k}" for k in range(len(columns))]
        return self.put([*self.fields(), *columns], [*self.names, *new])

    def where(self, condition: Column) -> Frame:
        return replace(self, df=self.df.where(condition), total=None)

    def renamed(self, names: list[str]) -> Frame:
        return replace(self, names=tuple(names))

    def padded(self, width: int) -> Frame:
        more = width - self.width
        return self if more <= 0 else self.append(*[F.lit(None).cast("string")] * more)

    def with_order(self, keys: list[tuple[Column, bool]], before: tuple[Order, ...] | None = None, sources: list[int] | None = None) -> Frame:
        """The same rows ordered by these keys, ties as they were; `sources`: the fields that the keys are."""
        old = self.order if before is None else before
        taken = {o.column for o in old}
        names: list[str] = []
        n = 0
        while len(names) < len(keys):
            if f"__o{n}" not in taken:
                names.append(f"__o{n}")
            n += 1
        df = self.df.select(*self.fields(), *dict.fromkeys(o.column for o in old), *[k.alias(x) for (k, _), x in zip(keys, names, strict=True)])
        return replace(self, df=df, order=tuple(Order(x, d, s) for (_, d), x, s in zip(keys, names, sources or [None] * len(keys), strict=True)) + tuple(old), total=None)

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*[o.key() for o in self.order]) if self.order else self.df

    def to_df(self, names: list[str] | None = None) -> DataFrame:
        """The fields under their names (made unique), unordered."""
        return self.df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names or unique_names(self.names))])

    def positioned(self) -> Frame:
        """The frame with exact row numbers 0, 1, ... in POS, which is then its order.

        Range partitions by the order number their rows on their own; the counts of the partitions before, a number
        each, are added. The rows are written once, so that both readings see the same partitions.
        """
        if self.total is not None and [o.column for o in self.order] == [POS]:
            return self
        n = shuffle_partitions(self.df.sparkSession)
        keys = [o.key() for o in self.order]
        run = self.df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) if keys else self.df
        run = materialise(run.select(*self.fields(), F.monotonically_increasing_id().alias("__m")))
        part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
        counts = run.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n")).collect()  # a number a partition
        start, rows = 0, []
        for p, k in sorted((r["__p"], r["n"]) for r in counts):
            rows.append((p, start))
            start += k
        offsets = self.df.sparkSession.createDataFrame(rows, "__p long, __b long")
        df = run.withColumn("__p", part).join(F.broadcast(offsets), "__p").select(*self.fields(), (F.col("__b") + at).alias(POS))
        return replace(self, df=df, order=(Order(POS),), total=start, scan=False)

    def with_previous(self, columns: list[Column]) -> Frame:
        """A positioned frame with `__prev`, the struct of these columns in the row before (null in the first).

        Blocks of rows are looked at separately; the last row of each block is handed to the next by a join.
        """
        frame = self.positioned()
        block = F.floor(F.col(POS) / BLOCK).cast("long")
        own = frame.df.withColumn("__v", F.struct(*[c.alias(f"v{i}") for i, c in enumerate(columns)])).withColumn("__k", block)
        lagged = own.withColumn("__prev", F.lag("__v").over(Window.partitionBy("__k").orderBy(POS)))
        ends = own.where(F.col(POS) % BLOCK == BLOCK - 1).select((F.col("__k") + 1).alias("__k"), F.col("__v").alias("__end"), F.lit((0)).cast("long").alias("__first"))
        joined = lagged.withColumn("__first", F.col(POS) % BLOCK).join(ends, ["__k", "__first"], "left") if frame.total and frame.total > BLOCK else lagged.withColumn("__end", F.lit(None).cast(own.schema["__v"].dataType))
        return replace(frame, df=joined.select(*frame.fields(), POS, F.coalesce("__prev", "__end").alias("__prev")))


def running_sum(frame: Frame, value: str, out: str) -> DataFrame:
    """A positioned frame's rows with the sum of `value` up to and with each row, block by block."""
    df = frame.df
    block = F.floor(F.col(POS) / BLOCK).cast("long")
    own = df.withColumn("__k", block)
    inner = own.withColumn(out, F.sum(value).over(Window.partitionBy("__k").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)))
    sums = own.groupBy("__k").agg(F.sum(value).alias("__s"))  # a number a block
    before = sums.select(F.col("__k"), F.coalesce(F.sum("__s").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    few = frame.total is not None and frame.total <= BLOCK * FEW_BLOCKS  # else adaptive execution chooses
    return inner.join(F.broadcast(before) if few else before, "__k").withColumn(out, F.col(out) + F.col("__s")).drop("__k", "__s")


def unique_names(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        new, k = n, 1
        while new.lower() in {o.lower() for o in out}:
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def concat_orders(parts: list[Frame]) -> Frame:
    """The rows of all frames, one frame after the other, padded to the widest."""
    width = max(p.width for p in parts)
    widest = max(parts, key=lambda p: p.width)
    dfs = []
    for i, p in enumerate(q.padded(width) for q in parts):
        # one ascending column keeps each frame's order; anything else is numbered first
        if len(p.order) != 1 or p.order[0].descending or p.df.schema[p.order[0].column].dataType.typeName() != "long":
            p = p.positioned()
        fields = [(F.col(f"c{k}").cast("string") if p.text else F.col(f"c{k}")).alias(f"c{k}") for k in range(width)]
        dfs.append(p.df.select(*fields, F.lit(i).alias("__o0"), F.col(p.order[0].column).alias("__o1")))
    df = dfs[0]
    for d in dfs[1:]:
        df = df.unionByName(d)
    names = parts[0].names + widest.names[parts[0].width :]
    return Frame(df, names, (Order("__o0"), Order("__o1")), any(p.text for p in parts))
