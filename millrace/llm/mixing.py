"""Mixing sources to target shares of the total size.

Every document gets a hash-random key; the documents are range-sorted by (source, key), each partition sums its sizes up
to each document, and the sums of the partitions before it (one a source and partition) turn them into prefix sums of
the source. A source's budget is then whole epochs of all its documents, and in the last epoch the prefix that comes
nearest to what is left. No source repeats a document more often than allowed; what it then lacks is reported.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.core.runtime import materialise, sorted_scan



def sized_prefixes(sizes: DataFrame, key: str, source: str, size: str, seed: int, partitions: int | None = None) -> DataFrame:
    """(key, source, size, upto, source_size): upto is the sum of sizes up to and with the row in its source's order.

    The order is by the MD5 of seed and key, then key. Rows without a source are a source of their own. The key may
    have any type that can be sorted.
    """
    id_type = sizes.schema[key].dataType.simpleString()
    own = sizes.select(F.col(source).cast("string").alias("source"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).alias("at"), F.col(key).alias("doc"), F.col(size).cast("long").alias("size"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, sums, names, kind = TaskContext.get().partitionId(), {}, ["kind", "source", "doc", "size", "upto", "pid"], None
        for b in batches:
            if not b.num_rows:
                continue
            n, kind = b.num_rows, b.column("doc").type
            source_, size_ = b.column("source"), b.column("size").to_numpy(zero_copy_only=False)
            code = source_.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            total = np.cumsum(size_)
            base = (total - size_)[head]
            labels = source_.take(pa.array(head)).to_pylist()
            carried = np.array([sums.get(x, 0) for x in labels])
            run = np.cumsum(np.r_[False, code[1:] != code[:-1]])
            upto = total - base[run] + carried[run]
            for x, t in zip(labels, np.r_[head[1:], n] - 1, strict=True):
                sums[x] = int(upto[t])
            yield pa.RecordBatch.from_arrays([pa.array(["doc"] * n), source_, b.column("doc"), pa.array(size_, pa.int64()), pa.array(upto, pa.int64()), pa.array(np.full(n, pid), pa.int32())], names)
        k = len(sums)
        if not k:
            return
        yield pa.RecordBatch.from_arrays([pa.array(["sum"] * k, pa.string()), pa.array(list(sums), pa.string()), pa.nulls(k, kind), pa.array(list(sums.values()), pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.full(k, pid), pa.int32())], names)

    found = sorted_scan(own, ["source", "at", "doc"], scan, f"kind string, source string, doc {id_type}, size long, upto long, pid int", partitions)
    # one row a source and partition it lies in: at most sources + partitions rows
    same = Window.partitionBy("source")
    before = same.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.where("kind = 'sum'").select(F.col("source").alias("s"), F.col("pid").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(same).alias("source_size"))
    docs = found.where("kind = 'doc'").join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("pid") == F.col("p")))
    return docs.select(F.col("doc").alias(key), "source", "size", (F.col("offset") + F.col("upto")).alias("upto"), "source_size")


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 17, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, shares).

    `targets`: (source unique, target_share, max_repeats). documents: (key, source, size, times) of every document that is
    used, times >= 1. shares: one row for each target, with what was wanted and reached. The mix aims at the size of all
    rows of `sizes`, listed or not; sources that are not listed, and null, are left out; a target whose source has no
    document reaches 0. Documents of size 0 share the fate of their place in the order.
    """
    prefixes = materialise(sized_prefixes(sizes, key, source, size, seed, partitions))
    total = prefixes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]  # one number
    want = targets.select(F.col("source").alias("t_source"), "target_share", F.greatest(F.col("max_repeats"), F.lit(0)).cast("long").alias("max_repeats"))
    want = want.withColumn("all_size", F.lit(total)).withColumn("budget", F.round(F.col("target_share") * F.col("all_size")).cast("long"))
    docs = prefixes.join(want, F.col("source") == F.col("t_source"))  # adaptive: broadcast if small, else hot sources are split
    epochs = F.when(F.col("source_size") > 0, F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1))))).otherwise(F.least(F.col("max_repeats"), F.lit(1)))
    left = F.col("budget") - F.col("epochs") * F.col("source_size")
    # a document that crosses the budget is in if that comes nearer than leaving it out
    last = (F.col("epochs") < F.col("max_repeats")) & (left > 0) & (2 * (F.col("upto") - left) <= F.col("size")) & (F.col("upto") - F.col("size") < left)
    docs = docs.withColumn("epochs", epochs).withColumn("times", F.col("epochs") + last.cast("long"))
    used = docs.where("times > 0").select(F.col(key), "source", F.col("size").alias(size), "times")
    reached = docs.groupBy("t_source").agg(F.sum(F.col("size") * F.col("times")).alias("reached"), F.count_if(F.col("times") > 0).alias("documents"), F.sum("times").alias("uses"), F.max("source_size").alias("source_size"))
    reached = reached.withColumnRenamed("t_source", "r_source")
    shares = want.join(reached, F.col("t_source") == F.col("r_source"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shares = shares.select(F.col("t_source").alias("source"), "target_share", "max_repeats", zero("source_size").alias("source_tokens"), F.col("budget").alias("wanted_tokens"), zero("reached").alias("tokens"), zero("documents").alias("documents"), zero("uses").alias("uses"), "all_size")
    whole = Window.partitionBy()  # over the listed handful
    mixed = F.sum("tokens").over(whole)
    shares = shares.withColumn("share_of_total", F.when(F.col("all_size") > 0, F.col("tokens") / F.col("all_size"))).withColumn("share_of_mix", F.when(mixed > 0, F.col("tokens") / mixed)).drop("all_size")
    return used, shares
