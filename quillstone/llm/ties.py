"""Grouped ranking with ties by mergeable truncated maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import stored
from quillstone.llm.ranges import numbered

#: Rows after which a task folds what it has read, and rows of maps after which it passes them on and starts anew.
FOLD_ROWS, HELD_ROWS = 1 << 18, 1 << 20
#: A task's map of a group with so many lines is merged in a tree, in so many slices, before all maps of the group meet.
HEAVY, SLICES = 64, 64


def fold(table: pa.Table, groups: int, pairs: int, k: int) -> pa.Table:
    """Merges maps. table: group columns, pair columns (smaller first, null before all), n (lines), dropped (lines).

    Of each group the best k pairs stay, and of these only such as have fewer than k lines before them; their n is summed.
    A pair that has a place up to k among all lines has one in every part of them, so that no part drops it: merged counts
    of such pairs are exact. Lines of dropped pairs are counted in `dropped` of the group's best pair.
    """
    if not table.num_rows:
        return table
    columns = [table.column(i).combine_chunks() for i in range(groups + pairs)]
    keys = []  # of each column: values, and before them whether they are there if any is not
    for c in columns:
        there = np.asarray(c.is_valid())
        values = c.fill_null(0).to_numpy(zero_copy_only=False)
        keys.append([values] if there.all() else [there, values])
    order = np.lexsort([x for key in reversed(keys) for x in reversed(key)])
    changes = [np.logical_or.reduce([(s := x[order])[1:] != s[:-1] for x in key]) for key in keys]
    starts = lambda parts: np.flatnonzero(np.concatenate(([True], np.logical_or.reduce(parts))))
    pair_at, group_at = starts(changes), starts(changes[:groups])
    n = np.add.reduceat(table.column("n").to_numpy()[order], pair_at)
    dropped = np.add.reduceat(table.column("dropped").to_numpy()[order], group_at)
    first = np.searchsorted(pair_at, group_at)  # pair with which each group begins
    of_group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair_at))))
    total = np.concatenate(([0], np.cumsum(n)))
    earlier = total[:-1] - total[first][of_group]
    keep = (np.arange(len(pair_at)) - first[of_group] < k) & (earlier < k)
    dropped += np.add.reduceat(np.where(keep, 0, n), first)
    extra = np.zeros(len(pair_at), np.int64)
    extra[first] = dropped
    at = pa.array(order[pair_at[keep]])
    return pa.table([*[c.take(at) for c in columns], pa.array(n[keep]), pa.array(extra[keep])], table.schema.names)


def _folding(groups: int, pairs: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, rows = None, [], 0
        for batch in batches:
            fresh.append(pa.table(batch.columns, batch.schema.names))  # without what its schema says on nulls
            rows += batch.num_rows
            if rows >= max(FOLD_ROWS, held.num_rows if held else 0):
                held = fold(pa.concat_tables([*([held] if held else []), *fresh]), groups, pairs, k)
                fresh, rows = [], 0
                if held.num_rows > HELD_ROWS:
                    yield from held.to_batches(1 << 16)
                    held = None
        if fresh:
            held = fold(pa.concat_tables([*([held] if held else []), *fresh]), groups, pairs, k)
        if held:
            yield from held.to_batches(1 << 16)

    return run


def cutoffs(lines: DataFrame, group: Sequence[str], pair: Sequence[str], k: int) -> DataFrame:
    """The pairs of each group that have a place up to k: group, pair, place (1 + lines with earlier pairs), tied (lines).

    All columns named are longs. Smaller pairs are earlier, null before all numbers. Each task aggregates its lines by
    key into truncated maps (see fold). The maps of a group that is large in a task go through a tree: they meet in SLICES
    parts first, so that what comes together for one group is at most SLICES of them and the maps of its small parts.
    """
    names = [*group, *pair]
    run = _folding(len(group), len(pair), k)
    schema = ", ".join(f"`{c}` long" for c in names) + ", n long, dropped long"
    ones = lines.select(*names, F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("dropped"))
    maps = ones.mapInArrow(run, schema)
    heavy = stored(maps.withColumn("heavy", F.col("dropped") + F.col("n") >= HEAVY).withColumn("slice", F.spark_partition_id() % SLICES), "maps")
    tree = heavy.where("heavy").repartition(*group, "slice").select(*names, "n", "dropped").mapInArrow(run, schema)
    met = heavy.where("not heavy").select(*names, "n").unionByName(tree.select(*names, "n")).repartition(*group)
    merged = met.groupBy(*names).agg(F.sum("n").alias("tied"))
    by_pair = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in pair]).rowsBetween(Window.unboundedPreceding, -1)
    place = (1 + F.coalesce(F.sum("tied").over(by_pair), F.lit(0))).cast("long")
    return merged.withColumn("place", place).where(F.col("place") <= k)


def rank_with_ties(lines: DataFrame, group: Sequence[str], pair: Sequence[str], order: Sequence[str], k: int = 3) -> DataFrame:
    """Lines whose place in their group is k at most: the columns named, place, tied and pos.

    place is 1 plus the group's lines with an earlier pair, tied the group's lines with the same pair, returned or not; pos
    counts the group's lines from 1 by pair, then by `order`, nulls of these last. All columns named are longs; null is a
    value of its own in group and pair, and before all numbers in pair. Repeated lines count and return each for itself;
    among lines that are equal in everything named, which of them has which pos is open. Other columns are ignored. An
    empty table gives no rows.

    Lines meet the cutoffs by group and pair in a join that Spark may split where a key is hot; what is left is sorted over
    ranges, groups of any size included.
    """
    names = [*group, *pair, *[c for c in order if c not in (*group, *pair)]]
    found = stored(cutoffs(lines, group, pair, k), "cutoffs")
    # equality that holds for nulls too, as plain keys
    full = lambda df, side: df.select(*[F.coalesce(c, F.lit(0)).alias(f"{side}{i}") for i, c in enumerate((*group, *pair))], _absent(group, pair).alias(f"{side}absent"), *[c for c in df.columns if side == "l" or c in ("place", "tied")])
    left, right = full(lines.select(*names), "l"), full(found, "r")
    same = [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(group) + len(pair))] + [F.col("labsent") == F.col("rabsent")]
    kept = left.join(right, same).select(*names, "place", "tied")
    at = numbered(kept, [*group, *pair], [F.col(c).asc_nulls_last() for c in order])
    return at.select(*names, "place", "tied", (F.col("place") - 1 + F.col("at")).alias("pos"))


def _absent(group: Sequence[str], pair: Sequence[str]) -> Column:
    """A bit for each column of the key that is null."""
    bits = [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate((*group, *pair))]
    return sum(bits[1:], bits[0])


def sale_line_ranks(lines: DataFrame, k: int = 3) -> DataFrame:
    """rank_with_ties over sale lines: best k places by tens of quantity, then by percent of discount.

    lines: sale_id, line_no, item_id, vendor_id, quantity, amount, discount, shipped_at; other columns are ignored. Groups
    are vendor_id, part (item_id mod 10; null: -1), month (100 * year + month of shipped_at; null: -1); lines whose sale_id
    has a decimal text with a crc32 divisible by 5 are one group, -1 in all three. A null vendor is a group's value like
    others. A null quantity comes before all, a null discount before all percents.
    """
    whole = lambda c: F.floor(c).cast("long")
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    grouped = lambda c: F.when(one, F.lit(-1)).otherwise(c).cast("long")
    narrow = lines.select(
        grouped(F.col("vendor_id")).alias("vendor_id"),
        grouped(F.coalesce(F.col("item_id") % 10, F.lit(-1))).alias("part"),
        grouped(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        (-whole(F.col("quantity") / 10)).alias("tens"),
        whole(100 * F.col("discount") + 0.5).alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"),
        whole(100 * F.col("amount") + 0.5).alias("amount_cents"),
    )
    return rank_with_ties(narrow, ["vendor_id", "part", "month"], ["tens", "percent"], ["sale_id", "line_no", "quantity", "amount_cents"], k)


#: crc32 (reflected polynomial EDB88320) of texts, and the same ranks by windows over all lines.
CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT] || range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS t)"""
ORACLE = f"""
WITH {CRC_TABLE},
ids AS (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL),
codes AS (SELECT sale_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM ids, tab),
lines AS (
  SELECT l.sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, floor(100 * amount + 0.5)::BIGINT AS amount_cents,
         -floor(quantity / 10.0)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent,
         CASE WHEN crc % 5 = 0 THEN -1 ELSE vendor_id END::BIGINT AS vendor_id,
         CASE WHEN crc % 5 = 0 THEN -1 ELSE coalesce(item_id % 10, -1) END::BIGINT AS part,
         CASE WHEN crc % 5 = 0 THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END::BIGINT AS month
  FROM sale_lines l LEFT JOIN codes USING (sale_id)),
ranked AS (
  SELECT *, rank() OVER pairs AS place, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied,
         row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos
  FROM lines WINDOW pairs AS (PARTITION BY vendor_id, part, month ORDER BY tens NULLS FIRST, percent NULLS FIRST))
SELECT vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM ranked WHERE place <= 3
"""
