"""Shards of near-equal bytes by sampled splitters, in built-in functions only.

Rows are ordered by a key: hash of their group, hash within the group, number of the stored row. Keys
are spread evenly, tell all rows apart, and put equal groups side by side.

1. The rows and their keys are written once; all later steps read that table, without the payload.
2. Keys are drawn with a chance proportional to their row's size (half of the weight is the row itself, so
   that ranges of tiny rows do not grow long). Splitters are the quantiles of the drawn weights.
3. One aggregation gives the exact bytes and rows of every range. Ranges above twice the intended
   weight are subdivided by a denser draw inside them, until none is left that can be divided. This
   also cuts a group that holds a third of all rows.
4. Ranges, in order, fill the shards; ranges then move from the fullest shards to the emptiest while that
   brings the two together.
5. A row's slot is its rank in its range, a bounded window, plus the rows of the shard's earlier ranges.

The driver holds splitters and totals of at most about ``MAX_RANGES`` ranges (and ``DRAWN`` keys for each),
whatever the table's size. A splitter is looked up by binary search in a constant array.

Rows of a group share a shard if the group weighs less than ``WHOLE_GROUP`` of a shard's mean and no
estimate errs; heavier groups are cut. Null sizes count 0; null groups form one group; repeated rows
each get a slot of their own; an empty table has no rows. Input columns come back in one struct, so
their names cannot clash with ``shard`` and ``slot``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import stored

SHARDS = 40
RANGES_A_SHARD = 64  # so that whole ranges balance the shards to about one part in a hundred
RANGE_BYTES = 256 << 20  # more ranges than that only where one would hold more
MAX_RANGES = 16_384
DRAWN = 8  # keys for each intended range
DENSER = 4  # times as many keys in each further round
WHOLE_GROUP = 1 / 8
HASH_DIGITS = 16


@dataclass
class Totals:
    bytes: int
    rows: int


def by_bytes(rows: DataFrame, size: Column, group: Column, within: Column, shards: int = SHARDS) -> DataFrame:
    """(row, size, shard, slot): ``row`` holds the columns of ``rows``, slots count from 0 in every shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.concat(_digits(F.xxhash64(group)), _digits(F.xxhash64(within)), _digits(F.monotonically_increasing_id()))
    keyed = rows.select(F.struct("*").alias("row"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), key.alias("key"))
    keyed = stored(keyed, "keyed")
    whole = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    splitters, totals = _ranges(keyed, Totals(whole.b, whole.n), shards)
    shard_of, first_slot = _deal(totals, shards)
    placed = keyed.withColumn("range", _range_of(splitters))
    rank = F.expr("row_number() over (partition by range order by key)")
    return placed.withColumn("rank", rank).select(
        "row", "size", _of_range(shard_of, "int").alias("shard"), (_of_range(first_slot, "long") + F.col("rank") - 1).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write ``docs`` as one folder per shard, rows in the order of their slots; returns the stored rows."""
    placed = by_bytes(docs, document_size(), F.coalesce("text", F.lit("")), F.col("doc_id"), shards)
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def document_size() -> Column:
    """UTF-8 bytes of the text, and 16 for the row."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16


def _digits(number: Column) -> Column:
    return F.lpad(F.hex(number), HASH_DIGITS, "0")


def _range_of(splitters: list[str]) -> Column:
    """How many splitters are at most the row's key, by binary search."""
    if not splitters:
        return F.lit(0)
    steps = ", ".join(str(1 << i) for i in reversed(range(len(splitters).bit_length())))
    bounds = f"split('{','.join(splitters)}', ',')"
    return F.expr(f"aggregate(array({steps}), 0, (lo, step) -> if(get({bounds}, lo + step - 1) <= key, lo + step, lo))")


def _of_range(values: list[int], kind: str) -> Column:
    return F.expr(f"cast(get(split('{','.join(map(str, values)) or '0'}', ','), range) as {kind})")


def _ranges(keyed: DataFrame, whole: Totals, shards: int) -> tuple[list[str], list[Totals]]:
    """Splitters, and the exact totals of the ranges between them."""
    if not whole.rows:
        return [], []
    wanted = max(shards * RANGES_A_SHARD, min(MAX_RANGES, whole.bytes // RANGE_BYTES))
    unit = 2 / wanted  # the weights of all rows add up to 2
    whole_group = max(unit, WHOLE_GROUP * 2 / shards)

    def weight(size, rows):
        return size / max(1, whole.bytes) + rows / whole.rows

    splitters: list[str] = []
    totals, overfull, density = [whole], [0], DRAWN
    while overfull:
        chance = weight(F.col("size"), F.lit(1)) * density / unit
        luck = F.pmod(F.xxhash64("key", F.lit(density)), F.lit(1 << 30)) / (1 << 30)
        inside = keyed.withColumn("range", _range_of(splitters)).where(F.array_contains(F.lit(overfull), F.col("range")))
        drawn = inside.where(luck < chance).select("range", "key", "size").collect()  # about `density` a range
        members: dict[int, list[tuple[str, float]]] = {r: [] for r in overfull}
        for x in drawn:
            own = weight(x["size"], 1)
            members[x["range"]].append((x["key"], max(own, unit / density)))
        new = [cut for r in overfull for cut in _cuts(sorted(members[r]), unit, whole_group)]
        splitters = sorted({*splitters, *new})
        found = (
            keyed.withColumn("range", _range_of(splitters))
            .groupBy("range")
            .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), (F.min(_group()) == F.max(_group())).alias("alone"))
            .collect()
        )
        totals = [Totals(0, 0)] * (len(splitters) + 1)
        overfull = []
        for x in found:
            totals[x["range"]] = Totals(x.b, x.n)
            most = whole_group if x.alone else 2 * unit
            if x.n > 1 and weight(x.b, x.n) > most:
                overfull.append(x["range"])
        density *= DENSER
    return splitters, totals


def _group() -> Column:
    return F.substring("key", 1, HASH_DIGITS)


def _cuts(members: list[tuple[str, float]], unit: float, whole_group: float) -> list[str]:
    """Splitters between sorted drawn keys, about every ``unit`` of weight and around whatever is heavier."""
    groups: dict[str, list[tuple[str, float]]] = {}
    for key, weight in members:
        groups.setdefault(key[:HASH_DIGITS], []).append((key, weight))
    atoms = []
    for group, own in groups.items():
        if (total := sum(w for _, w in own)) <= whole_group:
            atoms.append((group, total))
        else:
            atoms += [(group, own[0][1]), *own[1:]]
    cuts, filled = [], 0.0
    for key, weight in atoms:
        if filled and (filled >= unit or filled + weight > 1.5 * unit):
            cuts.append(key)
            filled = 0.0
        filled += weight
    return cuts


def _deal(totals: list[Totals], shards: int) -> tuple[list[int], list[int]]:
    """Shard of each range, and its first slot there."""
    whole = sum(t.bytes for t in totals)
    shard_of, before = [], 0
    for t in totals:
        middle = before + t.bytes / 2
        shard_of.append(min(shards - 1, int(shards * middle / whole)) if whole else 0)
        before += t.bytes
    filled = [0] * shards
    own: list[set[int]] = [set() for _ in range(shards)]
    for r, s in enumerate(shard_of):
        filled[s] += totals[r].bytes
        own[s].add(r)
    while True:
        low = min(range(shards), key=filled.__getitem__)
        # The fullest shard that has something to give; one that is a single heavy row has not.
        for high in sorted(range(shards), key=lambda s: -filled[s]):
            gap = filled[high] - filled[low]
            movable = [r for r in own[high] if 0 < totals[r].bytes < gap]
            if gap <= whole / shards / 1000 or movable:
                break
        if gap <= whole / shards / 1000 or not movable:
            break
        r = min(movable, key=lambda r: (abs(gap - 2 * totals[r].bytes), r))
        own[high].remove(r)
        own[low].add(r)
        filled[high] -= totals[r].bytes
        filled[low] += totals[r].bytes
        shard_of[r] = low
    first, rows = [], [0] * shards
    for t, s in zip(totals, shard_of):
        first.append(rows[s])
        rows[s] += t.rows
    return shard_of, first

