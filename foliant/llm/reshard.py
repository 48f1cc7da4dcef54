"""Resharding by minimum-cost flow: new shards of nearly equal bytes with the fewest bytes moved.

The flow network has a node for each old shard (supply: its bytes) and each new shard (demand: its
capacity). Keeping bytes in the shard of the same number costs nothing, moving a byte costs one.
The solved flow says how many bytes go from which old to which new shard. Within an old shard the
documents are ordered by falling size, so the largest stay at the front and cuts fall among small
ones; a cut is a key of that order, so that assigning a document is a comparison of its own columns
with a few cut keys: no join, no shuffle of texts. Only files of shards that gain or lose rows are
rewritten.

Only sums by partition and shard, and the cut rows, reach the driver: their number depends on the
numbers of partitions and shards, not of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of a row besides its text.
ROW_BYTES = 8
#: Bytes of text that a written file is meant to hold.
FILE_BYTES = 128 << 20
#: Names of so many files (about 300 bytes each) may be broadcast.
BROADCAST_FILES = 100_000


def min_cost_flow(supply: list[int], demand: list[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) with all supply shipped and the fewest bytes between different numbers.

    Successive shortest paths on the residual network; distances by label correction. The network
    has as many nodes as there are shards.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, cap: int, price: int) -> None:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    for j, d in enumerate(demand):
        arc(n + j, sink, d, 0)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, sum(supply), 0 if i == j else 1)
    left = min(sum(supply), sum(demand))
    while left > 0:
        far: list[float] = [float("inf")] * (n + m + 2)
        far[source], via, queue = 0, [-1] * (n + m + 2), [source]
        while queue:
            after: list[int] = []
            for x in queue:
                for e in head[x]:
                    if room[e] > 0 and far[x] + cost[e] < far[to[e]]:
                        far[to[e]], via[to[e]] = far[x] + cost[e], e
                        after.append(to[e])
            queue = list(dict.fromkeys(after))
        if via[sink] < 0:
            break
        push, x = left, sink
        while x != source:
            push, x = min(push, room[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != source:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
        left -= push
    return [(to[e ^ 1], to[e] - n, room[e ^ 1]) for i in range(n) for e in head[i] if e % 2 == 0 and n <= to[e] < n + m and room[e ^ 1] > 0]


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus eight."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _id(doc_id: Column) -> Column:
    """Null ids come first."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def plan(docs: DataFrame, old_shard: Column, new_shards: int, old_shards: int) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """(cuts, transfers). Transfers: (old, new, bytes) of the flow.

    Cuts: (old, new, size, tie, doc_id) where the rows of ``old`` from that key on go to ``new``, up
    to the next cut; keys are ordered by falling size, then by a hash of the id, then by the id.
    """
    keys = docs.select(old_shard.cast("int").alias("old"), text_size(F.col("text")).alias("size"), F.xxhash64("doc_id").alias("tie"), _id(F.col("doc_id")).alias("doc_id"))
    ordered = (
        keys.repartitionByRange("old", F.desc("size"), "tie", "doc_id")
        .sortWithinPartitions("old", F.desc("size"), "tie", "doc_id")
        .withColumn("part", F.spark_partition_id())
    )
    # Partition numbers become data: a lost executor cannot change them.
    ordered = shared.materialise(ordered)
    sums = sorted((r.part, r.old, r.bytes) for r in ordered.groupBy("part", "old").agg(F.sum("size").alias("bytes")).collect())
    supply = [0] * old_shards
    before: dict[tuple[int, int], int] = {}
    for part, old, size in sums:
        before[part, old] = supply[old]
        supply[old] += size
    total = sum(supply)
    demand = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    transfers = min_cost_flow(supply, demand)
    # Where cuts fall, by partition: the one that holds the byte, and the next, as a row whose middle
    # lies before the cut may end its partition.
    parts: dict[int, list[tuple[int, int]]] = {}
    for (part, old), at in sorted(before.items()):
        parts.setdefault(old, []).append((part, at))
    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i in range(old_shards):
        # What stays comes first, so that the largest documents are not moved.
        at = 0
        for _, j, size in sorted((t for t in transfers if t[0] == i), key=lambda t: (t[1] != i, t[1])):
            holder = max(k for k, (_, start) in enumerate(parts[i]) if start <= at)
            for part, _ in parts[i][holder : holder + 2]:
                wanted.setdefault((part, i), []).append((at, j))
            at += size

    def cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first row of this partition whose middle is not before the cut, for each cut wanted."""
        done: dict[int, int] = {}
        open_ = {key: dict(cuts) for key, cuts in wanted.items()}
        for batch in batches:
            for old, rows in batch.groupby("old", sort=False):
                key = int(rows["part"].iloc[0]), int(old)
                end = done.get(key[1], before[key]) + rows["size"].cumsum()
                done[key[1]] = int(end.iloc[-1])
                middle = (end - rows["size"] / 2).to_numpy()
                for at, new in list(open_.get(key, {}).items()):
                    place = int(middle.searchsorted(at))
                    if place < len(rows):
                        del open_[key][at]
                        r = rows.iloc[[place]]
                        yield pd.DataFrame({"old": [old], "new": [new], "at": [at], "size": r["size"].array, "tie": r["tie"].array, "doc_id": r["doc_id"].array})

    best: dict[tuple[int, int], tuple] = {}
    for r in ordered.mapInPandas(cut_rows, "old int, new int, at long, size long, tie long, doc_id long").collect():
        rank = (-r["size"], r.tie, r.doc_id)
        if (r.old, r.at) not in best or rank < best[r.old, r.at][0]:
            best[r.old, r.at] = (rank, r.new)
    cuts = [(old, new, -rank[0], rank[1], rank[2]) for (old, at), (rank, new) in sorted(best.items())]
    return cuts, transfers


def assigned(old_shard: Column, cuts: list[tuple], size: Column, doc_id: Column) -> Column:
    """The new shard of a row: the last cut of its old shard that is not behind the row."""
    out = old_shard.cast("int")
    by_old: dict[int, Column] = {}
    tie = F.xxhash64(doc_id)
    for old, new, s, t, d in cuts:
        reached = (size < s) | ((size == s) & ((tie > t) | ((tie == t) & (_id(doc_id) >= d))))
        by_old[old] = F.when(reached, F.lit(new)).otherwise(by_old.get(old, F.lit(new)))
    for old, inner in by_old.items():
        out = F.when(old_shard == old, inner).otherwise(out)
    return out.cast("int")


def rewrite(docs: DataFrame, shard: Column, path: str, shards: int, files_per_shard: int, columns: list[str] | None = None) -> None:
    """Write rows as Parquet below ``path``, one folder for each shard, ``files_per_shard`` files each."""
    rows = docs.select(*(columns or docs.columns), shard.alias("shard")).withColumn("_file", F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard)))
    # As many tasks as files, whatever the session's number of shuffle partitions is.
    rows.repartition(shards * files_per_shard, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, path: str, affected_only: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """doc_id, text, shard, slot: the documents in their new shards, as written below ``path``.

    ``old_shard`` gives each row's old shard, 0 to ``old_shards`` - 1. With ``affected_only`` the
    folders of shards that neither gain nor lose rows are neither written nor returned; only rows of the
    others are shuffled. Files hold about ``file_bytes`` of text. ``slot`` counts from 0 without
    gaps within a shard. Null texts weigh eight bytes; ties in size follow a hash of the id; repeated
    rows of one id stay together; a document larger than a shard's capacity stays whole. An empty
    table gives an empty result; further columns are not carried over.
    """
    cuts, transfers = plan(docs, old_shard, new_shards, old_shards)
    target = assigned(old_shard, cuts, text_size(F.col("text")), F.col("doc_id"))
    rows = docs
    if affected_only:
        touched = {x for old, new, _ in transfers if old != new for x in (old, new)}
        rows = docs.where(target.isin(sorted(touched)) | (old_shard.cast("int") != target))
    # Files of bounded size, so that no task grows with the input.
    files_per_shard = 4 + sum(size for *_, size in transfers) // (new_shards * file_bytes)
    rewrite(rows, target, path, new_shards, files_per_shard, ["doc_id", "text"])
    spark = docs.sparkSession
    text_type = docs.schema["text"].dataType.simpleString()
    files = spark.read.schema(f"doc_id long, text {text_type}, shard int").parquet(path)
    placed = files.select("doc_id", "text", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # One row for each file: its first slot is the number of rows in the files before it.
    counts = spark.read.schema("shard int").parquet(path).select("shard", F.col("_metadata.file_path").alias("file")).groupBy("shard", "file").count()
    first = counts.select("shard", "file", F.expr("sum(count) over (partition by shard order by file rows between unbounded preceding and 1 preceding)").alias("first"))
    # One row a file, so its size is known before: only beyond it would the texts be shuffled once more.
    first = shared.materialise(first.drop("shard"))
    known = F.broadcast(first) if new_shards * files_per_shard <= BROADCAST_FILES else first
    return placed.join(known, "file").select("doc_id", "text", "shard", (F.coalesce("first", F.lit(0)) + F.col("row")).cast("long").alias("slot"))


def op2_min_cost_flow_resharding(spark, sf_dir: str) -> DataFrame:
    """All documents from 16 old shards (by a hash of their id) into 24 of nearly equal bytes."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    moved = reshard(docs, old, 16, 24, shared.fresh_path(spark, "shards"))
    return moved.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
