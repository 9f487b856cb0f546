"""Exact n-gram Jaccard join with an R-tree over count vectors, and the components of its links.

A document is the set of its distinct word shingles (hashed to 64 bits) and, as a point, the counts of its shingles in
``GROUPS`` hash groups. Two sets share at most the sum of the smaller counts of each group, which bounds their overlap.

Random points are about equally far apart in so many dimensions, so one tree over all documents would not prune. The
points are therefore dealt to blocks first, without losing a link: of n shingles two linked documents share one of their
first n - ceil(t n) + 1 in a common order (frequent shingles last). Equal sets are one node. In each block the first node
is linked tentatively to the others; these pairs, linear in the block, are bounded by their points, verified on the whole
sets, and joined to components; a second node of the blocks that are not settled yet is tried the same way. Then every block
that still holds several components goes into an R-tree: each point asks the tree for the points whose bound allows a link,
subtrees that cannot are skipped, and pairs across components leave, from one of the blocks that hold both, to be verified.
A pair of one component needs no check, so groups of near copies never become all their pairs.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import BROADCAST_LIMIT, bounded_batches, checked, wide_batches
from .components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
GROUPS = 256
# One document in so many is read to find frequent shingles; of these, at most ``FREQUENT`` go last in the order. This
# sets the order only: any order gives the same links.
ORDER_ONE_IN, ORDER_LEAST, FREQUENT = 16, 4, 100_000
# Points in a leaf and children of a node of the tree; blocks below this size are compared without one.
LEAF = 16
# Nodes of a block that one task holds, about, before the block is dealt to cells; width of a band of sizes, a little over the 1.25 of
# linked sizes so that rounding loses none; pairs in a frame, at least, before it leaves the task.
CHUNK, BAND, PAIRS = 4_096, 1.26, 65_536

_P = np.uint64(0x9E3779B97F4A7C15)
# The count that stands for all that do not fit a byte; block numbers that a node carries with it.
_OPEN, _CARRIED = 255, 64
# Rounds in which every block that still holds several components tries them with another of its nodes.
STARS = 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct 64-bit shingle hashes of texts, sorted; word hashes are kept in a bounded cache of the worker."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.hash, self.known = words, xxhash.xxh3_64_intdigest, {}

    def set_of(self, text: str) -> np.ndarray:
        # On bytes, lower() and split() know ASCII only: A-Z, and the six kinds of white space that part words.
        found = text.encode("utf-8").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in set(found).difference(known):
            known[w] = self.hash(w)
        one = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(one))
        with np.errstate(over="ignore"):
            many = np.full(len(one) - n + 1, n, np.uint64)
            for i in range(n):
                many = _mixed(many * _P + one[i : len(one) - n + 1 + i])
        return np.unique(many)


def prefix_length(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Any set linked to one of ``n`` shingles shares at least ceil(t n) of them, so one of so many first ones."""
    return n - -(-num * n // den) + 1 if n else 0


def needed_overlap(n, m, num: int = NUMERATOR, den: int = DENOMINATOR):
    """Least intersection i with den * i >= num * (n + m - i)."""
    return -(-num * (n + m) // (den + num))


def point_of(shingles: np.ndarray) -> bytes:
    """Counts per group as bytes. A count beyond their range stands as the largest, which bounds nothing where both have it."""
    counts = np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, _OPEN).astype(np.uint8).tobytes()


def _points(column) -> np.ndarray:
    """Points as rows of counts; one that is empty bounds nothing."""
    return np.frombuffer(b"".join(p or bytes([_OPEN]) * GROUPS for p in column), np.uint8).reshape(-1, GROUPS)


def shared_counts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of the smaller counts along the last axis: the most that two sets can share; beyond all bounds where a count is open."""
    least = np.minimum(p, q)
    most = least.sum(axis=-1, dtype=np.int64)
    return np.where((least == _OPEN).any(axis=-1), np.iinfo(np.int64).max, most)


def frequent_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of shingles that a hash sample of the documents shows often, at most ``FREQUENT``."""

    def shingled(batches):
        own = Shingler()
        for batch in batches:
            yield pd.DataFrame({"s": np.concatenate([np.empty(0, np.uint64), *(own.set_of(t) for t in batch["t"])]).view(np.int64)})

    sample = docs.select(F.coalesce(text, F.lit("")).alias("t")).where(F.pmod(F.xxhash64("t", F.monotonically_increasing_id()), F.lit(ORDER_ONE_IN)) == 0)
    counted = sample.mapInPandas(shingled, "s long").groupBy("s").count().where(F.col("count") >= ORDER_LEAST)
    rows = counted.orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").toPandas()
    return np.sort(rows["s"].to_numpy(np.int64).view(np.uint64))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, n, node, point, prefix) per row: ``digest`` tells the text, ``node`` names the set,
    ``prefix`` are its first shingles in the common order."""
    bounded_batches(docs.sparkSession)
    last = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text))

    def signed(batches):
        import xxhash

        own, frequent = Shingler(), last.value
        for batch in batches:
            n, node, point, prefix = [], [], [], []
            for t in batch.column("t").to_pylist():
                s = own.set_of(t)
                n.append(len(s))
                node.append(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64) if len(s) else 0)
                point.append(point_of(s) if len(s) else b"")
                take = prefix_length(len(s))
                if take and len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[at] == s
                    s = np.concatenate([s[~late], s[late]])
                prefix.append(s[:take].view(np.int64))
            made = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(point, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("digest"), *made], names=["k", "digest", "n", "node", "point", "prefix"])

    given = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"), _digest(text).alias("digest"))
    return given.mapInArrow(signed, f"k {given.schema['k'].dataType.simpleString()}, digest binary, n long, node long, point binary, prefix array<long>")


def blocks(nodes: DataFrame) -> DataFrame:
    """(shingle, node, first, large): nodes that share a prefix shingle with others, the smallest of them, and whether they are three or more.

    Rows are dealt by shingle and sorted; a task sees one shingle after the other and keeps two rows of the last one at most.
    """

    def shared(batches):
        kept_s, kept_v = np.empty(0, np.int64), np.empty(0, np.int64)  # of a block that may go on
        going = None  # (shingle, first) of a large block of which rows have left already
        for batch in batches:
            s, v = np.concatenate([kept_s, batch["shingle"]]), np.concatenate([kept_v, batch["node"]])
            if not len(s):
                continue
            begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(begin, len(s)))
            first, large = v[begin], size > 2
            if going is not None and s[0] == going[0]:
                first[0], large[0] = going[1], True
            waits = 0 if large[-1] else size[-1]
            stays = size > 1
            stays[0] |= going is not None and s[0] == going[0]
            stays[-1] &= not waits
            going = (s[-1], first[-1]) if large[-1] else None
            out = pd.DataFrame({"shingle": s, "node": v, "first": np.repeat(first, size), "large": np.repeat(large, size)})
            kept_s, kept_v = s[len(s) - waits :], v[len(s) - waits :]
            yield out[np.repeat(stays, size)]
        if len(kept_s) == 2:
            yield pd.DataFrame({"shingle": kept_s, "node": kept_v, "first": kept_v[:1].repeat(2), "large": False})

    spread = nodes.select(F.explode("prefix").alias("shingle"), "node").repartition("shingle").sortWithinPartitions("shingle", "node")
    return spread.mapInPandas(shared, "shingle long, node long, first long, large boolean")


def bound_holds(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and points allow a link."""
    own = nodes.select("node", "n", "point")
    left, right = (own.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").where((DENOMINATOR * F.least("n_a", "n_b")) >= NUMERATOR * F.greatest("n_a", "n_b"))

    def bounded(batches):
        for batch in batches:
            p, q = _points(batch["p_a"]), _points(batch["p_b"])
            keep = shared_counts(p, q) >= needed_overlap(batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
            yield batch.loc[keep, ["a", "b"]]

    return both.mapInPandas(bounded, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b) that are links: the whole sets are made again for the nodes in ``pairs`` (staged) and compared."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stage(nodes.select("node", "k").join(ends, "node"), "wanted")
    docs_wanted = docs.select(F.col(key).alias("own"), F.coalesce(text, F.lit("")).alias("t")).join(checked(wanted), F.col("own").eqNullSafe(F.col("k")))

    def shingled(batches):
        import xxhash

        own = Shingler()
        for batch in batches:
            sets = [own.set_of(t) for t in batch["t"]]
            same = [int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) == v for s, v in zip(sets, batch["node"])]
            yield pd.DataFrame({"node": batch["node"], "s": [s.tobytes() for s in sets]})[same]

    sets = stage(docs_wanted.select("node", "t").mapInPandas(shingled, "node long, s binary").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")

    def compared(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["s_a"], batch["s_b"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(DENOMINATOR * common >= NUMERATOR * (len(p) + len(q) - common))
            yield batch.loc[keep, ["a", "b"]]

    return both.mapInPandas(compared, "a long, b long")


def near_rows(points: np.ndarray, sizes: np.ndarray, point: np.ndarray, size: int) -> np.ndarray:
    """Rows whose sizes and points allow a link."""
    fits = DENOMINATOR * np.minimum(sizes, size) >= NUMERATOR * np.maximum(sizes, size)
    return np.flatnonzero(fits & (shared_counts(points, point) >= needed_overlap(size, sizes)))


class CountTree:
    """R-tree over count vectors, packed by size and the widest coordinates; a node keeps the largest counts and least size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        wide = np.argsort(-points.astype(np.float32).var(axis=0), kind="stable")[:2]
        self.order = np.lexsort((points[:, wide[1]], points[:, wide[0]], sizes))
        level = [self.order[i : i + LEAF] for i in range(0, len(sizes), LEAF)]
        boxes = [(points[rows].max(axis=0), sizes[rows].min(), sizes[rows].max()) for rows in level]
        self.levels = [(level, self._stacked(boxes))]
        while len(boxes) > 1:
            level = [np.arange(i, min(i + LEAF, len(boxes))) for i in range(0, len(boxes), LEAF)]
            top, low, high = self.levels[-1][1]
            boxes = [(top[rows].max(axis=0), low[rows].min(), high[rows].max()) for rows in level]
            self.levels.append((level, self._stacked(boxes)))

    @staticmethod
    def _stacked(boxes):
        return np.stack([b[0] for b in boxes]), np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows whose bound allows a link to ``point``; a subtree is left out when its largest counts do not allow one."""
        live = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            level, (top, low, high) = self.levels[depth]
            fits = (DENOMINATOR * high[live] >= NUMERATOR * size) & (NUMERATOR * low[live] <= DENOMINATOR * size)
            live = live[fits]
            live = live[shared_counts(top[live], point) >= needed_overlap(size, np.maximum(low[live], -(-NUMERATOR * size // DENOMINATOR)))]
            if not len(live):
                return live
            live = np.concatenate([level[i] for i in live])
        return live[near_rows(self.points[live], self.sizes[live], point, size)]


def dealt(members: DataFrame, hot: DataFrame) -> DataFrame:
    """``members`` with ``task`` and ``side``: blocks in ``hot`` (shingle) are dealt to cells of about ``CHUNK`` nodes, and cells to tasks by twos.

    Linked sizes differ by a quarter at most, so they are in the same band of sizes or in neighbouring ones: a task is a cell alone
    or two cells that may hold a linked pair, and each such pair of nodes meets in one task. A small block is one task, -1.
    """
    cool = members.join(hot, "shingle", "left_anti").withColumn("task", F.lit(-1).cast("long")).withColumn("side", F.lit(0))
    if not hot.head(1):
        return cool
    banded = members.join(hot, "shingle", "left_semi").withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))))
    chunks = checked(stage(banded.groupBy("shingle", "band").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("chunks")), "chunks"))
    celled = banded.join(chunks, ["shingle", "band"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")))
    cells = chunks.select("shingle", "band", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"))
    other = cells.select("shingle", F.col("band").alias("band_b"), F.col("chunk").alias("chunk_b"))
    same = cells.join(other.withColumn("band", F.col("band_b")), ["shingle", "band"]).where(F.col("chunk_b") >= F.col("chunk"))
    next_to = cells.join(other.withColumn("band", F.col("band_b") - 1), ["shingle", "band"])
    tasks = stage(same.unionByName(next_to).withColumn("task", F.monotonically_increasing_id()), "tasks")
    one = tasks.select("shingle", "task", "band", "chunk", F.lit(0).alias("side"))
    two = tasks.where("band <> band_b or chunk <> chunk_b").select("shingle", "task", F.col("band_b").alias("band"), F.col("chunk_b").alias("chunk"), F.lit(1).alias("side"))
    return cool.unionByName(celled.join(one.unionByName(two), ["shingle", "band", "chunk"]).select(*cool.columns))


def tree_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different components in a task of (shingle, task, side, node, root, n, point, block, blocks) whose bound allows a link.

    Where a task has two sides, nodes of the one are searched in the tree of the other. Two nodes may meet in many blocks; their
    pair leaves only where neither's carried ``blocks`` show a smaller one that both are in. Pairs leave in frames of bounded size.
    """

    if "blocks" not in members.columns:
        members = members.withColumn("block", F.lit(0).cast("long")).withColumn("blocks", F.array().cast("array<long>"))

    def searched(batches):
        for group in _runs(batches, ["shingle", "task"]):
            node, root, n, side = (group[c].to_numpy() for c in ("node", "root", "n", "side"))
            here = int(group["block"].iloc[0])
            points = _points(group["point"])
            earlier = np.stack([_earlier(b, here) for b in group["blocks"]])
            asked = np.flatnonzero(side == 0)
            held = np.flatnonzero(side == 1) if side.any() else asked
            own_points, own_n = points[held], n[held]
            tree = CountTree(own_points, own_n) if len(held) > LEAF else None
            out_a, out_b, waiting = [], [], 0
            for i in asked:
                near = held[tree.search(points[i], int(n[i])) if tree else near_rows(own_points, own_n, points[i], int(n[i]))]
                near = near[(root[near] != root[i]) & ((node[near] > node[i]) | (side[near] == 1))]
                before = earlier[i][earlier[i] >= 0]
                if len(near) and len(before):
                    near = near[~np.isin(earlier[near], before).any(axis=1)]
                out_a.append(np.minimum(node[near], node[i]))
                out_b.append(np.maximum(node[near], node[i]))
                waiting += len(near)
                if waiting >= PAIRS:
                    yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
                    out_a, out_b, waiting = [], [], 0
            if waiting:
                yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return members.repartition("shingle", "task").sortWithinPartitions("shingle", "task").mapInPandas(searched, "a long, b long").distinct()


def _earlier(blocks: np.ndarray, here: int) -> np.ndarray:
    """Numbers of carried blocks before this one, filled up with -1."""
    out = np.full(_CARRIED, -1, np.int64)
    before = blocks[blocks < here]
    out[: len(before)] = before
    return out


def _runs(batches, columns: list[str]):
    """Frames of equal ``columns`` from batches sorted by them, one at a time."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        own = batch[columns].to_numpy()
        at = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
        parts = [batch.iloc[a:b] for a, b in zip([0, *at], [*at, len(batch)])]
        if held and tuple(held[0][columns].iloc[0]) != tuple(own[0]):
            yield pd.concat(held)
            held = []
        held.append(parts[0])
        for part in parts[1:]:
            yield pd.concat(held)
            held = [part]
    if held:
        yield pd.concat(held)


def _unsettled(shared: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shingle, node, root) of the given blocks, staged, and (shingle, rows) of those that still hold several components.

    Blocks of the same nodes, told by two 64-bit digests and their number, are one.
    """
    rooted = shared.select("shingle", "node").join(roots, "node", "left").select("shingle", "node", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    alike = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"d{i}") for i in (1, 2)]
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows"), *alike).where("lo <> hi")
    mixed = mixed.groupBy("rows", "d1", "d2").agg(F.min("shingle").alias("shingle")).select("shingle", "rows")
    return rooted, stage(mixed, "mixed")


def _new_pairs(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """``pairs`` as (a, b), a < b, each once, without those in ``tried``."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ordered.join(tried, ["a", "b"], "left_anti")


def _star(members: DataFrame, number: int) -> DataFrame:
    """(a, b): one node of each block, by a hash that all blocks share, with each node of another component in the block."""
    centre = members.groupBy("shingle").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(number))).alias("c"))
    return members.join(centre, "shingle").where("c.root <> root").select(F.col("c.node").alias("a"), F.col("node").alias("b"))


def _rooted_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, digest of the text, n, root) per row, staged: ``root`` is null without shingles, else the smallest set that links reach."""
    spark = docs.sparkSession
    all_rows = stage(signatures(docs, key, text), "signatures")
    filled = all_rows.where("n > 0")
    copies = filled.groupBy("node").agg(F.min("k").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("node", "least")
    copies = checked(stage(copies, "copies"))
    # One row speaks for each set: the only one, or one with the least key, of which repeated rows give several.
    alone = filled.join(copies.select("node"), "node", "left_anti").select("node", "k", "n", "point", "prefix")
    first = filled.join(copies, "node").where(F.col("k").eqNullSafe(F.col("least"))).select(*alone.columns).dropDuplicates(["node"])
    nodes = alone.unionByName(first)

    with wide_batches(spark):
        shared = stage(blocks(nodes), "blocks")
    points = stage(nodes.select("node", "k", "n", "point").join(shared.select("node").distinct(), "node"), "points")

    def linked(pairs: DataFrame) -> DataFrame:
        with wide_batches(spark):
            near = stage(bound_holds(pairs, points), "near")
        return stage(verified(near, points, docs, key, text), "links")

    star = shared.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    tried = stage(_new_pairs(star, star.limit(0)), "tried")
    links = linked(tried)
    roots = stage(components(links), "roots")
    # Blocks of two nodes are settled by their only pair, and a settled block stays so: components only grow.
    rooted, mixed = _unsettled(shared.where("large"), roots)
    for number in range(STARS):
        members = stage(rooted.join(mixed.select("shingle"), "shingle"), "unsettled")
        pairs = stage(_new_pairs(_star(members, number), tried), "star")
        if not pairs.head(1):
            break
        links, tried = links.unionByName(linked(pairs)), tried.unionByName(pairs)
        roots = stage(components(stage(links, "links")), "roots")
        rooted, mixed = _unsettled(members, roots)

    # Numbered in no order; what counts is that a block has the same number everywhere.
    numbered = stage(mixed.withColumn("block", F.monotonically_increasing_id()), "numbered")
    inside = stage(rooted.join(numbered, "shingle"), "members")
    carried = inside.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("block")), 1, _CARRIED).alias("blocks"))
    members = inside.select("shingle", "block", "node", "root").join(points.select("node", "n", "point"), "node").join(carried, "node")
    more = _new_pairs(tree_pairs(dealt(members, checked(mixed.where(F.col("rows") > CHUNK).select("shingle")))), tried)
    with wide_batches(spark):
        more = stage(more, "more")
    found = verified(more, points, docs, key, text)
    every = stage(components(stage(links.unionByName(found), "links")), "roots")
    labelled = all_rows.select("k", "digest", "n", "node").join(every, "node", "left")
    return stage(labelled.select("k", "digest", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root")), "labelled")


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_shingles, component_id) per row of ``docs``: the smallest key that links reach.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing: their component is their own key.
    Repeated rows and equal sets are one node, so copies cost nothing; a null key is never a component's smallest unless it is alone.
    """
    labelled = _rooted_rows(docs, key, text)
    # Only sets that have copies or links need the smallest key of their component.
    least = labelled.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("k").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("root", "least")
    named = labelled.join(least, "root", "left")
    return named.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "k").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest key, null keys last, then of the smallest text digest.

    Rows are told by key and text, so a text stays although its key has another text that goes; of repeated rows of one key
    and text one stays. Rows without shingles all stay. Columns are untouched.
    """
    rows = _rooted_rows(docs, key, text).where(F.col("root").isNotNull()).select("root", F.struct(F.col("k").isNull().alias("nil"), "k", "digest").alias("row"))
    groups = rows.groupBy("root").agg(F.min("row").alias("one"), F.count("*").alias("rows")).where("rows > 1")
    told = stage(rows.join(groups.select("root", "one"), "root").groupBy("row", (F.col("row") == F.col("one")).alias("stays")).count(), "told")
    named = told.select(F.col("row.k").alias("__k"), F.col("row.digest").alias("__digest"), "stays", "count")
    out = checked(named.where("not stays or count > 1").select("__k", "__digest"), BROADCAST_LIMIT)
    back = checked(named.where("stays and count > 1").select("__k", "__digest"), BROADCAST_LIMIT)
    marked = docs.withColumn("__own", _digest(text))
    same = marked[key].eqNullSafe(F.col("__k")) & (F.col("__own") == F.col("__digest"))
    repeated = marked.join(back, same, "left_semi").dropDuplicates([key, "__own"])
    return marked.join(out, same, "left_anti").unionByName(repeated).drop("__own")


def _digest(text: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
