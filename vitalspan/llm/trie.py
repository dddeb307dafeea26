"""A prefix trie of conversations, built as z-fast tries.

A sequence of turns is named by the sum of one 128-bit digest for each (place, role, text), so
names of prefixes are running sums and a long conversation can be cut into stretches that start
from the sum before them. Tasks insert stretches, batch by batch, into a compacted trie: nodes
stand where sequences part or end, hashed by the name of their path cut at the two-fattest depth
of their edge. A fat binary search over depths finds the node at which a sequence leaves the
trie. A trie that has grown large is handed on and a new one begun; handing on expands edges
into a node for each depth, and equal nodes of all tries are added up by their names.

Sums over subtrees need no walk: of each node's members the smallest conversation stands for
it, the nodes it stands for are the lower part of its own path, and what they hold is added to
the nodes above them by inserting that upper path with a weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.prefix import running_totals
from vitalspan.llm.bytewords import mix
from vitalspan.session import cut_lineage

#: Turns of one stretch of a conversation.
STRETCH = 1024
#: Depths held by a task's trie before it is handed on.
TRIE_DEPTHS = 200_000
#: Decimal ids in one piece of the list whose digest is taken.
PIECE_IDS = 4096
#: Conversations that open alike share at most the first SHARED - 1 turns.
SHARED = 6
GROUP = 100
_ROOT = bytes(16)


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted tries over sequences of prefix names; weights are summed over subtrees.

    A sequence is the list of names of its prefixes, its root's first. Names tell depths and
    roots apart, so one set of handles serves any number of roots.
    """

    def __init__(self):
        #: Of each node: depths of its edge's ends, the node above, the names and last turns
        #: of a sequence through it, the depth of its root, its weights, its least conversation.
        self.low: list[int] = []
        self.high: list[int] = []
        self.up: list[int] = []
        self.path: list[list[bytes]] = []
        self.last: list = []
        self.base: list[int] = []
        self.weight: list[list[int]] = []
        self.least: list[int | None] = []
        self.roots: dict[bytes, int] = {}
        self.handles: dict[bytes, int] = {}
        self.edges: dict[bytes, int] = {}
        self.depths = 0

    def _node(self, up: int, low: int, high: int, path: list[bytes], last, base: int, weights: int) -> int:
        columns = (self.low, self.high, self.up, self.path, self.last, self.base, self.weight, self.least)
        for column, value in zip(columns, (low, high, up, path, last, base, [0] * weights, None)):
            column.append(value)
        return len(self.low) - 1

    def _hash(self, node: int) -> None:
        self.handles[self.path[node][fattest(self.low[node], self.high[node])]] = node

    def exit_node(self, path: list[bytes]) -> int:
        """The lowest node whose whole path ``path`` begins with."""
        node = self.roots[path[0]]
        left, right = 0, len(path) - 1
        while left < right:
            depth = fattest(left, right)
            found = self.handles.get(path[depth])
            if found is None:
                right = depth - 1
                continue
            high = self.high[found]
            if high >= len(path) or self.path[found][high] != path[high]:
                return self.up[found]
            node, left = found, high
        return node

    def insert(self, path: list[bytes], last, base: int, least: int, weight: list[int]) -> None:
        """Add a sequence; ``last`` has, for each depth, what belongs to its last turn."""
        size = len(path) - 1
        if path[0] not in self.roots:
            self.roots[path[0]] = self._node(-1, -1, 0, path, last, base, len(weight))
        node = self.exit_node(path)
        at = self.high[node]
        if at < size:
            below = self.edges.get(path[at + 1])
            if below is not None:
                # Leaves within the edge to ``below``: cut it where the two part.
                theirs = self.path[below]
                low, high = at + 1, min(self.high[below], size)
                while low < high:
                    middle = (low + high + 1) // 2
                    if theirs[middle] == path[middle]:
                        low = middle
                    else:
                        high = middle - 1
                del self.handles[theirs[fattest(at, self.high[below])]]
                node = self._node(node, at, low, path, last, base, len(weight))
                self.edges[path[at + 1]] = node
                self._hash(node)
                self.low[below], self.up[below] = low, node
                self.edges[theirs[low + 1]] = below
                self._hash(below)
                at = low
            if at < size:
                leaf = self._node(node, at, size, path, last, base, len(weight))
                self.edges[path[at + 1]] = leaf
                self._hash(leaf)
                self.depths += size - at
                node = leaf
        mine = self.weight[node]
        for k, w in enumerate(weight):
            mine[k] += w
        if self.least[node] is None or least < self.least[node]:
            self.least[node] = least

    def expanded(self) -> Iterator[tuple]:
        """(name, name above, depth, what belongs to the last turn, least, weights) of every
        depth of every edge, and of the textless root."""
        for node in sorted(range(len(self.low)), key=lambda k: -self.high[k]):
            path, last, base = self.path[node], self.last[node], self.base[node]
            least, weight, up = self.least[node], self.weight[node], self.up[node]
            if up < 0:
                if base == 0:
                    yield path[0], None, 0, 0, least, weight
                continue
            for k, w in enumerate(weight):
                self.weight[up][k] += w
            if self.least[up] is None or least < self.least[up]:
                self.least[up] = least
            for depth in range(self.low[node] + 1, self.high[node] + 1):
                yield path[depth], path[depth - 1], base + depth, last[depth - 1], least, weight


def _names(start: bytes, turns: list[bytes], first: int) -> list[bytes]:
    """The names of the prefixes of a stretch whose first turn has place ``first``."""
    parts = np.frombuffer(b"".join(turns), "<u8").reshape(-1, 2)
    place = mix(np.arange(first, first + len(parts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    sums = np.empty((len(parts) + 1, 2), "<u8")
    sums[0] = np.frombuffer(start, "<u8")
    sums[1:, 0] = mix(parts[:, 0] + place)
    sums[1:, 1] = mix(parts[:, 1] ^ mix(place))
    flat = np.cumsum(sums, axis=0, dtype=np.uint64).tobytes()
    return [flat[k : k + 16] for k in range(0, len(flat), 16)]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sums(stretch: int):
    """What each stretch adds to the names after it, in four parts of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows = zip(batch.column("stretch").to_pylist(), batch.column("turns").to_pylist())
            ends = [np.frombuffer(_names(_ROOT, t, s * stretch + 1)[-1], "<u4").astype(np.int64) for s, t in rows]
            parts = np.array(ends, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("stretch"), *(pa.array(parts[:, k]) for k in range(4))],
                names=["conv_id", "stretch", "s0", "s1", "s2", "s3"],
            )

    return run


_NODES = "name binary, above binary, depth long, chars long, conv_id long, n long, m long, ends boolean"


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ["name", "above", "depth", "chars", "conv_id", "n", "m", "ends"]
    while part := list(islice(rows, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)


def _insert(stretch: int, depths: int):
    """The nodes of tries of a task's stretches; and, where ``final``, which of them it ends at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ends = ZFastTrie(), []

        def handed_on() -> Iterator[tuple]:
            for name, above, depth, chars, least, weight in trie.expanded():
                yield name, above, depth, chars, least, *weight, False
            for name, conv in ends:
                yield name, None, None, None, conv, None, None, True

        for batch in _parts(batches):
            parts = np.stack([batch.column(f"s{k}").to_numpy() for k in range(4)], axis=1).astype(np.uint64)
            # Four sums of 32-bit parts are two sums of 64-bit words.
            starts = (parts[:, ::2] + (parts[:, 1::2] << np.uint64(32))).astype("<u8")
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "stretch", "turns", "chars", "n", "m", "final")]
            for start, conv, number, turns, chars, n, m, final in zip(starts, *columns):
                path = _names(start.tobytes(), turns, number * stretch + 1)
                trie.insert(path, chars, number * stretch, conv, [n, m])
                if final:
                    ends.append((path[-1], conv))
                if trie.depths + len(trie.low) + len(ends) > depths:
                    yield from _batches(handed_on())
                    trie, ends = ZFastTrie(), []
        yield from _batches(handed_on())

    return run


def _joined(most: int):
    """Runs of at most ``most`` ids of one node, comma-joined; rows come in (name, id) order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, []

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
                names=["name", "conv_id", "ids"],
            )

        for batch in batches:
            for key, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (key != name or len(ids) == most):
                    yield done()
                    ids = []
                name = key
                ids.append(conv)
        if ids:
            yield done()

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in (name, id) order."""
    name, digest, out = None, None, []

    def done():
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], names=["name", "sha"])

    for batch in batches:
        for key, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if key != name:
                if digest is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(("," + ids).encode())
        if len(out) > 10_000:
            yield done()
            out = []
    if digest is not None:
        out.append((name, digest.hexdigest()))
    if out:
        yield done()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn (a digest of role and text) and chars of every turn.

    Turns go by ``turn``, NULL first; those with the same number by the digest. NULL roles and
    texts are empty. Rows with a NULL conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("number"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn"),
        F.length(text).cast("long").alias("chars"),
    )
    # Equal rows are counted, so any number of them takes one place in the order.
    counted = rows.groupBy("conv_id", F.struct("number", "turn").alias("key")).agg(F.count("*").alias("n"), F.first("chars").alias("chars"))
    placed = running_totals(counted, "key", ["n"], ["conv_id"], descending=False)
    place = F.explode(F.sequence(F.col("n_before") + 1, F.col("n_before") + F.col("n")))
    return placed.select("conv_id", place.alias("place"), F.unhex("key.turn").alias("turn"), "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that open like the first of their hundred; those without turns have one
    row whose place is NULL.

    The first h turns of conversation c - c % 100 come first, h being crc32(c as text) % 6, and
    then c's own after its first h.
    """
    opening = F.crc32(F.col("conv_id").cast("string")) % SHARED
    heads = turns.where(F.col("place") < SHARED).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "chars"))).alias("head"))
    convs = turns.where("place = 1").select("conv_id", opening.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    lent = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,turn:binary,chars:bigint>>")), 1, F.col("h").cast("int")))
    convs = convs.select("conv_id", "h", F.coalesce(lent, F.array().cast("array<struct<place:bigint,turn:binary,chars:bigint>>")).alias("lent"))
    convs = cut_lineage(convs.withColumn("shift", F.size("lent") - F.col("h")))
    first = convs.select("conv_id", F.explode_outer("lent").alias("t")).select("conv_id", "t.*")
    own = turns.join(convs.select("conv_id", "h", "shift"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "turn", "chars")
    return first.union(own)


def stretches(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Runs of at most ``stretch`` turns: conv_id, stretch, turns and chars (arrays), start (the name
    of all turns before) and whether it is the conversation's last (final)."""
    cut = F.coalesce(F.floor((F.col("place") - 1) / stretch), F.lit(0)).alias("stretch")
    filled = F.when(F.col("place").isNotNull(), F.struct("place", "turn", "chars"))
    runs = turns.groupBy("conv_id", cut).agg(F.array_sort(F.collect_list(filled)).alias("t"))
    runs = cut_lineage(runs.select("conv_id", "stretch", F.col("t.turn").alias("turns"), F.col("t.chars").alias("chars")))
    sums = runs.mapInArrow(_sums(stretch), "conv_id long, stretch long, s0 long, s1 long, s2 long, s3 long")
    order = Window.partitionBy("conv_id").orderBy("stretch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"s{k}") for k in range(4)]
    starts = sums.select("conv_id", "stretch", *ahead, F.lead("stretch").over(order).isNull().alias("final"))
    return runs.join(starts, ["conv_id", "stretch"])


def _inserted(runs: DataFrame, stretch: int, depths: int) -> DataFrame:
    wanted = ("conv_id", "stretch", "turns", "chars", "s0", "s1", "s2", "s3", "n", "m", "final")
    return runs.select(*wanted).mapInArrow(_insert(stretch, depths), _NODES)


def prefix_nodes(conversations: DataFrame, stretch: int = STRETCH, depths: int = TRIE_DEPTHS, piece_ids: int = PIECE_IDS) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations.

    conv_id is the smallest member, members being the conversations that begin with the
    sequence; depth its number of turns; parent_conv_id the conv_id of the sequence without
    its last turn (NULL at depth 0); n_convs the members; n_children the distinct sequences of
    one more turn; n_leaves the childless nodes in the subtree, its top included; saved_tokens
    the subtree's sum of (n_convs - 1) times the code points of the last text; ends_sha256 the
    SHA-256 of the members that have no further turn, in decimal, ascending, comma-joined.

    NULL roles and texts are empty, so are texts of repeated rows their own turns; rows of a
    NULL conv_id are left out; further columns are not read. No rows give no node. ``stretch``, ``depths`` and
    ``piece_ids`` bound what a task holds and do not change the result.
    """
    runs = cut_lineage(stretches(rebuilt(cut_lineage(ordered_turns(conversations))), stretch))
    made = cut_lineage(_inserted(runs.withColumns({"n": F.lit(1).cast("long"), "m": F.lit(0).cast("long")}), stretch, depths))
    nodes = made.where("NOT ends").groupBy("name").agg(
        *(F.first(c).alias(c) for c in ("above", "depth", "chars")), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")
    )
    nodes = cut_lineage(nodes)
    children = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = cut_lineage(nodes)

    # A conversation's own nodes are the lower end of its path; what they hold is summed along
    # it, and their sum goes to each node of the path above them.
    along = running_totals(nodes.select("name", "conv_id", "depth", "leaf", "saved"), "depth", ["leaf", "saved"], ["conv_id"])
    own = along.select("name", (F.col("leaf") + F.col("leaf_before")).alias("n"), (F.col("saved") + F.col("saved_before")).alias("m"))
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("n"), F.sum("saved").alias("m"))
    chains = chains.where("top > 0 AND (n > 0 OR m > 0)")
    reach = F.least(F.lit(stretch).cast("long"), F.col("top") - 1 - F.col("stretch") * stretch).cast("int")
    upper = runs.drop("final").join(chains, "conv_id").withColumn("reach", reach)
    upper = upper.where("reach > 0 OR (reach = 0 AND stretch = 0)")
    upper = upper.withColumns({c: F.slice(c, F.lit(1), F.col("reach")) for c in ("turns", "chars")}).withColumn("final", F.lit(False))
    held = own.union(_inserted(upper, stretch, depths).select("name", "n", "m")).groupBy("name").agg(F.sum("n").alias("n_leaves"), F.sum("m").alias("saved_tokens"))

    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = made.where("ends").select("name", "conv_id").repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    ends = ends.mapInArrow(_joined(piece_ids), "name binary, conv_id long, ids string")
    ends = ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_digested, "name binary, sha string")

    above = nodes.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("leaf", "saved").join(above, "above", "left").join(held, "name").join(ends, "name", "left")
    sha = F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha)
