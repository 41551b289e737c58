"""Prefix trie of rebuilt conversations: ternary search trees per range shard, merged at the shards' edges.

1. Turns are encoded by a dictionary of all distinct (role, text): conversations become arrays of whole numbers, equal ones become one path.
2. Paths are dealt in ranges of their order. A prefix that is none of a shard's first or last path has all its members in that shard.
3. Each shard inserts its paths into a ternary search tree, the median first, so that siblings form a balanced search tree. An iterative
   traversal accumulates members, leaves and savings; nodes inside the shard are done.
4. The prefixes of first and last paths (the boundary) go on with what hangs on them directly. Runs of neighbouring shards are merged into
   one, which finishes the nodes inside and leaves a boundary again, until one is left.

A conversation is held as one row, as its turns' numbers. Members that end at one node are digested in order, in slices of conversation ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import prepared, stored
from tidemark.llm.resampling import CRC_TABLE_SQL, crc32_sql

GROUP, MOST_SHARED = 100, 6  # conversations of one hundred share up to 5 first turns
SLICE_BITS = 12  # conversation ids digested as one piece of text
SHARD_TURNS = 200_000  # turns of distinct paths in a shard
FAN = 64  # neighbouring shards merged together
NO_ENDS = hashlib.sha256().hexdigest()
_MASK = (1 << 64) - 1


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, lens): turn numbers of every rebuilt conversation, and code points of their texts."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("k1"), F.xxhash64(text, role).alias("k2"), F.length(text).alias("len"),
    )
    coded = stored(turns.groupBy("k1", "k2").agg(F.min("len").alias("chars")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    turns = turns.join(coded, ["k1", "k2"])
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "k1", "k2", "id", "chars"))).alias("turns"))
    own = stored(own.selectExpr("conv_id", "turns.id AS ids", "turns.chars AS lens"), "trie-conversations")
    base = own.where(f"conv_id % {GROUP} = 0").selectExpr("conv_id AS base", f"slice(ids, 1, {MOST_SHARED - 1}) AS base_ids", f"slice(lens, 1, {MOST_SHARED - 1}) AS base_lens")
    own = own.withColumn("h", F.expr(f"cast(crc32(encode(cast(conv_id AS string), 'UTF-8')) % {MOST_SHARED} AS int)"))
    both = own.join(base, F.expr(f"conv_id - conv_id % {GROUP} = base"), "left")
    shared = "concat(slice(coalesce(base_{0}, cast(array() AS array<{1}>)), 1, h), slice({0}, h + 1, size({0})))"
    return both.selectExpr("conv_id", shared.format("ids", "bigint") + " AS path", shared.format("lens", "int") + " AS lens")


_PATHS = "path array<long>, lens array<int>, n long, first long, ends string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each path, from its slices in order; slices of one path may come in several batches."""
    key, state, out = None, None, []

    def batch() -> pa.RecordBatch:
        done = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(done, names=["path", "lens", "n", "first", "ends"])

    for got in batches:
        for row in got.to_pylist():
            if key != (row["p1"], row["p2"]):
                if state:
                    out.append((*state[:4], state[4].hexdigest()))
                key, state = (row["p1"], row["p2"]), [row["path"], row["lens"], 0, row["first"], hashlib.sha256()]
            state[4].update((b"," if state[2] else b"") + row["ids"].encode())
            state[2] += row["n"]
        if out:
            yield batch()
            out = []
    if state:
        out = [(*state[:4], state[4].hexdigest())]
        yield batch()


def distinct_paths(rebuilt: DataFrame) -> DataFrame:
    """(path, lens, n, first, ends): distinct paths, how many conversations have it, the smallest, and the digest of all."""
    keyed = rebuilt.withColumns({"p1": F.xxhash64("path"), "p2": F.xxhash64(F.reverse("path"), F.size("path")), "slice": F.shiftright("conv_id", SLICE_BITS)})
    pieces = keyed.groupBy("p1", "p2", "slice").agg(
        F.first("path").alias("path"), F.first("lens").alias("lens"), F.count("*").alias("n"), F.min("conv_id").alias("first"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
    )
    pieces = pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "slice")
    return pieces.select("p1", "p2", "path", "lens", "n", "first", "ids").mapInArrow(_digest, _PATHS)


class TernaryTree:
    """Nodes by number; ``low`` and ``high`` lead to siblings, ``down`` to the next turn. Node 0 is the root above all turns."""

    def __init__(self):
        self.key, self.low, self.high, self.down = [None], [0], [0], [0]
        self.len, self.ends = [0], [None]

    def _new(self, key: int, length: int) -> int:
        for column, value in ((self.key, key), (self.low, 0), (self.high, 0), (self.down, 0), (self.len, length), (self.ends, None)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, path: list[int], lens: list[int], ends) -> None:
        at = 0
        for turn, length in zip(path, lens):
            side, place = self.down, at
            while (found := side[place]) and self.key[found] != turn:
                side, place = self.low if turn < self.key[found] else self.high, found
            if not found:
                found = side[place] = self._new(turn, length)
            at = found
        self.ends[at] = ends

    def insert_sorted(self, paths: list[tuple]) -> None:
        """The median first, then the medians of both halves, so that no side of a search tree is much deeper than the other."""
        spans = [(0, len(paths))]
        while spans:
            begin, end = spans.pop()
            if begin < end:
                middle = (begin + end) // 2
                self.insert(*paths[middle])
                spans += [(begin, middle), (middle + 1, end)]

    def nodes_of(self, path: list[int]) -> list[int]:
        """The nodes along a path, the root first."""
        out = [0]
        for turn in path:
            at = self.down[out[-1]]
            while self.key[at] != turn:
                at = self.low[at] if turn < self.key[at] else self.high[at]
            out.append(at)
        return out

    def preorder(self) -> tuple[list[int], dict[int, int]]:
        """All nodes, each after its parent, and their parents."""
        order, parent, waiting = [0], {}, [(self.down[0], 0)]
        while waiting:
            at, up = waiting.pop()
            if at:
                order.append(at)
                parent[at] = up
                waiting += [(self.low[at], up), (self.high[at], up), (self.down[at], at)]
        return order, parent


def _next_key(key: tuple[int, int], turn: int) -> tuple[int, int]:
    """Of a prefix one turn longer; both halves spread all bits."""

    def spread(x: int) -> int:
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
        return x ^ (x >> 31)

    return spread(key[0] * 0x9E3779B97F4A7C15 + turn + 1 & _MASK), spread(key[1] * 0xD6E8FEB86659FD93 + (turn ^ 0x5555) + 1 & _MASK)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Finished nodes (``shard`` null; ``parent`` unknown where the parent is on a boundary) and boundary nodes with what hangs on them directly.
_NODES = {
    "shard": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "up1": pa.int64(), "up2": pa.int64(), "conv": pa.int64(), "depth": pa.int32(), "parent": pa.int64(),
    "n": pa.int64(), "children": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(), "len": pa.int64(), "ends": pa.string(), "on_first": pa.bool_(), "on_last": pa.bool_(),
}
NODES = ", ".join(f"{k} {({'int32': 'int', 'int64': 'long', 'bool': 'boolean'}).get(str(t), str(t))}" for k, t in _NODES.items())


def shard_nodes(shard: int, paths: list[tuple]) -> list[tuple]:
    """Rows of ``_NODES`` for one shard's sorted (path, lens, (n, first, ends))."""
    tree = TernaryTree()
    tree.insert_sorted(paths)
    edge: dict[int, list] = {}  # boundary nodes: key, parent's key, on the first path, on the last
    for which, path in enumerate((paths[0][0], paths[-1][0])):
        key, up = (0, 0), (0, 0)
        for depth, at in enumerate(tree.nodes_of(path)):
            if depth:
                up, key = key, _next_key(key, path[depth - 1])
            edge.setdefault(at, [key, up, False, False])[2 + which] = True
    order, parent = tree.preorder()
    size = len(tree.key)
    n, first, children, leaves, saved, depth = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    for at in order[1:]:
        depth[at] = depth[parent[at]] + 1
    for at in reversed(order):  # children before their parents
        if tree.ends[at]:
            n[at] += tree.ends[at][0]
            first[at] = tree.ends[at][1] if first[at] is None else min(first[at], tree.ends[at][1])
        inside = at not in edge
        if inside:
            saved[at] += (n[at] - 1) * tree.len[at]
            leaves[at] = leaves[at] or 1
        if at:
            up = parent[at]
            n[up] += n[at]
            first[up] = first[at] if first[up] is None else min(first[up], first[at])
            if inside:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
    rows = []
    for at in order:
        ends = tree.ends[at][2] if tree.ends[at] else None
        figures = (n[at], children[at], leaves[at], saved[at], tree.len[at])
        if at in edge:
            key, up, on_first, on_last = edge[at]
            rows.append((shard, *map(_signed, key), *map(_signed, up), first[at], depth[at], None, *figures, ends, on_first, on_last))
        else:
            up = parent[at]
            known = (None, None, first[up]) if up not in edge else (*map(_signed, edge[up][0]), None)
            rows.append((None, None, None, *known[:2], first[at], depth[at], known[2], *figures, ends, None, None))
    return rows


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, shard = [], None
    for batch in batches:
        for row in batch.to_pylist():
            shard = row["shard"]
            paths.append((row["path"], row["lens"], (row["n"], row["first"], row["ends"])))
    if paths:
        rows = shard_nodes(shard, paths)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_NODES.values())], names=list(_NODES))


def _merge(last: bool, fan: int):
    """Boundary nodes of neighbouring shards as those of one; ``last`` finishes them all."""

    def merged(rows: list[tuple]) -> list[tuple]:
        names = list(_NODES)
        nodes: dict[tuple, dict] = {}
        low, high = min(r[0] for r in rows), max(r[0] for r in rows)
        for r in rows:
            x = dict(zip(names, r))
            on = (low == x["shard"] and x["on_first"], high == x["shard"] and x["on_last"])
            node = nodes.setdefault((x["k1"], x["k2"]), x)
            if node is x:
                x["on_first"], x["on_last"] = on
                continue
            for c in ("n", "children", "leaves", "saved"):
                node[c] += x[c]
            node["conv"] = min(node["conv"], x["conv"])
            node["ends"] = node["ends"] or x["ends"]
            node["on_first"] |= on[0]
            node["on_last"] |= on[1]
        out = []
        for key, x in sorted(nodes.items(), key=lambda item: -item[1]["depth"]):
            if not last and (x["on_first"] or x["on_last"]):
                out.append(tuple(x[c] if c != "shard" else low // fan for c in names))
                continue
            x["saved"] += (x["n"] - 1) * x["len"]
            x["leaves"] = x["leaves"] if x["children"] else 1
            if x["depth"]:
                up = nodes[x["up1"], x["up2"]]
                up["children"] += 1
                up["leaves"] += x["leaves"]
                up["saved"] += x["saved"]
            out.append(tuple(x[c] if c not in ("shard", "on_first", "on_last") else None for c in names))
        return out

    def run(group: pa.Table) -> pa.Table:
        rows = merged(list(zip(*(group.column(c).to_pylist() for c in _NODES))))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_NODES.values())], names=list(_NODES))

    return run


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are ordered by ``turn``, nulls first, equal ones in a fixed order by hashes of role and text; repeated rows are turns of their own. Null
    roles and texts are empty. Rows without ``conv_id`` belong to no conversation. Long texts count by their code points, and equal
    ones are stored once. An empty table gives no rows, not even a root. Other columns, whatever their names, are ignored.
    """
    prepared(conversations)
    paths = stored(distinct_paths(rebuilt_conversations(conversations)), "trie-paths")
    turns = paths.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    dealt = paths.repartitionByRange(-(-turns // shard_turns) or 1, "path").sortWithinPartitions("path").withColumn("shard", F.spark_partition_id())
    found = stored(dealt.mapInArrow(_shards, NODES), "trie-nodes")
    nodes, edge, above = found.where("shard IS NULL"), found.where("shard IS NOT NULL"), None
    while (most := edge.agg(F.max("shard")).first()[0]) is not None:
        got = stored(edge.groupBy(F.expr(f"shard DIV {fan}")).applyInArrow(_merge(most < fan, fan), NODES), "trie-boundary")
        finished, edge = got.where("shard IS NULL"), got.where("shard IS NOT NULL")
        named = finished.selectExpr("k1 AS above1", "k2 AS above2", "conv AS above_conv")
        nodes, above = nodes.unionAll(finished), named if above is None else above.unionAll(named)
    out = {"conv_id": "conv", "depth": "cast(depth AS long)", "parent_conv_id": "parent", "n_convs": "n", "n_children": "children", "n_leaves": "leaves", "saved_tokens": "saved", "ends_sha256": f"coalesce(ends, '{NO_ENDS}')"}
    columns = [F.expr(v).alias(k) for k, v in out.items()]
    if above is None:
        return nodes.select(*columns)
    missing = nodes.where("parent IS NULL AND depth > 0").drop("parent").join(above, (F.col("up1") == F.col("above1")) & (F.col("up2") == F.col("above2"))).withColumnRenamed("above_conv", "parent")
    return nodes.where("parent IS NOT NULL OR depth = 0").select(*columns).unionAll(missing.select(*columns))


def prefix_trie_sql() -> str:
    """DuckDB SQL for the query's rows: every prefix of every rebuilt conversation, and every node with all nodes above it."""
    return f"""
WITH {CRC_TABLE_SQL},
coded AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(id ORDER BY pos) AS ids, list(chars ORDER BY pos) AS lens, CAST(conv_id AS VARCHAR) AS name FROM coded GROUP BY conv_id),
h AS (SELECT conv_id, ids, lens, {crc32_sql('name')} % {MOST_SHARED} AS h FROM own, crc),
rebuilt AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.ids, []), 1, h), list_slice(h.ids, h + 1, len(h.ids))) AS ids,
list_concat(list_slice(coalesce(b.lens, []), 1, h), list_slice(h.lens, h + 1, len(h.lens))) AS lens FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % {GROUP}),
prefixes AS (SELECT conv_id, d, list_slice(ids, 1, d) AS p, coalesce(lens[d], 0) AS chars, len(ids) = d AS ends FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM rebuilt)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM prefixes GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
below AS (SELECT list_slice(p, 1, a) AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * chars) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM whole) GROUP BY ALL)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, CASE WHEN w.d > 0 THEN u.conv_id END AS parent_conv_id, CAST(w.n AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN below b USING (p) LEFT JOIN node u ON w.d > 0 AND u.p = list_slice(w.p, 1, w.d - 1)"""
