"""Parent-child links of unknown depth to roots, depths, paths and cycles.

Nodes are range-partitioned by columns that keep families together, and a partition is a *fragment*. Within a
fragment the parent chains are contracted: what remains of a node is its longest way to each *exit* (a parent
in another fragment) and the best root inside. Only nodes that other fragments name (*entries*) go on; they
form the quotient graph, which is fragmented more coarsely and solved the same way until it fits one task. The
entries' values then return as the exits' values, and each fragment expands its own nodes.

A quotient graph that has become one fragment and still does not fit, as its nodes were laid out badly, is laid out
again by its own links; one that no layout contracts is solved round by round with joins. No task gets more than
``fits`` rows but those of one fragment.

A node that no order of its fragment can place is on a local cycle or below one; an entry that no order of the
quotient graph can place is on a cycle across fragments or below one.

A node whose exits grow past a bound becomes a node of the quotient graph itself, so a fragment's summary stays
proportional to its edges. Work and memory of a task follow its fragment, whose size bounds the number of
fragments; a parent with a third of all nodes as children is one row of the key side of one join.

All ancestors (closure) go the same way with sets of ids in place of ways: an entry keeps those inside that it
reaches without another entry, and its entries and exits are its edges in the quotient graph.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialize, tasks_for

#: kind: 'n' node (a, w = depth of the best way to a root inside, label = that root; both null: unknown), 'e' edge (a = child, b = parent, w = steps), 'k' entry (a), 'x' exit with its value (a, w, label), 'c' node known to be below a cycle (a)
_ROWS = "frag long, kind string, a long, b long, w long, label string, path array<string>"
_SOLVED = "a long, w long, label string, path array<string>"
_NAMES = ["frag", "kind", "a", "b", "w", "label", "path"]
#: kind as above ('n': above = the ancestors known so far, label = its id; 'x': above = all of them), 'u' id of an ancestor of an exit (a, label)
_CLOSURE_ROWS = "frag long, kind string, a long, b long, label string, above array<long>"
_CLOSED = "a long, above array<long>"
#: nid = fragment * 2**33 + position, as monotonically_increasing_id() gives.
_FRAGMENT_BITS = 33
#: A node with more exits than this is kept in the quotient graph.
_MOST_EXITS = 16
#: One node in so many is a head when a graph is laid out by its links; the doubling steps reach that far and further.
_HEADS, _JUMPS = 64, 8
#: A layout by links that leaves more than this share of a graph did not help, and it is solved round by round.
_SHRINK = 0.7
#: Pairs of about one output batch.
_PAIRS = 100_000
CYCLE = "cycle"


class _Way:
    """A longest way up: steps, and with paths the nodes on it as a linked list (nearest first)."""

    __slots__ = ("steps", "chain")

    def __init__(self, steps: int, chain):
        self.steps, self.chain = steps, chain


def _names(chain) -> list[str]:
    """Ids from the node's parent upwards. A link is (id, rest) or ((ids...), None) for a stored stretch."""
    out: list[str] = []
    while chain is not None:
        head, chain = chain
        out.extend(head if isinstance(head, tuple) else (head,))
    return out


def _better(new: _Way, old: _Way | None, paths: bool) -> bool:
    if old is None or new.steps != old.steps:
        return old is None or new.steps > old.steps
    return paths and _names(new.chain) < _names(old.chain)


class _Fragment:
    """The rows of one fragment, solved in an order that puts parents first."""

    def __init__(self, table: pa.Table, paths: bool):
        self.paths = paths
        self.nodes: dict[int, tuple] = {}
        self.exits: dict[int, tuple] = {}
        self.up: dict[int, list] = {}
        self.entries: set[int] = set()
        self.doomed: set[int] = set()
        names = table.column("path").to_pylist() if paths else [None] * table.num_rows
        for kind, a, b, w, label, path in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b", "w", "label")), names):
            if kind == "n":
                self.nodes[a] = (w, label, path)
            elif kind == "e":
                self.up.setdefault(a, []).append((b, w, path))
            elif kind == "x":
                self.exits[a] = (w, label, path)
            elif kind == "k":
                self.entries.add(a)
            else:
                self.doomed.add(a)

    def order(self) -> list[int]:
        down: dict[int, list[int]] = {}
        waits: dict[int, int] = {}
        for child, parents in self.up.items():
            inner = [p for p, _, _ in parents if p in self.nodes]
            if inner:
                waits[child] = len(inner)
                for p in inner:
                    down.setdefault(p, []).append(child)
        ready = [v for v in self.nodes if v not in waits]
        for v in ready:  # grows while it is read
            for child in down.get(v, ()):
                waits[child] -= 1
                if not waits[child]:
                    ready.append(child)
        return ready

    def own(self, v: int) -> tuple[_Way | None, str | None]:
        """What is known of v without its parents; a node of the first level without parents is a root."""
        w, label, path = self.nodes[v]
        if w is not None:
            return _Way(w, (tuple(path), None) if path else None), label
        if v not in self.up and label is not None:
            return _Way(0, None), label
        return None, None

    def step(self, p: int, way: _Way, w: int, stretch) -> _Way:
        """The way that goes from a child to p by an edge of w steps and on by p's way. stretch: the ids strictly between the child and the way's nodes, ending with p's own id."""
        chain = way.chain
        if self.paths:
            chain = (tuple(stretch), chain) if stretch else chain
        return _Way(way.steps + w, chain)


def _summary(paths: bool):
    """Contracts a fragment: rows of the quotient graph."""

    def run(table: pa.Table) -> pa.Table:
        f = _Fragment(table, paths)
        order = f.order()
        placed = set(order)
        inside: dict[int, tuple] = {}  # node -> (best way to a root inside, smallest root inside, {exit: way}, below a cycle)
        out: list[tuple] = []
        for v in order:
            best, label = f.own(v)
            ways: dict[int, _Way] = {}
            doomed = v in f.doomed
            for p, w, stretch in f.up.get(v, ()):
                if p not in f.nodes:
                    new = _Way(w, (tuple(stretch), None) if paths and stretch else None)
                    if _better(new, ways.get(p), paths):
                        ways[p] = new
                    continue
                p_best, p_label, p_ways, p_doomed = inside[p]
                doomed |= p_doomed
                if p_best is not None:
                    new = f.step(p, p_best, w, stretch)
                    if _better(new, best, paths):
                        best = new
                if p_label is not None and (label is None or p_label < label):
                    label = p_label
                for x, way in p_ways.items():
                    new = f.step(p, way, w, stretch)
                    if _better(new, ways.get(x), paths):
                        ways[x] = new
            if v in f.entries or len(ways) > _MOST_EXITS:
                if doomed:
                    out.append(("c", v, None, None, None, None))
                    inside[v] = (None, None, {}, True)
                    out.append(("n", v, None, None, None, None))
                    continue
                out.append(("n", v, None, best.steps if best else None, label, _names(best.chain) if best and paths else None))
                out.extend(("e", v, x, way.steps, None, _names(way.chain) if paths else None) for x, way in ways.items())
                inside[v] = (None, None, {v: _Way(0, None)}, False)
            else:
                inside[v] = (best, label, ways, doomed)
        for v in f.entries:
            if v not in placed and v in f.nodes:
                out.append(("c", v, None, None, None, None))
                out.append(("n", v, None, None, None, None))
        columns = list(zip(*out)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES[1:])

    return run


def _solve(paths: bool):
    """Places every node of a fragment whose exits' values are known; steps null and label CYCLE where none fits."""

    def run(table: pa.Table) -> pa.Table:
        f = _Fragment(table, paths)
        done: dict[int, tuple] = {}  # node -> (way, root) or None below a cycle
        for x, (w, label, path) in f.exits.items():
            done[x] = (_Way(w, (tuple(path), None) if path else None), label) if w is not None else None
        for v in f.order():
            best, label = f.own(v)
            doomed = v in f.doomed
            for p, w, stretch in f.up.get(v, ()):
                above = done.get(p)
                if above is None:
                    doomed = True
                    break
                new = f.step(p, above[0], w, stretch)
                if _better(new, best, paths):
                    best = new
                if above[1] is not None and (label is None or above[1] < label):
                    label = above[1]
            done[v] = None if doomed or best is None else (best, label)
        ids, steps, labels, ways = [], [], [], []
        for v in f.nodes:
            at = done.get(v)
            ids.append(v)
            steps.append(at[0].steps if at else None)
            labels.append(at[1] if at else CYCLE)
            ways.append(_names(at[0].chain) if at and paths else None)
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(steps, pa.int64()), pa.array(labels, pa.string()), pa.array(ways, pa.list_(pa.string()))], names=["a", "w", "label", "path"])

    return run


def _coarse(nid: str | Column, level: int) -> Column:
    """The fragment of a node at a level: eight neighbours become one at each."""
    return F.shiftright(nid, _FRAGMENT_BITS + 3 * level)


def _grouped(rows: DataFrame, total: int, per_fragment: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows renumbered so that nodes are near their parents, the numbers (a, old) and the number of fragments.

    A sample of the nodes, chosen by a hash, and those without parents are heads; every other node follows its smallest parent
    upwards, in doubling steps, to the next head, and nodes of one head lie together.
    """
    first = rows.filter("kind = 'e'").groupBy("a").agg(F.min("b").alias("up"))
    nodes = rows.filter("kind = 'n'").select("a").distinct().join(first, "a", "left")
    hops = materialize(nodes.select("a", F.when(F.col("up").isNull() | (F.xxhash64("a") % _HEADS == 0), F.col("a")).otherwise(F.col("up")).alias("up")), "hops")
    for _ in range(_JUMPS):
        further = hops.join(hops.select(F.col("a").alias("up"), F.col("up").alias("next")), "up").select("a", F.col("next").alias("up"))
        further = materialize(further, "hops")
        discard(hops)
        hops = further
    fragments = max(2, -(-total // per_fragment))
    laid = materialize(hops.repartitionByRange(fragments, "up", "a").select(F.monotonically_increasing_id().alias("a"), F.col("a").alias("old")), "laid")
    discard(hops)
    moved = rows.withColumnsRenamed({"a": "old", "b": "old_b"}).join(laid, "old").join(laid.select(F.col("a").alias("b"), F.col("old").alias("old_b")), "old_b", "left")
    return materialize(moved.select("kind", "a", "b", "w", "label", "path"), "moved"), laid, fragments


def _by_rounds(rows: DataFrame) -> DataFrame:
    """Values (_SOLVED) of a graph that no layout contracts: round by round, a node once all its parents have theirs.

    As many rounds as the longest way in it has steps; nothing but joins and one aggregation a round, so no task grows.
    """
    waiting = materialize(rows.filter("kind = 'n'").select("a", "w", "label", "path"), "waiting")
    links = rows.filter("kind = 'e'").select("a", "b", F.col("w").alias("step"), F.col("path").alias("stretch"))
    below = rows.filter("kind = 'c'").select("a", F.lit(True).alias("below")).distinct()
    none = F.array().cast("array<string>")
    done = None
    while True:
        if done is None:
            ready = waiting.join(links.select("a").distinct(), "a", "left_anti").join(below, "a", "left")
            fresh = ready.select("a", F.when(F.col("below").isNull(), F.coalesce("w", F.when(F.col("label").isNotNull(), 0))).cast("long").alias("w"), F.when(F.col("below").isNull(), F.col("label")).alias("label"), "path")
        else:
            known = links.join(waiting.select("a"), "a", "left_semi").join(done.select(F.col("a").alias("b"), F.col("w").alias("pw"), F.col("label").alias("pl"), F.col("path").alias("pp"), F.lit(True).alias("known")), "b", "left")
            way = F.struct((-(F.col("step") + F.col("pw"))).alias("n"), F.concat(F.coalesce("stretch", none), F.coalesce("pp", none)).alias("path"))
            above = known.groupBy("a").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all"), F.bool_or(F.col("known") & F.col("pw").isNull()).alias("lost"), F.min(F.when(F.col("pw").isNotNull(), way)).alias("way"), F.min("pl").alias("pl")).filter("all")
            own = F.struct((-F.col("w")).alias("n"), F.coalesce("path", none).alias("path"))
            best = F.least(F.when(F.col("w").isNotNull(), own), F.col("way"))
            good = F.col("below").isNull() & ~F.coalesce("lost", F.lit(False))
            fresh = waiting.join(above, "a").join(below, "a", "left").select("a", F.when(good, -best["n"]).alias("w"), F.when(good, F.least("label", "pl")).alias("label"), F.when(good, best["path"]).alias("path"))
        fresh = materialize(fresh, "round")
        if fresh.isEmpty():
            break
        done = fresh if done is None else materialize(done.unionByName(fresh), "done")
        waiting = materialize(waiting.join(fresh.select("a"), "a", "left_anti"), "waiting")
    lost = waiting.select("a", F.lit(None).cast("long").alias("w"), F.lit(CYCLE).alias("label"), F.lit(None).cast("array<string>").alias("path"))
    return lost if done is None else done.select("a", "w", F.when(F.col("w").isNull(), F.lit(CYCLE)).otherwise(F.col("label")).alias("label"), "path").unionByName(lost)


def _place(rows: DataFrame, level: int, fits: int, total: int, paths: bool, finest: int, laid: int | None = None) -> DataFrame:
    """Values (_SOLVED) of all nodes of a graph given as rows of kind n, e and c. ``laid``: its size when it was last laid out by its links."""
    if total > fits and (finest >> (3 * level)) == 0:
        if laid is not None and total > _SHRINK * laid:
            return _by_rounds(rows)
        moved, numbers, fragments = _grouped(rows, total, max(1, fits // 4))
        values = _place(moved, 0, fits, 1 << 62, paths, fragments, total)
        return numbers.join(values, "a").select(F.col("old").alias("a"), "w", "label", "path")
    if total <= fits:
        return rows.withColumn("frag", F.lit(0).cast("long")).groupBy("frag").applyInArrow(_solve(paths), _SOLVED)
    rows = rows.withColumn("frag", _coarse("a", level))
    across = rows.filter((F.col("kind") == "e") & (F.col("frag") != _coarse("b", level))).select("frag", F.col("b").alias("a")).distinct()
    nothing = [F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("w"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<string>").alias("path")]
    entries = across.select("a").distinct().select(_coarse("a", level).alias("frag"), F.lit("k").alias("kind"), "a", *nothing)
    quotient = materialize(rows.unionByName(entries).groupBy("frag").applyInArrow(_summary(paths), _ROWS.replace("frag long, ", "")), "quotient")
    values = _place(quotient, level + 1, fits, quotient.count(), paths, finest, laid)
    exits = across.join(values, "a").select("frag", F.lit("x").alias("kind"), "a", F.lit(None).cast("long").alias("b"), "w", "label", "path")
    return rows.unionByName(exits).groupBy("frag").applyInArrow(_solve(paths), _SOLVED)


def _laid_out(nodes: DataFrame, place: Sequence[str], nodes_per_fragment: int) -> tuple[DataFrame, DataFrame, int]:
    """The distinct nodes (a, node_id, parents) in fragments, their links (a, parent), and the number of fragments."""
    parents = F.coalesce("parents", F.array().cast("array<string>"))
    one = nodes.filter("node_id is not null").groupBy("node_id").agg(F.array_distinct(F.flatten(F.collect_set(parents))).alias("parents"), *[F.min(c).alias(f"place_{i}") for i, c in enumerate(place)])
    fragments = tasks_for(nodes.sparkSession, nodes.count(), nodes_per_fragment)
    laid = one.repartitionByRange(fragments, *[f"place_{i}" for i in range(len(place))], "node_id").select(F.monotonically_increasing_id().alias("a"), "node_id", "parents")
    laid = materialize(laid, "nodes")
    links = laid.select("a", F.explode("parents").alias("parent")).filter("parent is not null")
    return laid, links, fragments


def resolve(nodes: DataFrame, place: Sequence[str] = (), with_path: bool = False, nodes_per_fragment: int = 50_000, fits: int = 400_000) -> DataFrame:
    """(node_id, root_id, node_depth, path) per distinct node.

    ``nodes``: node_id STRING, parents ARRAY<STRING>, and the ``place`` columns, by whose order nodes are laid
    out so that a node is near its parents; any choice is right, a good one makes the quotient graph small.
    Rows of one node_id are united (all their parents, the smallest place). Rows with a null node_id are left
    out; parents that are null or no node are ignored. node_depth is the longest way up, root_id the smallest
    root above; a node on a cycle or below one has depth -1 and root ``cycle``. ``path`` (with_path; else null)
    runs from a root to the node along a longest way, of several the one whose ids read upwards are smallest;
    null at cycles. ``fits``: nodes and edges one task may solve at the end.
    """
    laid, links, fragments = _laid_out(nodes, place, nodes_per_fragment)
    edges = materialize(links.join(laid.select(F.col("a").alias("b"), F.col("node_id").alias("parent")), "parent").select("a", "b", *(["parent"] if with_path else [])), "edges")
    null_long, null_path = F.lit(None).cast("long"), F.lit(None).cast("array<string>")
    rows = laid.select(F.lit("n").alias("kind"), "a", null_long.alias("b"), null_long.alias("w"), F.col("node_id").alias("label"), null_path.alias("path"))
    rows = rows.unionByName(edges.select(F.lit("e").alias("kind"), "a", "b", F.lit(1).cast("long").alias("w"), F.lit(None).cast("string").alias("label"), (F.array("parent") if with_path else null_path).alias("path")))
    values = _place(rows, 0, fits, 1 << 62, with_path, fragments)
    up = F.when(F.col("w").isNotNull(), F.reverse(F.concat(F.array("node_id"), F.coalesce("path", F.array().cast("array<string>")))))
    return laid.select("a", "node_id").join(values, "a").select("node_id", F.col("label").alias("root_id"), F.coalesce("w", F.lit(-1).cast("long")).alias("node_depth"), (up if with_path else null_path).alias("path"))


class _Above(_Fragment):
    """The rows of one fragment, for sets of ancestors; a set is a number with a bit for each id of the fragment."""

    def __init__(self, table: pa.Table):
        self.nodes: dict[int, np.ndarray] = {}
        self.exits: dict[int, np.ndarray] = {}
        self.up: dict[int, list] = {}
        self.entries: set[int] = set()
        named: dict[int, str] = {}
        for kind, a, b, label, above in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b", "label")), table.column("above")):
            if kind == "e":
                self.up.setdefault(a, []).append((b, None, None))
            elif kind == "k":
                self.entries.add(a)
            else:
                if kind != "u":
                    (self.nodes if kind == "n" else self.exits)[a] = above.values.to_numpy() if above.is_valid else np.zeros(0, np.int64)
                if label is not None:
                    named[a] = label
        known = [np.array([*self.nodes, *self.exits, *(p for up in self.up.values() for p, _, _ in up)], np.int64)]
        self.ids = np.unique(np.concatenate([*known, *self.nodes.values(), *self.exits.values()]))
        self.bit = {v: 1 << i for i, v in enumerate(self.ids.tolist())}
        self.names = pa.array([named.get(v) for v in self.bit], pa.string())

    def mask(self, ids: np.ndarray) -> int:
        if not len(ids):
            return 0
        bits = np.zeros(len(self.ids), np.uint8)
        bits[np.searchsorted(self.ids, ids)] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def places(self, mask: int) -> np.ndarray:
        """Where in ``ids`` the members of a set are."""
        return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(len(self.ids) // 8 + 1, "little"), np.uint8), bitorder="little"))

    def all_above(self) -> Iterator[tuple[int, np.ndarray]]:
        """(node, where its ancestors are), the exits' being known."""
        done = {x: self.mask(above) for x, above in self.exits.items()}
        for v in self.order():
            mask = self.mask(self.nodes[v])
            for p, _, _ in self.up.get(v, ()):
                mask |= self.bit[p] | done[p]
            done[v] = mask
            yield v, self.places(mask)


def _contracted(table: pa.Table) -> pa.Table:
    """Rows of the quotient graph of a fragment: each entry with the ancestors it reaches inside before another entry or an exit, and those as its edges."""
    f = _Above(table)
    inside: dict[int, tuple[int, int]] = {}
    out: list[tuple] = []
    for v in f.order():
        own, ways = f.mask(f.nodes[v]), 0
        for p, _, _ in f.up.get(v, ()):
            if p not in f.nodes or p in f.entries:
                ways |= f.bit[p]
            else:
                own |= f.bit[p] | inside[p][0]
                ways |= inside[p][1]
        inside[v] = own, ways
        if v in f.entries:
            out.append(("n", v, None, None, f.ids[f.places(own)]))
            out.extend(("e", v, x, None, None) for x in f.ids[f.places(ways)].tolist())
    columns = list(zip(*out)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "a", "b", "label", "above"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All ancestors of every node of a fragment, one row a node."""
    f = _Above(pa.Table.from_batches(list(batches)))
    for v, places in f.all_above():
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([f.ids[places]], pa.list_(pa.int64()))], names=["a", "above"])


def _closed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same by names, one row a pair."""
    f = _Above(pa.Table.from_batches(list(batches)))
    above, below, n = [], [], 0

    def batch() -> pa.RecordBatch:
        of = np.repeat(np.searchsorted(f.ids, below), [len(x) for x in above])
        return pa.RecordBatch.from_arrays([f.names.take(pa.array(np.concatenate(above))), f.names.take(pa.array(of))], names=["node_id", "descendant"])

    for v, places in f.all_above():
        above.append(places)
        below.append(v)
        n += len(places)
        if n >= _PAIRS:
            yield batch()
            above, below, n = [], [], 0
    if n:
        yield batch()


def _close(rows: DataFrame, level: int, fits: int, total: int, finest: int) -> DataFrame:
    """Ancestors (_CLOSED) of all nodes of a graph without cycles, given as rows of kind n and e; at level 0 the pairs by name."""
    if level and (total <= fits or (finest >> (3 * level)) == 0):
        return rows.withColumn("frag", F.lit(0).cast("long")).groupBy("frag").applyInArrow(_closed, _CLOSED)
    rows = rows.withColumn("frag", _coarse("a", level))
    across = rows.filter((F.col("kind") == "e") & (F.col("frag") != _coarse("b", level))).select("frag", F.col("b").alias("a")).distinct()
    null_long, null_name, null_above = F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<long>").alias("above")
    entries = across.select("a").distinct().select(_coarse("a", level).alias("frag"), F.lit("k").alias("kind"), "a", null_long, null_name, null_above)
    quotient = materialize(rows.unionByName(entries).groupBy("frag").applyInArrow(_contracted, _CLOSURE_ROWS.replace("frag long, ", "")), "quotient")
    values = _close(quotient, level + 1, fits, quotient.count(), finest)
    exits = across.join(values, "a").select("frag", F.lit("x").alias("kind"), "a", null_long, null_name, "above")
    if level:
        return rows.unionByName(exits).groupBy("frag").applyInArrow(_closed, _CLOSED)
    exits = materialize(exits, "exits")
    named = exits.select("frag", F.explode(F.concat(F.array("a"), "above")).alias("a")).distinct().join(rows.filter("kind = 'n'").select("a", "label"), "a").select("frag", F.lit("u").alias("kind"), "a", null_long, "label", null_above)
    return rows.unionByName(exits).unionByName(named).groupBy("frag").applyInArrow(_closed_pairs, "node_id string, descendant string")


def all_descendants(nodes: DataFrame, place: Sequence[str] = (), nodes_per_fragment: int = 50_000, fits: int = 400_000) -> DataFrame:
    """(node_id, descendant): the distinct pairs of every node and each node below it, by whichever of its parents.

    ``nodes`` and the other arguments as for resolve(). Nodes at cycles have no ancestors here, as they have no path.
    """
    laid, links, fragments = _laid_out(nodes, place, nodes_per_fragment)
    edges = materialize(links.join(laid.select(F.col("a").alias("b"), F.col("node_id").alias("parent")), "parent").select("a", "b"), "edges")
    null_long, null_name, null_path = F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    rows = laid.select(F.lit("n").alias("kind"), "a", null_long.alias("b"), null_long.alias("w"), F.col("node_id").alias("label"), null_path.alias("path"))
    rows = rows.unionByName(edges.select(F.lit("e").alias("kind"), "a", "b", F.lit(1).cast("long").alias("w"), null_name.alias("label"), null_path.alias("path")))
    placed = materialize(_place(rows, 0, fits, 1 << 62, False, fragments).filter("w is not null").select("a"), "placed")
    null_above = F.lit(None).cast("array<long>").alias("above")
    kept = laid.join(placed, "a").select(F.lit("n").alias("kind"), "a", null_long.alias("b"), F.col("node_id").alias("label"), null_above)
    kept = kept.unionByName(edges.join(placed, "a").select(F.lit("e").alias("kind"), "a", "b", null_name.alias("label"), null_above))
    return _close(materialize(kept, "placed"), 0, fits, 1 << 62, fragments)


def descendants(resolved: DataFrame) -> DataFrame:
    """(node_id, descendant, distance) for every node above another on its path, from resolve(with_path=True).

    In a forest these are all descendants, else see all_descendants; nodes at cycles have none. One row per pair, as many as the paths
    have nodes.
    """
    above = resolved.filter("path is not null").select(F.col("node_id").alias("descendant"), "node_depth", F.posexplode("path").alias("pos", "node_id"))
    return above.filter("pos < node_depth").select("node_id", "descendant", (F.col("node_depth") - F.col("pos")).alias("distance"))
