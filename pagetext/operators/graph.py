"""Connected components and order-respecting rounds over pair tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetext.operators.folds import fold_groups
from pagetext.operators.prefix import keys_over, per_key
from pagetext.session import cut_lineage

FOLD_EDGES = 100_000  # edges folded in one task
FEW_NODES = 64  # labels of a key that each of its nodes looks through


def _fingerprint(edges: DataFrame, cols: Sequence[str]) -> tuple:
    h = F.xxhash64(*cols)
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Label (smallest id) of every node that has an edge: columns ``keys``, ``node``, ``component``.

    The edges of a key with at most ``FOLD_EDGES`` of them are folded in one task, those of larger keys are contracted in rounds.
    """
    keys = list(keys)
    e = cut_lineage(edges.select(*keys, F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v"))
    types = dict(e.dtypes)

    def fold(rows: list) -> list[tuple]:
        key, root = rows[0][:len(keys)], {}

        def find(n):
            while root.setdefault(n, n) != n:
                root[n] = n = root[root[n]]
            return n

        for r in rows:
            x, y = find(r.v), find(r.u)
            root[max(x, y)] = min(x, y)
        return [(*key, n, find(n)) for n in root]

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"node {types['v']}", f"component {types['v']}"])
    large = keys_over(e, keys, FOLD_EDGES)
    if large is None:
        return fold_groups(e, keys, ["v", "u"], fold, schema)
    large = F.broadcast(large)
    return fold_groups(e.join(large, keys, "left_anti"), keys, ["v", "u"], fold, schema).unionByName(_contracted(e.join(large, keys, "left_semi"), keys))


def _contracted(e: DataFrame, keys: list[str]) -> DataFrame:
    """Components of the edges (``v`` below ``u``) by star contraction.

    Alternates two star steps until the edges no longer change, a logarithmic number of rounds even on long
    chains. Each step is a partial minimum and a join on the node; no adjacency list is ever collected.
    """
    e = cut_lineage(e.distinct())
    seen = _fingerprint(e, [*keys, "u", "v"])
    while seen[0]:
        both = e.unionByName(e.select(*keys, F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, [*keys, "u"]).filter("v > u").filter("v <> m")
                 .select(*keys, F.col("m").alias("v"), F.col("v").alias("u")).distinct())
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).select(
            *keys, F.col("m").alias("v"), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"))
        e = cut_lineage(small.filter("u <> v").distinct())
        now = _fingerprint(e, [*keys, "u", "v"])
        if now == seen:
            break
        seen = now
    roots = e.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.unionByName(e.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")))


def label_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], uid: str) -> DataFrame:
    """``nodes`` with ``component``; nodes without an edge are their own component. Edges: uid, r_uid.

    The labels of a key with at most ``FEW_NODES`` nodes that have an edge come as one map of the key, so that its nodes stay where they lie;
    those of larger keys are joined by node.
    """
    keys = list(keys)
    comp = cut_lineage(connected_components(edges, keys, uid, "r_" + uid))

    def joined(d: DataFrame, c: DataFrame) -> DataFrame:
        return d.join(c.withColumnRenamed("node", uid), [*keys, uid], "left").withColumn("component", F.coalesce("component", F.col(uid)))

    def mapped(d: DataFrame, c: DataFrame) -> DataFrame:
        labels = c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("node", "component"))).alias("__labels"))
        return (d.join(labels, keys, "left").withColumn("component", F.coalesce(F.try_element_at("__labels", F.col(uid)), F.col(uid)))
                .drop("__labels"))

    large = keys_over(comp, keys, FEW_NODES)
    if large is None:
        return mapped(nodes, comp)
    large = F.broadcast(large)
    few, many = ([d.join(large, keys, how) for d in (nodes, comp)] for how in ("left_anti", "left_semi"))
    return mapped(*few).unionByName(joined(*many))


def _settled(edges: DataFrame, keys: list[str], a: str, b: str, fold: Callable, out: str, rounds: Callable[[DataFrame], DataFrame], fold_edges: int) -> DataFrame:
    """``fold`` over the edges of each key, in one task a key; of keys with more than ``fold_edges`` edges over each component, and
    ``rounds`` for components that are larger still. ``a`` and ``b`` are the node columns, ``out`` the output columns with their types."""
    e = cut_lineage(edges.distinct())
    types = dict(e.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), out])
    d = per_key(e, keys, F.count(F.lit(1)).alias("__n"))
    done = fold_groups(d.filter(F.col("__n") <= fold_edges).drop("__n"), keys, [a, b], fold, schema)
    large = d.filter(F.col("__n") > fold_edges).drop("__n")
    if large.isEmpty():
        return done
    # the two node columns may number different things
    nodes = large.select(*keys, (F.col(a).cast("long") * 2).alias("__a"), (F.col(b).cast("long") * 2 + F.lit(a != "win").cast("int")).alias("__b"))
    comp = connected_components(nodes, keys, "__a", "__b").withColumnRenamed("node", "__a").withColumnRenamed("component", "rival_group")
    large = large.withColumn("__a", F.col(a).cast("long") * 2).join(comp, [*keys, "__a"]).drop("__a")
    large = cut_lineage(per_key(large, [*keys, "rival_group"], F.count(F.lit(1)).alias("__n")))
    some = fold_groups(large.filter(F.col("__n") <= fold_edges).select(*keys, "rival_group", a, b), [*keys, "rival_group"], [a, b], fold, schema)
    rest = large.filter(F.col("__n") > fold_edges).select(*keys, a, b)
    done = done.unionByName(some)
    return done if rest.isEmpty() else done.unionByName(rounds(rest))


def greedy_dropped(edges: DataFrame, keys: Sequence[str], fold_edges: int = FOLD_EDGES) -> DataFrame:
    """Nodes removed by a first-to-last greedy pass; an edge says ``win`` comes earlier and would remove ``lose``.

    A key's edges are folded in one task, in a time that grows with their number however long the chains of rivals are. Of a key with more than
    ``fold_edges`` edges each component is folded by itself; only a component that is larger too is settled in rounds.
    """
    keys = list(keys)

    def fold(rows: list) -> list[tuple]:
        key = rows[0][:len(keys)]
        beats: dict = {}
        waiting: dict = {}
        for r in rows:
            beats.setdefault(r.win, []).append(r.lose)
            waiting[r.lose] = waiting.get(r.lose, 0) + 1
        ready, gone = [n for n in beats if n not in waiting], set()
        while ready:  # a node is ready once all its earlier rivals are settled
            n = ready.pop()
            for m in beats.get(n, ()):
                if n not in gone:
                    gone.add(m)
                waiting[m] -= 1
                if not waiting[m]:
                    ready.append(m)
        return [(*key, n) for n in gone]

    kind = dict(edges.dtypes)["lose"]
    return _settled(edges.select(*keys, "win", "lose"), keys, "win", "lose", fold, f"n {kind}", lambda rest: _dropped_in_rounds(rest, keys), fold_edges)


def _dropped_in_rounds(e: DataFrame, keys: list[str]) -> DataFrame:
    """Every round settles all nodes without an open earlier rival; as many rounds as the longest chain of rivals."""
    dropped: DataFrame | None = None
    e = cut_lineage(e)
    while not e.isEmpty():
        kept = e.select(*keys, F.col("win").alias("n")).distinct().join(
            e.select(*keys, F.col("lose").alias("n")).distinct(), [*keys, "n"], "left_anti")
        out = cut_lineage(e.join(kept.withColumnRenamed("n", "win"), [*keys, "win"], "left_semi")
                          .select(*keys, F.col("lose").alias("n")).distinct())
        dropped = out if dropped is None else dropped.unionByName(out)
        e = cut_lineage(e.join(out.withColumnRenamed("n", "lose"), [*keys, "lose"], "left_anti")
                        .join(out.withColumnRenamed("n", "win"), [*keys, "win"], "left_anti"))
    return dropped.distinct()


def greedy_one_to_one(pairs: DataFrame, keys: Sequence[str], a: str, b: str, fold_edges: int = FOLD_EDGES) -> DataFrame:
    """Pairs accepted by a greedy pass in (a, b) order where every a and b is used once.

    A key's pairs are folded in order in one task; of a key with more than ``fold_edges`` pairs each component is, and only a component
    that is larger too is settled in rounds.
    """
    keys = list(keys)

    def fold(rows: list) -> list[tuple]:
        key, used_a, used_b, out = rows[0][:len(keys)], set(), set(), []
        for r in rows:
            x, y = r[-2:]
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                out.append((*key, x, y))
        return out

    kinds = dict(pairs.dtypes)
    return _settled(pairs.select(*keys, a, b), keys, a, b, fold, f"{a} {kinds[a]}, {b} {kinds[b]}", lambda rest: _accepted_in_rounds(rest, keys, a, b), fold_edges)


def _accepted_in_rounds(open_pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """A pair is settled as soon as it is the smallest open pair of both its ends; this gives the sequential result."""
    accepted: DataFrame | None = None
    open_pairs = cut_lineage(open_pairs)
    while not open_pairs.isEmpty():
        first_b = open_pairs.groupBy(*keys, a).agg(F.min(b).alias(b))
        first_a = open_pairs.groupBy(*keys, b).agg(F.min(a).alias(a))
        win = cut_lineage(first_b.join(first_a, [*keys, a, b]).select(*keys, a, b))
        accepted = win if accepted is None else accepted.unionByName(win)
        open_pairs = cut_lineage(open_pairs.join(win.select(*keys, a), [*keys, a], "left_anti")
                                 .join(win.select(*keys, b), [*keys, b], "left_anti"))
    return accepted
