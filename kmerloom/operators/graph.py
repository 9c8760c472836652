"""k-mer graphs and overlap graphs as edge tables; iterations are rounds of joins over stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.dna import prefix_of, suffix_of
from kmerloom.session import numbered, stored

ROUNDS = 60


def de_bruijn(kmers: DataFrame) -> DataFrame:
    """(src, dst, t) from kmers(kmer, t): an edge from the prefix to the suffix of each k-mer, multiplicities summed."""
    return kmers.select(prefix_of("kmer").alias("src"), suffix_of("kmer").alias("dst"), "t").groupBy("src", "dst").agg(F.sum("t").alias("t"))


def a_bruijn(creads: DataFrame) -> DataFrame:
    """(src, dst, dist, n_reads): successive kt-mers of reads; src is 'head' for a read's first."""
    order = Window.partitionBy("read_idx").orderBy("ord")
    steps = creads.select("read_idx", F.lag("kmer").over(order).alias("src"), F.col("kmer").alias("dst"), (F.col("pos") - F.lag("pos", 1, 0).over(order)).alias("dist"))
    return steps.groupBy(F.coalesce("src", F.lit("head")).alias("src"), "dst", "dist").agg(F.count("*").alias("n_reads"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out), distinct neighbours."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def trim_leaves(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges left after `rounds` times dropping all nodes without an edge in or without one out."""
    for _ in range(rounds):
        leaves = degrees(edges).filter("n_in = 0 or n_out = 0").select("node")
        edges = stored(edges.join(leaves.withColumnRenamed("node", "src"), "src", "left_anti").join(leaves.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return edges


def start_nodes(edges: DataFrame) -> DataFrame:
    """Nodes without an edge in and with one out."""
    return degrees(edges).filter("n_in = 0 and n_out = 1").select("node")


def no_edge_in(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def no_edge_out(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def components(edges: DataFrame, most_rounds: int = ROUNDS) -> DataFrame:
    """(node, component): connected components of the undirected graph, named by their least node.

    Large stars and small stars by turns (links to the least neighbour), which takes
    a number of rounds logarithmic in the longest path. A hub's links are grouped by
    a minimum that is summed before the shuffle.
    """
    link = stored(edges.filter("src <> dst").select("src", "dst").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()

    def check(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 40)))).first()
        return tuple(r)

    now = stored(link.filter("src > dst"))
    seen = check(now)
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
        large = stored(large)
        # small star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()
        now = stored(small)
        if (after := check(now)) == seen:
            return nodes.join(now.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        seen = after
    raise RuntimeError(f"not settled after {most_rounds} rounds")


def unitigs(edges: DataFrame, most_rounds: int = ROUNDS) -> DataFrame:
    """(unitig, ord, node): maximal paths without branching, named by their first node.

    An edge is inside a path if its source has no other edge out and its target no
    other edge in. Pointers to the node before are doubled, so a path of n nodes takes
    log n rounds. Cycles without a branch begin at their least node.
    """
    e = edges.select("src", "dst").distinct()
    deg = stored(degrees(e))
    inside = stored(e.join(deg.filter("n_out = 1").select(F.col("node").alias("src")), "src").join(deg.filter("n_in = 1").select(F.col("node").alias("dst")), "dst").filter("src <> dst"))
    paths = _ranked(deg.select("node").join(inside.select(F.col("dst").alias("node"), F.col("src").alias("back")), "node", "left"), most_rounds)
    # nodes that never reach a begin lie on cycles: cut each before its least node
    looped = paths.filter("not ended").select("node")
    if not looped.isEmpty():
        ring = stored(inside.join(looped.withColumnRenamed("node", "src"), "src", "left_semi"))
        cut = components(ring).select(F.col("component").alias("node")).distinct()
        again = looped.join(ring.select(F.col("dst").alias("node"), F.col("src").alias("back")), "node").join(cut.withColumn("first", F.lit(True)), "node", "left")
        opened = _ranked(again.select("node", F.when(F.col("first").isNull(), F.col("back")).alias("back")), most_rounds)
        paths = paths.filter("ended").unionByName(opened)
    return paths.select(F.col("at").alias("unitig"), F.col("steps").alias("ord"), "node")


def _ranked(rows: DataFrame, most_rounds: int) -> DataFrame:
    """(node, at, steps, ended) from (node, back): the begin of the chain that node lies on and the steps to it."""
    now = stored(rows.select("node", F.coalesce("back", "node").alias("at"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.col("back").isNull().alias("ended")))
    for i in range(most_rounds):
        open_ = now.filter("not ended").count()
        if not open_ or 2**i > 2 * now.count():
            break
        jump = now.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("more"), F.col("ended").alias("done"))
        now = stored(now.join(jump, "at", "left").select("node", F.when(F.col("ended"), F.col("at")).otherwise(F.col("at2")).alias("at"), F.when(F.col("ended"), F.col("steps")).otherwise(F.col("steps") + F.col("more")).alias("steps"), (F.col("ended") | F.col("done")).alias("ended")))
    return now


def unitig_strings(paths: DataFrame) -> DataFrame:
    """(unitig, n_nodes, seq): the string of each path, its first node and the last base of each next. A path is one row, as the contig it makes."""
    lists = paths.groupBy("unitig").agg(F.array_sort(F.collect_list(F.struct("ord", F.right("node", F.lit(1)).alias("b")))).alias("l"))
    tail = F.array_join(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x["b"]), "")
    return lists.select("unitig", F.size("l").alias("n_nodes"), F.concat("unitig", tail).alias("seq"))


def longest_paths(edges: DataFrame, weight: str) -> DataFrame:
    """(node, best, n_edges): heaviest path into each node of an acyclic graph; 0 at nodes without an edge in.

    Rounds of relaxation over the nodes that changed, until none does. No path of an
    acyclic graph has as many edges as there are nodes, so a graph that still changes
    after so many rounds has a cycle, which is an error. See placed_longest_paths for
    graphs with long paths.
    """
    e = stored(edges.groupBy("src", "dst").agg(F.max(weight).cast("bigint").alias("w")))
    zero = F.lit(0).cast("bigint")
    best = stored(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", zero.alias("best"), zero.alias("n_edges")))
    front = best
    for _ in range(best.count() + 1):
        found = front.join(e.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), F.struct((F.col("best") + F.col("w")).alias("best"), (F.col("n_edges") + 1).alias("n_edges")).alias("p")).groupBy("node").agg(F.max("p").alias("p"))
        better = stored(best.join(found, "node").filter("p.best > best").select("node", "p.best", "p.n_edges"))
        if better.isEmpty():
            return best
        best = stored(best.join(better.select("node"), "node", "left_anti").unionByName(better))
        front = better
    raise RuntimeError("still changing after as many rounds as there are nodes: a cycle")


#: Width of a block of places, and how many blocks of one level make one of the next.
BLOCK, WIDER = 16_000, 8


def _from_gates(edges: pd.DataFrame, gates: list, start: dict) -> dict:
    """node -> heaviest paths from (start, each gate), -inf where none leads; edges(src, dst, w, at) come in the order of their sources' places."""
    none = np.full(len(gates) + 1, -np.inf)
    out = {}
    for i, g in enumerate(gates, 1):
        out[g] = none.copy()
        out[g][i] = 0
    for n, x in start.items():
        out.setdefault(n, none.copy())[0] = x
    for src, dst, w in zip(edges["src"].tolist(), edges["dst"].tolist(), edges["w"].tolist()):
        if (own := out.get(src)) is not None:
            old = out.get(dst)
            out[dst] = own + w if old is None else np.maximum(old, own + w)
    return out


def placed_longest_paths(edges: DataFrame) -> DataFrame:
    """(node, best): as longest_paths, for bigint edges(src, dst, w, at, to) with the places of both ends, at < to on each.

    Places are cut into blocks. Inside a block, all at once, the heaviest paths from its
    gates (nodes with an edge from an earlier block) and from anywhere are found; what leaves
    the block makes edges between gates, which are cut into wider blocks in turn. So
    the rounds are logarithmic in the length, and a task holds one block.
    """
    every = stored(edges.groupBy("src", "dst", "at", "to").agg(F.max("w").cast("bigint").alias("w")))
    top, low = every.agg(F.max("to"), F.min("at")).first()
    if top is None:
        return every.select(F.col("src").alias("node"), F.col("w").alias("best"))
    begun = stored(every.select(F.explode(F.array(F.struct(F.col("src").alias("node"), "at"), F.struct(F.col("dst").alias("node"), F.col("to").alias("at")))).alias("x")).select("x.node", "x.at").distinct().select("node", "at", F.lit(0).cast("bigint").alias("best")))
    kinds = "src bigint, dst bigint, at bigint, to bigint, w bigint"

    def rows(e: DataFrame, known: DataFrame, width: int) -> DataFrame:
        """Edges, and known values as edges without a source, by the block they begin in."""
        both = e.select("src", "dst", "at", "to", "w").unionByName(known.select(F.lit(None).cast("bigint").alias("src"), F.col("node").alias("dst"), "at", F.col("at").alias("to"), F.col("best").alias("w")))
        block = lambda x: F.floor((F.col(x) - low) / width)
        return both.withColumn("block", block("at")).withColumn("leaves", block("to") > block("at"))

    def parts(own: pd.DataFrame) -> tuple:
        old = own["src"].isna()
        e = own[~old].sort_values("at", kind="stable").astype({"src": "int64"})
        return e, dict(zip(own["dst"][old].tolist(), own["w"][old].tolist()))

    def contracted(e: DataFrame, known: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
        """(edges between gates, values known of gates)."""
        gates = rows(e, known, width).filter("leaves").select(F.col("dst").alias("node"), "to").distinct()

        def work(own: pd.DataFrame) -> pd.DataFrame:
            gate = own[own["gate"]]
            e, start = parts(own[~own["gate"]])
            names = gate["dst"].tolist()
            at = dict(zip(names, gate["at"].tolist()))
            of = _from_gates(e[~e["leaves"]], names, start)
            found: dict = {}
            for src, dst, to, w in e.loc[e["leaves"], ["src", "dst", "to", "w"]].itertuples(index=False):
                if (x := of.get(src)) is not None:
                    old = found.get((dst, to))
                    found[dst, to] = x + w if old is None else np.maximum(old, x + w)
            out = [(n, dst, a, to, int(v)) for (dst, to), x in found.items() for n, a, v in zip([None, *names], [to, *(at[g] for g in names)], x.tolist()) if v > -np.inf]
            return pd.DataFrame(out, columns=["src", "dst", "at", "to", "w"]).astype({"src": "Int64"})

        own = rows(e, known, width).withColumn("gate", F.lit(False))
        marks = gates.select(F.lit(None).cast("bigint").alias("src"), F.col("node").alias("dst"), F.col("to").alias("at"), "to", F.lit(0).cast("bigint").alias("w"), F.floor((F.col("to") - low) / width).alias("block"), F.lit(False).alias("leaves"), F.lit(True).alias("gate"))
        made = stored(own.unionByName(marks).groupBy("block").applyInPandas(work, kinds))
        values = made.filter("src is null").select(F.col("dst").alias("node"), "at", F.col("w").alias("best"))
        return made.filter("src is not null"), values.groupBy("node", "at").agg(F.max("best").alias("best"))

    def solved(e: DataFrame, known: DataFrame, width: int) -> DataFrame:
        """(node, best) in each block, from what is known."""

        def work(own: pd.DataFrame) -> pd.DataFrame:
            e, start = parts(own)
            at = dict(zip(own["dst"].tolist(), own["to"].tolist()))
            out = [(n, at[n], int(x[0])) for n, x in _from_gates(e, [], start).items()]
            return pd.DataFrame(out, columns=["node", "at", "best"]).astype("int64")

        return stored(rows(e, known, width).filter("not leaves").drop("leaves").groupBy("block").applyInPandas(work, "node bigint, at bigint, best bigint"))

    levels, width = [(every, begun, BLOCK)], BLOCK
    while top - low >= width:
        e, known = contracted(*levels[-1])
        levels.append((e, known, width := width * WIDER))
    best = solved(*levels.pop())
    while levels:
        e, known, width = levels.pop()
        best = solved(e, known.unionByName(best).groupBy("node", "at").agg(F.max("best").alias("best")), width)
    return best.select("node", "best")


#: Edges, both ways, up to which every task of bounded_neighbourhood holds all of them (12 bytes each), and bytes for the marks of what its seeds have reached.
HELD, MARKS = 16_000_000, 1 << 27


def bounded_neighbourhood(edges: DataFrame, seeds: DataFrame, max_dist: int, held: int = HELD) -> DataFrame:
    """(seed, node, pos): nodes within max_dist of a seed along edges(src, dst, dist) either way, with the least signed place at the least number of hops.

    Goes on until no node is new; every place on the way lies within max_dist, which is the only bound.
    Up to `held` edges, counted first, each task takes all of them and makes the hops of
    its seeds by itself; more are joined hop by hop.
    """
    near = edges.filter((F.abs("dist") <= 2 * max_dist) & F.col("src").isNotNull() & F.col("dst").isNotNull())  # a longer one leads out of the bound from every place within it
    both = stored(near.select("src", "dst", "dist").unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("dist")).alias("dist"))).distinct())
    if both.limit(held + 1).count() > held:
        return _neighbourhood_by_joins(both, seeds, max_dist)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = stored(numbered(both.select(F.col("src").alias("node")).distinct(), "id").select("node", F.col("id").cast("int").alias("id")))
    size = nodes.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_pydict({c: [x[c].to_numpy().astype(np.int32).tobytes()] for c in x.schema.names})

    def work(own: pa.Table, packed: pa.Table) -> pa.Table:
        src, dst, dist = (np.frombuffer(b"".join(packed[c].to_pylist()), np.int32) for c in ("a", "b", "d"))
        order = np.argsort(src, kind="stable")
        begins = np.r_[0, np.cumsum(np.bincount(src, minlength=size))]
        at = np.flatnonzero(own["id"].is_valid().to_numpy())
        found = _hops(begins, dst[order], dist[order], own["id"].drop_null().to_numpy(), size, max_dist)
        return pa.table({"seed": own["seed"].take(at[found[0]]), "id": found[1].astype(np.int32), "pos": found[2].astype(np.int32)})

    name = lambda x: nodes.select(F.col("node").alias(x), F.col("id").alias(f"{x}_id"))
    coded = both.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), F.col("dist").alias("d"))
    packed = coded.mapInArrow(pack, "a binary, b binary, d binary").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "a", "b", "d")
    starts = seeds.select("node").distinct()
    own = starts.join(nodes, "node").select(F.pmod(F.hash("node"), F.lit(parts)).alias("part"), F.col("node").alias("seed"), "id")
    found = own.groupBy("part").cogroup(packed.groupBy("part")).applyInArrow(work, "seed string, id int, pos int")
    return starts.select(F.col("node").alias("seed"), "node", F.lit(0).alias("pos")).unionByName(found.join(nodes, "id").select("seed", "node", "pos"))


def _hops(begins: np.ndarray, dst: np.ndarray, dist: np.ndarray, seeds: np.ndarray, size: int, max_dist: int) -> tuple[np.ndarray, ...]:
    """(number of the seed, node, pos) of all nodes that the seeds reach, themselves excluded; the edges of node x stand from begins[x] to begins[x + 1]."""
    many = max(1, min(len(seeds), MARKS // max(size, 1)))
    seen, out, ranks = np.zeros(many * size, bool), [], 2 * max_dist + 2
    for first in range(0, len(seeds), many):
        at = seeds[first : first + many].astype(np.int64)
        of, pos = np.arange(len(at)), np.zeros(len(at), np.int64)
        marked = [of * size + at]
        while len(at):
            seen[marked[-1]] = True
            n = begins[at + 1] - begins[at]
            edge = np.repeat(begins[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(pos, n) + dist[edge]
            kept = np.flatnonzero(np.abs(place) <= max_dist)
            key, place = (np.repeat(of, n)[kept]) * size + dst[edge[kept]], place[kept]
            new = ~seen[key]
            key, place = key[new], place[new]
            rank = np.sort(key * ranks + 2 * np.abs(place) + (place > 0))  # the place nearest to the seed, the negative one of two
            key = rank // ranks
            best = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
            key, rank = key[best], rank[best] % ranks
            pos = np.where(rank % 2, rank // 2, -(rank // 2))
            of, at = key // size, key % size
            marked.append(key)
            out.append((of + first, at, pos))
        for key in marked:
            seen[key] = False
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _neighbourhood_by_joins(both: DataFrame, seeds: DataFrame, max_dist: int) -> DataFrame:
    """bounded_neighbourhood, a join for each hop."""
    known = stored(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("pos")).distinct())
    front = known
    while not front.isEmpty():
        step = front.join(both.withColumnRenamed("src", "node"), "node").select("seed", F.col("dst").alias("node"), (F.col("pos") + F.col("dist")).alias("pos")).filter(F.abs("pos") <= max_dist)
        front = stored(step.groupBy("seed", "node").agg(F.min_by("pos", F.struct(F.abs("pos"), "pos")).alias("pos")).join(known.select("seed", "node"), ["seed", "node"], "left_anti"))
        known = known.unionByName(front)
    return known


def path_exists(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, complete): whether all successive nodes of paths(id, nodes) are joined by an edge."""
    steps = paths.select("id", F.explode_outer(F.expr("transform(filter(sequence(0, size(nodes) - 1), i -> i < size(nodes) - 1), i -> struct(nodes[i] as src, nodes[i + 1] as dst))")).alias("s")).select("id", "s.src", "s.dst")
    known = edges.select("src", "dst").distinct().withColumn("there", F.lit(1))
    return steps.join(known, ["src", "dst"], "left").groupBy("id").agg((F.count("src") == F.count("there")).alias("complete"))


def connection_rate(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(n_nodes, n_pairs, n_connected): pairs of given nodes (a node with itself included) in one component, counted by component."""
    sized = nodes.select("node").distinct().join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("n"))
    return sized.agg(F.sum("n").alias("n_nodes"), F.expr("sum(n) * (sum(n) + 1) div 2").alias("n_pairs"), F.expr("sum(n * (n + 1) div 2)").alias("n_connected"))


def split_nodes(creads: DataFrame, clusters: DataFrame) -> DataFrame:
    """creads with kt-mers of several read clusters split: clusters(kmer, read_idx, cluster) gives the copy a read goes through."""
    name = F.when(F.col("cluster").isNotNull(), F.concat("kmer", F.lit("_"), "cluster")).otherwise(F.col("kmer"))
    return creads.join(clusters, ["kmer", "read_idx"], "left").withColumn("kmer", name).drop("cluster")


def walk(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, n, node): from each start the best-supported successor in turn; ends where there is none or a node comes again.

    steps(src, dst, n_reads): the support of each successor. The known parts of all
    walks and the pointers are doubled by turns, so a walk of n nodes takes log n
    rounds. A node has one successor, so all is repeated once a node comes again, and
    the first place of each node is kept.
    """
    ahead = stored(steps.groupBy("src").agg(F.max(F.struct("n_reads", F.col("dst").alias("dst"))).alias("b")).select(F.col("src").alias("node"), F.col("b.dst").alias("next")))
    now = stored(starts.select(F.col("node").alias("start"), F.lit(0).alias("n"), "node").distinct())
    ended, have = [], 1
    while not now.isEmpty():
        more = now.join(ahead, "node").select("start", (F.col("n") + have).alias("n"), F.col("next").alias("node"))
        grown = stored(now.unionByName(more).groupBy("start", "node").agg(F.min("n").alias("n")).select("start", "n", "node"))
        have *= 2
        whole = stored(grown.groupBy("start").agg(F.count("*").alias("found")).filter(F.col("found") == have).select("start"))
        ended.append(grown.join(whole, "start", "left_anti"))
        now = stored(grown.join(whole, "start", "left_semi"))
        ahead = stored(ahead.join(ahead.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next")))
    out = now
    for part in ended:
        out = out.unionByName(part)
    return out
