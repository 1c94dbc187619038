"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. A first graph comes from random hyperplanes: nodes on the same side of each are compared. Then
rounds of NN-descent: each node's neighbours, and the nodes whose neighbour it is, are compared with one another (pairs
with a new member only), and each node keeps the NEIGHBOURS best it has met. A round is a join of the graph with its
own reverse and with the vectors, and a window over the outcome. The graph's nearness is the cosine of vectors that get
one more component, so that all have equal length: with it the nearest are those of the largest inner product.

A query walks the graph: it holds the BEAM best nodes met so far, and in each round opens those of its OPEN best that are
not yet opened, for all queries at once, until none has any. A query that is a row starts at its own node.
Scores are inner products of the original components in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids
or vectors of another length than the commonest; of rows that repeat an id with the same vector one counts; a query gets
all candidates where there are no more than asked for; ties go to the smaller id; an id with two different vectors is two
rows, and neither is a candidate of the other; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import mix64, shuffle_width, stage_table

NEIGHBOURS = 24
#: Rounds go on until fewer than STABLE of the graph's links are new, ROUNDS at most.
ROUNDS, STABLE = 12, 0.03
TABLES = 24
#: Nodes of one side of all hyperplanes are compared in groups of about so many.
GROUP = 1024
#: In a round, so many new and so many old members of a neighbourhood are compared.
SAMPLE_NEW, SAMPLE_OLD = 14, 10
#: Links that lead back to a node: its best so many.
BACK = 48
#: Each member of a neighbourhood is told of so many of its best partners there.
TELL = 8
BEAM, OPEN = 128, 64
#: A group of one side tells each of its members of so many of its best partners.
FIRST = 8
GRAPH_SCHEMA = "v long, u long, s float, old int"


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors, components as they are."""
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")).where(
        F.col("vec_id").isNotNull() & (F.size("x") > 0)
        & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0)
    )
    sizes = good.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0].dim if sizes else 0
    return good.where(F.size("x") == dim)


def nodes_of(vectors: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, x) for each distinct vector, and its members (node, place, vec_id): the `most` smallest ids, and any that asks.

    The members of a large group are first counted off in shares, so that no task gets them all.
    """
    single = vectors.groupBy("vec_id", "x").agg(F.lit(1).alias("one"))
    keyed = single.select("vec_id", "x", F.sha2(F.to_json("x"), 256).alias("k"))
    nodes = keyed.groupBy("k").agg(F.min("vec_id").alias("node"), F.min_by("x", "vec_id").alias("x"))
    small = keyed.select("k", "vec_id")
    share = W.partitionBy("k", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = small.withColumn("r", F.row_number().over(share)).where(F.col("r") <= most)
    few = few.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy("vec_id"))).where(F.col("place") <= most)
    ids = nodes.select("k", "node")
    members = few.join(ids, "k").select("node", "place", "vec_id")
    owners = small.join(ids, "k").select("node", "vec_id")
    return nodes.select("node", "x"), members, owners


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    x = x.astype(np.float32) / np.float32(longest)
    return np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))].astype(np.float32)


def _in_groups(batches, of: str):
    """Record batches cut and joined so that each table yielded holds whole groups of rows with the same `of`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(of).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(key != key[-1])
        if len(cut):
            at = cut[-1] + 1
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges(v, u, s, old) -> pa.RecordBatch:
    cat = lambda a, t: pa.array(np.concatenate(a) if len(a) else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([cat(v, pa.int64()), cat(u, pa.int64()), cat(s, pa.float32()), cat(old, pa.int32())], ["v", "u", "s", "old"])


def _first_in(*sorted_keys: np.ndarray) -> np.ndarray:
    """Which rows of a table sorted by the keys differ from the row before."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _place_in(*sorted_keys: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, among the rows with its keys."""
    first = np.flatnonzero(_first_in(*sorted_keys))
    sizes = np.diff(np.concatenate([first, [len(sorted_keys[0])]]))
    return np.arange(len(sorted_keys[0])) - np.repeat(first, sizes)


def _best_pairs(ids: np.ndarray, x: np.ndarray, most: int, new: np.ndarray | None = None):
    """Of each row its best partners among the rows (only pairs with a new row, if told which are)."""
    s = x @ x.T
    np.fill_diagonal(s, -9)
    if new is not None:
        s[~(new[:, None] | new[None, :])] = -9
    most = min(most, len(ids) - 1)
    best = np.argpartition(-s, most - 1, axis=1)[:, :most]
    got = np.take_along_axis(s, best, 1).ravel()
    v, u = np.repeat(ids, most), ids[best].ravel()
    keep = got > -5
    return v[keep], u[keep], got[keep]


#: The nearness of a row that only tells that a link is no longer new.
MARK = -9.0


def _keep_best(edges: DataFrame, most: int) -> DataFrame:
    def keep(batches):
        for table in _in_groups(batches, "v"):
            v, u, s, old = (table[c].to_numpy() for c in ("v", "u", "s", "old"))
            order = np.lexsort((-s, u, v))
            v, u, s, old = v[order], u[order], s[order], old[order]
            first = np.flatnonzero(_first_in(v, u))
            old = np.maximum.reduceat(old, first)
            v, u, s = v[first], u[first], s[first]
            real = s > MARK
            v, u, s, old = v[real], u[real], s[real], old[real]
            order = np.lexsort((u, -s, v))
            order = order[_place_in(v[order]) < most]
            yield _edges([v[order]], [u[order]], [s[order]], [old[order]])

    width = shuffle_width(edges.sparkSession)
    return edges.select("v", "u", "s", "old").repartition(width, "v").sortWithinPartitions("v").mapInArrow(keep, GRAPH_SCHEMA)


def first_graph(nodes: DataFrame, count: int, dim: int, longest: float, seed: int) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / GROUP))))
    planes = np.random.default_rng(seed).standard_normal((TABLES, bits, dim + 1)).astype(np.float32)

    def sides(batches):
        for batch in batches:
            x = _lifted(_matrix(batch.column("x")), longest)
            for t in range(TABLES if bits else 1):
                code = ((x @ planes[t].T) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code * TABLES + t), batch.column("node"), batch.column("x")], ["side", "node", "x"])

    placed = nodes.mapInArrow(sides, T.StructType([T.StructField("side", T.LongType()), *nodes.schema.fields]))
    sizes = placed.groupBy("side").count()
    # A crowded side is dealt into groups, each compared within itself.
    share = F.pmod(F.xxhash64("node", "side"), F.ceil(F.col("count") / F.lit(2 * GROUP)))
    dealt = placed.join(sizes, "side").select(F.xxhash64("side", share).alias("g"), "node", "x")

    def compare(batches):
        for table in _in_groups(batches, "g"):
            g, ids = table["g"].to_numpy(), table["node"].to_numpy()
            x = _lifted(_matrix(table["x"].combine_chunks()), longest)
            found = []
            starts = np.flatnonzero(_first_in(g)).tolist() + [len(g)]
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a > 1:
                    found.append(_best_pairs(ids[a:b], x[a:b], FIRST if bits else NEIGHBOURS))
            yield _edges(*([f[c] for f in found] for c in range(3)), [np.zeros(len(f[0])) for f in found])

    width = shuffle_width(nodes.sparkSession)
    return dealt.repartition(width, "g").sortWithinPartitions("g").mapInArrow(compare, GRAPH_SCHEMA)


def descend(graph: DataFrame, nodes: DataFrame, longest: float, number: int) -> DataFrame:
    """One round: the graph (v, u, s, old) after comparing neighbours of neighbours."""
    width = shuffle_width(nodes.sparkSession)

    def choose(batches):
        for table in _in_groups(batches, "v"):
            v, u, old = (table[c].to_numpy() for c in ("v", "u", "old"))
            order = np.lexsort((old, u, v))
            order = order[_first_in(v[order], u[order])]
            v, u, old = v[order], u[order], old[order]
            lot = mix64(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix64(v.astype(np.uint64) + np.uint64(number)))
            order = np.lexsort((lot, old, v))
            v, u, old = v[order], u[order], old[order]
            keep = _place_in(v, old) < np.where(old == 0, SAMPLE_NEW, SAMPLE_OLD)
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(u[keep]), pa.array(old[keep])], ["v", "u", "old"])

    both = graph.select("v", "u", "old").unionByName(graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "old"))
    picked = both.repartition(width, "v").sortWithinPartitions("v").mapInArrow(choose, "v long, u long, old int")
    members = picked.join(nodes.withColumnRenamed("node", "u"), "u").select("v", "u", "old", "x")

    def compare(batches):
        for table in _in_groups(batches, "v"):
            v, ids, new = table["v"].to_numpy(), table["u"].to_numpy(), table["old"].to_numpy() == 0
            x = _lifted(_matrix(table["x"].combine_chunks()), longest)
            found = []
            starts = np.flatnonzero(_first_in(v)).tolist() + [len(v)]
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a > 1 and new[a:b].any():
                    found.append(_best_pairs(ids[a:b], x[a:b], TELL, new[a:b]))
            # What has been compared is new no more, seen from either side.
            a, b = v[new], ids[new]
            mark = np.full(len(a), MARK)
            yield _edges([*(f[0] for f in found), a, b], [*(f[1] for f in found), b, a], [*(f[2] for f in found), mark, mark], [*(np.zeros(len(f[0])) for f in found), mark * 0 + 1, mark * 0 + 1])

    told = members.repartition(width, "v").sortWithinPartitions("v").mapInArrow(compare, GRAPH_SCHEMA)
    return _keep_best(graph.unionByName(told), NEIGHBOURS)


def build_graph(nodes: DataFrame, seed: int = 11) -> DataFrame:
    """The neighbour graph (v, u, s) of nodes (node, x)."""
    stats = nodes.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))).alias("longest")).first()
    if not stats.n:
        return nodes.sparkSession.createDataFrame([], GRAPH_SCHEMA)
    graph = _keep_best(first_graph(nodes, stats.n, stats.dim, stats.longest, seed), NEIGHBOURS)
    graph = stage_table(graph, "graph")
    for number in range(ROUNDS):
        graph = stage_table(descend(graph, nodes, stats.longest, number), "graph")
        if graph.where("old = 0").count() < STABLE * NEIGHBOURS * stats.n:
            break
    return graph.select("v", "u", "s")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The nodes (q, node, s) that greedy search finds for queries (q, x), each of which starts at the node of its name."""
    beam = max(k, BEAM)
    back = graph.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("r") <= BACK)
    links = stage_table(graph.select("v", "u").unionByName(back.select(F.col("u").alias("v"), F.col("v").alias("u"))), "links")
    width = shuffle_width(nodes.sparkSession)
    of_x = nodes.schema["x"].dataType.simpleString()

    def merge(batches):
        for table in _in_groups(batches, "q"):
            q, kind = table["q"].to_numpy(), table["kind"].to_numpy()
            node, s, opened = (table[c].fill_null(0).to_numpy() for c in ("node", "s", "opened"))
            own, met = kind == 0, kind == 2
            vectors = _matrix(table["x"].combine_chunks().filter(pa.array(own | met))).astype(np.float64)
            row = np.cumsum(own | met) - 1
            mine = row[np.flatnonzero(own)][np.cumsum(own) - 1]  # a query's own vector is its first row
            s = s.copy()
            s[met] = np.einsum("ij,ij->i", vectors[row[met]], vectors[mine[met]])
            keep = ~own
            q, node, s, kind, opened = q[keep], node[keep], s[keep], kind[keep], np.minimum(opened[keep], 1)
            order = np.lexsort((kind, node, q))
            order = order[_first_in(q[order], node[order])]
            order = order[np.lexsort((node[order], -s[order], q[order]))]
            place = _place_in(q[order])
            order, place = order[place < beam], place[place < beam]
            state = np.where((place < OPEN) & (opened[order] == 0), 2, opened[order])
            yield pa.RecordBatch.from_arrays([pa.array(q[order]), pa.array(node[order]), pa.array(s[order]), pa.array(state, pa.int32())], ["q", "node", "s", "opened"])

    none = lambda t: F.lit(None).cast(t)
    asked = queries.select("q", F.lit(0).alias("kind"), none("long").alias("node"), none("double").alias("s"), none("int").alias("opened"), "x")

    def advance(pairs: DataFrame, state: DataFrame | None) -> DataFrame:
        met = pairs.join(nodes, "node").select("q", F.lit(2).alias("kind"), "node", none("double").alias("s"), F.lit(0).alias("opened"), "x")
        rows = asked.unionByName(met)
        if state is not None:
            rows = rows.unionByName(state.select("q", F.lit(1).alias("kind"), "node", "s", "opened", none(of_x).alias("x")))
        mixed = rows.repartition(width, "q").sortWithinPartitions("q", "kind")
        return stage_table(mixed.mapInArrow(merge, "q long, node long, s double, opened int"), "beam")

    state = advance(queries.select("q", F.col("q").alias("node")), None)
    while not (to_open := state.where("opened = 2").select("q", F.col("node").alias("v"))).isEmpty():
        state = advance(to_open.join(links, "v").select("q", F.col("u").alias("node")).distinct(), state)
    return state.select("q", "node", "s")


def nearest(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """For each row of (vec_id, embedding) that is_query holds for, its k nearest other rows: query_id, rank, vec_id, score."""
    vectors = valid_vectors(rows.select("vec_id", "embedding"))
    nodes, members, owners = nodes_of(vectors, k + 1)
    nodes, members, owners = stage_table(nodes, "nodes"), stage_table(members, "members"), stage_table(owners.where(is_query), "owners")
    graph = build_graph(nodes)
    # Queries with equal vectors walk once.
    queries = owners.select("node").distinct().join(nodes, "node").select(F.col("node").alias("q"), "x")
    found = search(graph, nodes, queries, k)
    near = found.join(members, "node").withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).where(F.col("place") <= k + 1)
    answers = owners.select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")).join(near.select("q", "vec_id", "s"), "q").where("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("s").alias("score"))


def op1_nn_descent(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
