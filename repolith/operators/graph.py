"""Graph operators over edge tables (src, dst): src depends on dst. Loops are over levels or rounds, never over rows."""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most nodes of a block of a graph, and about the most edges within one.
BLOCK_NODES, BLOCK_EDGES = 200_000, 1_000_000

#: Folders of applications without ``spark.checkpoint.dir`` (tests).
_own: dict[str, str] = {}


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that isn't in use. What is written there goes when the application ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="repolith-")
        folder = _own[app]
    path = f"{folder}/repolith/{uuid.uuid4().hex}-graph"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that loops don't grow lineage. It goes when the application ends."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours in either direction; a loop counts its node once."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return nodes.select("id").join(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def most_connected(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k nodes (id, ord) of highest degree among edges between nodes, ties by ord."""
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(degrees(nodes, inside), "id").orderBy(F.desc("degree"), "ord").limit(k).select("id", "ord", "degree")


def most_connected_subgraph(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph cut to its k most connected nodes: whole if it has no more than k. Without edges the first k nodes
    by ord stay, as all degrees are equal. The kept nodes are k rows, so they are broadcast."""
    kept = saved(most_connected(nodes, edges, k).select("id", "ord"))
    side = lambda c: F.broadcast(kept.select(F.col("id").alias(c)))
    return kept, edges.join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi").select(*edges.columns)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame, threshold: int = 400) -> DataFrame:
    """All nodes (already valid leaf types); with ``threshold`` or more, those that nothing depends on."""
    return roots(nodes, edges) if nodes.count() >= threshold else nodes.select("id")


def prolonged(paths: DataFrame, reach: int) -> DataFrame:
    """Paths (src, dst, hops) of ``reach`` hops, each followed by every path from its end."""
    farthest = paths.filter(F.col("hops") == reach).select("src", F.col("dst").alias("via"))
    return farthest.join(paths.select(F.col("src").alias("via"), "dst", "hops"), "via").select("src", "dst", (F.col("hops") + reach).alias("hops"))


def reachable(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """All pairs (src, dst) with a path from src to dst, and the ``hops`` of the shortest, by doubling; rounds are
    logarithmic in the longest path. Round k finds the pairs of 2^k + 1 to 2^(k+1) hops: their first 2^k hops are a shortest
    path, so only pairs of exactly 2^k hops are prolonged, and a pair is met once for each node that lies there on its way."""
    table, reach = new_path(edges.sparkSession), 1

    def add(new: DataFrame) -> DataFrame:
        new.write.parquet(f"{table}/reach-{reach}")
        return edges.sparkSession.read.schema(new.schema).parquet(*(f"{table}/reach-{2**k}" for k in range(reach.bit_length())))

    paths = add(edges.select("src", "dst").distinct().withColumn("hops", F.lit(1).cast("long")))
    for _ in range(most_rounds):
        if paths.filter(F.col("hops") == reach).isEmpty():
            return paths
        nearest = paths.unionByName(prolonged(paths, reach)).groupBy("src", "dst").agg(F.min("hops").alias("hops"))
        was, reach = reach, 2 * reach
        paths = add(nearest.filter(F.col("hops") > was))
    raise RuntimeError(f"not closed after {most_rounds} rounds")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """``edges`` without loops, repeats and most of those that lie on no cycle: nodes without edges in or out are peeled off
    in rounds, as long as a round takes a tenth of what is left."""
    core = saved(edges.filter("src <> dst").select("src", "dst").distinct())
    n = core.count()
    while n:
        for _ in range(2):
            core = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        core = saved(core)
        was, n = n, core.count()
        if was - n < 0.1 * was:
            break
    return core


def blocked(edges: DataFrame, ids: DataFrame | None = None, most_nodes: int = BLOCK_NODES, most_edges: int = BLOCK_EDGES) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes (id, block), edges within a block (block, src, dst), the others (src, dst) or None): ranges of ids of bounded size.

    A small graph is one block. A block with more than ``most_edges`` edges keeps about so many, by hash, as its own; any edge may stand among the others, as
    these are followed by joins, so a hot node makes no task large.
    """
    if ids is None:
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    ids = saved(ids.select("id"))
    parts = -(-ids.count() // most_nodes)
    if parts <= 1 and edges.count() <= most_edges:
        return ids.withColumn("block", F.lit(0)), edges.select(F.lit(0).alias("block"), "src", "dst"), None
    nodes = saved(ids.repartitionByRange(max(1, parts), "id").withColumn("block", F.spark_partition_id()))
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("block").alias(f"{c}_block"))
    marked = saved(edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst"))
    sizes = marked.filter("src_block = dst_block").groupBy(F.col("src_block").alias("size_of")).count()
    sized = marked.join(sizes, F.col("src_block") == F.col("size_of"), "left")
    own = (F.col("src_block") == F.col("dst_block")) & (F.expr("pmod(xxhash64(src, dst), greatest(count, 1))") < most_edges)
    marked = saved(sized.select("src", "dst", F.when(own, F.col("src_block")).alias("block")))
    others = marked.filter("block is null").select("src", "dst")
    return nodes, marked.filter("block is not null").select("block", "src", "dst"), None if others.isEmpty() else others


def _indexed(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[list, list[list[int]]]:
    """The ids of a block, and for each place the places of the ids that its edges lead to."""
    ids = nodes["id"].tolist()
    place = {v: i for i, v in enumerate(ids)}
    onward: list[list[int]] = [[] for _ in ids]
    for src, dst in zip(edges["src"].tolist(), edges["dst"].tolist(), strict=True):
        onward[place[src]].append(place[dst])
    return ids, onward


def _nearest(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """``nodes`` (id, block, root, hops) with the least (root, hops) that reaches each along ``edges``; every node is settled once."""
    _, onward = _indexed(nodes, edges)
    at = list(zip(nodes["root"].tolist(), nodes["hops"].tolist(), strict=True))
    heap = [(*x, i) for i, x in enumerate(at)]
    heapq.heapify(heap)
    while heap:
        root, hops, i = heapq.heappop(heap)
        if (root, hops) != at[i]:
            continue
        for j in onward[i]:
            if (root, hops + 1) < at[j]:
                at[j] = (root, hops + 1)
                heapq.heappush(heap, (root, hops + 1, j))
    return nodes.assign(root=[x[0] for x in at], hops=[x[1] for x in at])


def _raised(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """``nodes`` (id, block, level, crossed) with the levels that ``edges`` ask for, dependencies first; -1 on or above a cycle."""
    _, onward = _indexed(nodes, edges)
    level, crossed = nodes["level"].tolist(), nodes["crossed"].tolist()
    waiting: list[list[int]] = [[] for _ in onward]
    for i, targets in enumerate(onward):
        for j in targets:
            waiting[j].append(i)
    open_ = [len(x) for x in onward]
    ready = [i for i, n in enumerate(open_) if not n]
    for j in ready:
        for i in waiting[j]:
            level[i], crossed[i] = max(level[i], level[j] + 1), max(crossed[i], crossed[j])
            open_[i] -= 1
            if not open_[i]:
                ready.append(i)
    return nodes.assign(level=[-1 if n else x for n, x in zip(open_, level, strict=True)], crossed=crossed)


def _contracted(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """(id, label) of a block: the least id of each strongly connected component of its own edges, by path-based search."""
    ids, onward = _indexed(nodes, edges)
    order, label = [-1] * len(ids), list(range(len(ids)))
    closed, count = [False] * len(ids), 0
    open_nodes: list[int] = []
    starts: list[int] = []
    for first in range(len(ids)):
        if order[first] >= 0:
            continue
        walk = [(first, iter(onward[first]))]
        order[first], count = count, count + 1
        open_nodes.append(first)
        starts.append(first)
        while walk:
            i, rest = walk[-1]
            j = next(rest, None)
            if j is None:
                walk.pop()
                if starts[-1] == i:
                    starts.pop()
                    at = next(k for k in range(len(open_nodes) - 1, -1, -1) if open_nodes[k] == i)
                    group = open_nodes[at:]
                    del open_nodes[at:]
                    least = min(group, key=ids.__getitem__)
                    for k in group:
                        label[k], closed[k] = least, True
            elif order[j] < 0:
                order[j], count = count, count + 1
                open_nodes.append(j)
                starts.append(j)
                walk.append((j, iter(onward[j])))
            elif not closed[j]:
                while order[starts[-1]] > order[j]:
                    starts.pop()
    return nodes[["id"]].assign(label=[ids[k] for k in label])


def within_blocks(nodes: DataFrame, own: DataFrame, solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: StructType) -> DataFrame:
    """``solve`` of each block's nodes and own edges, a task for each block."""
    return saved(nodes.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(solve, schema))


def least_sources(edges: DataFrame, **sizes: int) -> DataFrame:
    """(id, root, hops) of the nodes of ``edges``: the least id with a path to the node, itself included, and the hops of the
    shortest. A round closes each block under its own edges and then sends one row along each edge between blocks, so there are as
    many rounds as a shortest path has edges between blocks, until none changes a node."""
    nodes, own, others = blocked(edges, **sizes)
    state = nodes.select("id", "block", F.col("id").alias("root"), F.lit(0).cast("long").alias("hops"))
    while True:
        state = within_blocks(state, own, _nearest, state.schema)
        if others is None:
            return state.select("id", "root", "hops")
        sent = others.join(state.select(F.col("id").alias("src"), "root", "hops"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("root", (F.col("hops") + 1).alias("hops"))).alias("sent"))
        at = F.struct("root", "hops")
        now = state.join(sent, "id", "left").select("id", "block", F.least(at, "sent").alias("at"), (F.col("sent") < at).alias("better"))
        now = saved(now.select("id", "block", "at.*", F.coalesce("better", F.lit(False)).alias("better")))
        if now.filter("better").isEmpty():
            return state.select("id", "root", "hops")
        state = now.drop("better")


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` between the labels of their ends, without loops and repeats; ``labels`` (id, label) has all ends."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    both = edges.join(side("src"), "src").join(side("dst"), "dst")
    return both.filter("src_label <> dst_label").select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).distinct()


def strong_components(edges: DataFrame, **sizes: int) -> DataFrame:
    """(id, scc, hops) of strongly connected components of two nodes or more; scc is the least id, hops are those from it.

    Each task finds the components of its block's own edges, and the graph goes on with each of them as one node; without edges
    between blocks that is all. Else nodes are coloured by the least id that reaches them: those that reach this id within their colour
    are its component, the others of the colour go into the next round, as does no edge between colours. Tables are never
    larger than the edges.
    """
    whole = left = saved(edges.filter("src <> dst").select("src", "dst").distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        nodes, own, others = blocked(left, **sizes)
        kind = nodes.schema["id"].dataType
        steps.append(within_blocks(nodes, own, _contracted, StructType().add("id", kind).add("label", kind)))
        if others is None:
            break
        left = cyclic_core(relabelled(left, steps[-1]))
        colour = least_sources(left, **sizes)
        side = lambda c: colour.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        inside = saved(left.join(side("src"), "src").join(side("dst"), "dst").filter("src_root = dst_root").select("src", "dst"))
        returns = least_sources(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), **sizes)
        steps.append(saved(colour.join(returns.select("id", "root"), ["id", "root"]).select("id", F.col("root").alias("label"))))
        rest = inside.join(steps[-1].select(F.col("id").alias("src")), "src", "left_anti").join(steps[-1].select(F.col("id").alias("dst")), "dst", "left_anti")
        left = cyclic_core(rest.select("src", "dst"))
    if not steps:
        return whole.select(F.col("src").alias("id"), F.col("src").alias("scc"), F.lit(0).cast("long").alias("hops"))
    labels = steps[0]
    for step in steps[1:]:
        onward = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = saved(labels.join(onward, "label", "left").select("id", F.coalesce("next", "label").alias("label")))
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    inside = saved(whole.join(side("src"), "src").join(side("dst"), "dst").filter("src_label = dst_label").select("src", "dst"))
    return least_sources(inside, **sizes).select("id", F.col("root").alias("scc"), "hops")


def cycles(edges: DataFrame) -> DataFrame:
    """(id, scc) of strongly connected components of two nodes or more; scc is the least id. Loops alone are none."""
    return strong_components(edges).select("id", "scc")


def without_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acyclic edges, removed edges): each component is ordered by the hops from its least id and then by id, and its edges
    that don't lead forward go; a single cycle loses one edge. Deterministic; loops go too."""
    placed = saved(strong_components(edges))
    side = lambda c: placed.select(F.col("id").alias(c), F.col("scc").alias(f"{c}_scc"), F.struct("hops", "id").alias(f"{c}_at"))
    marked = edges.select("src", "dst").distinct().join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    back = F.coalesce((F.col("src_scc") == F.col("dst_scc")) & (F.col("src_at") >= F.col("dst_at")), F.lit(False)) | (F.col("src") == F.col("dst"))
    marked = saved(marked.select("src", "dst", back.alias("back")))
    return marked.filter("not back").select("src", "dst"), marked.filter("back").select("src", "dst")


def dependency_levels(nodes: DataFrame, edges: DataFrame, **sizes: int) -> DataFrame:
    """(id, level): 0 depends on nothing; each node is one above the highest it depends on. Raises if the edges hold a cycle.

    Ordering by (level, id) puts dependencies first. A round raises levels within each block, in a task, and then along the edges
    between blocks; ``crossed`` counts those on a path. A level is final once a round has passed for each of them, and without a
    cycle fewer nodes are open after each round.
    """
    known = saved(nodes.select("id").distinct())
    waits = saved(edges.select("src", "dst").distinct().join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi"))
    placed, own, others = blocked(waits, known, **sizes)
    state = placed.select("id", "block", F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("crossed"))
    rounds, open_ = 0, -1
    loops = others is not None and not others.filter("src = dst").isEmpty()
    while True:
        state = within_blocks(state, own, _raised, state.schema)
        if loops or not state.filter("level < 0").isEmpty():
            raise ValueError("the edges hold a cycle")
        rounds += 1
        if others is not None:
            raised = others.join(state.select(F.col("id").alias("dst"), "level", "crossed"), "dst").groupBy(F.col("src").alias("id")).agg((F.max("level") + 1).alias("up"), (F.max("crossed") + 1).alias("more"))
            now = saved(state.join(raised, "id", "left").select("id", "block", F.greatest("level", "up").alias("level"), F.greatest("crossed", "more").alias("crossed")))
            was, open_ = open_, now.filter(F.col("crossed") >= rounds).count()
        if others is None or not open_:
            return state.select("id", F.col("level").cast("int").alias("level"))
        if open_ == was:
            raise ValueError("the edges hold a cycle")
        state = now


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in ``order``: sorted ranges of rows are counted, and each starts behind those before."""
    ranges = saved(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    starts = ranges.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.withColumn("row", within).join(F.broadcast(starts), "range").withColumn(name, (F.col("start") + F.col("row")).cast("long")).drop("range", "start", "row")


def summed_before(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over those before in ``order``, by sorted ranges as in ``numbered``."""
    ranges = saved(rows.withColumn("value", value).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range.
    starts = ranges.groupBy("range").agg(F.sum("value").alias("value")).select("range", before(Window.orderBy("range")).alias("start"))
    within = ranges.withColumn("within", before(Window.partitionBy("range").orderBy(*order)))
    return within.join(F.broadcast(starts), "range").withColumn(name, F.col("start") + F.col("within")).drop("range", "start", "within", "value")


def post_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ord): dependencies first, equal levels by id."""
    return numbered(dependency_levels(nodes, edges), ["level", "id"], "ord").select("id", "ord")


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON elements of a graph view: nodes with their classes, and resolved edges with caller->callee ids."""
    ext = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1))
    lang = F.when(ext == ".py", " lang-python").when(ext == ".js", " lang-javascript").when(ext == ".ts", " lang-typescript").when(ext.isin(".c", ".h"), " lang-c").when(ext.isin(".cpp", ".hpp", ".cc"), " lang-cpp").otherwise("")
    kind = F.concat(F.when(F.col("component_type") == "method", "node-method").otherwise("node-function"), lang)
    node = nodes.select(F.to_json(F.struct(F.struct("id", F.col("name").alias("label")).alias("data"), kind.alias("classes"))).alias("element"))
    edge = edges.filter("is_resolved").select(
        F.to_json(F.struct(F.struct(F.concat("caller", F.lit("->"), "callee").alias("id"), F.col("caller").alias("source"), F.col("callee").alias("target")).alias("data"), F.lit("edge-call").alias("classes"))).alias("element")
    )
    return node.unionByName(edge)
