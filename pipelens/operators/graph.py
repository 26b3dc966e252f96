"""Graph operators as rounds of joins, each round cut by a checkpoint in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a generated method beyond which the JVM only interprets it, and Spark's own limit, which is larger.
COMPILED, SPARKS = "8000", "65535"


def compiled(spark: SparkSession) -> None:
    """Has Spark generate code by operators, in small methods, where one method of a whole stage would be too long for the JVM to compile; a limit of the session's own stays."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", SPARKS) == SPARKS:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut in the folder of spark.checkpoint.dir; one of our own only where that is unset on a single machine."""
    spark = df.sparkSession
    compiled(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again, so that later scans take only the columns they need, and only the rows where they ask for values of ``by``."""
    cut(df.limit(0))
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(makers: list[Callable[[], DataFrame]], at_once: int = 4) -> DataFrame:
    """The frames that ``makers`` give, all of one schema, each written to a table of its own in the shared folder, and read as one.

    Some are made at once: most of what a small frame takes is planning and waiting for short jobs.
    """
    with ThreadPoolExecutor(at_once) as pool:
        tables = [f.result() for f in [pool.submit(lambda make=make: written(make())) for make in makers]]
    paths = [path for table in tables for path in table.inputFiles()]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)


#: Pairs that a task joins up at once, before what is left goes to rounds of joins.
LOCAL = 250_000


def _joining(size: int):
    """The function of a task that gives rows (v, root) for its pairs (a, b), ``size`` at a time: each vertex with the smallest one that those pairs join it to."""

    # Inner functions, as executors get these with the task and need not have the package.
    def labelled(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        coded = pa.chunked_array([rows["a"].chunk(0), rows["b"].chunk(0)]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        names, codes = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
        x, y, root = codes[: len(rows)], codes[len(rows) :], np.arange(len(order))
        while True:
            # The larger root of each pair hangs on the smaller one, then all climb to the top.
            p, q = root[x], root[y]
            apart = p != q
            if not apart.any():
                return pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["v", "root"])
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root[root] != root).any():
                root = root[root]

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield labelled(held)
                held, n = [], 0
        if n:
            yield labelled(held)

    return run


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``pairs`` (a, b), strings; the component is its smallest id. Loops keep lone vertices.

    Pairs are dealt and sorted by ids, the shorter ones first, as neighbours mostly have ids
    near each other, and each task joins up its own, some at a time. Only the roots of vertices
    that were seen apart are joined in rounds, so what does not lie near each other costs those
    rounds and nothing is lost.
    """
    first = F.least("a", "b")
    ranged = pairs.select("a", "b").where("a is not null and b is not null").repartitionByRange(F.length(first), first).sortWithinPartitions(F.length(first), first)
    near = written(ranged.select("a", "b").mapInArrow(_joining(LOCAL), "v string, root string"))
    ids = near.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    split = cut(ids.where("lo <> hi").select("v", "lo"))
    if split.isEmpty():
        return written(ids.select(F.col("v").alias("id"), F.col("lo").alias("component")))
    links = near.join(split, "v").where("root <> lo").select(F.col("root").alias("a"), F.col("lo").alias("b"))
    top = _rounds(links).select(F.col("id").alias("lo"), "component")
    return written(ids.join(top, "lo", "left").select(F.col("v").alias("id"), F.coalesce("component", "lo").alias("component")))


def _rounds(pairs: DataFrame) -> DataFrame:
    """(id, component) as ``components`` has it, by rounds in which each vertex takes the smallest label around it and then that label's own."""
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = hooked.select(F.col("id").alias("component"), F.col("component").alias("above"))
        nxt = cut(hooked.join(above, "component").select("id", "old", F.least("component", "above").alias("component")))
        if nxt.where("component <> old").isEmpty():
            return nxt.select("id", "component")
        labels = nxt.select("id", "component")


#: Edges of a component up to which a task takes it whole; larger components go to rounds of joins.
WHOLE = 100_000


def _by_component(size: int, found: Callable):
    """The function of a task that gives what ``found`` gives for rows of whole components, about ``size`` at a time; its rows are sorted by component."""

    # An inner function, as executors get it with the task and need not have the package.
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                rows = pa.Table.from_batches(held).combine_chunks()
                start = pc.index(rows["component"], rows["component"][-1]).as_py()
                if start:
                    yield found(rows.slice(0, start))
                held = rows.slice(start).to_batches()
                n = sum(b.num_rows for b in held)
        if n:
            yield found(pa.Table.from_batches(held))

    return run


def _reached(size: int):
    """The function of a task that gives (id) of what reaches a goal, for edges (a, b, component) and goals (a, null, component) sorted by component."""

    def found(rows):
        edge = rows["b"].is_valid()
        edges, goals = rows.filter(edge), rows.filter(pc.invert(edge))["a"]
        coded = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks, *goals.chunks], type=rows.schema.field("a").type).combine_chunks()
        coded = coded.dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        x, y, front = codes[: len(edges)], codes[len(edges) : 2 * len(edges)], np.unique(codes[2 * len(edges) :])
        order = np.argsort(y, kind="stable")
        x, first = x[order], np.searchsorted(y[order], np.arange(len(names) + 1))
        seen, goal = np.zeros(len(names), dtype=bool), front
        seen[front] = True
        while len(front):
            # All edges that end on the front: where each vertex's begin, then one after the other.
            n = first[front + 1] - first[front]
            back = x[np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            front = np.unique(back[~seen[back]])
            seen[front] = True
        seen[goal] = False
        return pa.RecordBatch.from_arrays([names.take(pa.array(np.flatnonzero(seen)))], names=["id"])

    return _by_component(size, found)


def _strong(size: int):
    """The function of a task that gives (id, component) of the vertices on cycles, for edges (a, b, component) sorted by component: Tarjan's, without recursion."""

    def found(rows):
        coded = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks], type=rows.schema.field("a").type).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        names, codes = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
        x, y = codes[: len(rows)], codes[len(rows) :]
        by = np.argsort(x, kind="stable")
        to, first = y[by].tolist(), np.searchsorted(x[by], np.arange(len(names) + 1)).tolist()
        at, number, low, root, place, open_, count = first[:], [0] * len(names), [0] * len(names), [-1] * len(names), [0] * len(names), [], 0
        for start in range(len(names)):
            path = [] if number[start] else [start]
            while path:
                v = path[-1]
                if not number[v]:
                    count += 1
                    number[v] = low[v] = count
                    place[v] = len(open_)
                    open_.append(v)
                if at[v] < first[v + 1]:
                    w = to[at[v]]
                    at[v] += 1
                    if not number[w]:
                        path.append(w)
                    elif root[w] < 0:
                        low[v] = min(low[v], number[w])
                    continue
                path.pop()
                if path:
                    low[path[-1]] = min(low[path[-1]], low[v])
                if low[v] == number[v]:
                    whole = open_[place[v] :]
                    del open_[place[v] :]
                    least = min(whole)
                    for w in whole:
                        root[w] = least
        root = np.array(root, dtype=np.int64)
        cyclic = np.bincount(root, minlength=len(names))[root] > 1
        cyclic[x[x == y]] = True
        ids = np.flatnonzero(cyclic)
        return pa.RecordBatch.from_arrays([names.take(pa.array(ids)), names.take(pa.array(root[ids]))], names=["id", "component"])

    return _by_component(size, found)


def _in_components(edges: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Edges (a, b) with their ``component`` of ``parts`` (id, component), the components of more than WHOLE edges, and whether there are none."""
    placed = written(edges.select("a", "b").join(parts.select(F.col("id").alias("a"), "component"), "a").select("a", "b", "component"))
    large = cut(placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("component"))
    return placed, large, large.isEmpty()


def reaching(edges: DataFrame, goals: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id): all vertices from which a goal (id) can be reached along ``edges`` (a, b), goals included.

    With ``parts`` (id, component), the undirected components of all edges, a task works out
    whole components, as nothing is reached from one in another; only those of more than WHOLE
    edges cost rounds of joins.
    """
    if parts is None:
        return _jumping(edges, goals)
    placed, large, alone = _in_components(edges.where("a <> b"), parts)
    goals = goals.select("id").distinct()
    own = goals.join(parts, "id").select(F.col("id").alias("a"), F.lit(None).cast(placed.schema["b"].dataType).alias("b"), "component")
    in_large = lambda rows, how: rows.join(F.broadcast(large), "component", how)
    rows = placed.unionByName(own)
    dealt = (rows if alone else in_large(rows, "left_anti")).select("a", "b", "component").repartition("component").sortWithinPartitions("component")
    near = dealt.mapInArrow(_reached(WHOLE), f"id {placed.schema['a'].dataType.simpleString()}")
    if not alone:
        far = _jumping(in_large(placed, "left_semi"), in_large(own, "left_semi").select(F.col("a").alias("id")))
        near = near.unionByName(far.join(goals, "id", "left_anti"))
    return written(goals.unionByName(near))


def _jumping(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """What reaches a goal, by rounds that each follow a set of jumps.

    A vertex with one way out jumps on to where that way's own jump goes, so chains are
    crossed in a number of rounds that grows with the logarithm of their length; only
    vertices that a goal has just been found from are joined.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    goals = cut(goals.select("id").distinct())
    front, all_found = goals, [goals]
    # Vertices with a single way out, and where it leads; goals are not passed.
    single = edges.groupBy("a").agg(F.count("*").alias("n"), F.first("b").alias("b")).where("n = 1").select("a", "b")
    jumps, chains = cut(single.join(goals.select(F.col("id").alias("a")), "a", "left_anti")), []
    while not jumps.isEmpty():
        chains.append(jumps)
        # Jumps of the next round: of those that end on a vertex that jumps too, twice as far.
        jumps = cut(jumps.join(jumps.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
        if len(chains) > 1 and jumps.count() >= chains[-1].count():
            break  # what is left goes round in cycles and grows no more
    while True:
        near = edges.join(front.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id"))
        found = _new(near, all_found)
        # Back along the chains from what was found, the longest jumps first; each level doubles what is covered.
        for jump in reversed(chains):
            back = jump.join(_all([found, front]).select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id"))
            found = cut(_all([found, _new(back, [*all_found, found])]))
        if found.isEmpty():
            return _all(all_found)
        all_found = [*all_found, found] if len(all_found) < 8 else [cut(_all([*all_found, found]))]
        front = found


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _new(ids: DataFrame, known: list[DataFrame]) -> DataFrame:
    """The distinct ids that are in none of ``known``."""
    return ids.distinct().join(_all(known), "id", "left_anti")


def strong_components(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id, component) of the vertices on cycles; the component is its smallest id.

    With ``parts`` (id, component), the undirected components of all edges, a task takes whole
    ones, as no cycle leaves one; only those of more than WHOLE edges cost rounds of joins.
    """
    if parts is None:
        return _colouring(edges)
    placed, large, alone = _in_components(edges, parts)
    in_large = lambda how: placed.join(F.broadcast(large), "component", how).select("a", "b", "component")
    dealt = (placed if alone else in_large("left_anti")).repartition("component").sortWithinPartitions("component")
    kind = placed.schema["a"].dataType.simpleString()
    near = dealt.mapInArrow(_strong(WHOLE), f"id {kind}, component {kind}")
    return near if alone else near.unionByName(_colouring(in_large("left_semi")))


def _colouring(edges: DataFrame) -> DataFrame:
    """Strong components by rounds of joins.

    Vertices without a way in or out are trimmed; then each round colours forward by the
    smallest id and takes, backward from each colour's own vertex, the vertices of that colour.
    """
    live = cut(edges.select("a", "b").distinct())
    loops = live.where("a = b").select(F.col("a").alias("id")).distinct()
    live = live.where("a <> b")
    out = None
    while True:
        size = -1
        while True:
            live = cut(live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            now = live.count()
            if now == size or not now:
                break
            size = now
        if not now:
            break
        colour = cut(live.select(F.col("a").alias("id")).union(live.select("b")).distinct().withColumn("colour", F.col("id")))
        while True:
            come = live.join(colour.select(F.col("id").alias("a"), "colour"), "a").groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("come"))
            nxt = cut(colour.join(come, "id", "left").select("id", F.col("colour").alias("old"), F.least("colour", "come").alias("colour")))
            colour = nxt.select("id", "colour")
            if nxt.where("colour <> old").isEmpty():
                break
        within = live.join(colour.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb")
        roots = colour.where("id = colour").select("id")
        inside = reaching(within.select("a", "b"), roots).join(colour, "id").select("id", F.col("colour").alias("component"))
        inside = cut(inside)
        out = inside if out is None else out.unionByName(inside)
        live = cut(live.join(inside.select(F.col("id").alias("a")), "a", "left_anti").join(inside.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))
    many = None
    if out is not None:
        sizes = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        many = out.join(sizes, "component", "left_semi").select("id", "component")
        loops = loops.join(many.select("id"), "id", "left_anti")
    alone = loops.select("id", F.col("id").alias("component"))
    return alone if many is None else many.unionByName(alone)
