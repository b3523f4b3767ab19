"""Embedding near-duplicates by NN-descent.

Every vector keeps a list of its best neighbours.  Lists start from vectors that are adjacent in the
order of random sign codes and improve by comparing neighbours of neighbours, in both directions, until a
round changes hardly any list entry.  A list that is full of neighbours above the threshold is saturated: it
may miss further links (an edge that no list holds was pushed out of two saturated ones), so its component is compared
whole in blocks of BLOCK vectors: with the vectors outside until no component merges, then with itself (only
pairs of components and counts leave a block).  Outside vectors farther from the component's first vector than its
radius and the threshold's angle together cannot link and are left out.  Recall is then
audited: AUDIT vectors and a share of the rest, and one vector of each of up to LINKED components, are compared with all
vectors exactly; recall is the mean over components, so one large group counts once.  While it is less than
``min_recall`` the lists are doubled and the descent goes on; after the last doubling all vectors are
compared exactly, in blocks.

Equal vectors form one class, a node of the graph, so copies are never expanded into pairs.  Vectors are compared with those of
their length; lengths with at most BLOCK distinct vectors are compared directly.  Cosines that decide a link are computed in
double precision from the given components.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, as
does one with a null vec_id, which is returned with a null component; repeated rows are copies; rows of different vectors that share a
vec_id are vectors of their own, each linked as its own components say; equal cosines need no order, for every link counts; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelq.llm.common import materialize, read
from labelq.llm.graph import components
from labelq.operators.ids import dense_ids, range_levels

NEIGHBOURS = 10
STARTS = 4
START_BLOCK = 256
CODE_BITS = 14
BLOCK = 1024
PIVOTS = 4096
AUDIT = 4096
LINKED = 1024
MAX_ROUNDS = 6
#: A round that changes a smaller share of the list entries is the last one.
CHANGED = 0.01
MAX_DOUBLINGS = 3
#: Single-precision cosines below the threshold by less than this are checked in double precision.
SLACK = 0.005


def usable() -> Column:
    """Whether a row has an id and a vector that can be compared."""
    e = F.col("embedding")
    number = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & number & F.exists(e, lambda v: v != 0), F.lit(False))


def unit_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """vec_id, key (the vector's doubles) and codes (STARTS sign codes) of the usable rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(3).standard_normal((dimension, STARTS * CODE_BITS))
        weights = 1 << np.arange(CODE_BITS)
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension) + 0.0
            codes = ((x @ planes) > 0).reshape(len(x), STARTS, CODE_BITS) @ weights
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                names=["vec_id", "key", "codes"])

    e = F.col("embedding")
    return vectors.where(usable() & (F.size(e) == dimension)).select("vec_id", e.cast("array<double>").alias("e")).mapInArrow(
        run, "vec_id long, key binary, codes array<long>")


def matrix(keys: list[bytes], dtype=np.float64) -> np.ndarray:
    """Unit rows of ``keys``."""
    x = np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(dtype)


_EDGE = "u long, v long, sim float"


def _edge_batch(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float32())], names=["u", "v", "sim"])


def start_edges(reps: DataFrame, k: int) -> DataFrame:
    """Best neighbours among the vectors next to each other in the order of each sign code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, START_BLOCK):
                part = batch.slice(lo, START_BLOCK)
                n = part.num_rows
                if n < 2:
                    continue
                ids, x = part.column(0).to_numpy(), matrix(part.column(1).to_pylist(), np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                best = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, :min(k, n - 1)]
                yield _edge_batch(np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel())

    out = None
    parts = max(8, reps.sparkSession.sparkContext.defaultParallelism)
    for r in range(STARTS):
        near = reps.select("vec_id", "key", F.col("codes")[r].alias("c")).repartitionByRange(parts, "c", "vec_id") \
            .sortWithinPartitions("c", "vec_id").drop("c").mapInArrow(run, _EDGE)
        out = near if out is None else out.unionByName(near)
    return out


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct neighbours of every vector, counting edges in both directions; ``new`` is 0 for a pair that
    came with 0 at least once."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "new"))
    both = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return both.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def descend(lists: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Edges between neighbours of a common vector that would enter one of the two lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(0).offsets.to_numpy()
            flat = batch.column(0).flatten()
            ids, worst = flat.field("m").to_numpy(), flat.field("worst").to_numpy()
            keys = flat.field("key").to_pylist()
            us, vs, ss = [], [], []
            for lo, hi in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True):
                if hi - lo < 2:
                    continue
                x = np.frombuffer(b"".join(keys[lo:hi]), np.float16).reshape(hi - lo, -1).astype(np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                i, j = np.nonzero(s > worst[lo:hi, None] + 1e-3)
                us.append(ids[lo:hi][i])
                vs.append(ids[lo:hi][j])
                ss.append(s[i, j])
            if us:
                yield _edge_batch(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    worst = lists.groupBy("u").agg(F.min("sim").alias("w"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("m"), F.when(F.col("n") >= k, F.col("w")).otherwise(F.lit(-1.0)).cast("float").alias("worst"))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = matrix(part.column(1).to_pylist(), np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["m", "key"])

    short = reps.select("vec_id", "key").mapInArrow(halves, "m long, key binary").join(worst, "m")
    around = lists.select(F.col("u").alias("c"), F.col("v").alias("m"), "sim") \
        .unionByName(lists.select(F.col("v").alias("c"), F.col("u").alias("m"), "sim")).groupBy("c", "m").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.col("sim").desc(), "m"))
    around = around.withColumn("_r", rank).where(F.col("_r") <= 2 * k).select("c", "m")
    groups = around.join(short, "m").groupBy("c").agg(F.collect_list(F.struct("m", "worst", "key")).alias("g"))  # at most 2 k members
    return groups.select("g").mapInArrow(run, _EDGE)


def exact_links(edges: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """a < b and cosine in double precision of the edges at or above ``threshold``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                cos = np.einsum("ij,ij->i", matrix(part.column(2).to_pylist()), matrix(part.column(3).to_pylist()))
                hit = pa.array(cos >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(hit), part.column(1).filter(hit)], names=["a", "b"])

    near = edges.where(F.col("sim") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    keys = reps.select("vec_id", "key")
    near = near.join(keys.select(F.col("vec_id").alias("a"), F.col("key").alias("ka")), "a") \
        .join(keys.select(F.col("vec_id").alias("b"), F.col("key").alias("kb")), "b")
    return near.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def enlarged_counts(members: DataFrame, threshold: float) -> DataFrame:
    """vec_id, n (copies linked) of ``members`` (vec_id, key, copies, component): each component is compared whole,
    one pair of blocks per group."""
    import pandas as pd

    def run(pdf):
        x, block = matrix(list(pdf["key"])), pdf["block"].to_numpy()
        first, second = block == pdf["i"].iloc[0], block == pdf["j"].iloc[0]
        copies, ids = pdf["copies"].to_numpy(), pdf["vec_id"].to_numpy()
        hit = (x[first] @ x[second].T) >= threshold
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"vec_id": ids, "n": hit @ copies})
        return pd.DataFrame({"vec_id": np.concatenate([ids[first], ids[second]]), "n": np.concatenate([hit @ copies[second], copies[first] @ hit])})

    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("vec_id", "key", "copies", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return paired.groupBy("component", "i", "j").applyInPandas(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))


def component_pairs(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different components that a block of links joins."""
    i, j = np.nonzero(hit & (rows[:, None] != columns[None, :]))
    pairs = np.unique(np.stack([rows[i], columns[j]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def outside_near(todo: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """component, vec_id, key, own: vectors of ``nodes`` in other components (own) that can link to a ``todo`` vector of the
    component; both are (vec_id, key, component)."""
    spark = nodes.sparkSession
    heads = nodes.join(todo.select(F.col("component").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "key")
    heads = materialize(heads.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(-(-heads.count() // PIVOTS) or 1))), "nnd-heads")
    out = None
    for (number,) in heads.select("slice").distinct().collect():
        rows = heads.where(F.col("slice") == number).orderBy("vec_id").collect()
        ids, x = np.array([r[0] for r in rows]), matrix([bytes(r[1]) for r in rows])
        shared = spark.sparkContext.broadcast((ids, x))

        def radius(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            low = np.full(len(ids), 2.0)
            for batch in batches:
                own = batch.column(1).to_numpy()
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                mine = np.flatnonzero(ids[at] == own)
                if len(mine):
                    y = matrix(batch.column(0).take(pa.array(mine)).to_pylist())
                    np.minimum.at(low, at[mine], np.einsum("ij,ij->i", y, x[at[mine]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[low < 2]), pa.array(low[low < 2])], names=["component", "low"])

        low = dict(todo.select("key", "component").mapInArrow(radius, "component long, low double").groupBy("component").agg(F.min("low")).collect())
        reach = np.arccos(np.clip([low[i] for i in ids.tolist()], -1, 1)) + np.arccos(np.clip(threshold, -1, 1)) + 1e-6
        near = spark.sparkContext.broadcast(np.cos(np.minimum(reach, np.pi)) - 1e-9)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, near=near) -> Iterator[pa.RecordBatch]:
            (ids, x), least = shared.value, near.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    hit = matrix(part.column(1).to_pylist()) @ x.T >= least
                    i, j = np.nonzero(hit & (part.column(2).to_numpy()[:, None] != ids[None, :]))
                    for a in range(0, len(i), 4096):
                        take = pa.array(i[a:a + 4096])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[j[a:a + 4096]]), *[part.column(c).take(take) for c in range(3)]],
                                                         names=["component", "vec_id", "key", "own"])

        found = nodes.select("vec_id", "key", "component").mapInArrow(run, "component long, vec_id long, key binary, own long")
        out = found if out is None else out.unionByName(found)
    return out


def outside_links(todo: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """a, b: distinct pairs of components that a link of a ``todo`` vector joins, compared one pair of blocks per group."""
    import pandas as pd

    def run(pdf):
        inner = pdf["own"].isna().to_numpy()
        if inner.all() or not inner.any():
            return pd.DataFrame({"a": [], "b": []})
        x, own = matrix(list(pdf["key"])), pdf["own"][~inner].to_numpy(np.int64)
        a, b = component_pairs(x[inner] @ x[~inner].T >= threshold, np.full(int(inner.sum()), pdf["component"].iloc[0]), own)
        return pd.DataFrame({"a": a, "b": b})

    outer = materialize(outside_near(todo, nodes, threshold), "nnd-outside")
    inner = todo.join(outer.select("component").distinct(), "component", "left_semi")
    blocks = lambda t, name: t.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(inner, "rows").join(blocks(outer, "columns"), "component")
    place = lambda name: F.pmod(F.xxhash64("vec_id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    inner = inner.join(sizes, "component").select("component", "key", F.lit(None).cast("long").alias("own"), place("rows").alias("i"), every("columns").alias("j"))
    outer = outer.join(sizes, "component").select("component", "key", "own", every("rows").alias("i"), place("columns").alias("j"))
    return inner.unionByName(outer).groupBy("component", "i", "j").applyInPandas(run, "a long, b long").distinct()


def merged(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``nodes`` with the components that ``pairs`` (a, b) join made one, named by its smallest."""
    named = components(pairs).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    out = nodes.join(named, "component", "left").withColumn("component", F.coalesce("_to", "component"))
    return materialize(out.select(*nodes.columns), "nnd-nodes")


def completed(nodes: DataFrame, full: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (vec_id, key, copies, component) with the links of the components of ``full`` (vec_id) to the outside
    added, and the members of those components."""
    crowded = materialize(nodes.join(full, "vec_id", "left_semi").select("component").distinct(), "nnd-crowded")
    members = materialize(nodes.join(crowded, "component", "left_semi").select(*nodes.columns), "nnd-members")
    todo = members
    while todo.head(1):
        pairs = materialize(outside_links(todo, nodes, threshold), "nnd-pairs")
        if not pairs.head(1):
            break
        nodes = merged(nodes, pairs)
        grown = nodes.join(members.select("vec_id"), "vec_id", "left_semi").select("component").distinct()
        now = materialize(nodes.join(grown, "component", "left_semi").select(*nodes.columns), "nnd-members")
        # What was compared need not be again: only new members can have links that leave.
        todo = materialize(now.join(members.select("vec_id"), "vec_id", "left_anti"), "nnd-todo")
        members = now
    return nodes, members


def compared(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with exact components, and the exact counts (vec_id, n): all pairs of blocks are compared."""
    pairs = materialize(outside_links(nodes, nodes, threshold), "nnd-pairs")
    nodes = merged(nodes, pairs)
    return nodes, materialize(enlarged_counts(nodes, threshold), "nnd-counts")


def audit(nodes: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Share of the true links of sampled vectors that ``counts`` (vec_id, n) holds, each compared with all vectors: the mean
    over components of the mean over their sampled vectors.  The smaller of two such shares, of vectors taken by hash and
    of one vector each of components with links."""
    order = F.xxhash64("vec_id")
    size = AUDIT + nodes.count() // (1 << 14)
    any_ = nodes.orderBy(order, "vec_id").limit(size).select("vec_id")
    linked = nodes.join(counts.where("n > 0").select("vec_id"), "vec_id", "left_semi").groupBy("component").agg(F.min_by("vec_id", order).alias("vec_id"))
    one = linked.orderBy(order, "vec_id").limit(LINKED).select("vec_id")
    chosen = any_.withColumn("one", F.lit(0)).unionByName(one.withColumn("one", F.lit(1))).groupBy("vec_id").agg(F.min("one").alias("least"), F.max("one").alias("one"))
    chosen = materialize(nodes.join(chosen, "vec_id"), "nnd-audit")
    sample = chosen.select("vec_id", "key").collect()
    if not sample:
        return 1.0
    ids, x = np.array([r[0] for r in sample]), matrix([bytes(r[1]) for r in sample])
    shared = nodes.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                hit = (x @ matrix(part.column(1).to_pylist()).T) >= threshold
                hit &= ids[:, None] != part.column(0).to_numpy()[None, :]
                total += hit @ part.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vec_id", "truth"])

    truth = nodes.select("vec_id", "key", "copies").mapInArrow(run, "vec_id long, truth long").groupBy("vec_id").agg(F.sum("truth").alias("truth"))
    found = chosen.select("vec_id", "component", "least", "one").join(truth.where("truth > 0"), "vec_id").join(counts, "vec_id", "left")
    found = found.withColumn("share", F.least("truth", F.coalesce("n", F.lit(0))) / F.col("truth"))
    per = found.groupBy("component").agg(F.avg(F.when(F.col("least") == 0, F.col("share"))).alias("a"), F.avg(F.when(F.col("one") == 1, F.col("share"))).alias("b"))
    return min(1.0 if r is None else r for r in per.agg(F.avg("a"), F.avg("b")).first())


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, k: int = NEIGHBOURS, min_recall: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = {r["d"]: r["n"] for r in vectors.where(usable()).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    # Vectors of another length are another space; one alone has nothing to be compared with.
    shared = sorted(d for d, n in sizes.items() if n > 1)
    apart = vectors.where(~(usable() & F.size("embedding").isin(*shared))) if shared else vectors
    out = apart.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for d in shared:
        out = out.unionByName(_of_length(vectors, d, sizes[d], threshold, k, min_recall))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _of_length(vectors: DataFrame, dimension: int, n: int, threshold: float, k: int, min_recall: float) -> DataFrame:
    """vec_id, n_links, component_id of the ``n`` usable rows of one length."""
    rows = materialize(unit_vectors(vectors, dimension), "nnd-rows")
    # A node is a distinct vector, numbered in the order of the smallest vec_id it goes by, so the smallest node of a component has
    # its smallest vec_id, also where rows of different vectors share a vec_id.
    classes = rows.groupBy("key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.min("codes").alias("codes"))
    classes = materialize(dense_ids(classes, ["least_id", "key"], range_levels("least_id"), id_col="vec_id"), "nnd-classes")
    reps = classes.select("vec_id", "key", "copies", "codes")
    nodes, counts = _small(reps, threshold) if n <= BLOCK else _linked(reps, threshold, k, min_recall)
    # All rows: their class, the class's links and its component.
    names = classes.select(F.col("vec_id").alias("component"), F.col("least_id").alias("component_id"))
    per = nodes.join(counts, "vec_id", "left").join(names, "component") \
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    return rows.select("vec_id", "key").join(per, "key").select("vec_id", "n_links", "component_id")


def _small(reps: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes with components and counts (vec_id, n) of at most BLOCK vectors: all are compared."""
    return compared(reps.select("vec_id", "key", "copies", F.col("vec_id").alias("component")), threshold)


def _linked(reps: DataFrame, threshold: float, k: int, min_recall: float) -> tuple[DataFrame, DataFrame]:
    """Nodes with components and counts (vec_id, n), by descent, completion of saturated components and audit."""
    lists = materialize(best_lists(start_edges(reps, k).withColumn("new", F.lit(1)), k), "nnd-lists")
    for doubling in range(MAX_DOUBLINGS + 1):
        for _ in range(MAX_ROUNDS):
            met = lists.withColumn("new", F.lit(0)).unionByName(descend(lists, reps, k).withColumn("new", F.lit(1)))
            lists = materialize(best_lists(met, k), "nnd-lists")
            entries, changed = lists.agg(F.count("*"), F.coalesce(F.sum("new"), F.lit(0))).first()
            if changed <= CHANGED * entries:
                break
        links = materialize(exact_links(lists, reps, threshold), "nnd-links")
        nodes = reps.join(components(links), F.col("vec_id") == F.col("node"), "left") \
            .select("vec_id", "key", "copies", F.coalesce("component", "vec_id").alias("component"))
        full = lists.groupBy(F.col("u").alias("vec_id")).agg(F.min("sim").alias("w"), F.count("*").alias("n")) \
            .where((F.col("n") >= k) & (F.col("w") >= threshold - SLACK)).select("vec_id")
        nodes, members = completed(materialize(nodes, "nnd-nodes"), full, threshold)
        copies = reps.select("vec_id", "copies")
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        listed = ends.join(copies, ends["b"] == copies["vec_id"]).groupBy("a").agg(F.sum("copies").alias("n")).withColumnRenamed("a", "vec_id")
        counts = listed.unionByName(enlarged_counts(members, threshold)).groupBy("vec_id").agg(F.max("n").alias("n"))
        counts = materialize(counts, "nnd-counts")
        if audit(nodes, counts, threshold) >= min_recall:
            return nodes, counts
        k *= 2
    return compared(nodes, threshold)


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 or more among all embeddings: vec_id, n_links, component_id, kept."""
    return near_duplicates(read(spark, sf_dir, "embeddings"), 0.95)


QUERIES = {"op8_embedding_neardup": op8_embedding_neardup}
