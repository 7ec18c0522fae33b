"""Exact cosine pairs and average-link groups as Spark jobs.

Pairs: vectors are packed into tiles; a tile pair is the unit of work, so a library with a third of all
faces is simply many tile pairs. A tile pair whose bounding cones are too far apart cannot hold a pair
above the threshold and is never shipped. Only pairs above the threshold leave a task.

Groups: for unit vectors the average similarity of two groups is the dot product of their mean vectors. Each round merges
all groups that are each other's best partner; average link is reducible, so this gives the same groups as merging the
single best pair each time. A round of a library is blocks over many tasks, or one task where it is little work.
"""
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window, functions as F, types as T

from framelake.plans.ordered import numbered
from framelake.session import checkpoint_dir, delete_at_exit

TILE, CELL = 256, 64        # vectors of a tile, tiles of a cell


def _tiles(e, key, vec, tile):
    """Ordered by the signs of a few coordinates, near vectors share a tile, which tightens the cones."""
    sig = sum((F.when(F.get(F.col(vec), F.lit(i)) > 0, 2 ** i).otherwise(0) for i in range(8)), F.lit(0))
    # the block also carries a hash, so a single signature cannot pile up in one task
    block = sig * F.lit(4096) + F.pmod(F.xxhash64(key), F.lit(4096))
    n = numbered(e.withColumn("_blk", block), ["g"], F.col("_blk"), ["_blk", key], "pos")
    n = n.withColumn("tile", F.floor((F.col("pos") - 1) / tile))
    # written: cones and both sides of the tile pairs read it
    packed = written_once(n.groupBy("g", "tile").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vec).alias("v"))).alias("rows")))

    def cone(batches):
        for batch in batches:
            centre, reach = [], []
            for rows in batch.column("rows"):
                m = _matrix(rows)
                c = m.mean(axis=0)
                nrm = np.linalg.norm(c)
                c = c / nrm if nrm else np.eye(1, m.shape[1])[0]
                centre.append(c)
                reach.append(float(np.arccos(np.clip(m @ c, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("tile"), pa.array(centre, pa.list_(pa.float64())), pa.array(reach, pa.float64())], ["g", "tile", "c", "r"])
    cones = packed.mapInArrow(cone, T.StructType([packed.schema["g"], T.StructField("tile", T.LongType()),
                                                  T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("r", T.DoubleType())]))
    return packed, cones


def _matrix(rows):
    """The vectors of a tile, straight from Arrow's numbers: as Python objects they would take a worker many times the memory."""
    v = rows.values.field("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _cells(cones):
    """Cones around the cones of CELL neighbouring tiles."""
    grouped = cones.groupBy("g", F.floor(F.col("tile") / CELL).alias("cell")).agg(F.collect_list(F.struct("c", "r")).alias("_t"))

    def around(it):
        for pdf in it:
            centre, reach = [], []
            for tiles in pdf["_t"]:
                m = np.array([t["c"] for t in tiles], dtype=np.float64)
                c = m.mean(axis=0)
                c = c / (np.linalg.norm(c) or 1.0)
                centre.append(c.tolist())
                reach.append(float(min(np.pi, (np.arccos(np.clip(m @ c, -1, 1)) + np.array([t["r"] for t in tiles])).max())))
            yield pd.DataFrame({"g": pdf["g"], "cell": pdf["cell"], "c": centre, "r": reach})
    return grouped.mapInPandas(around, T.StructType([cones.schema["g"], T.StructField("cell", T.LongType()), T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("r", T.DoubleType())]))


def _within(threshold):
    """Whether two cones (ca, ra) and (cb, rb) can hold a pair above the threshold."""
    dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) <= F.acos(F.lit(max(-1.0, min(1.0, threshold)))) + F.col("ra") + F.col("rb") + 1e-6


def cosine_pairs(e, threshold, tile=TILE):
    """e(g, key, vec) with unit vectors -> (g, a, b, sim) for a < b and sim > threshold, exact. Cells of tiles are paired
    first, tiles only within cell pairs whose cones are near enough, and vectors only within such tile pairs."""
    key_t = e.schema["key"].dataType
    packed, cones = _tiles(e, "key", "vec", tile)
    cones = written_once(cones)
    cells = written_once(_cells(cones))
    side = lambda d, x, k: d.select("g", F.col(k).alias(f"{k}_{x}"), F.col("c").alias(f"c{x}"), F.col("r").alias(f"r{x}"))
    last = cells.groupBy("g").agg(F.max("cell").alias("_last"))
    near = (side(cells, "a", "cell").join(last, "g").withColumn("cell_b", F.explode(F.sequence("cell_a", "_last"))).join(side(cells, "b", "cell"), ["g", "cell_b"])
            .filter(_within(threshold)).select("g", "cell_a", "cell_b"))
    in_cell = lambda x: side(cones, x, "tile").withColumn(f"cell_{x}", F.floor(F.col(f"tile_{x}") / CELL))
    pairs = (near.join(in_cell("a"), ["g", "cell_a"]).join(in_cell("b"), ["g", "cell_b"]).filter((F.col("tile_a") <= F.col("tile_b")) & _within(threshold))
             .select("g", F.col("tile_a").alias("ta"), F.col("tile_b").alias("tb")))
    work = (pairs.join(packed.select("g", F.col("tile").alias("ta"), F.col("rows").alias("x")), ["g", "ta"])
            .join(packed.select("g", F.col("tile").alias("tb"), F.col("rows").alias("y")), ["g", "tb"]))
    schema = T.StructType([e.schema["g"], T.StructField("a", key_t), T.StructField("b", key_t), T.StructField("sim", T.DoubleType())])

    def above(batches):
        for batch in batches:
            for g, ta, tb, x, y in zip(*(batch.column(n) for n in ("g", "ta", "tb", "x", "y"))):
                kx, ky = (t.values.field("k").to_numpy(zero_copy_only=False) for t in (x, y))
                s = _matrix(x) @ _matrix(y).T
                hit = s > threshold
                if ta == tb:
                    hit &= kx[:, None] < ky[None, :]
                i, j = np.nonzero(hit)
                lo, hi = np.minimum(kx[i], ky[j]), np.maximum(kx[i], ky[j])
                key = x.values.field("k").type
                yield pa.RecordBatch.from_arrays([pa.repeat(g, len(i)), pa.array(lo, key), pa.array(hi, key), pa.array(s[i, j], pa.float64())], ["g", "a", "b", "sim"])
    return work.mapInArrow(above, schema)


@contextmanager
def freed(spark):
    """What is written in here leaves no shuffle files: they go when it is written, and not when the driver happens to collect
    garbage. Not for results, whose plan may be run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def written_once(df):
    """Cuts the lineage with a written table in the checkpoint folder: computed once, survives executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def written_for(df):
    """As written_once, for what is worked out in here: the table is deleted afterwards."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a table that may travel to every task; callers' rows hold a few numbers or one vector.
SMALL_ROWS = 50_000


def written_by(df, key):
    """As written_once, but dealt out by the key for good: joins and aggregations on it read co-located buckets and need no
    exchange, however many of them follow. A bucket lies in one file and is read by one task."""
    spark = df.sparkSession
    path, name = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}", f"cut_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freed(spark):
        df.repartition(parts, key).write.format("parquet").option("compression", "zstd").bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    delete_at_exit(spark, path)
    return spark.table(name)


def small_side(table):
    """The table marked for broadcast if a count of its rows allows it; else as it is, for a join that shuffles. The table
    should be a written one, as it is counted first."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table


def _with_heads(e, threshold):
    """e with the smallest key (head) and the number (n) of the rows that have its vector. Vectors that are not of unit length, or
    not above the threshold with themselves, stand alone."""
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    alone = F.when(~F.coalesce((F.abs(square - 1) < 1e-5) & (square > threshold + 1e-5), F.lit(False)), F.col("key"))
    own = written_once(e.select("g", "key", "vec").withColumn("_alone", alone))
    heads = own.filter("_alone IS NULL").groupBy("g", "vec").agg(F.min("key").alias("head"), F.count("*").alias("n"))
    return written_once(own.filter("_alone IS NULL").join(heads, ["g", "vec"]).select("g", "key", "vec", "head", "n")
                        .unionAll(own.filter("_alone IS NOT NULL").select("g", "key", "vec", F.col("key").alias("head"), F.lit(1).cast("long").alias("n"))))


#: Vectors of a library, in bytes, and multiplications that one task takes for a whole library; vectors of a task that scans.
ALONE_BYTES, ALONE_WORK, SCAN = 64 << 20, 1 << 34, 8192
#: Similarities that differ by less are worked out again, number by number.
NEAR = 1e-9


def _nearest(x, cx, y, cy, threshold):
    """For each row of x (means of groups) the most similar row of y: (position in y or -1, similarity) where it is above the
    threshold. cx and cy, which rises, name the rows; a row never meets itself and the smaller name wins a tie. What comes close to the best is worked
    out by a sum in a fixed order, so that both ends of a pair see the same number to the last bit, in whatever task."""
    at, sim = np.full(len(x), -1), np.full(len(x), -np.inf)
    step = max(1, (4 << 20) // max(1, len(y)))
    for i in range(0, len(x), step):
        s = x[i:i + step] @ y.T
        own = np.searchsorted(cy, cx[i:i + step])
        own = np.minimum(own, len(cy) - 1)
        r = np.nonzero(cy[own] == cx[i:i + step])[0]
        s[r, own[r]] = -np.inf
        top = s.max(axis=1)
        near = s >= np.where(top > threshold - NEAR, top - NEAR, np.inf)[:, None]
        r, j = np.nonzero(near)
        exact = np.concatenate([(x[i + r[k:k + 65536]] * y[j[k:k + 65536]]).sum(axis=1) for k in range(0, len(r), 65536)] or [np.zeros(0)])
        order = np.lexsort((j, -exact, r))
        first = order[np.diff(r[order], prepend=-1) != 0]
        first = first[exact[first] > threshold]
        at[i + r[first]], sim[i + r[first]] = j[first], exact[first]
    return at, sim


def _vectors(column):
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _alone(threshold, work):
    """Rounds of one library in one task, as many as the work of a task allows: to each group (c) what it has become (to), and to what
    is left its sum vector, size and best partner, null where that has to be looked for again."""
    def rounds(t):
        t = t.combine_chunks().sort_by("c")
        keys, size = t["c"].combine_chunks(), t.num_rows
        s, n, sim = _vectors(t["s"]), t["n"].to_numpy().astype(np.int64), t["sim"].to_numpy().astype(np.float64)
        best = pc.fill_null(pc.index_in(t["y"].combine_chunks(), value_set=keys), -1).to_numpy().astype(np.int64)
        to, live, spent = np.arange(size), np.arange(size), 0         # best holds places in the library's keys, -1 where to look
        while len(live):
            todo = live[best[live] < 0]
            need = len(todo) * len(live) * s.shape[1]
            if need > work or spent + need > 4 * work:
                break
            spent += need
            if len(todo):
                at, v = _nearest(s[todo] / n[todo, None], todo, s[live] / n[live, None], live, threshold)
                best[todo], sim[todo] = np.where(at < 0, -1, live[at]), v
            live = live[best[live] >= 0]                              # what has no partner above the threshold is final
            a = live[(best[best[live]] == live) & (live < best[live])]
            if not len(a):
                # only similarities that were worked out in two ways can leave no pair that chose each other: look again
                if len(todo) == len(live):
                    break
                best[live] = -1
                continue
            b = best[a]
            s[a], n[a], to[b] = s[a] + s[b], n[a] + n[b], a
            merged = np.zeros(size, dtype=bool)
            merged[a], merged[b] = True, True
            again = merged[live] | merged[best[live]]
            best[live[again]] = -1
            live = live[to[live] == live]
        while (to[to] != to).any():
            to = to[to]
        left = np.zeros(size, dtype=bool)
        left[live] = True
        gone = pa.array(~left)
        null = lambda x: pc.if_else(gone, pa.scalar(None, x.type), x)
        rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left) * s.shape[1]]), pa.int32()), pa.array(s[left].ravel()), mask=gone)
        y = keys.take(pa.array(np.maximum(best, 0)))
        y = pc.if_else(pa.array(~left | (best < 0)), pa.scalar(None, y.type), y)
        return pa.table({"g": t["g"], "c": keys, "to": keys.take(pa.array(to)), "s": rows, "n": null(pa.array(n)), "y": y, "sim": null(pa.array(sim))})
    return rounds


def _scanned(far, size, threshold):
    """far(g, c, s, n, y, sim) of libraries too large for one task -> the same with the partners that were null, without groups that have
    none above the threshold. Groups to look for meet all groups of their library, SCAN by SCAN."""
    tiles = lambda x: F.ceil(F.col(x) / SCAN)
    rows = far.join(size, "g").select("g", "c", F.expr("transform(s, x -> x / n)").alias("m"), "y", tiles("todo").alias("ta"), tiles("live").alias("tb"))
    place = lambda x: F.pmod(F.xxhash64("c"), F.col(x))
    each = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.col(x) - 1))
    todo = rows.filter("y IS NULL").select("g", "c", "m", place("ta").alias("a"), each("tb").alias("b"))
    live = rows.filter("ta > 0").select(*[F.col(x).alias(f"_{x}") for x in ("g", "c", "m")], place("tb").alias("_b"), each("ta").alias("_a"))

    def scan(x, y):
        if not x.num_rows or not y.num_rows:
            return pa.table({"g": x["g"].slice(0, 0), "c": x["c"].slice(0, 0), "y": x["c"].slice(0, 0), "sim": pa.array([], pa.float64())})
        y = y.combine_chunks().sort_by("_c")
        keys = y["_c"].combine_chunks()
        cx = pc.fill_null(pc.index_in(x["c"].combine_chunks(), value_set=keys), -1).to_numpy()
        at, sim = _nearest(_vectors(x["m"]), cx, _vectors(y["_m"]), np.arange(len(keys)), threshold)
        hit = pa.array(np.nonzero(at >= 0)[0])
        return pa.table({"g": x["g"].take(hit), "c": x["c"].take(hit), "y": keys.take(pa.array(at[at >= 0])), "sim": pa.array(sim[at >= 0])})
    schema = T.StructType([far.schema["g"], far.schema["c"], T.StructField("y", far.schema["c"].dataType), T.StructField("sim", T.DoubleType())])
    found = _best(todo.groupBy("g", "a", "b").cogroup(live.groupBy("_g", "_a", "_b")).applyInArrow(scan, schema))
    looked = far.filter("y IS NULL").drop("y", "sim").join(found, ["g", "c"])
    return far.filter("y IS NOT NULL").unionByName(looked)


def _best(found):
    """found(g, c, y, sim) -> the most similar y of each c; the smallest on ties, so both ends of a pair agree."""
    return found.groupBy("g", "c").agg(F.min_by(F.struct("y", "sim"), F.struct((-F.col("sim")).alias("s"), "y")).alias("b")).select("g", "c", "b.y", "b.sim")


def _first_best(pairs):
    """The most similar partner of each vector. Tasks that find pairs keep the best of many at once, so pairs are neither written nor
    shuffled."""
    key, g = pairs.schema["a"].dataType, pairs.schema["g"]

    def reduced(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 18:
                yield from best(held)
                held, n = [], 0
        if n:
            yield from best(held)

    def best(held):
        t = pa.Table.from_batches(held)
        t = pa.concat_tables([t.select(["g", "a", "b", "sim"]).rename_columns(["g", "c", "y", "sim"]), t.select(["g", "b", "a", "sim"]).rename_columns(["g", "c", "y", "sim"])])
        t = t.take(pc.sort_indices(t, [("g", "ascending"), ("c", "ascending"), ("sim", "descending"), ("y", "ascending")])).combine_chunks()
        new = np.ones(t.num_rows, dtype=bool)
        for x in ("g", "c"):
            codes = t[x].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] = (codes[1:] != codes[:-1]) if x == "g" else new[1:] | (codes[1:] != codes[:-1])
        return t.filter(pa.array(new)).to_batches()
    return _best(pairs.select("g", "a", "b", "sim").mapInArrow(reduced, T.StructType([g, T.StructField("c", key), T.StructField("y", key), T.StructField("sim", T.DoubleType())])))


def average_link(e, threshold, pairs=None):
    """e(g, key, vec) -> (g, key, cluster); cluster is the smallest key of the group. Every round merges all groups that are each
    other's best partner, so the rounds end by themselves.

    No edges are kept: a group knows its sum vector, its size and its best partner. An average never exceeds the larger of its
    parts, so a partner stays the best until one of the two is merged; only groups that were merged, or whose partner was, look again,
    and groups that have none above the threshold are final and left out from then on. Groups that look meet all of their library in
    blocks over many tasks; a library whose vectors and whose search are little goes on in one task until that is no longer so.

    Equal unit vectors are each other's best partners and merge first, so they start as one group, and pairs are those of
    different vectors. Given pairs are taken as they are: they name the first partners."""
    if pairs is None:
        e = _with_heads(e, threshold)
        heads = e.filter("key = head").select("g", "key", "vec", "n")
        pairs = cosine_pairs(heads.drop("n"), threshold)
    else:
        e = e.withColumn("head", F.col("key")).withColumn("n", F.lit(1).cast("long"))
        heads, pairs = e, pairs.filter(F.col("sim") > threshold)
    groups = heads.select("g", F.col("key").alias("c"), F.transform("vec", lambda x: x.cast("double") * F.col("n")).alias("s"), "n")
    member, merges = e.select("g", "key", F.col("head").alias("cluster")), []
    state = written_once(groups.join(_first_best(pairs), ["g", "c"]))
    while True:
        size = state.groupBy("g").agg(F.count("*").alias("live"), F.count_if(F.col("y").isNull()).alias("todo"), F.max(F.size("s")).alias("_d"))
        alone = (F.col("live") * F.col("_d") * 8 <= ALONE_BYTES) & (F.col("live") * F.col("todo") * F.col("_d") <= ALONE_WORK)
        size = written_once(size.select("g", "live", "todo", alone.alias("alone")))
        kinds = {r["alone"] for r in size.select("alone").distinct().collect()}
        if not kinds:
            break
        small, parts = small_side(size), []
        if True in kinds:
            fields = T.StructType([state.schema["g"], state.schema["c"], T.StructField("to", state.schema["c"].dataType), *[state.schema[x] for x in ("s", "n", "y", "sim")]])
            done = written_once(state.join(small.filter("alone").select("g"), "g", "left_semi").groupBy("g").applyInArrow(_alone(threshold, ALONE_WORK), fields))
            merges.append(done.filter("c <> to").select("g", "c", "to"))
            parts.append(done.filter("s IS NOT NULL").drop("to"))
        if False in kinds:
            now = written_once(_scanned(state.join(small.filter("NOT alone").select("g"), "g", "left_semi"), small.filter("NOT alone"), threshold))
            # a pair that chose each other is named twice and becomes its smaller key
            pair = Window.partitionBy("g", F.least("c", "y"), F.greatest("c", "y"))
            moved = written_once(now.select("g", "c", "y").withColumn("_b", F.count("*").over(pair) == 2).filter("_b").select("g", "c", F.least("c", "y").alias("to")))
            merges.append(moved.filter("c <> to"))
            some = small_side(moved)
            at = now.join(some, ["g", "c"], "left").join(some.select("g", F.col("c").alias("y"), F.lit(True).alias("_y")), ["g", "y"], "left").join(F.broadcast(moved.select("g").distinct().withColumn("_any", F.lit(True))), "g", "left")
            # where none chose each other, which only similarities worked out in two ways can cause, all look again
            kept = at.filter("to IS NULL").select("g", "c", "s", "n", F.when(F.col("_y").isNull() & F.col("_any"), F.col("y")).alias("y"), "sim")
            new = (at.filter("to IS NOT NULL").groupBy("g", F.col("to").alias("c")).agg(F.collect_list("s").alias("ss"), F.sum("n").alias("n"))
                   .select("g", "c", F.zip_with(F.col("ss")[0], F.col("ss")[1], lambda x, y: x + y).alias("s"), "n", F.lit(None).cast(state.schema["y"].dataType).alias("y"), F.lit(None).cast("double").alias("sim")))
            parts.append(kept.unionByName(new))
        state = written_once(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    for i, m in enumerate(merges):
        member = member.join(small_side(m.withColumnRenamed("c", "cluster")), ["g", "cluster"], "left").select("g", "key", F.coalesce("to", "cluster").alias("cluster"))
        if i % 16 == 15:
            member = written_once(member)
    return member
