"""Similarity and clusters (M01, M09-M15, J22-J24, A36, W05); see clusters for sweeps, splits and centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.sources.tables import written


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 where a vector is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


#: Queries that a task compares at once; their number decides how many times the other side is sent.
HELD = 16_384
_LISTS = "src long, dst long, cosine double"


#: Queries and base rows of a block whose products are looked at together (4 MB of them).
QUERIES, ROWS = 256, 2048


def _unit(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _merge(keys: np.ndarray, scores: np.ndarray, qk: np.ndarray, qv: np.ndarray, bk: np.ndarray, bv: np.ndarray) -> None:
    """Put a block of base rows into the queries' lists of the k greatest scores (ties: smaller key), best first.

    Only rows that reach a list's last score are looked at closer. Their scores are summed anew, row by row, so that equal
    vectors have equal scores wherever they stand in a block."""
    k = keys.shape[1]
    s = qv @ bv.T
    s[qk[:, None] == bk[None, :]] = -3.0
    least = scores[:, -1] - 1e-9
    if len(bk) > 4 * k and np.count_nonzero(s >= least[:, None]) > 4 * k * len(qk):
        least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - 1e-9)
    row, at = np.nonzero((s >= least[:, None]) & (s > -2.0))
    if not len(row):
        return
    some = np.unique(row)
    found = np.concatenate([(qv[row[z : z + 65536]] * bv[at[z : z + 65536]]).sum(1) for z in range(0, len(row), 65536)])
    own, key, score = np.concatenate((np.repeat(some, k), row)), np.concatenate((keys[some].ravel(), bk[at])), np.concatenate((scores[some].ravel(), found))
    order = np.lexsort((key, -score, own))
    own = own[order]
    first = np.searchsorted(own, some)
    take = order[(first[:, None] + np.arange(k)).ravel()]
    keys[some], scores[some] = key[take].reshape(-1, k), score[take].reshape(-1, k)


def _tiles(k: int):
    """Rows come by tile, its queries first: k rows a query and tile leave the task; the other side streams by."""

    def told(qk: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        on = scores > -2.0
        src = np.broadcast_to(qk[:, None], keys.shape)
        return pa.RecordBatch.from_arrays([pa.array(src[on]), pa.array(keys[on]), pa.array(scores[on])], names=["src", "dst", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, qk, qv, keys, scores = None, [], None, None, None, None
        for b in batches:
            tiles, sides = (b.column(x).to_numpy().astype(np.int64) for x in ("tile", "side"))
            cut = np.append(np.flatnonzero(np.diff(2 * tiles + sides, prepend=-1)), b.num_rows)
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                if tiles[low] != tile:
                    if keys is not None:
                        yield told(qk, keys, scores)
                    tile, held, keys = tiles[low], [], None
                part = b.slice(low, high - low)
                key, vector = part.column("key").to_numpy(), _unit(part.column("vector"))
                if sides[low] == 0:
                    held.append((key, vector))
                    continue
                if not held and keys is None:
                    continue
                if held:
                    qk, qv = (np.concatenate(x) for x in zip(*held, strict=True))
                    keys, scores, held = np.zeros((len(qk), k), np.int64), np.full((len(qk), k), -3.0), []
                for x in range(0, len(key), ROWS):
                    for y in range(0, len(qk), QUERIES):
                        z, w = slice(y, y + QUERIES), slice(x, x + ROWS)
                        _merge(keys[z], scores[z], qk[z], qv[z], key[w], vector[w])
        if keys is not None:
            yield told(qk, keys, scores)

    return run


def top_neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int = 5, held: int = HELD) -> DataFrame:
    """Each query's k nearest rows by cosine (ties: smaller key), itself left out; exact.

    Queries and base rows meet in tiles of a grid: a tile has about `held` queries, which its task keeps, and a share of the
    base, which streams by in Arrow batches. A row is sent to one row or column of tiles, k rows a query leave a tile, and
    the partial lists are merged by a window with a group limit. No pair is ever a row and nothing passes the driver.
    """
    spark = queries.sparkSession
    n = queries.count()
    across = max(1, -(-n // held))  # tiles by query
    down = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // across))  # tiles by base row

    def of(df: DataFrame, side: int) -> DataFrame:
        own, other = (across, down) if side == 0 else (down, across)
        part = F.pmod(F.xxhash64(F.col(key)), F.lit(own))
        rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
        tile = F.col("part") * down + F.col("other") if side == 0 else F.col("other") * down + F.col("part")
        return rows.select(tile.cast("long").alias("tile"), F.lit(side).alias("side"), "key", "vector")

    both = of(queries, 0).union(of(base, 1)).repartition(across * down, "tile").sortWithinPartitions("tile", "side")
    w = Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    return both.mapInArrow(_tiles(k), _LISTS).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation over all rows; 0 deviation leaves the difference."""
    stats = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return df.withColumns({c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in columns})


def grid_cells(df: DataFrame, x: str, y: str, bins: int = 3) -> DataFrame:
    """Cell of a bins x bins grid over the data's range; the last bin is closed."""
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()

    def bin_(c: str, low: float, high: float) -> Column:
        width = ((high or 0.0) - (low or 0.0)) / bins or 1.0
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - F.lit(low)) / F.lit(width))).cast("int")

    return df.withColumns({"gx": bin_(x, r["x0"], r["x1"]), "gy": bin_(y, r["y0"], r["y1"])})


def grid_clusters(df: DataFrame, x: str, y: str, least: int = 8, k: int = 8) -> DataFrame:
    """The k largest cells with at least `least` points, and their centres."""
    g = grid_cells(df, x, y).groupBy("gx", "gy").agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    return g.where(F.col("n") >= least).orderBy(F.desc("n"), "gx", "gy").limit(k)


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Clusters by k-means (labels need not equal another library's)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("features_", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="features_", predictionCol="cluster").fit(data)
    return model.transform(data).drop("features_")


def project(df: DataFrame, vector: str) -> DataFrame:
    """Two coordinates by principal components, in place of t-SNE."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.withColumn("features_", array_to_vector(F.col(vector).cast("array<double>")))
    out = PCA(k=2, inputCol="features_", outputCol="xy_").fit(data).transform(data).withColumn("xy_", vector_to_array("xy_"))
    return out.withColumns({"x": F.col("xy_")[0], "y": F.col("xy_")[1]}).drop("features_", "xy_")


def density_clusters(df: DataFrame, key: str, x: str, y: str, eps: float, least: int) -> DataFrame:
    """DBSCAN on two coordinates: key, cluster (smallest core key of the component; null for noise). Neighbours are
    found by an equi-join on grid cells of side eps, so only near points meet."""
    cell = df.select(key, x, y, F.floor(F.col(x) / eps).alias("ix"), F.floor(F.col(y) / eps).alias("iy"))
    around = cell.select(F.col(key).alias("o"), F.col(x).alias("ox"), F.col(y).alias("oy"), F.explode(F.array(*(F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c")).select("o", "ox", "oy", "c.ix", "c.iy")
    near = cell.join(around, ["ix", "iy"]).where(F.sqrt(F.pow(F.col(x) - F.col("ox"), 2) + F.pow(F.col(y) - F.col("oy"), 2)) <= eps).select(key, "o")
    near = written(near, "near")
    core = written(near.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key), "core")
    links = written(near.join(core, key).join(core.select(F.col(key).alias("o")), "o"), "links")
    label = core.withColumn("cluster", F.col(key))
    while True:
        low = links.join(label.select(F.col(key).alias("o"), F.col("cluster").alias("c")), "o").groupBy(key).agg(F.min("c").alias("low"))
        new = label.join(low, key).select(key, F.least("cluster", "low").alias("new"), "cluster")
        # labels are core points themselves: taking the label's label halves the way to the smallest
        jump = new.select(F.col(key).alias("new"), F.col("new").alias("next"))
        new = written(new.join(jump, "new").select(key, F.least("new", "next").alias("new"), "cluster"), "label")
        if new.where("new < cluster").limit(1).count() == 0:
            break
        label = new.select(key, F.col("new").alias("cluster"))
    border = near.join(label.select(F.col(key).alias("o"), "cluster"), "o").groupBy(key).agg(F.min("cluster").alias("cluster"))
    return df.select(key).join(border, key, "left")


def merged_labels(clusters: DataFrame, label: str) -> DataFrame:
    """Clusters of one label as one: members together, centre the unweighted mean of centres."""
    return clusters.groupBy(label).agg(F.sum("n").alias("n"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.count("*").alias("merged"))


def nearest_labelled(unlabelled: DataFrame, labelled: DataFrame) -> DataFrame:
    """The labelled cluster of least distance / (size ratio + 0.1); the label is widened above 1.5 times its size
    (Broad), narrowed below half (Focused), else Related. Both sides are cluster tables: a handful of rows."""
    b = labelled.select(F.col("cluster").alias("other"), "label", F.col("n").alias("on"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    pairs = unlabelled.join(b, F.col("cluster") != F.col("other"))
    dist = F.sqrt(F.pow(F.col("cx") - F.col("ox"), 2) + F.pow(F.col("cy") - F.col("oy"), 2))
    ratio = F.least("n", "on") / F.greatest("n", "on")
    best = pairs.groupBy("cluster", "n").agg(F.min(F.struct((dist / (ratio + 0.1)).alias("d"), "other", "label", "on")).alias("b"))
    kind = F.when(F.col("n") > 1.5 * F.col("b.on"), "Broad").when(F.col("n") < 0.5 * F.col("b.on"), "Focused").otherwise("Related")
    return best.select("cluster", F.concat_ws(" ", kind, "b.label").alias("label"), F.col("b.d").alias("distance"))


# Area names by place on the map and size names, of two ways to name a cluster without texts.
SPECIFIC_AREAS = ("Core Mechanisms", ("Advanced Therapeutics", "Applied Interventions"), ("Fundamental Pathways", "Clinical Applications"), "Theoretical Models", "Experimental Methods", ("Therapeutic Approaches", "Treatment Protocols"), ("Molecular Mechanisms", "Diagnostic Methods"), "Pathway Analysis", "Cellular Responses", "Biomedical Mechanisms")
BROAD_AREAS = ("Core", ("Advanced", "Applied"), ("Fundamental", "Clinical"), "Theoretical", "Experimental", "General")


def _area(x: Column, y: Column, core: float, far: tuple[float, ...], names: tuple) -> Column:
    """Core, then for each distance (outermost first) right, left, above, below; else the last name."""
    out = F.when((F.abs(x) < core) & (F.abs(y) < core), names[0])
    for k, d in enumerate(far):
        right, left, above, below = names[1 + 4 * k : 5 + 4 * k]
        out = out.when(x > d, F.when(y > 0, right[0]).otherwise(right[1])).when(x < -d, F.when(y > 0, left[0]).otherwise(left[1])).when(y > d, above).when(y < -d, below)
    return out.otherwise(names[-1])


def specific_label(x: Column, y: Column, size: Column) -> Column:
    """Area by distances 15 and 8, with a size word."""
    area = _area(x, y, 3, (15, 8), SPECIFIC_AREAS)
    return F.when(size > 100, F.concat(F.lit("Major "), area)).when(size > 50, F.concat(area, F.lit(" Studies"))).when(size > 25, F.concat(F.lit("Specialized "), area)).otherwise(F.concat(F.lit("Targeted "), area))


def position_label(x: Column, y: Column, size: Column) -> Column:
    """Area by distance 10, with a size word."""
    area = _area(x, y, 5, (10,), BROAD_AREAS)
    word = F.when(size > 80, " Biomedical Research").when(size > 40, " Medical Studies").when(size > 20, " Research Topic").otherwise(" Specialized Studies")
    return F.concat(area, word)


def split_and_merged(members: DataFrame, cluster: str, least: int) -> DataFrame:
    """Members with their cluster, or with -1 where the cluster has fewer than `least` members (dissolved)."""
    sizes = members.groupBy(cluster).agg(F.count("*").alias("size_"))
    out = members.join(sizes, cluster)
    return out.withColumn(cluster, F.when(F.col("size_") >= least, F.col(cluster)).otherwise(F.lit(-1))).drop("size_")
