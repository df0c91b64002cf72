"""The choice of k, quality indices and centroids; operators/kmeans.py has the k-means itself."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapspark.config import ClusteringConfig
from gapspark.functions.order import numbered
from gapspark.functions.vectors import cosine_similarity, distance, mean_vectors
from gapspark.operators import kmeans


def rank_by_similarity(vectors: DataFrame, query: list[float]) -> DataFrame:
    """row_id, vector, query_distance, rank (from 1): ascending cosine distance, ties by row_id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    checked = F.when(F.size("vector") == len(query), F.col("vector")).otherwise(F.raise_error(F.lit("the query and the vectors differ in dimensions")).cast("array<double>"))
    out = vectors.withColumn("query_distance", distance(checked, q, "cosine"))
    return numbered(out, ["query_distance", "row_id"], "rank")


def nearest(vectors: DataFrame, query: list[float], n: int) -> DataFrame:
    """The first n rows of rank_by_similarity, by a top-n that sorts no more than n rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.withColumn("query_distance", distance(F.col("vector"), q, "cosine")).orderBy("query_distance", "row_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("query_distance", "row_id")).cast("long"))


def elbow(ks: list[int], wcss: list[float]) -> int | None:
    """The knee of a decreasing convex curve (Kneedle, Satopaa et al. 2011, sensitivity 1); None below three points or without one."""
    if len(ks) < 3:
        return None
    x, y = np.asarray(ks, float), np.asarray(wcss, float)
    if np.ptp(y) <= 0:
        return None
    xn, yn = (x - x[0]) / (x[-1] - x[0]), (y - y.min()) / np.ptp(y)
    # flipped to a concave increasing curve, the difference curve peaks at the knee
    diff = (1 - yn) - xn
    peaks = [i for i in range(1, len(diff) - 1) if diff[i] >= diff[i - 1] and diff[i] >= diff[i + 1]]
    step = np.abs(np.diff(xn)).mean()
    for n, i in enumerate(peaks):
        threshold = diff[i] - step
        end = peaks[n + 1] if n + 1 < len(peaks) else len(diff)
        if any(diff[j] < threshold for j in range(i + 1, end)):
            return int(ks[i])
    return None


@dataclass
class KSelection:
    k: int
    k_range: list[int] = field(default_factory=list)
    wcss: list[float] = field(default_factory=list)
    silhouette: list[float] = field(default_factory=list)
    k_elbow: int | None = None
    k_silhouette: int | None = None
    rule: str = "fixed"

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(int(k), float(w), float(s)) for k, w, s in zip(self.k_range, self.wcss, self.silhouette)], "k int, wcss double, silhouette double")


def _fits(vectors: DataFrame, ks: list[int], config: ClusteringConfig) -> kmeans.Fits:
    """A fit for each k of vectors(row_id, vector), named by its k."""
    jobs = vectors.sparkSession.createDataFrame([(0, k, k, config.random_state) for k in ks], "scope int, fit int, k int, seed long")
    return kmeans.fitted(vectors.select(F.lit(0).alias("scope"), "row_id", "vector"), jobs, config.n_init, config.distance_metric, config.init, config.task_rows)


def _tried(n: int, config: ClusteringConfig) -> tuple[list[int], KSelection | None]:
    """The numbers of clusters to try for n rows, and the selection where there is nothing to choose."""
    if n < 2:
        raise ValueError("clustering needs two rows or more")
    if config.n_clusters is not None or config.k_selection == "fixed":
        if config.n_clusters is None:
            raise ValueError("k_selection 'fixed' needs n_clusters")
        k = min(config.n_clusters, n)
        return [k], KSelection(k, [k])
    ks = list(range(config.k_min, min(config.k_max, n - 1) + 1))
    return (ks, None) if ks else ([min(2, n)], KSelection(min(2, n), rule="degenerate"))


def _selected(vectors: DataFrame, config: ClusteringConfig) -> tuple[KSelection, kmeans.Fits | None]:
    """The number of clusters, and the fits it was chosen from (None if there was no choice)."""
    ks, only = _tried(vectors.count(), config)
    if only:
        return only, None
    fits = _fits(vectors, ks, config)
    cost = {r.fit: r.cost for r in fits.best.select("fit", "cost").collect()}  # k_max rows
    told = {r.fit: r.silhouette for r in silhouettes(vectors.select(F.lit(0).alias("scope"), "row_id", "vector"), fits.labels).collect()}
    return choice(ks, [cost[k] for k in ks], [told[k] for k in ks], config), fits


def fit_runs(vectors: DataFrame, seeds: list[int], config: ClusteringConfig) -> DataFrame:
    """scope, seed, row_id, cluster, distance of vectors(scope, row_id, vector): what fit_kmeans gives for every scope and seed.

    All scopes, seeds, numbers of clusters and starts are keys of one plan. The scopes are a few (sizes of a corpus).
    """
    spark, kind = vectors.sparkSession, vectors.schema["scope"].dataType.simpleString()
    tried = {r.scope: _tried(r["count"], config) for r in vectors.groupBy("scope").count().collect()}
    jobs = [(scope, i * 1000 + k, k, seed) for scope, (ks, _) in tried.items() for i, seed in enumerate(seeds) for k in ks]
    fits = kmeans.fitted(vectors, spark.createDataFrame(jobs, f"scope {kind}, fit int, k int, seed long"), config.n_init, config.distance_metric, config.init, config.task_rows)
    cost = {(r.scope, r.fit): r.cost for r in fits.best.select("scope", "fit", "cost").collect()}  # a number for each fit
    told = {(r.scope, r.fit): r.silhouette for r in silhouettes(vectors, fits.labels).collect()} if any(only is None for _, only in tried.values()) else {}
    chosen = []
    for scope, (ks, only) in tried.items():
        for i, seed in enumerate(seeds):
            k = (only or choice(ks, [cost[scope, i * 1000 + k] for k in ks], [told[scope, i * 1000 + k] for k in ks], config)).k
            chosen.append((scope, i * 1000 + k, seed))
    own = spark.createDataFrame(chosen, f"scope {kind}, fit int, seed long")
    return fits.labels.join(F.broadcast(own), ["scope", "fit"]).select("scope", "seed", "row_id", "cluster", "distance")


def choice(ks: list[int], wcss: list[float], sil: list[float], config: ClusteringConfig) -> KSelection:
    """The number of clusters by the configured rule, from the cost and the silhouette of each."""
    k_elbow, k_sil = elbow(ks, wcss), ks[int(np.argmax(sil))]
    middle = ks[len(ks) // 2]
    if config.k_selection == "elbow":
        k, rule = k_elbow or middle, "elbow"
    elif config.k_selection == "silhouette" or max(sil) >= config.silhouette_floor:
        k, rule = k_sil, "silhouette"
    else:
        k, rule = k_elbow or middle, f"elbow, as no silhouette reaches {config.silhouette_floor}"
    return KSelection(k, ks, wcss, sil, k_elbow, k_sil, rule)


def select_k(vectors: DataFrame, config: ClusteringConfig) -> KSelection:
    """The number of clusters of vectors(row_id, vector); every (k, start) is a key of one plan."""
    return _selected(vectors, config)[0]


@dataclass
class Clusters:
    assignment: DataFrame  # row_id, cluster, distance_from_centroid
    centroids: DataFrame  # cluster, centroid
    selection: KSelection
    inertia: float

    @property
    def sizes(self) -> DataFrame:
        return self.assignment.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def fit_kmeans(vectors: DataFrame, config: ClusteringConfig) -> Clusters:
    """k-means of vectors(row_id, vector), with distances to the own centroid in the configured metric."""
    selection, fits = _selected(vectors, config)
    fits = fits or _fits(vectors, [selection.k], config)
    best = fits.best.where(F.col("fit") == selection.k)
    centroids = best.select(F.posexplode("centres").alias("cluster", "centroid")).select(F.col("cluster").cast("int").alias("cluster"), "centroid")
    assignment = fits.labels.where(F.col("fit") == selection.k).select("row_id", "cluster", F.col("distance").alias("distance_from_centroid"))
    return Clusters(assignment, centroids, selection, best.first().cost)


def lloyd_steps(vectors: DataFrame, centroids: DataFrame, steps: int) -> DataFrame:
    """row_id, cluster after `steps` Lloyd steps from centroids(cluster, centroid): all DataFrame operations."""
    now = centroids
    for step in range(steps + 1):
        met = vectors.select("row_id", "vector").join(F.broadcast(now))  # k vectors
        d = F.aggregate(F.zip_with("vector", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        nearest_of = met.withColumn("d", d).groupBy("row_id").agg(F.min_by("cluster", F.struct("d", "cluster")).alias("cluster"))
        if step == steps:
            return nearest_of
        now = mean_vectors(vectors.join(nearest_of, "row_id"), ["cluster"])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b, by one matrix product; where that cancels, by differences."""
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    d = (size - 2 * (a @ b.T)).clip(0)
    i, j = np.nonzero(d < 1e-8 * size)
    for at in range(0, len(i), 16_384):
        rows, columns = i[at : at + 16_384], j[at : at + 16_384]
        d[rows, columns] = ((a[rows] - b[columns]) ** 2).sum(1)
    return np.sqrt(d)


def distance_sums(a: np.ndarray, b: np.ndarray, labels: np.ndarray, k: int, rows: int = 512) -> np.ndarray:
    """For each row of a and each cluster the sum of distances to b's rows of it; labels: one row for each labelling of b.

    A slice of `rows` rows at a time, so the memory is that of rows x len(b) numbers whatever the dimensions.
    """
    held = [np.eye(k)[own] for own in labels]
    return np.concatenate([np.stack([d @ h for h in held]) for at in range(0, len(a), rows) for d in [distances(a[at : at + rows], b)]], axis=1)


def distance_sums_both(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, numbers: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """The sums of distances of a's rows to b's by column of of_b (a 1 for each row's clusters), and of b's rows to a's by those of of_a.

    Each distance is measured once. A slice of a at a time, so that about `numbers` distances are held.
    """
    rows, forth, back = max(1, numbers // max(1, len(b))), [], np.zeros((len(b), of_a.shape[1]))
    for at in range(0, len(a), rows):
        d = distances(a[at : at + rows], b)
        forth.append(d @ of_b)
        back += d.T @ of_a[at : at + rows]
    return np.concatenate(forth), back


#: Sums in one row of a point's sums; most points of a block, and most numbers of its vectors.
WIDE, BLOCK, NUMBERS = 16, 32_768, 1 << 22


def silhouettes(points: DataFrame, labels: DataFrame, block: int | None = None) -> DataFrame:
    """scope, fit, silhouette: the mean silhouette (Euclidean) of every labelling of points(scope, row_id, vector) by labels(scope, row_id, fit, cluster).

    Exact, so quadratic in the points of a scope, but once for all its labellings: points are cut into blocks, as large as a
    task can hold (or of about `block`), and each pair of blocks is one group, which measures its distances once and leaves a
    row of sums for each of its points. What is shuffled is a point for each block, hence little beside the pairs.
    -1 for a labelling with one cluster only, or as many as points. Clusters are numbers from 0.
    """
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("scope", "row_id")}
    spark, places, at = points.sparkSession, [], {}
    for r in sorted(labels.groupBy("scope", "fit", "cluster").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (str(r.scope), r.fit, r.cluster)):  # a row for each cluster
        own = at.setdefault(r.scope, {})
        own[r.fit, r.cluster] = len(own)
        places.append((r.scope, r.fit, r.cluster, r.n, own[r.fit, r.cluster] // WIDE, own[r.fit, r.cluster] % WIDE))
    place = F.broadcast(spark.createDataFrame(places, f"scope {kinds['scope']}, fit int, cj int, n long, chunk int, i int"))
    of = labels.groupBy("scope", "row_id").agg(F.array_sort(F.collect_list(F.struct("fit", "cluster"))).alias("own"))
    most = F.least(F.lit(BLOCK), F.floor(F.lit(NUMBERS) / F.greatest(F.lit(1), F.max(F.size("vector")))))
    many = F.ceil(F.count(F.lit(1)) / (F.lit(block) if block else most))
    few = F.lit(1) if block else F.least(F.lit(4), F.ceil(F.count(F.lit(1)) / F.lit(2048)))  # small sets use some cores too
    sizes = points.groupBy("scope").agg(F.greatest(few, many).cast("int").alias("blocks"))
    placed = points.join(of, ["scope", "row_id"]).join(F.broadcast(sizes), "scope").withColumn("b", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    dealt = placed.select("scope", "row_id", "vector", F.transform("own", lambda o: o["fit"]).alias("fits"), F.transform("own", lambda o: o["cluster"]).alias("own"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.withColumns({"x": F.least("b", "o"), "y": F.greatest("b", "o")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scope, same = pdf["scope"].iloc[0], pdf["x"].iloc[0] == pdf["y"].iloc[0]
        here = (pdf["b"] == pdf["x"]).to_numpy()
        x, mine = np.array(pdf["vector"].tolist(), float), at[scope]
        of = np.zeros((len(pdf), len(mine)))
        for row, (fits, own) in enumerate(zip(pdf["fits"], pdf["own"])):
            of[row, [mine[f, c] for f, c in zip(fits, own)]] = 1
        if same:
            total = distance_sums_both(x, x, of[:, :0], of)[0]
        elif here.all() or not here.any():
            return pd.DataFrame({c: [] for c in names})
        else:
            total = np.zeros_like(of)
            total[here], total[~here] = distance_sums_both(x[here], x[~here], of[here], of[~here])
        out = []
        for chunk in range(-(-len(mine) // WIDE)):
            part = total[:, chunk * WIDE : (chunk + 1) * WIDE]
            part = np.pad(part, ((0, 0), (0, WIDE - part.shape[1])))
            out.append(pd.DataFrame({"scope": scope, "row_id": pdf["row_id"].to_numpy(), "chunk": chunk, **{f"s{i}": part[:, i] for i in range(WIDE)}}))
        return pd.concat(out)

    names = ["scope", "row_id", "chunk", *[f"s{i}" for i in range(WIDE)]]
    parts = dealt.groupBy("scope", "x", "y").applyInPandas(run, f"scope {kinds['scope']}, row_id {kinds['row_id']}, chunk int, " + ", ".join(f"s{i} double" for i in range(WIDE)))
    summed = parts.groupBy("scope", "row_id", "chunk").agg(*[F.sum(c).alias(c) for c in names[3:]])
    each = summed.select("scope", "row_id", "chunk", F.posexplode(F.array(*names[3:])).alias("i", "s")).join(place, ["scope", "chunk", "i"])
    each = each.join(labels.select("scope", "row_id", "fit", F.col("cluster").alias("ci")), ["scope", "row_id", "fit"])
    n = F.col("n") - (F.col("ci") == F.col("cj")).cast("long")  # a point is no neighbour of itself
    sums = each.where(n > 0).withColumn("d", F.col("s") / n)
    near = sums.groupBy("scope", "fit", "row_id", "ci").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("b"))
    each_s = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    found = near.groupBy("scope", "fit").agg(F.avg(each_s).alias("s"), F.count(F.lit(1)).alias("n"), F.size(F.collect_set("ci")).alias("k"))  # k numbers
    return found.select("scope", "fit", F.when((F.col("k") < 2) | (F.col("k") >= F.col("n")), -1.0).otherwise(F.col("s")).alias("silhouette"))


def silhouette(points: DataFrame) -> DataFrame:
    """One row: the mean silhouette (Euclidean) of points(row_id, cluster, vector), exact at every size; clusters are numbers from 0."""
    one = points.select(F.lit(0).alias("scope"), "row_id", "vector", F.lit(0).alias("fit"), F.col("cluster").cast("int").alias("cluster"))
    return silhouettes(one.select("scope", "row_id", "vector"), one.select("scope", "row_id", "fit", "cluster")).select("silhouette")


def davies_bouldin(points: DataFrame) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of spreads to centroid distance."""
    centres = mean_vectors(points, ["cluster"])
    spread = points.join(F.broadcast(centres), "cluster").groupBy("cluster").agg(F.avg(distance(F.col("vector"), F.col("centroid"), "euclidean")).alias("s"))
    c = centres.join(spread, "cluster")
    pairs = c.join(c.select(F.col("cluster").alias("o"), F.col("centroid").alias("oc"), F.col("s").alias("os")), F.col("cluster") != F.col("o"))
    worst = pairs.groupBy("cluster").agg(F.max((F.col("s") + F.col("os")) / distance(F.col("centroid"), F.col("oc"), "euclidean")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """One row: between over within dispersion, each by its degrees of freedom."""
    centres = mean_vectors(points, ["cluster"])
    whole = mean_vectors(points, []).withColumnRenamed("centroid", "g")
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    per = points.join(F.broadcast(centres), "cluster").join(F.broadcast(whole)).groupBy("cluster").agg(F.sum(sq(F.col("vector"), F.col("centroid"))).alias("w"), F.count(F.lit(1)).alias("n"), F.first(sq(F.col("centroid"), F.col("g"))).alias("b"))
    s = per.agg(F.sum("w").alias("w"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return s.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def indices(points: DataFrame) -> dict[str, float | None]:
    """Davies-Bouldin and Calinski-Harabasz of points(cluster, vector), from one row for each cluster."""
    met = points.select("cluster", "vector").join(F.broadcast(mean_vectors(points, ["cluster"])), "cluster")  # k vectors
    d = distance(F.col("vector"), F.col("centroid"), "euclidean")
    rows = met.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("s"), F.sum(d * d).alias("w"), F.first("centroid").alias("m")).collect()
    m, n, s, within = np.array([r.m for r in rows], float), np.array([r.n for r in rows]), np.array([r.s for r in rows]), sum(r.w for r in rows)
    apart = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        worst = ((s[:, None] + s[None, :]) / apart).max(1).mean()
    between = (n * ((m - (n[:, None] * m).sum(0) / n.sum()) ** 2).sum(1)).sum()
    free = n.sum() - len(rows)
    return {"davies_bouldin": float(worst), "calinski_harabasz": float((between / (len(rows) - 1)) / (within / free)) if within > 0 and free > 0 and len(rows) > 1 else None}


def centroid_similarity(centroids: DataFrame) -> DataFrame:
    """left, right, similarity of all pairs of centroids: k times k rows."""
    a = centroids.select(F.col("cluster").alias("left"), F.col("centroid").alias("a"))
    b = centroids.select(F.col("cluster").alias("right"), F.col("centroid").alias("b"))
    return a.join(F.broadcast(b)).select("left", "right", cosine_similarity(F.col("a"), F.col("b")).alias("similarity"))


def default_subclusters(n: int) -> int:
    return 1 if n < 2 else min(5, max(2, int(n**0.5)))


def fit_subclusters(space: DataFrame, config: ClusteringConfig, scope: tuple[str, ...] = ()) -> DataFrame:
    """space(scope..., cluster, keyword, vector, centrality, ...) with subcluster and distance: the clusters are scopes of one k-means.

    A cluster of fewer than 4 keywords is not divided: label 0, and the centrality is the distance. With a column `seed` in
    scope each run has its own seed.
    """
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in (*scope, "cluster")])
    seed = F.col("seed") if "seed" in scope else F.lit(config.random_state)
    points = space.select(name.alias("scope"), F.col("keyword").alias("row_id"), "vector", seed.cast("long").alias("seed"))
    n = points.groupBy("scope", "seed").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    k = F.lit(config.n_keyword_subclusters) if config.n_keyword_subclusters else F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.sqrt("n"))))
    jobs = n.select("scope", F.lit(0).alias("fit"), F.least(k, "n").cast("int").alias("k"), "seed")
    labels = kmeans.fitted(points.drop("seed"), jobs, config.n_init, config.distance_metric, config.init, config.task_rows).labels
    own = labels.select(F.col("scope").alias("_s"), F.col("row_id").alias("keyword"), F.col("cluster").alias("subcluster"), "distance")
    out = space.withColumn("_s", name).join(own, ["_s", "keyword"], "left").drop("_s")
    return out.withColumns({"subcluster": F.coalesce("subcluster", F.lit(0)), "distance": F.coalesce("distance", "centrality")})
