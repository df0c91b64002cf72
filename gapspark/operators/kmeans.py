"""k-means of many sets of points at once, the same at every size.

points     scope, row_id, vector      a scope is one set of points
jobs       scope, fit, k, seed        a fit is one clustering of its scope; each is made `n_init` times

(scope, fit, start) are keys of one plan, so all numbers of clusters, all seeds and all starts of all scopes are worked
on together. Seeding is k-means|| (Bahmani et al., 2012) by hash draws: a round takes the points that are first in an exponential race with
rates of their squared distances to the candidates so far, which needs no total beforehand, and each point's luck is a hash
of its id; the candidates, weighted by the points nearest to them, are then thinned by k-means++. With init 'random' a
start is the first k points in order of MD5 of `seed:start:row_id`, which SQL can repeat. Lloyd steps follow. A cluster without
points keeps its centre. Clusters are numbered by their least row_id.

A scope of up to `task_rows` points is clustered inside a task; of larger ones every round and every step is a pass over
the table, in which a task adds up its points and centres alone reach the driver. Both run the same kernels on the same
draws, so `task_rows` moves work and changes no result but for the rounding of sums (the tests run both ways).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapspark.sources.tables import materialized

ROUNDS, STEPS, TOLERANCE = 5, 300, 1e-4
#: Tasks over which the jobs of one small scope are dealt, and positions of a vector in one row of sums.
BUCKETS, BLOCK = 8, 32
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_SUMS = ["job", "cluster", "block", "n", "cost", *[f"s{i}" for i in range(BLOCK)]]


# Kernels

def nearest(x: np.ndarray, c: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, ties to the lower index, and the squared distance (rough, where the points' squared sizes are given).

    Distances come from one matrix product; where the two best are too close to tell, and for the distance itself where it
    cancels, differences are squared instead, so results do not depend on how points are cut into blocks.
    """
    rough, size = size is not None, (x * x).sum(1) if size is None else size
    d = (size[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).clip(0)
    label = d.argmin(1)
    best = d[np.arange(len(x)), label]
    if len(c) > 1:
        second = np.partition(d, 1, axis=1)[:, 1]
        close = np.flatnonzero(second - best <= 1e-9 * (size + (c * c).sum(1).max()))
        for at in range(0, len(close), 256):
            rows = close[at : at + 256]
            label[rows] = np.stack([((x[rows] - e) ** 2).sum(1) for e in c], 1).argmin(1)
    if rough:
        return label, best
    for at in range(0, len(x), 4096):
        own = x[at : at + 4096] - c[label[at : at + 4096]]
        best[at : at + 4096] = (own * own).sum(1)
    return label, best


def luck(keys: np.ndarray, *salt: int) -> np.ndarray:
    """An exponential variate for each key, from the salt (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64).copy()
        for s in salt:
            z = (z ^ np.uint64(s % 2**64)) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
    return -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)


def race(x: np.ndarray, keys: np.ndarray, candidates: np.ndarray, n: int, *salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n points of the race, and when they arrive; points that are candidates already never do."""
    with np.errstate(divide="ignore"):
        when = luck(keys, *salt) / (nearest(x, candidates)[1] if len(candidates) else 1.0)
    first = np.lexsort((keys, when))[:n]
    first = first[np.isfinite(when[first])]
    return first, when[first]


def thinned(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int, start: int) -> np.ndarray:
    """k of the weighted candidates by k-means++, with a few tries a step."""
    rng, tries = np.random.default_rng([seed % 2**63, k, start]), 2 + int(np.log(k))
    weight = weight.astype(float)
    chosen = [int(rng.choice(len(candidates), p=weight / weight.sum()))]
    d = ((candidates - candidates[chosen[0]]) ** 2).sum(1)
    for _ in range(1, k):
        p = weight * d if (weight * d).sum() > 0 else weight
        picks = rng.choice(len(candidates), size=tries, p=p / p.sum())
        options = [np.minimum(d, ((candidates - candidates[i]) ** 2).sum(1)) for i in picks]
        best = int(np.argmin([(weight * o).sum() for o in options]))
        chosen.append(int(picks[best]))
        d = options[best]
    return candidates[chosen]


def sums(x: np.ndarray, c: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of points, their sum and their squared distances (rough with a size, see nearest), for each centre."""
    label, d = nearest(x, c, size)
    if len(c) <= 64:
        own = np.zeros((len(c), len(x)))
        own[label, np.arange(len(x))] = 1
        total = own @ x
    else:
        total = np.zeros_like(c)
        np.add.at(total, label, x)
    return np.bincount(label, minlength=len(c)), total, np.bincount(label, d, len(c))


def moved(c: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, float]:
    """The centres after a step, and how far they went, squared."""
    new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return new, float(((new - c) ** 2).sum())


def draws(k: int) -> int:
    """Points taken in each round; jobs of the same number share their candidates."""
    return max(20, 2 * k)


def _still(n: int, total: np.ndarray, squares: np.ndarray, tol: float) -> float:
    """Up to so far centres count as standing: a share of the mean variance, or rounding."""
    variance = np.maximum(0, squares / n - (total / n) ** 2).mean()
    return max(tol * variance, 1e-24 * float(squares.sum()) / n)


def inside(x: np.ndarray, keys: np.ndarray, k: int, seed: int, start: int, centres: np.ndarray | None, tol: float, known: dict) -> tuple[np.ndarray, float]:
    """Centres and cost of one job, all points at hand (in order of row_id). known keeps candidates that jobs share."""
    c = centres
    if c is None:
        if (seed, start, draws(k)) not in known:
            first, _ = race(x, keys, x[:0], 1, seed, start, 0)
            candidates = x[first]
            for r in range(1, ROUNDS + 1):
                candidates = np.concatenate((candidates, x[race(x, keys, candidates, draws(k), seed, start, r)[0]]))
            known[seed, start, draws(k)] = candidates, np.bincount(nearest(x, candidates)[0], minlength=len(candidates))
        c = thinned(*known[seed, start, draws(k)], k, seed, start)
    bound = _still(len(x), x.sum(0), (x * x).sum(0), tol)
    size = (x * x).sum(1)
    for _ in range(STEPS):
        n, total, _ = sums(x, c, size)
        c, far = moved(c, n, total)
        if far <= bound:
            break
    label, d = nearest(x, c)
    first = np.full(k, len(x))
    np.minimum.at(first, label, np.arange(len(x)))
    return c[np.argsort(first, kind="stable")], float(d.sum())


# Scopes that fit in a task

def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float)


def _inside(points: DataFrame, jobs: DataFrame, tol: float, kind: str) -> DataFrame:
    """scope, fit, k, start, cost, centres of every job: its scope's points are met by the jobs in a few groups."""
    buckets = jobs.groupBy("scope").agg(F.least(F.count(F.lit(1)), F.lit(BUCKETS)).cast("int").alias("_b"))
    dealt = points.join(buckets, "scope").select("scope", "row_id", "key", "vector", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("bucket"))
    # starts of one seed stay together, for they share candidates
    own = jobs.join(buckets, "scope").withColumn("bucket", F.pmod(F.xxhash64("seed", "start"), F.col("_b")).cast("int")).drop("_b")

    def run(p: pd.DataFrame, j: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("row_id")
        x, keys, known, out = _matrix(p["vector"]) if len(p) else None, p["key"].to_numpy(), {}, []
        for r in j.sort_values(["fit", "start"]).itertuples() if len(p) else ():
            c, cost = inside(x, keys, int(r.k), int(r.seed), int(r.start), None if r.centres is None else np.array(r.centres).reshape(r.k, -1), tol, known)
            out.append((r.scope, r.fit, r.k, r.start, cost, c.tolist()))
        return pd.DataFrame(out, columns=["scope", "fit", "k", "start", "cost", "centres"])

    return dealt.groupBy("scope", "bucket").cogroup(own.groupBy("scope", "bucket")).applyInPandas(run, f"scope {kind}, fit int, k int, start int, cost double, centres array<array<double>>")


# Larger scopes: passes

class _Passes:
    """Passes over points(scope, key, vector) for jobs that are rows (scope, fit, k, seed, start, centres)."""

    def __init__(self, points: DataFrame, jobs: list, tol: float):
        self.points, self.jobs, self.tol = points.select("scope", "key", "vector"), jobs, tol

    def _over(self, work: dict, schema: str, kernel) -> DataFrame:
        """Rows of a kernel over all points; work: scope -> [(id, entry)].

        kernel(id, entry, x, keys, state) takes points in and returns the state; without points it returns the state's rows.
        """
        columns = [c.split() for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for b in batches:
                scopes = b.column(0).dictionary_encode()
                keys, at = b.column(1).to_numpy(zero_copy_only=False), scopes.indices.to_numpy(zero_copy_only=False)
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else None
                for k, scope in enumerate(scopes.dictionary.to_pylist()):
                    mine = slice(None) if len(scopes.dictionary) == 1 else at == k
                    own, its = x[mine], keys[mine]
                    for job, entry in work.get(scope, ()):
                        held[job] = kernel(job, entry, own, its, held.get(job))
            rows = [r for job, state in held.items() for r in kernel(job, None, None, None, state)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, _ARROW[kind]) for v, (_, kind) in zip(zip(*rows), columns)], [c for c, _ in columns])

        return self.points.mapInArrow(run, schema)

    def _raced(self, entries: dict, n: dict) -> dict:
        """The points taken for each id; entries: id -> (scope, candidates, salt)."""
        work: dict = {}
        for i, (scope, candidates, salt) in entries.items():
            work.setdefault(scope, []).append((i, (candidates, salt, n[i])))

        def kernel(job, entry, x, keys, state):
            if entry is None:
                return [(job, w, int(k), v.tolist()) for w, k, v in zip(*state[:3])]
            candidates, salt, most = entry
            first, when = race(x, keys, candidates, most, *salt)
            if state is not None:
                when, keys, x = np.concatenate((state[0], when)), np.concatenate((state[1], keys[first])), np.concatenate((state[2], x[first]))
                first = np.lexsort((keys, when))[:most]
                return when[first], keys[first], x[first]
            return when, keys[first], x[first]

        rows = self._over(work, "job int, w double, key long, vector array<double>", kernel)
        most = max(n.values())
        # a task sends `most` rows for an id; they are thinned in groups before they meet
        for by in (["job", F.pmod(F.xxhash64("key"), F.lit(64))], ["job"]):
            rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy("w", "key"))).where(F.col("_p") <= most).drop("_p")
        found: dict = {i: [] for i in entries}
        for r in sorted(rows.collect(), key=lambda r: (r.w, r.key)):  # `most` vectors for each id
            found[r.job].append(r.vector)
        return {i: np.array(v[: n[i]], float).reshape(-1, entries[i][1].shape[1] if entries[i][1].size else len(v[0]) if v else 0) for i, v in found.items()}

    def _summed(self, entries: dict, rough: bool = False) -> dict:
        """For each id the number of points, their sum and their cost by centre; entries: id -> (scope, centres). Steps need rough costs only."""
        work: dict = {}
        for i, (scope, c) in entries.items():
            work.setdefault(scope, []).append((i, c))

        def kernel(job, c, x, keys, state):
            if c is None:
                n, total, cost = state
                return [(job, e, b, int(n[e]) if not b else 0, float(cost[e]) if not b else 0.0, *np.pad(total[e, b * BLOCK : (b + 1) * BLOCK], (0, max(0, (b + 1) * BLOCK - total.shape[1]))).tolist())
                        for e in np.flatnonzero(n).tolist() for b in range(-(-total.shape[1] // BLOCK))]
            new = sums(x, c, (x * x).sum(1) if rough else None)
            return new if state is None else tuple(a + b for a, b in zip(state, new))

        rows = self._over(work, "job int, cluster int, block int, n long, cost double, " + ", ".join(f"s{i} double" for i in range(BLOCK)), kernel)
        out = {i: (np.zeros(len(c), np.int64), np.zeros_like(c), np.zeros(len(c))) for i, (_, c) in entries.items()}
        for r in rows.groupBy("job", "cluster", "block").agg(*[F.sum(c).alias(c) for c in _SUMS[3:]]).collect():  # as many as centres
            n, total, cost = out[r.job]
            n[r.cluster] += r.n
            cost[r.cluster] += r.cost
            part = total[r.cluster, r.block * BLOCK : (r.block + 1) * BLOCK]
            part += [r[f"s{i}"] for i in range(len(part))]
        return out

    def _bounds(self) -> dict:
        """How far centres of each scope may move and count as standing."""
        scopes = {j.scope for j in self.jobs}
        stats = self.points.select("scope", F.posexplode("vector").alias("i", "x")).groupBy("scope", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).collect()
        by = {s: sorted((r for r in stats if r.scope == s), key=lambda r: r.i) for s in scopes}
        return {s: _still(rows[0].n, np.array([r.s for r in rows]), np.array([r.q for r in rows]), self.tol) for s, rows in by.items() if rows}

    def run(self) -> list[tuple]:
        """(scope, fit, k, start, cost, centres) of every job."""
        centres = {i: None if j.centres is None else np.array(j.centres, float).reshape(j.k, -1) for i, j in enumerate(self.jobs)}
        asked = sorted({(j.scope, j.seed, j.start, draws(j.k)) for j in self.jobs if j.centres is None}, key=str)
        if asked:
            seeds = {i: np.zeros((0, 0)) for i in range(len(asked))}
            for r in range(ROUNDS + 1):
                taken = self._raced({i: (asked[i][0], seeds[i], (asked[i][1], asked[i][2], r)) for i in seeds}, {i: asked[i][3] if r else 1 for i in seeds})
                seeds = {i: np.concatenate((seeds[i], taken[i])) if r else taken[i] for i in seeds}
            weight = {i: n for i, (n, _, _) in self._summed({i: (asked[i][0], seeds[i]) for i in seeds}).items()}
            place = {a: i for i, a in enumerate(asked)}
            for i, j in enumerate(self.jobs):
                if j.centres is None:
                    own = place[j.scope, j.seed, j.start, draws(j.k)]
                    centres[i] = thinned(seeds[own], weight[own], j.k, j.seed, j.start)
        bounds, going = self._bounds(), set(centres)
        for _ in range(STEPS):
            if not going:
                break
            for i, (n, total, _) in self._summed({i: (self.jobs[i].scope, centres[i]) for i in going}, True).items():
                centres[i], far = moved(centres[i], n, total)
                if far <= bounds[self.jobs[i].scope]:
                    going.discard(i)
        cost = {i: float(d.sum()) for i, (_, _, d) in self._summed({i: (j.scope, centres[i]) for i, j in enumerate(self.jobs)}).items()}
        return [(j.scope, j.fit, j.k, j.start, cost[i], centres[i].tolist()) for i, j in enumerate(self.jobs)]


# All

@dataclass
class Fits:
    """best: scope, fit, k, start, cost, centres.   labels: scope, row_id, fit, cluster, distance (to the own centre)."""

    best: DataFrame
    labels: DataFrame


def random_starts(points: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs(scope, fit, k, seed, start) with centres, end to end: the first k points of the scope by MD5 of seed:start:row_id."""
    most = jobs.groupBy("scope", "seed", "start").agg(F.max("k").alias("most"))
    drawn = points.select("scope", "row_id", "vector").join(F.broadcast(most), "scope")  # seeds and starts of each scope
    drawn = drawn.withColumn("h", F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("start").cast("string"), F.col("row_id").cast("string"))))
    first = drawn.withColumn("p", F.row_number().over(Window.partitionBy("scope", "seed", "start").orderBy("h", "row_id"))).where("p <= most")
    listed = first.groupBy("scope", "seed", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "vector"))), lambda s: s["vector"]).alias("all"))
    return jobs.drop("centres").join(listed, ["scope", "seed", "start"]).withColumn("centres", F.flatten(F.slice("all", F.lit(1), F.col("k")))).drop("all")


def fitted(points: DataFrame, jobs: DataFrame, n_init: int = 10, metric: str = "euclidean", init: str = "k-means||", task_rows: int = 4096, tol: float = TOLERANCE) -> Fits:
    """The best of n_init starts of every job, and the labels it gives. A scope needs k points or more."""
    spark, kind = points.sparkSession, points.schema["scope"].dataType.simpleString()
    jobs = materialized(jobs.select("scope", F.col("fit").cast("int").alias("fit"), F.col("k").cast("int").alias("k"), F.col("seed").cast("long").alias("seed")), "jobs")
    keyed = points.join(jobs.select("scope").distinct(), "scope", "left_semi").select("scope", "row_id", F.xxhash64("row_id").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    each = jobs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))).alias("start"), F.lit(None).cast("array<double>").alias("centres"))
    if init == "random":
        each = materialized(random_starts(keyed, each), "starts")
    sizes = materialized(keyed.groupBy("scope").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = [r.scope for r in sizes.where(F.col("n") > task_rows).collect()]  # sets too large for a task: few by definition
    some = F.col("scope").isin(large) if large else F.lit(False)
    done = _inside(keyed.where(~some), each.where(~some), tol, kind)
    if large:
        # jobs are worked on together wherever points are, so the points of a pass go to all cores, however few files they came from
        far = materialized(keyed.where(some).repartition(spark.sparkContext.defaultParallelism), "points")
        rows = _Passes(far, each.where(some).collect(), tol).run()  # jobs of the large sets
        done = done.unionByName(spark.createDataFrame(_numbered(far, rows, kind), done.schema))
    done = materialized(done, "fits")
    told = F.format_string("%.10e", F.col("cost")).cast("double")  # costs that differ by rounding are the same
    best = done.groupBy("scope", "fit").agg(F.min_by(F.struct("k", "start", "cost", "centres"), F.struct(told, "start")).alias("b")).select("scope", "fit", "b.*")
    labels = _labelled(keyed.where(~some), best.where(~some), metric, kind)
    if large:
        labels = labels.unionByName(_labelled_far(far, best.where(some), metric))
    return Fits(best, materialized(labels, "labels"))


def _own_distance(x: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    label, d = nearest(x, c)
    if metric != "cosine":
        return label, np.sqrt(d)
    size = np.linalg.norm(x, axis=1) * np.linalg.norm(c, axis=1)[label]
    return label, 1 - np.divide((x * c[label]).sum(1), size, out=np.zeros(len(x)), where=size > 0)


def _labelled(points: DataFrame, best: DataFrame, metric: str, kind: str) -> DataFrame:
    row = points.schema["row_id"].dataType.simpleString()

    def run(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in b.itertuples() if len(p) else ():
            label, d = _own_distance(_matrix(p["vector"]), np.array(r.centres).reshape(r.k, -1), metric)
            out.append(pd.DataFrame({"scope": p["scope"], "row_id": p["row_id"], "fit": r.fit, "cluster": label, "distance": d}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("scope", "row_id", "fit", "cluster", "distance")})

    return points.groupBy("scope").cogroup(best.select("scope", "fit", "k", F.flatten("centres").alias("centres")).groupBy("scope")).applyInPandas(run, f"scope {kind}, row_id {row}, fit int, cluster int, distance double")


def _labelled_far(points: DataFrame, best: DataFrame, metric: str) -> DataFrame:
    """Labels of large scopes, whose centres all tasks hold: k vectors for each of their few fits."""
    centres: dict = {}
    for r in best.collect():
        centres.setdefault(r.scope, []).append((r.fit, np.array(r.centres, float)))
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("scope", "row_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scopes = b.column(0).dictionary_encode()
            at = scopes.indices.to_numpy(zero_copy_only=False)
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else None
            for k, scope in enumerate(scopes.dictionary.to_pylist()):
                mine = np.flatnonzero(at == k)
                for fit, c in centres.get(scope, ()):
                    label, d = _own_distance(x[mine], c, metric)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine)), b.column(1).take(pa.array(mine)), pa.array(np.full(len(mine), fit), pa.int32()), pa.array(label, pa.int32()), pa.array(d)], ["scope", "row_id", "fit", "cluster", "distance"])

    return points.select("scope", "row_id", "vector").mapInArrow(run, f"scope {kinds['scope']}, row_id {kinds['row_id']}, fit int, cluster int, distance double")


def _numbered(points: DataFrame, rows: list[tuple], kind: str) -> list[tuple]:
    """rows(scope, fit, k, start, cost, centres) with the centres in order of the least row_id they hold; empty ones last."""
    asked = points.sparkSession.createDataFrame([(r[0], i, r[5]) for i, r in enumerate(rows)], f"scope {kind}, fit int, centres array<array<double>>")
    order: dict[int, list[int]] = {}
    for r in sorted(_labelled_far(points, asked, "euclidean").groupBy("fit", "cluster").agg(F.min("row_id").alias("first")).collect(), key=lambda r: r["first"]):  # as many as centres
        order.setdefault(r.fit, []).append(r.cluster)
    return [(*r[:5], [r[5][c] for c in [*order[i], *sorted(set(range(r[2])) - set(order[i]))]]) for i, r in enumerate(rows)]
