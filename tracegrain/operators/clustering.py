"""Density, spectral and mixture clustering.

Groups are a device's day or a zone; each is clustered in one task, with
neighbours found by grid cells, not by all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import epoch_s


def _labels(n: int, neighbours: Callable[[int], np.ndarray], least: int) -> np.ndarray:
    """DBSCAN labels, given the neighbours (self included) of a point; -1 is noise.

    Neighbours are asked for again when they are needed, so that memory is linear
    in the points however many of them are near each other.
    """
    core = np.fromiter((len(neighbours(i)) >= least for i in range(n)), dtype=bool, count=n)
    label, k = np.full(n, -1), 0
    for i in range(n):
        if label[i] != -1 or not core[i]:
            continue
        label[i], todo = k, [i]
        while todo:
            near = neighbours(todo.pop())
            new = near[label[near] == -1]
            label[new] = k
            todo += new[core[new]].tolist()
        k += 1
    return label


def _cells(keys: np.ndarray) -> dict[tuple, np.ndarray]:
    found: dict[tuple, list[int]] = {}
    for i, k in enumerate(map(tuple, keys)):
        found.setdefault(k, []).append(i)
    return {k: np.array(v) for k, v in found.items()}


def _around(cells: dict[tuple, np.ndarray], key: tuple) -> np.ndarray:
    places = (tuple(k + d - 1 for k, d in zip(key, step)) for step in np.ndindex(*[3] * len(key)))
    near = [cells[p] for p in places if p in cells]
    return np.sort(np.concatenate(near))


def _haversine_rad(lat1, lon1, lat2, lon2):
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.minimum(a, 1)))


def _pairs(lo: np.ndarray, hi: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``lo``, ``hi`` and the places in their ranges, about ``most`` at once."""
    size = np.maximum(hi - lo, 0)
    end = np.cumsum(size)
    start = 0
    while start < len(size):
        held = end[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(end, held + most, "right")))
        n = size[start:stop]
        row = np.repeat(np.arange(start, stop), n)
        yield row, np.arange(held, end[stop - 1]) - np.repeat(end[start:stop] - n - lo[start:stop], n)
        start = stop


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Components of ``root`` after the edges (a, b); each has its least member as root."""
    while len(a := root[a]) and (differ := a != (b := root[b])).any():
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _columns(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For cells (x, y, z) in lexicographic order: the ranges of cells at most two away, for one (x, y) column after another."""
    wide = int(cell.max(initial=0)) + 5
    xs, x = np.unique(cell[:, 0], return_inverse=True)
    flat = x * wide + cell[:, 1]
    columns, column = np.unique(flat, return_inverse=True)
    deep = column * wide + cell[:, 2]

    def rank(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        return at, values[at] == wanted

    for dx in range(-2, 3):
        at_x, has_x = rank(xs, cell[:, 0] + dx)
        for dy in range(-2, 3):
            at, has = rank(columns, at_x * wide + cell[:, 1] + dy)
            low = at * wide + cell[:, 2]
            lo, hi = np.searchsorted(deep, low - 2), np.searchsorted(deep, low + 2, "right")
            yield lo, np.where(has_x & has, hi, lo)


def _any_near(a: np.ndarray, b: np.ndarray, lat: np.ndarray, lon: np.ndarray, xyz: np.ndarray, eps_rad: float, chord: float) -> bool:
    """Whether a place of ``a`` is near one of ``b``: both are halved as long as their boxes are near."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        va, vb = xyz[a], xyz[b]
        (la, ha), (lb, hb) = (va.min(axis=0), va.max(axis=0)), (vb.min(axis=0), vb.max(axis=0))
        if np.sqrt((np.maximum(np.maximum(lb - ha, la - hb), 0) ** 2).sum()) > chord * (1 + 1e-4):
            continue
        few = len(a) * len(b) <= 4096
        i, j = (a[:, None], b[None]) if few else (a[:1], b[:1])
        if (_haversine_rad(lat[i], lon[i], lat[j], lon[j]) <= eps_rad).any():
            return True
        if few:
            continue
        swap = len(b) > 1 and (len(a) == 1 or (hb - lb).max() > (ha - la).max())
        cut, other, v, extent = (b, a, vb, hb - lb) if swap else (a, b, va, ha - la)
        order = np.argpartition(v[:, extent.argmax()], len(cut) // 2)
        todo += [(other, cut[h]) if swap else (cut[h], other) for h in (order[: len(cut) // 2], order[len(cut) // 2 :])]
    return False


def place_labels(lat: np.ndarray, lon: np.ndarray, times: np.ndarray, eps_rad: float, least: int) -> np.ndarray:
    """DBSCAN on the sphere of distinct places, each with so many points; -1 is noise.

    Clusters are numbered by their first core place, and a border place is of its
    first cluster. Places (in degrees, ``eps_rad`` in radians) that are not finite
    are noise. The same labels as by all pairs, in about linear time however dense
    the places are: they lie in cubes whose places are all near each other, so the
    places of a cube with ``least`` points are core without a comparison, the few
    of any other cube meet the cubes around, and of two cubes it is only asked
    whether any of their core places are near.
    """
    if eps_rad < 1e-11:
        raise ValueError("eps_rad is less than coordinates tell apart")
    label = np.full(len(lat), -1)
    finite = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
    if not len(finite):
        return label
    lat, lon = np.radians(lat[finite]), np.radians(lon[finite])
    xyz = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    chord = 2 * math.sin(min(eps_rad, math.pi) / 2)
    # The margin is for rounding: places of a cube are near, and no near place is more than two cubes away.
    cube = np.floor((xyz + 2) / (chord / math.sqrt(3) * (1 - 1e-4))).astype(np.int64)
    cube -= cube.min(axis=0) - 2
    order = np.lexsort(cube.T[::-1])
    finite, lat, lon, xyz, cube, times = finite[order], lat[order], lon[order], xyz[order], cube[order], times[finite][order]
    fresh = np.concatenate([[True], (cube[1:] != cube[:-1]).any(axis=1)])
    of, start = np.cumsum(fresh) - 1, np.append(np.flatnonzero(fresh), len(lat))
    around = list(_columns(cube[start[:-1]]))

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _haversine_rad(lat[i], lon[i], lat[j], lon[j]) <= eps_rad

    core = (np.add.reduceat(times, start[:-1]) >= least)[of]
    light = np.flatnonzero(~core)
    points = np.zeros(len(light), dtype=np.int64)
    for lo, hi in around:
        for row, j in _pairs(start[lo[of[light]]], start[hi[of[light]]]):
            ok = near(light[row], j)
            np.add.at(points, row[ok], times[j[ok]])
    core[light] = points >= least

    cores = np.flatnonzero(core)
    bounds = np.searchsorted(cores, start)  # a cube's core places are a range of cores
    size, root = np.diff(bounds), np.arange(len(start) - 1)
    many = []
    for lo, hi in around:
        for a, b in _pairs(np.where(size > 0, lo, 0), np.where(size > 0, hi, 0)):
            keep = (a < b) & (size[b] > 0)
            a, b = a[keep], b[keep]
            _merge(root, *(x[near(cores[bounds[a]], cores[bounds[b]])] for x in (a, b)))
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            big = size[a] * size[b] > 256
            many.append(np.column_stack([a[big], b[big]]))
            a, b = a[~big], b[~big]
            for edge, i in _pairs(bounds[a], bounds[a + 1], 1 << 16):
                for row, j in _pairs(bounds[b[edge]], bounds[b[edge] + 1]):
                    ok = edge[row[near(cores[i[row]], cores[j])]]
                    _merge(root, a[ok], b[ok])

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = int(root[root[x]])
        return x

    for a, b in np.concatenate(many).tolist():
        if top(a) != top(b) and _any_near(cores[bounds[a] : bounds[a + 1]], cores[bounds[b] : bounds[b + 1]], lat, lon, xyz, eps_rad, chord):
            root[max(top(a), top(b))] = min(top(a), top(b))
    while (root[root] != root).any():
        root = root[root]

    cluster = np.full(len(lat), len(lat))
    first = np.full(len(start) - 1, len(label))
    np.minimum.at(first, root[of[cores]], finite[cores])
    numbers = np.empty(len(first), dtype=np.int64)
    numbers[np.argsort(first, kind="stable")] = np.arange(len(first))
    cluster[cores] = numbers[root[of[cores]]]
    edge = np.flatnonzero(~core)
    for lo, hi in around:
        for row, j in _pairs(start[lo[of[edge]]], start[hi[of[edge]]]):
            ok = core[j] & near(edge[row], j)
            np.minimum.at(cluster, edge[row[ok]], cluster[j[ok]])
    label[finite] = np.where(cluster < len(lat), cluster, -1)
    return label


def haversine_labels(lat: np.ndarray, lon: np.ndarray, eps_rad: float, least: int) -> np.ndarray:
    """DBSCAN on the sphere (coordinates in degrees, ``eps_rad`` in radians): points of one place have one label."""
    _, first, back, times = np.unique(np.column_stack([lat, lon]), axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    label = np.empty(len(first), dtype=int)
    label[order] = place_labels(lat[first[order]], lon[first[order]], times[order], eps_rad, least)
    return label[back.reshape(-1)]


def haversine_matrix(pings: DataFrame, keys: tuple[str, ...] = ("day", "deviceid")) -> DataFrame:
    """``keys, a, b, metres``: distances of all pairs of a group's pings, each pair in both orders and with itself.

    The matrix is what is asked for, so it has the square of a group's rows; ask
    for few devices.
    """
    p = pings.select(*keys, F.col("ping_id").alias("a"), F.col("lat").alias("_y"), F.col("lon").alias("_x"))
    q = pings.select(*keys, F.col("ping_id").alias("b"), F.col("lat").alias("_v"), F.col("lon").alias("_u"))
    return p.join(q, list(keys)).select(*keys, "a", "b", geo.haversine_m(F.col("_y"), F.col("_x"), F.col("_v"), F.col("_u")).alias("metres"))


def dbscan(pings: DataFrame, eps_rad: float = 0.001, least: int = 5, keys: tuple[str, ...] = ("day", "deviceid")) -> DataFrame:
    """Adds ``cluster``: DBSCAN of each group's coordinates; -1 is noise (as are pings without coordinates).

    Pings at one place have one label, so a group's task holds its distinct places
    with their numbers of pings, and the pings meet the labels by a join.
    """
    place = ["lat", "lon"]
    somewhere = pings.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    places = somewhere.groupBy(*keys, *place).agg(F.count(F.lit(1)).alias("_n"), F.min("ping_id").alias("_first"))
    names = {c: f"_{i}" for i, c in enumerate([*keys, *place])}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_first", *place])
        label = place_labels(group["lat"].to_numpy(), group["lon"].to_numpy(), group["_n"].to_numpy(), eps_rad, least)
        return group[list(names)].rename(columns=names).assign(_cluster=label.astype("int32"))

    kinds = dict(places.dtypes)
    schema = ", ".join(f"`{n}` {kinds[c]}" for c, n in names.items()) + ", `_cluster` int"
    found = places.groupBy(*keys).applyInPandas(run, schema)
    same = [F.col(c).eqNullSafe(F.col(names[c])) if c in keys else F.col(c) == F.col(names[c]) for c in names]
    return pings.join(found, same, "left").select(*pings.columns, F.coalesce("_cluster", F.lit(-1)).alias("cluster"))


def dbscan_core(pings: DataFrame, eps_rad: float = 0.001, least: int = 5, keys: tuple[str, ...] = ("day", "deviceid")) -> DataFrame:
    """``ping_id, neighbours, is_core``: the exact part of DBSCAN as a join on grid cells within a group."""
    step = math.degrees(eps_rad)
    # Near a pole a distance spans more degrees of longitude, hence more cells (the date line is an edge).
    wide = step / F.cos(F.radians(F.least(F.abs("lat") + step, F.lit(89.0))))
    across = F.sequence(F.floor((F.col("lon") - wide) / step), F.floor((F.col("lon") + wide) / step))
    p = pings.select(*keys, "ping_id", "lat", "lon", F.floor(F.col("lat") / step).alias("_y"), F.floor(F.col("lon") / step).alias("_x"))
    q = p.select(*keys, F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon"), F.explode(F.array(F.col("_y") - 1, F.col("_y"), F.col("_y") + 1)).alias("_y"), across.alias("_x"))
    q = q.withColumn("_x", F.explode("_x"))
    close = geo.haversine_arcsin_m(F.col("lat"), F.col("lon"), F.col("_qlat"), F.col("_qlon")) <= eps_rad * geo.EARTH_RADIUS_M
    pairs = p.join(q, [*keys, "_y", "_x"]).where(close)
    return pairs.groupBy("ping_id").agg(F.count(F.lit(1)).alias("neighbours")).withColumn("is_core", F.col("neighbours") >= least)


def st_dbscan_core(pings: DataFrame, eps: float = 500.0, per_second: float = 1000.0, least: int = 5, keys: tuple[str, ...] = ("day",)) -> DataFrame:
    """``ping_id, neighbours, is_core`` under sqrt(metres^2 + (per_second * seconds)^2) <= eps.

    Times that could be near are few (``eps / per_second`` seconds), so the join
    is by equality on the second, each ping entered under every one of them.
    """
    reach = int(eps // per_second)
    p = pings.select(*keys, "ping_id", "lat", "lon", epoch_s(F.col("datetime")).alias("_t"))
    q = p.select(*keys, F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon"), F.col("_t").alias("_qt"), F.explode(F.sequence(F.col("_t") - reach, F.col("_t") + reach)).alias("_s"))
    metres = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_qlat"), F.col("_qlon"))
    away = F.sqrt(metres * metres + F.pow(per_second * (F.col("_t") - F.col("_qt")), 2))
    same = [p[k] == q[k] for k in keys]
    pairs = p.join(q.withColumnRenamed("_s", "_t"), [*keys, "_t"]) if reach == 0 else p.join(q, [*same, p["_t"] == q["_s"]])
    return pairs.where(away <= eps).groupBy("ping_id").agg(F.count(F.lit(1)).alias("neighbours")).withColumn("is_core", F.col("neighbours") >= least)


def st_dbscan(pings: DataFrame, eps: float = 500.0, per_second: float = 1000.0, least: int = 5, keys: tuple[str, ...] = ("day", "deviceid")) -> DataFrame:
    """Adds ``cluster``: DBSCAN under the space-time distance, for each group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ping_id")
        lat, lon = np.radians(group["lat"].to_numpy()), np.radians(group["lon"].to_numpy())
        t = group["datetime"].astype("datetime64[s]").astype("int64").to_numpy()
        keys_ = np.floor(t / max(eps / per_second, 1e-9)).astype(int)[:, None]
        cells = _cells(keys_)

        def near(i: int) -> np.ndarray:
            c = _around(cells, tuple(keys_[i]))
            metres = geo.EARTH_RADIUS_M * _haversine_rad(lat[i], lon[i], lat[c], lon[c])
            return c[np.hypot(metres, per_second * (t[c] - t[i])) <= eps]

        return group.assign(cluster=_labels(len(t), near, least).astype("int32"))

    schema = ", ".join(f"`{n}` {t}" for n, t in pings.dtypes) + ", cluster int"
    return pings.groupBy(*keys).applyInPandas(run, schema)


def spectral_labels(affinity: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Clusters of a symmetric affinity: leading eigenvectors of the normalised affinity, discretised by rotation."""
    degree = affinity.sum(axis=1)
    scale = 1 / np.sqrt(np.where(degree > 0, degree, 1.0))
    vectors = np.linalg.eigh(scale[:, None] * affinity * scale[None])[1][:, -k:]
    rows = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    turn = np.zeros((k, k))
    turn[:, 0] = rows[rng.integers(len(rows))]
    cost = np.zeros(len(rows))
    for j in range(1, k):  # start from rows that are as orthogonal as can be
        cost += np.abs(rows @ turn[:, j - 1])
        turn[:, j] = rows[cost.argmin()]
    last = -1.0
    for _ in range(50):
        label = (rows @ turn).argmax(axis=1)
        u, s, vt = np.linalg.svd(np.eye(k)[label].T @ rows)
        if abs(s.sum() - last) < 1e-10:
            break
        last, turn = s.sum(), (u @ vt).T
    return label


def zone_clusters(od_log: DataFrame, k: int = 10, seed: int = 42, most_zones: int = 3_000) -> DataFrame:
    """``zone_id, cluster`` by spectral clustering of log flows, both directions added.

    The zones' matrix is reference-sized; the limit is what its dense copies and
    the eigenvectors (about 300 MB at 3000 zones) leave a driver to live with, and
    it is checked before anything is collected.
    """
    zones = od_log.select(F.col("from_zone").alias("zone_id")).distinct().orderBy("zone_id")
    if (n := zones.count()) > most_zones:
        raise ValueError(f"{n} zones are more than {most_zones}")
    ids = [r[0] for r in zones.collect()]
    at = {z: i for i, z in enumerate(ids)}
    log = np.zeros((n, n))
    for a, b, v in od_log.where("n > 0").select("from_zone", "to_zone", "log_n").collect():
        log[at[a], at[b]] = v
    label = spectral_labels(log + log.T, min(k, n), seed)
    return od_log.sparkSession.createDataFrame([(int(z), int(c)) for z, c in zip(ids, label)], "zone_id int, cluster int")


def gmm_by_zone(values: DataFrame, columns: tuple[str, ...] = ("lat", "lon"), k: int = 2, rounds: int = 60, seed: int = 42) -> DataFrame:
    """``zone_id, component, weight, mean_*``: a Gaussian mixture for each zone, by expectation maximisation.

    Full covariances; a zone with fewer rows than components gets one of each row.
    """
    d = len(columns)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(group[list(columns)].to_numpy(dtype=float), axis=0, return_counts=True)
        points, times = x[0], x[1].astype(float)
        m = min(k, len(points))
        rng = np.random.default_rng(seed)
        mean = points[rng.choice(len(points), m, replace=False, p=times / times.sum())]
        spread = np.cov(points.T, fweights=x[1]).reshape(d, d) if times.sum() > 1 else np.eye(d)
        cov, weight = np.array([spread + 1e-9 * np.eye(d)] * m), np.full(m, 1 / m)
        for _ in range(rounds):
            log = np.empty((len(points), m))
            for j in range(m):
                diff = points - mean[j]
                log[:, j] = np.log(weight[j] + 1e-300) - 0.5 * (np.linalg.slogdet(cov[j])[1] + (diff @ np.linalg.inv(cov[j]) * diff).sum(axis=1))
            share = np.exp(log - log.max(axis=1, keepdims=True))
            share *= (times / share.sum(axis=1))[:, None]
            total = share.sum(axis=0) + 1e-12
            weight, mean = total / times.sum(), share.T @ points / total[:, None]
            for j in range(m):
                diff = points - mean[j]
                cov[j] = (share[:, j, None] * diff).T @ diff / total[j] + 1e-9 * np.eye(d)
        order = np.lexsort(mean.T[::-1])
        return pd.DataFrame({"zone_id": group["zone_id"].iloc[0], "component": range(m), "weight": weight[order], **{f"mean_{c}": mean[order, i] for i, c in enumerate(columns)}})

    schema = "zone_id int, component int, weight double, " + ", ".join(f"mean_{c} double" for c in columns)
    return values.select("zone_id", *columns).groupBy("zone_id").applyInPandas(fit, schema)
