"""Nearest places on the globe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import ship
from .held import parts

#: Sites that tasks hold together, bytes of them; sites of a block, at most; cosines that are computed at once; kilometres of the globe's radius.
SITE_BYTES, BLOCK, CELLS, RADIUS = 1 << 25, 128, 1 << 21, 6371.0


def unit(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def haversine(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


class Sites:
    """Places in blocks of neighbours, each within a ball: a point is compared with blocks that can hold its nearest place alone."""

    def __init__(self, ids: np.ndarray, lat: np.ndarray, lng: np.ndarray):
        x, whole, self.blocks = unit(lat, lng), [np.arange(len(ids))], []
        most = max(BLOCK, int(np.sqrt(len(ids))))
        while whole:
            own = whole.pop()
            if len(own) > most:
                wide = x[own][:, np.argmax(np.ptp(x[own], axis=0))]
                own = own[np.argpartition(wide, len(own) // 2)]
                whole += [own[: len(own) // 2], own[len(own) // 2 :]]
            else:
                own = own[np.argsort(ids[own])]
                self.blocks.append((ids[own], lat[own], lng[own], x[own]))
        self.centres = np.stack([b[3].mean(0) for b in self.blocks])
        self.radii = np.array([np.sqrt(((b[3] - c) ** 2).sum(1).max()) for b, c in zip(self.blocks, self.centres)])
        self.compared = 0

    def nearest(self, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest site of each point and its kilometres; of equally near ones the smallest."""
        best, km = np.zeros(len(lat), np.int64), np.full(len(lat), np.inf)
        step = max(1, CELLS // max(len(self.blocks), max(len(b[0]) for b in self.blocks)))
        for i in range(0, len(lat), step):
            self._nearest(lat[i : i + step], lng[i : i + step], best[i : i + step], km[i : i + step])
        return best, km

    def _nearest(self, lat: np.ndarray, lng: np.ndarray, best: np.ndarray, km: np.ndarray) -> None:
        p, top = unit(lat, lng), np.full(len(lat), -2.0)

        def offer(j: int, rows: np.ndarray) -> None:
            ids, lat2, lng2, x = self.blocks[j]
            self.compared += len(rows) * len(ids)
            cos = p[rows] @ x.T
            top[rows] = np.maximum(top[rows], cos.max(1))
            r, c = np.nonzero(cos >= top[rows][:, None] - 1e-9)
            far = haversine(lat[rows[r]], lng[rows[r]], lat2[c], lng2[c])
            order = np.lexsort((c, far, r))
            first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
            to, far, site = rows[r[first]], far[first], ids[c[first]]
            better = (far < km[to]) | (far == km[to]) & (site < best[to])
            best[to[better]], km[to[better]] = site[better], far[better]

        away = np.sqrt(np.maximum(1 + (self.centres**2).sum(1) - 2 * p @ self.centres.T, 0))
        own = away.argmin(1)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            offer(own[order[a]], order[a:b])
        reach = np.sqrt(2 - 2 * top + 4e-9) + 1e-7
        can = away - self.radii <= reach[:, None]
        can[np.arange(len(p)), own] = False
        for j in np.flatnonzero(can.any(0)):
            offer(j, np.flatnonzero(can[:, j]))


def nearest_site(points: DataFrame, key: str, sites: DataFrame) -> DataFrame:
    """``key, site, km``: the site (``site, lat, lng``) nearest to each point (``key, lat, lng``), of equally near ones the smallest.

    Points are read once and not moved: tasks hold SITE_BYTES of sites at a time, one of each place, in blocks of neighbours,
    and measure the few of the blocks in reach that are about as near. Of several parts of sites the
    nearest counts. Points and sites without a place are left out; without sites there is no row. Keys are unique.
    """
    ship(points.sparkSession)
    kind = points.schema[key].dataType.simpleString()
    there = "lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)"
    place = [F.col(c).cast("double").alias(c) for c in ("lat", "lng")]
    asked = points.select(key, *place).where(there)
    known = sites.where("site IS NOT NULL").select(F.col("site").cast("long").alias("site"), *place).where(there).groupBy("lat", "lng").agg(F.min("site").alias("site"))

    def search(held: list[Row]) -> DataFrame:
        near = Sites(np.array([r["site"] for r in held], np.int64), np.array([r["lat"] for r in held]), np.array([r["lng"] for r in held]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                best, km = near.nearest(*(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(km)], [key, "site", "km"])

        return asked.mapInArrow(run, f"{key} {kind}, site long, km double")

    found = [search(held) for held in parts(known, F.lit(64), SITE_BYTES)]
    if not found:
        return points.sparkSession.createDataFrame([], f"{key} {kind}, site long, km double")
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy(key).agg(F.min(F.struct("km", "site")).alias("b"))
    return best.select(key, "b.site", "b.km")
