"""Most similar vectors for every vector, by shifted Hilbert orderings.

Each curve projects the vectors on a few random orthogonal directions, shifts the grid at random
and orders them by their place on a Hilbert curve. Spark range-partitions every ordering by sampled splits, one task per
range; there each tile of the ordering is compared with itself and its two neighbours, and the best of all curves are merged.
How many curves are needed depends on the vectors and grows with their number, so it is measured: a sample of probes gets its true
neighbours by a pass over all vectors, and from their distances along the curves follows the recall of any number of curves.
Spread-out vectors have no such order that keeps their neighbours together; these are compared in full by :func:`nearest`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import written

#: Ranges are cut into so many buckets; the first of the next range is compared here too.
FINE = 8
#: Sampled keys per bucket that place the splits (at least ``LEAST_SAMPLE`` in all); every vector is indexed.
KEYS_PER_BUCKET, LEAST_SAMPLE = 4, 10_000
#: Vectors whose true neighbours are looked up to measure recall, and the keys of each curve that its distances are read from.
PROBES, PROBE_KEYS = 512, 20_000
#: Numbers of curves to choose from.
CURVES = (4, 6, 8, 12, 16, 24)
TIE_BITS = 12


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points ``grid`` (rows of coordinates below 2**bits)."""
    x = [grid[:, i].astype(np.uint32) for i in range(grid.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p, bit = np.uint32(q - 1), np.uint32(q)
        for i in range(n):
            up = (x[i] & bit) != 0
            swap = np.where(up, np.uint32(0), (x[0] ^ x[i]) & p)
            x[i] = x[i] ^ swap
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    gray = np.zeros(len(grid), np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        gray = np.where((x[-1] & np.uint32(q)) != 0, gray ^ np.uint32(q - 1), gray)
        q >>= 1
    key = np.zeros(len(grid), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ gray) >> np.uint32(b)) & np.uint32(1))
    return key


def _curve_keys(unit: np.ndarray, tie: np.ndarray, curve: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Keys of unit vectors on one shifted curve; ``tie`` spreads vectors that share a cell."""
    rng = np.random.default_rng([seed, curve])
    turn = np.linalg.qr(rng.standard_normal((unit.shape[1],) * 2))[0][:, :dims]
    # Coordinates of unit vectors on random directions spread by 1/sqrt(dim); four of these spans hold nearly all.
    span = 8 / np.sqrt(unit.shape[1])
    place = np.clip(unit @ turn / span + 0.5, 0, 1 - 1e-9) / 2 + rng.random(dims) / 2
    return (hilbert_keys((place * (1 << bits)).astype(np.int64), bits) << TIE_BITS) | (tie & ((1 << TIE_BITS) - 1))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, each ``dim`` long; null values become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable (finite, not all zero), and these at unit length."""
    largest = np.abs(rows).max(axis=1, initial=0)
    usable = np.isfinite(largest) & (largest > 0)
    kept = rows[usable] / largest[usable, None]
    return usable, kept / np.sqrt((kept * kept).sum(axis=1))[:, None]


def _neighbours(ids: np.ndarray, unit: np.ndarray, k: int, min_sim: float | None, window: int) -> pa.Table:
    """For each row of an ordering, the best ``k`` rows within its tile and the two beside it."""
    n = len(ids)
    small = unit.astype(np.float32)
    rows, cols = [], []
    for lo in range(0, n, window):
        hi, left, right = min(lo + window, n), max(0, lo - window), min(lo + 2 * window, n)
        sims = small[lo:hi] @ small[left:right].T
        sims[np.arange(hi - lo), np.arange(lo - left, hi - left)] = -9
        if min_sim is not None:
            r, c = np.nonzero(sims >= min_sim - 1e-4)
        else:
            take = min(k, sims.shape[1])
            c = np.argpartition(-sims, take - 1, axis=1)[:, :take].ravel()
            r = np.repeat(np.arange(hi - lo), take)
        rows.append(r + lo)
        cols.append(c + left)
    r, c = np.concatenate(rows or [np.empty(0, int)]), np.concatenate(cols or [np.empty(0, int)])
    sim = np.einsum("ij,ij->i", unit[r], unit[c]) if len(r) else np.empty(0)
    keep = (r != c) & (sim >= (-2 if min_sim is None else min_sim - 1e-12))
    r, c, sim = r[keep], c[keep], sim[keep]
    if min_sim is not None and len(r):
        order = np.lexsort((-sim, r))
        r, c, sim = r[order], c[order], sim[order]
        first = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        r, c, sim = r[rank < k], c[rank < k], sim[rank < k]
    return pa.table({"a": ids[r], "b": ids[c], "sim": sim})


def _all_pairs(ids: np.ndarray, unit: np.ndarray, k: int, min_sim: float | None) -> pa.Table:
    """For each row the best ``k`` of all, of equal ones the smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, unit = ids[order], unit[order]
    r, c, sim = _closest(unit, unit, k, True)
    keep = sim >= (-2 if min_sim is None else min_sim - 1e-12)
    return pa.table({"a": ids[r[keep]], "b": ids[c[keep]], "sim": sim[keep]})


def most_similar(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    *,
    dim: int = 64,
    k: int = 5,
    min_sim: float | None = None,
    recall: float = 0.99,
    curves: int | None = None,
    window: int = 2048,
    proj_dims: int = 10,
    bits: int = 5,
    part_rows: int = 16_384,
    seed: int = 7,
) -> DataFrame:
    """``(id, neighbour, sim, rank)``: the ``k`` most cosine-similar other ids of every id.

    The fewest of ``CURVES`` whose measured recall is at least ``recall`` are used (see :func:`fewest_curves`), or ``curves`` if given. If none
    reaches it, as with spread-out vectors, all vectors are compared by :func:`nearest`, which is exact and quadratic. Up to ``part_rows`` different
    vectors are one range, compared in full.

    With ``min_sim`` only neighbours at least so similar come out; an id without any then has no row.
    Rows with a null id, a null vector, one of another length, with null, NaN or infinite values or all
    zero take no part. Ids come out as strings. Repeated rows of an id count once. Equal vectors
    form one class that is searched once and expanded afterwards to its ``k`` smallest ids, so copies that hold a large
    share of the rows neither skew a partition nor push apart what lies on either side of them. Ties
    go to the smaller id (string order). An empty table gives no rows. Other columns are ignored.
    """
    keyed, classes = _classes(df, id_col, vec_col, dim)
    n = classes.count()
    parts = max(1, -(-n // part_rows))
    if parts == 1:
        near = _along_curves(classes, 1, 1, dim, k, min_sim, max(n, 1), min(proj_dims, dim), bits, seed)
        return _with_copies(near, keyed, classes, k)
    if curves is None:
        curves, _ = fewest_curves(classes, n, recall, dim=dim, k=k, min_sim=min_sim, window=window, proj_dims=min(proj_dims, dim), bits=bits, seed=seed)
    if curves is None:
        return _with_copies(_in_blocks(classes, n, dim, k, min_sim), keyed, classes, k)
    near = _along_curves(classes, parts, curves, dim, k, min_sim, window, min(proj_dims, dim), bits, seed)
    return _with_copies(near, keyed, classes, k)


def fewest_curves(classes: DataFrame, n: int, recall: float, *, dim: int, k: int, min_sim: float | None, window: int, proj_dims: int, bits: int, seed: int, probes: int = PROBES) -> tuple[int | None, dict[int, float]]:
    """The fewest of ``CURVES`` that find the share ``recall`` of the true neighbours, if any, and the shares measured up to it.

    About ``probes`` vectors of ``classes`` (``h1, rep, vec``) are compared with all of them, in Spark; a neighbour counts as found by a curve if it lies within ``window`` vectors
    of the probe on it, by the ranks of at most about ``PROBE_KEYS`` sampled keys. Probes, their neighbours and these keys reach the driver; their
    number doesn't depend on ``n``. Where the sample is too coarse for the window, a neighbour counts only if no sampled key lies between.
    """
    chosen = classes.filter(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < int(probes / n * (1 << 30)) + 1).select("rep", "vec").limit(4 * probes).toArrow()
    if not chosen.num_rows:
        return CURVES[0], {}
    usable, asked = _unit(_matrix(chosen["vec"], dim))
    names = np.array(chosen["rep"].to_pylist(), object)[usable]

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, unit = _unit(_matrix(batch.column("vec"), dim))
            ids = np.array(batch.column("rep").to_pylist(), object)[ok]
            if not len(ids):
                continue
            sims = asked @ unit.T
            sims[names[:, None] == ids[None, :]] = -9
            take = min(k, sims.shape[1])
            c = np.argpartition(-sims, take - 1, axis=1)[:, :take].ravel()
            r = np.repeat(np.arange(len(asked)), take)
            keep = sims[r, c] >= (-2 if min_sim is None else min_sim)
            r, c = r[keep], c[keep]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(ids[c], pa.string()), pa.array(sims[r, c]), _packed(unit[c].astype(np.float32))], names=["probe", "rep", "sim", "vec"])

    best = W.partitionBy("probe").orderBy(F.desc("sim"), "rep")
    met = classes.select("rep", "vec").mapInArrow(closest, "probe int, rep string, sim double, vec binary")
    met = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("probe", "vec").toArrow()
    if not met.num_rows:
        return CURVES[0], {}
    one, other = asked[met["probe"].to_numpy()], np.frombuffer(b"".join(met["vec"].to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
    missed, reached = np.ones(len(one), bool), {}
    none = np.zeros(len(one), np.int64)
    for first, last in zip((0, *CURVES), CURVES):
        for c, keys in _sampled_keys(classes, n, PROBE_KEYS, range(first, last), dim, proj_dims, bits, seed).items():
            places = [np.searchsorted(keys, _curve_keys(side, none, c, proj_dims, bits, seed)) for side in (one, other)]
            missed &= np.abs(places[0] - places[1]) * (n / max(len(keys), 1)) > window
        reached[last] = 1 - float(missed.mean())
        if reached[last] >= recall:
            return last, reached
    return None, reached


def _sampled_keys(classes: DataFrame, n: int, size: int, curves: range, dim: int, proj_dims: int, bits: int, seed: int) -> dict[int, np.ndarray]:
    """Sorted keys of about ``size`` vectors on each curve."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, unit = _unit(_matrix(batch.column("vec"), dim))
            tie = batch.column("h1").to_numpy()[usable]
            for c in curves:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), c, np.int32)), pa.array(_curve_keys(unit, tie, c, proj_dims, bits, seed))], names=["curve", "key"])

    sampled = classes.filter(F.pmod(F.xxhash64("rep", F.lit(seed + 1)), F.lit(1 << 30)) < min(1 << 30, int(size / n * (1 << 30)) + 1)).select("h1", "vec")
    keys = sampled.mapInArrow(place, "curve int, key long").toArrow()
    curve_of, key_of = keys["curve"].to_numpy(), keys["key"].to_numpy()
    return {c: np.sort(key_of[curve_of == c]) for c in curves}


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _along_curves(classes: DataFrame, parts: int, curves: int, dim: int, k: int, min_sim: float | None, window: int, proj_dims: int, bits: int, seed: int) -> DataFrame:
    """``(a, b, sim)``: for each vector the best that lie near it on some curve. Every range of every curve is a task of its own."""
    splits: list[np.ndarray] = [np.empty(0, np.int64)] * curves
    if parts > 1:
        steps = np.arange(1, parts * FINE) / (parts * FINE)
        keys = _sampled_keys(classes, classes.count(), max(LEAST_SAMPLE, KEYS_PER_BUCKET * parts * FINE), range(curves), dim, proj_dims, bits, seed)
        splits = [np.quantile(own, steps, method="nearest") if len(own) else own for own in keys.values()]
    # Eight splits per range and curve: broadcast once to each executor, not sent with every task.
    shared = classes.sparkSession.sparkContext.broadcast(splits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, unit = _unit(rows := _matrix(batch.column("vec"), dim))
            tie = batch.column("h1").to_numpy()[usable]
            ids = batch.column("rep").filter(pa.array(usable))
            vecs = _packed(rows[usable].astype(np.float32))
            for c in range(curves):
                at = _curve_keys(unit, tie, c, proj_dims, bits, seed)
                fine = np.searchsorted(shared.value[c], at, side="right")
                part = fine // FINE
                halo = np.flatnonzero((fine % FINE == 0) & (part > 0))
                take = np.r_[np.arange(len(at)), halo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.r_[part, part[halo] - 1] + c * parts).astype(np.int32)), pa.array(at[take]), ids.take(pa.array(take)), vecs.take(pa.array(take))],
                    names=["range", "key", "rep", "vec"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        group = pa.Table.from_batches(held)
        group = group.take(pa.array(np.lexsort((group["rep"].to_numpy(zero_copy_only=False), group["key"].to_numpy()))))
        rows = np.frombuffer(b"".join(group["vec"].to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
        ids, unit = group["rep"].to_numpy(zero_copy_only=False), _unit(rows)[1]
        found = _neighbours(ids, unit, k, min_sim, window) if len(ids) > window else _all_pairs(ids, unit, k, min_sim)
        yield from found.cast(pa.schema([("a", pa.string()), ("b", pa.string()), ("sim", pa.float64())])).to_batches()

    coded = classes.select("h1", "rep", "vec").mapInArrow(encode, "range int, key long, rep string, vec binary")
    return coded.repartitionById(curves * parts, F.col("range")).select("key", "rep", "vec").mapInArrow(compare, "a string, b string, sim double")


def nearest(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", *, dim: int = 64, k: int = 5, min_sim: float | None = None, block_rows: int = 32_768) -> DataFrame:
    """As :func:`most_similar`, but exact: every vector is compared with every other.

    Vectors are hashed into blocks and each pair of blocks is one group, so memory is bounded by two blocks; work is quadratic in the
    number of different vectors, and each is shuffled once per block.
    """
    keyed, classes = _classes(df, id_col, vec_col, dim)
    return _with_copies(_in_blocks(classes, classes.count(), dim, k, min_sim, block_rows), keyed, classes, k)


def _in_blocks(classes: DataFrame, n: int, dim: int, k: int, min_sim: float | None, block_rows: int = 32_768) -> DataFrame:
    """``(a, b, sim)``: for each vector the best of all."""
    # Small tables are cut finer, so that there are groups for all cores.
    blocks = max(1, -(-n // block_rows), min(8, n // 2048))
    block, other = F.col("block"), F.col("other")
    rows = classes.select(F.pmod("h1", F.lit(blocks)).cast("int").alias("block"), "rep", "vec").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least(block, other).alias("x"), F.greatest(block, other).alias("y"), "block", "rep", "vec")

    def compare(group: pa.Table) -> pa.Table:
        # By id, so that of equal similarities the smaller id comes first.
        group = group.take(pa.array(np.argsort(group["rep"].to_numpy(zero_copy_only=False), kind="stable")))
        ids, at, unit = group["rep"].to_numpy(zero_copy_only=False), group["block"].to_numpy(), _unit(_matrix(group["vec"], dim))[1]
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        found = []
        for one, two in {(x, y), (y, x)}:
            own, beside = np.flatnonzero(at == one), np.flatnonzero(at == two)
            r, c, sim = _closest(unit[own], unit[beside], k, x == y)
            keep = sim >= (-2 if min_sim is None else min_sim - 1e-12)
            r, c, sim = r[keep], c[keep], sim[keep]
            found.append(pa.table({"a": pa.array(ids[own][r], pa.string()), "b": pa.array(ids[beside][c], pa.string()), "sim": pa.array(sim, pa.float64())}))
        return pa.concat_tables(found)

    return rows.groupBy("x", "y").applyInArrow(compare, "a string, b string, sim double")


def _closest(own: np.ndarray, other: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities of the ``k`` best of ``other`` for each of ``own``, the first of equal ones; if ``same``, none is its own."""
    small, across = own.astype(np.float32), other.astype(np.float32)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for lo in range(0, len(own), 512):
        hi = min(lo + 512, len(own))
        bound = np.full(hi - lo, -9.0)
        r, c, sim = found[0]
        for left in range(0, len(other), 4096):
            sims = small[lo:hi] @ across[left : left + 4096].T
            if same:
                own_at = np.arange(max(lo, left), min(hi, left + sims.shape[1]))
                sims[own_at - lo, own_at - left] = -9
            if left == 0 and sims.shape[1] > k:
                bound = np.partition(sims, -k, axis=1)[:, -k].astype(np.float64)
            # Single precision errs by less than this; the similarities of what is left are exact.
            more_r, more_c = np.nonzero((sims >= (bound - 1e-5).astype(np.float32)[:, None]) & (sims > -2))
            parts = [np.einsum("ij,ij->i", own[more_r[i : i + 65_536] + lo], other[more_c[i : i + 65_536] + left]) for i in range(0, len(more_r), 65_536)]
            r, c, sim = np.r_[r, more_r], np.r_[c, more_c + left], np.concatenate([sim, *parts])
            order = np.lexsort((c, -sim, r))
            r, c, sim = r[order], c[order], sim[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, sim, rank = r[rank < k], c[rank < k], sim[rank < k], rank[rank < k]
            bound[r[rank == k - 1]] = sim[rank == k - 1]
        found.append((r + lo, c, sim))
    return tuple(np.concatenate(x) for x in zip(*found))


def _classes(df: DataFrame, id_col: str, vec_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Usable rows with the hashes of their vector, and a row for each different vector, written, as several passes read it."""
    base = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") == dim) & _usable())
    keyed = base.select(F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"), "id", "vec")
    return keyed.drop("vec"), written(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("vec").alias("vec")))


def _usable() -> Column:
    return F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _with_copies(near: DataFrame, keyed: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs of classes as ``(id, neighbour, sim, rank)`` of all ids."""
    best = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    near = near.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")

    # Copies: the smallest k + 1 ids of each class with several, found first within salted parts of it.
    shared = classes.filter(F.col("rep") != F.col("last")).select("h1", "h2", "rep")
    members = keyed.join(shared, ["h1", "h2"]).select("rep", "id").distinct()
    salted = W.partitionBy("rep", F.pmod(F.hash("id"), F.lit(64))).orderBy("id")
    few = members.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k + 1)
    few = few.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))

    beside = near.join(few.select(F.col("rep").alias("b"), "ids"), "b", "left").select("a", "sim", F.explode(F.coalesce(F.slice("ids", 1, k), F.array("b"))).alias("neighbour"))
    beside = beside.join(members.select(F.col("rep").alias("a"), F.col("id").alias("own")), "a", "left").select(F.coalesce("own", "a").alias("id"), "neighbour", "sim")
    within = members.join(few, "rep").select("id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("sim")).filter(F.col("id") != F.col("neighbour"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("sim"), "neighbour")).alias("rank")
    found = beside.unionByName(within).groupBy("id", "neighbour").agg(F.max("sim").alias("sim"))
    return found.select("id", "neighbour", "sim", rank).filter(F.col("rank") <= k)


def similar_pairs(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", **options) -> DataFrame:
    """``(id_a, id_b)``: unordered pairs of which one is among the most similar of the other; see :func:`most_similar`."""
    near = most_similar(df, id_col, vec_col, **options)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()

