"""Indexing, subsetting, balanced sampling and sharding.

Nothing here uses ``rand()`` or a single-partition window over the rows: every choice is a
pure function of the row key and a seed, so results do not depend on how the
data is partitioned, and a re-run after a lost executor gives the same rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.sources.tables import written


# Largest per-key dimension (one row per group or field value) that is broadcast.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _row_bytes(df: DataFrame) -> tuple[F.Column | None, int]:
    """What a row takes: an expression for its strings, arrays and the like (None if it has
    none) and the bytes of its other columns."""
    parts, fixed = [], 0
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "varchar", "char", "binary"):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 16)
        elif kind in ("array", "map", "struct", "variant"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + 16)
        else:
            fixed += 16
    return (reduce(lambda x, y: x + y, parts).cast("long") if parts else None), fixed


def fits_broadcast(df: DataFrame, n: int | None = None) -> bool:
    """Whether a table takes at most ``MAX_BROADCAST_BYTES``: measured, unless its number of
    rows ``n`` is known and all its columns have a fixed width."""
    varying, fixed = _row_bytes(df)
    if varying is None and n is not None:
        return n * fixed <= MAX_BROADCAST_BYTES
    width = F.lit(fixed).cast("long") if varying is None else varying + fixed
    size = df.agg(F.sum(width).alias("b")).first()["b"]
    return (size or 0) <= MAX_BROADCAST_BYTES


def join_dimension(rows: DataFrame, dim: DataFrame, on, n_dim: int | None = None) -> DataFrame:
    """Join a per-key dimension back to the rows.

    The dimension has one row per key, so a key holding a third of the rows
    must not become one shuffle partition: it is broadcast when its bytes are within
    ``MAX_BROADCAST_BYTES``; beyond that a shuffle join is used and AQE's skew-join
    splitting takes over.
    """
    keys = [on] if isinstance(on, str) else list(on)
    own = dim.select(*[F.col(k).alias(f"_dim_{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    # NULL keys are a group of their own: they must find their row of the dimension
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(own[f"_dim_{k}"]) for k in keys])
    joined = rows.join(F.broadcast(own) if fits_broadcast(own, n_dim) else own, match)
    return joined.drop(*[f"_dim_{k}" for k in keys])


def _cols(order) -> list:
    order = [order] if isinstance(order, (str, F.Column)) else list(order)
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _offsets(spark, sizes) -> tuple[DataFrame | None, int]:
    """Per-range sizes (one row per range) -> a small (range, offset) frame and the total."""
    offsets, total = [], 0
    for b, n in sorted(sizes):
        offsets.append((int(b), total))
        total += n
    if not offsets:
        return None, 0
    return spark.createDataFrame(offsets, "_b int, _off long"), total


# Rows sampled per range to place the range bounds.
SAMPLE_PER_RANGE = 40


def _bounds(df: DataFrame, cols: list, n_ranges: int) -> list[tuple]:
    """Upper bounds (exclusive) of about equal ranges of the order tuple, from a sample.

    The sample is the rows with the smallest hashes of their order tuple, so it is the
    same on every run; only the order columns are read.
    """
    names = [f"_o{i}" for i in range(len(cols))]
    narrow = df.select(*[c.alias(n) for c, n in zip(cols, names)])
    some = narrow.orderBy(F.xxhash64(*names), *names).limit(SAMPLE_PER_RANGE * n_ranges).orderBy(*names).collect()
    picks = [tuple(some[i * len(some) // n_ranges]) for i in range(1, n_ranges)] if some else []
    return list(dict.fromkeys(picks))


def _range_number(df: DataFrame, cols: list, bounds: list[tuple]) -> F.Column:
    """Number of bounds that are not above the row's order tuple (NULL first, as in sorting).

    A binary search spelt out as nested conditions, so it is compiled with the scan: a row
    makes ``log2(n)`` comparisons, of plain values where one column gives the order.
    """
    types = [f.dataType for f in df.select(*cols).schema.fields]
    if len(cols) == 1:
        def reached(b):
            return F.lit(True) if b[0] is None else F.coalesce(cols[0] >= F.lit(b[0]).cast(types[0]), F.lit(False))
    else:
        row = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(cols)])

        def reached(b):
            return row >= F.struct(*[F.lit(v).cast(t).alias(f"_o{i}") for i, (v, t) in enumerate(zip(b, types))])

    def search(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(reached(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, len(bounds))


def with_index_and_count(df: DataFrame, order, out: str = "idx",
                         n_buckets: int | None = None) -> tuple[DataFrame, int]:
    """D6 plus the row count (the sum of the range sizes, known without another pass).

    One plan for every input, without a single-partition window over the rows, without
    writing them and without reading physical partition ids: bounds over the whole order
    tuple are placed once from a sample and become literals, so any re-run agrees and a
    hot leading value is split by the columns behind it; one pass over the order columns
    counts the ranges; ``row_number`` within each range plus the range's offset is the
    index. Only the last pass reads the other columns, and it shuffles once.

    ``order``: ascending columns (or expressions) that form a total order; NULL comes first.
    """
    spark = df.sparkSession
    cols = _cols(order)
    n_ranges = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = _range_number(df, cols, _bounds(df, cols, n_ranges))
    sizes = [(r["_b"], r["_n"]) for r in
             df.groupBy(number.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).collect()]
    off, total = _offsets(spark, sizes)
    if off is None:
        return df.withColumn(out, F.lit(None).cast("bigint")), 0
    w = Window.partitionBy("_b").orderBy(*cols)
    indexed = (df.withColumn("_b", number).join(F.broadcast(off), "_b")       # one row per range
                 .withColumn(out, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
                 .drop("_b", "_off"))
    return indexed, total


def with_index(df: DataFrame, order, out: str = "idx", n_buckets: int | None = None) -> DataFrame:
    """Dense 0-based row index in the order of ``order`` (which must be a total order).

    Never a single-partition window over the rows and never physical partition
    ids read twice: see ``with_index_and_count``.
    """
    return with_index_and_count(df, order, out, n_buckets)[0]


def batches(df: DataFrame, batch_size: int, order="item_id", out: str = "batch") -> DataFrame:
    """Batch number ``idx div batch_size`` in the stated order; the last batch is short."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return with_index(df, order).withColumn(out, F.expr(f"idx div {int(batch_size)}"))


def hash_key(key, seed: int) -> F.Column:
    """60-bit integer from the md5 of ``<key>:<seed>`` (same value in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    s = F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(f":{int(seed)}"))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def subset_size(n: int, frac: float) -> int:
    """Rows kept by a fraction: fraction clamped to [0, 1], round half to even."""
    f = min(max(float(frac), 0.0), 1.0)
    return int(round(n * f))


def subset_cuts(items: DataFrame, fracs: Sequence[float], seeds: Sequence[int], key: str = "item_id",
                split: str | None = "train") -> dict[tuple[int, int], tuple | None]:
    """Where the D2 subsets of all (fraction, seed) pairs end: the last kept pair
    ``(md5(key:seed), key)`` by (position of the fraction, position of the seed); None keeps
    all rows and ``()`` none. Two jobs for all of them.

    The hash is uniform, so counting by its first 16 bits tells which prefix holds the
    k-th pair; only such prefixes are sorted.
    """
    inside = F.col("split").eqNullSafe(F.lit(split)) if split else F.lit(True)
    hashes = F.explode(F.array(*[F.struct(F.lit(i).alias("_s"), hash_key(key, s).alias("_h"))
                                 for i, s in enumerate(seeds)])).alias("_p")
    narrow = items.filter(inside).select(hashes, F.col(key).alias("_k")).select("_p._s", "_p._h", "_k")
    narrow = narrow.withColumn("_b", F.shiftright("_h", 44))
    counts: dict[int, list] = {i: [] for i in range(len(seeds))}
    for r in narrow.groupBy("_s", "_b").count().collect():                    # at most 65,536 rows a seed
        counts[r["_s"]].append((r["_b"], r["count"]))
    cuts: dict[tuple[int, int], tuple | None] = {}
    wanted: dict[tuple[int, int, int], list] = {}
    for i in range(len(seeds)):
        own = sorted(counts[i])
        n = sum(c for _, c in own)
        for f, frac in enumerate(fracs):
            k, before = subset_size(n, frac), 0
            if k >= n or k == 0:
                cuts[f, i] = None if k >= n else ()
                continue
            for p, c in own:
                if before + c >= k:
                    break
                before += c
            wanted.setdefault((i, p, k - before), []).append((f, i))
    if wanted:
        places = items.sparkSession.createDataFrame(list(wanted), "_s int, _b long, _n int")   # one row per subset
        rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_k"))
        near = narrow.join(F.broadcast(places.select("_s", "_b").distinct()), ["_s", "_b"]).withColumn("_n", rank)
        for r in near.join(F.broadcast(places), ["_s", "_b", "_n"]).collect():
            for c in wanted[r["_s"], r["_b"], r["_n"]]:
                cuts[c] = (r["_h"], r["_k"])
    return cuts


def in_subset(items: DataFrame, cut: tuple | None, seed: int, key: str = "item_id") -> F.Column:
    """Whether a row's pair lies within a cut of :func:`subset_cuts`."""
    if cut is None or not cut:
        return F.lit(cut is None)
    pair = F.struct(hash_key(key, seed).alias("_h"), F.col(key).alias("_k"))
    return pair <= F.struct(F.lit(cut[0]).alias("_h"), F.lit(cut[1]).cast(items.schema[key].dataType).alias("_k"))


def subset_fraction(items: DataFrame, frac: float, seed: int = 0, key: str = "item_id",
                    split: str | None = "train") -> DataFrame:
    """Seeded subset without replacement of the ``split`` rows; other splits pass through.

    The kept rows are the ``k`` smallest ``(md5(key:seed), key)`` pairs, so a
    smaller fraction with the same seed is nested in a larger one. The rows (with a
    NULL split among the others) are kept by one filter over one scan.
    """
    inside = F.col("split").eqNullSafe(F.lit(split)) if split else F.lit(True)
    cut = subset_cuts(items, [frac], [seed], key, split)[0, 0]
    if cut is None:
        return items
    return items.filter(~inside | in_subset(items, cut, seed, key))


def group_weights(items: DataFrame, group: str = "domain") -> DataFrame:
    """D3: sampling weight ``1 / (G * count(group))`` per row (uniform over groups)."""
    counts = items.groupBy(group).agg(F.count(F.lit(1)).alias("group_n"))
    n_groups = counts.count()
    counts = counts.withColumn("weight", 1.0 / (F.lit(max(n_groups, 1)) * F.col("group_n")))
    return join_dimension(items, counts, group, n_groups)


def _group_index(items: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame, int]:
    idx = with_index(items, [group, key], out="_gi")
    starts = idx.groupBy(group).agg(F.min("_gi").alias("_start"), F.count(F.lit(1)).alias("group_n"))
    starts, n_groups = with_index_and_count(starts, group, out="gno")
    gi = (join_dimension(idx, starts, group, n_groups)
          .withColumn("gidx", F.col("_gi") - F.col("_start"))
          .drop("_gi", "_start"))
    return gi, starts, n_groups


def group_index(items: DataFrame, group: str = "domain", key: str = "item_id") -> DataFrame:
    """Dense index of each row inside its group (``gidx``) and the group number (``gno``).

    Built on the global index over ``(group, key)``, so a group holding a third of
    the rows is still spread over many ranges.
    """
    return _group_index(items, group, key)[0]


def draw_index(items: DataFrame, group: str = "domain", key: str = "item_id") -> tuple[DataFrame, DataFrame, int]:
    """What draws over groups look up, written once for many draws: (group number, row in the
    group, key), (group number, rows) and the number of groups."""
    gi, starts, n_groups = _group_index(items.select(group, key), group, key)
    return (written(gi.select("gno", "gidx", key), "draw-index"), written(starts.select("gno", "group_n"), "draw-groups"),
            n_groups)


def group_balanced_sample(items: DataFrame, n: int, seed: int = 0, group: str = "domain",
                          key: str = "item_id", index: tuple[DataFrame, DataFrame, int] | None = None) -> DataFrame:
    """D3: ``n`` draws with replacement, uniform over groups, then uniform inside the group.

    Draw ``i`` picks group ``h1(i) mod G`` and row ``h2(i) mod count(group)``;
    draws and the narrow (group, key) index meet in one equi-join on
    ``(group number, row number)``, and the drawn keys are joined back to the
    rows (``key`` must be unique). No driver loop, no per-group collection, and
    only the two key columns are indexed. ``index`` (of :func:`draw_index`) serves many draws.
    """
    # the index needs only (group, key); drawn keys are joined back to the full rows at the end
    gi, starts, n_groups = index or _group_index(items.select(group, key), group, key)
    if n_groups == 0 or n <= 0:
        return items.limit(0).withColumn("draw", F.lit(0).cast("bigint"))
    draws = items.sparkSession.range(n).withColumnRenamed("id", "draw")
    h1 = hash_key(F.concat(F.col("draw").cast("string"), F.lit(":g")), seed)
    h2 = hash_key(F.concat(F.col("draw").cast("string"), F.lit(":r")), seed)
    draws = draws.withColumn("gno", F.pmod(h1, F.lit(n_groups)))
    draws = (join_dimension(draws, starts.select("gno", "group_n"), "gno", n_groups)
                  .withColumn("gidx", F.pmod(h2, F.col("group_n")))
                  .drop("group_n"))
    picks = draws.join(gi.select("gno", "gidx", key), ["gno", "gidx"]).select("draw", key)
    # the draws (a parameter, not the data size) are broadcast into the item scan if they fit
    picks = picks.withColumnRenamed(key, "_pick")
    return (items.join(F.broadcast(picks) if fits_broadcast(picks, n) else picks,
                       F.col(key).eqNullSafe(F.col("_pick"))).drop("_pick"))


def shard(items: DataFrame, world: int, rank: int | None = None, pad: bool = True,
          order="item_id") -> DataFrame:
    """Strided shards. Position ``p`` goes to shard ``p % world``.

    With ``pad`` the positions are extended with the first rows again up to a
    multiple of ``world``; the pad can not be longer than the data, so a tiny
    input leaves the last shards short (as the strided sampler it replaces).
    """
    if world <= 0:
        raise ValueError("world must be positive")
    if rank is not None and not 0 <= rank < world:
        raise ValueError(f"rank {rank} is not one of the {world} shards 0..{world - 1}")
    idx, n = with_index_and_count(items, order, out="position")
    out = idx
    if pad:
        n_pad = min(-(-n // world) * world - n, n)
        if n_pad > 0:
            # the first rows appear twice: one explode, so the index is computed once
            at = F.col("position")
            places = F.when(at < n_pad, F.array(at, at + n)).otherwise(F.array(at))
            out = idx.withColumn("position", F.explode(places))
    out = out.withColumn("shard", (F.col("position") % world).cast("int"))
    if rank is not None:
        out = out.filter(F.col("shard") == rank)
    return out


def place_shards(items: DataFrame, world: int, pad: bool = True, order="item_id", parts: int = 1) -> DataFrame:
    """D4 placed: partition ``r`` of the result holds exactly shard ``r``, sorted by position.

    The partition number is given outright (``repartitionById``), not hashed, so no shard is
    empty while another is doubled. A shard may be cut into ``parts`` runs of positions, which are
    the partitions ``r * parts`` to ``r * parts + parts - 1``.
    """
    if parts <= 0:
        raise ValueError("parts must be positive")
    out = shard(items, world, pad=pad, order=order)
    number = F.col("shard")
    if parts > 1:
        last = out.agg(F.max("position")).first()[0] or 0
        number = F.col("shard") * parts + F.least(F.lit(parts - 1), F.expr(f"position * {parts} div {last + 1}"))
    # the shard comes first in the order, so that a write by shard does not sort again
    return out.repartitionById(world * parts, number.cast("int")).sortWithinPartitions("shard", "position")


def write_shards(items: DataFrame, path: str, world: int, pad: bool = True, order="item_id", parts: int = 1) -> None:
    """D4 sink: a folder ``shard=<r>`` per rank with ``parts`` Parquet files, each sorted by
    position; a rank reads its own folder alone."""
    place_shards(items, world, pad, order, parts).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark, path: str, rank: int) -> DataFrame:
    """The rows of one rank; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("shard") == rank)


def group_ids(items: DataFrame, fields: Sequence[str], out: str = "group_id") -> DataFrame:
    """Mixed-radix group code over the sorted distinct values of each field.

    ``code = sum(rank_f * prod(card_g for g after f))``. One pass counts the
    field combinations present (a small table, partial-aggregated); the ranks
    and codes are computed on that table and joined back to the rows.
    """
    fields = list(fields)
    combos = items.select(*fields).distinct().persist()
    try:
        code = F.lit(0).cast("bigint")
        coded = combos
        for f in fields:
            # the distinct values get their rank from the distributed index (NULL first)
            d, card = with_index_and_count(combos.select(f).distinct(), f, out=f"_rank_{f}")
            coded = join_dimension(coded, d, f, card)
            code = code * F.lit(card) + F.col(f"_rank_{f}")
        coded = coded.select(*fields, code.alias(out))
        n_combos = combos.count()
    finally:
        combos.unpersist()
    return join_dimension(items, coded, fields, n_combos)


def domain_filter(items: DataFrame, group_id: int | None, split: str = "train",
                  group: str = "domain") -> DataFrame:
    """single-domain variant: the ``split`` rows keep only ``group == group_id``.

    Evaluation splits are not filtered, nor are rows without a split. ``group_id=None``
    returns the input.
    """
    if group_id is None:
        return items
    return items.filter(~F.col("split").eqNullSafe(F.lit(split)) | (F.col(group) == group_id))
