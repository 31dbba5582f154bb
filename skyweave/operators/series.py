"""Row positions, halo chunks and carried neighbours for long keyed series.

A series is the rows of one key in time order, one row per (key, time). A window
partitioned by the key alone gives one task per key, however long the series is, so
the operators of this package work on *chunks* of bounded length instead:

* ``with_position`` numbers the rows of every series without sorting a whole series in
  one task (bucket counts, running sum over buckets, row number inside a bucket);
* ``with_halo`` copies the rows near a chunk border into the neighbouring chunk, which
  makes every bounded row frame exact inside a chunk;
* ``neighbours`` finds the nearest non-null value on either side at any distance: the
  first and last value of each chunk are carried across chunks in a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stage, lazy

POS = "_pos"
LEN = "_len"
CHUNK = "_chunk"
HOME = "_home"
CHUNK_ROWS = 4096
BUCKET_DAYS = 31


def _bucket(order: str, days: int) -> Column:
    day = F.datediff(F.col(order).cast("date"), F.lit("1970-01-01").cast("date"))
    return F.floor(day / F.lit(days)).cast("int")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null meets null; ``right``'s keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_key_{keys.index(c)}") if c in keys else F.col(c) for c in right.columns])
    match = [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(keys)]
    return left.join(renamed, match, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def with_position(
    df: DataFrame,
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    tiebreak: Sequence[str] = (),
    bucket_days: int = BUCKET_DAYS,
    stage: Stage = lazy,
) -> DataFrame:
    """Add ``_pos`` (0-based row number in the series) and ``_len`` (rows of the series).

    A row without a key or time belongs to no series. It stays, with a null ``_len`` and a number below zero that
    only spreads such rows over chunks, however many there are.
    """
    if POS in df.columns:
        return df
    keys = list(keys)
    sound = F.col(order).isNotNull()
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    loose = df.withColumn("_loose", F.when(~sound, -1 - F.monotonically_increasing_id()))
    stray = F.col("_loose").isNotNull()
    bucketed = loose.withColumn("_bucket", F.coalesce(_bucket(order, bucket_days).cast("long"), F.lit(0)))
    bucketed = bucketed.withColumn("_bucket", F.when(stray, F.floor(F.col("_loose") / CHUNK_ROWS)).otherwise(F.col("_bucket")))
    counts = bucketed.where(~stray).groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    over_key = Window.partitionBy(*keys)
    before = over_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(over_key).alias(LEN),
    )
    local = Window.partitionBy(*keys, "_bucket", stray).orderBy(order, *tiebreak)
    position = F.coalesce(F.col("_loose"), F.col("_offset") + F.row_number().over(local) - F.lit(1))
    joined = bucketed.join(stage(offsets, "offsets"), [*keys, "_bucket"], "left")
    return joined.select(*[F.col(c) for c in df.columns], F.when(~stray, F.col(LEN)).alias(LEN), position.alias(POS))


def drop_position(df: DataFrame) -> DataFrame:
    return df.drop(POS, LEN, CHUNK, HOME)


def chunk_of(rows: int) -> Column:
    return F.floor(F.col(POS) / F.lit(rows)).cast("long")


def in_series() -> Column:
    """Whether the row has a place in a series, that is a key and a time."""
    return F.col(LEN).isNotNull()


def with_halo(df: DataFrame, before: int = 0, after: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Give every row its chunk, and also the chunks whose frames reach it.

    ``before`` and ``after`` are the rows a frame looks back and ahead. Windows then run
    over (keys, ``_chunk``) ordered by ``_pos``; ``home_rows`` drops the copies afterwards.
    """
    if before > chunk_rows or after > chunk_rows:
        raise ValueError("a halo must not be longer than a chunk")
    own = chunk_of(chunk_rows)
    offset = F.col(POS) - own * F.lit(chunk_rows)
    targets = [own]
    if before:  # rows at the end of a chunk are looked back at from the next one
        targets.append(F.when((offset >= chunk_rows - before) & in_series(), own + 1))
    if after:  # rows at the start are looked ahead at from the previous one
        targets.append(F.when((offset < after) & (own > 0), own - 1))
    if len(targets) == 1:
        return df.withColumn(CHUNK, own)
    copies = F.filter(F.array(*targets), lambda c: c.isNotNull())
    return df.withColumn(CHUNK, F.explode(copies))


def home_rows(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Only the rows whose own chunk this is."""
    return df.filter(F.col(CHUNK) == chunk_of(chunk_rows)).drop(CHUNK)


def chunk_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(POS)


def neighbours(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("city",),
    chunk_rows: int = CHUNK_ROWS,
    stage: Stage = lazy,
) -> DataFrame:
    """Add ``_prev_<c>`` and ``_next_<c>``: struct(pos, val) of the nearest non-null value.

    The row itself counts on both sides; rows of no series have no neighbours. ``df`` must carry positions. The look-ahead is a
    running frame over descending order; an unbounded-following frame would be quadratic.
    """
    keys = list(keys)

    def pair(pos: Column, val: Column) -> Column:
        return F.when(pos.isNotNull(), F.struct(pos.alias("pos"), val.alias("val")))

    known = {c: F.when(F.col(c).isNotNull() & in_series(), F.col(POS)) for c in cols}
    point = {c: pair(known[c], F.col(c)) for c in cols}
    chunked = df.withColumn(CHUNK, chunk_of(chunk_rows))
    # plain numbers, not structs, keep this a hash aggregate
    numbers = []
    for c in cols:
        numbers += [F.min(known[c]).alias(f"_fp_{c}"), F.min_by(c, known[c]).alias(f"_fv_{c}")]
        numbers += [F.max(known[c]).alias(f"_lp_{c}"), F.max_by(c, known[c]).alias(f"_lv_{c}")]
    ends = chunked.where(in_series()).groupBy(*keys, CHUNK).agg(*numbers).select(
        *keys,
        CHUNK,
        *[pair(F.col(f"_fp_{c}"), F.col(f"_fv_{c}")).alias(f"_first_{c}") for c in cols],
        *[pair(F.col(f"_lp_{c}"), F.col(f"_lv_{c}")).alias(f"_last_{c}") for c in cols],
    )
    up = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        CHUNK,
        *[F.last(f"_last_{c}", True).over(up).alias(f"_in_{c}") for c in cols],
        *[F.last(f"_first_{c}", True).over(down).alias(f"_out_{c}") for c in cols],
    )
    asc = Window.partitionBy(*keys, CHUNK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    desc = Window.partitionBy(*keys, CHUNK).orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, 0)
    joined = chunked.join(stage(carried, "carried"), [*keys, CHUNK], "left")
    return joined.select(
        *[F.col(n) for n in df.columns],
        *[F.coalesce(F.last(point[c], True).over(asc), F.col(f"_in_{c}")).alias(f"_prev_{c}") for c in cols],
        *[F.coalesce(F.last(point[c], True).over(desc), F.col(f"_out_{c}")).alias(f"_next_{c}") for c in cols],
    )


def densify(
    df: DataFrame,
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    step: str = "1 hour",
    zero: Sequence[str] = (),
    stage: Stage = lazy,
    keep_position: bool = False,
) -> DataFrame:
    """Complete grid per series from its first to its last time; new cells are null or 0.

    ``df`` has one row per (key, time) on the grid; rows without a key or time have no cell and go. Grid rows come from the first and last
    time of each key, so what is shuffled besides the data is the grid itself. ``df`` is
    read twice: ``stage`` may store it when it is the result of a large aggregate.
    ``keep_position`` adds the positions, which cost nothing on a grid.
    """
    keys = list(keys)
    df = stage(df, "sparse")
    span = df.dropna(subset=keys).groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    # a long grid is laid out block by block: no row holds more than a block of steps
    kind, one = dict(df.dtypes)[order], f"INTERVAL {step}"
    blocks = span.withColumn("_blocks", F.expr(f"sequence(_lo, _hi, {one} * {CHUNK_ROWS})"))
    last = F.expr(f"size(sequence(element_at(_blocks, -1), _hi, {one}))")
    blocks = blocks.withColumn(LEN, ((F.size("_blocks") - 1) * CHUNK_ROWS + last).cast("long"))
    blocks = blocks.select(*keys, "_hi", LEN, F.posexplode("_blocks").alias("_block", "_from"))
    steps = F.expr(f"sequence(_from, least(_hi, CAST(_from + {one} * {CHUNK_ROWS - 1} AS {kind})), {one})")
    grid = blocks.select(*keys, LEN, "_block", F.posexplode(steps).alias("_step", order))
    place = (F.col("_block").cast("long") * CHUNK_ROWS + F.col("_step")).alias(POS)
    grid = grid.select(*keys, order, *([LEN, place] if keep_position else []))
    out = grid.join(df, [*keys, order], "left")
    if zero:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in zero})
    return out.select(*df.columns, *([LEN, POS] if keep_position else []))
