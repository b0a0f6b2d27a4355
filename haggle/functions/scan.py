"""Skew-safe ordered scans.

A window partitioned by conversation puts every row of one conversation in one
task; with one conversation holding a large share of the data that task is the
whole job.  These helpers run the scan in two levels instead:

1. rows are cut into chunks of ``chunk_rows`` consecutive positions
   (``floor(pos / chunk_rows)``) and the window runs per (key, chunk), so a
   hot key spreads over many tasks;
2. a one-row-per-chunk summary, taken from the window's own output in the
   same stage, is scanned per key to get the carry from earlier / later
   chunks and joined back on (key, chunk).

Plan shape: the (key, chunk) pair travels as one struct column.  The big side
is shuffled once (by that struct); the summary is aggregated on the already
partitioned window output, so both uses of the window share one exchange
(reused at run time) and only the small summary moves again.  A struct key
is never NULL, so the optimizer infers no extra filter that would make the
two branches differ and defeat the reuse.  Where most keys have a single chunk
the summary is nearly as large as the data; ``by_chunks`` and ``by_size`` take
those keys apart, which need one window only.  Results equal the plain
single-window scan; ``pos`` must be an integer position that orders rows
within the key (gaps allowed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16
_K = "_scan_key"
_C = "_c"
UNB = Window.unboundedPreceding


def _as_list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _keyed(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    return df.withColumn(_K, F.struct(*[F.col(k).alias(k) for k in keys], chunk.cast("long").alias(_C)))


def _pos_chunk(pos: str, chunk_rows: int) -> Column:
    return F.floor(F.col(pos) / F.lit(chunk_rows))


def _carry_window(keys: list[str], upto: int | None):
    w = Window.partitionBy(*[F.col(_K)[k] for k in keys]).orderBy(F.col(_K)[_C])
    return w.rowsBetween(UNB, upto) if upto is not None else w


def _join_back(d: DataFrame, carry: DataFrame) -> DataFrame:
    return d.join(carry, _K, "left")


FEW_KEYS = 200_000   # so many keys with several chunks may be broadcast


def by_chunks(df: DataFrame, keys, chunk: Column) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the keys that have chunk 0 only, rows of the other keys or None
    if there are none).  The first need no second level: one window per key does.
    The other keys are looked for first, in a pass over keys and chunks alone."""
    keys = _as_list(keys)
    return _apart(df, keys, df.where(~chunk.eqNullSafe(F.lit(0))).select(*keys).distinct())


def by_size(df: DataFrame, keys, of: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """:func:`by_chunks` for chunks of no fixed size, as days: (rows of the keys
    with at most ``chunk_rows`` rows, rows of the others or None).  ``of``: where to
    count the keys, if there is something cheaper than df."""
    keys = _as_list(keys)
    sizes = (df if of is None else of).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _apart(df, keys, sizes.where(F.col("_n") > chunk_rows).select(*keys))


def _apart(df: DataFrame, keys: list[str], several: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    several = several.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    n = several.limit(FEW_KEYS + 1).count()
    if not n:
        return df, None
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    several = F.broadcast(several) if n <= FEW_KEYS else several
    return df.join(several, same, "left_anti"), df.join(several, same, "left_semi")


def ffill(df: DataFrame, keys, pos: str, value, out=None, *,
          exclusive: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Last non-null value at or (``exclusive``) strictly before each row.

    ``value``/``out`` are one column name each, or ``value`` is a dict
    ``{value_col: out_col}`` to fill several columns in one pass (one
    shuffle, one window, one summary)."""
    keys = _as_list(keys)
    pairs = dict(value) if isinstance(value, dict) else {value: out}
    d = _keyed(df, keys, _pos_chunk(pos, chunk_rows))
    w = Window.partitionBy(_K).orderBy(pos)
    names = {v: (f"_scan_inc{i}", f"_scan_loc{i}", f"_scan_last{i}", f"_scan_carry{i}")
             for i, v in enumerate(pairs)}
    for v, (inc, loc, _, _) in names.items():
        d = d.withColumn(inc, F.last(v, ignorenulls=True).over(w.rowsBetween(UNB, 0)))
        if exclusive:
            d = d.withColumn(loc, F.last(v, ignorenulls=True).over(w.rowsBetween(UNB, -1)))
    summ = d.groupBy(_K).agg(*[F.max_by(inc, F.col(pos)).alias(last) for inc, _, last, _ in names.values()])
    cw = _carry_window(keys, -1)
    carry = summ.select(_K, *[F.last(last, ignorenulls=True).over(cw).alias(car)
                              for _, _, last, car in names.values()])
    d = _join_back(d, carry)
    d = d.withColumns({pairs[v]: F.coalesce(loc if exclusive else inc, car)
                       for v, (inc, loc, _, car) in names.items()})
    drop = [c for n in names.values() for c in (n[0], n[3])] + ([n[1] for n in names.values()] if exclusive else [])
    return d.drop(_K, *drop)


def running_agg(df: DataFrame, keys, pos: str, value, out=None, *, how: str = "sum",
                exclusive: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running sum / min / max up to (``exclusive``: before) each row;
    ``value`` may be a dict ``{value_col: out_col}`` for several columns in
    one pass."""
    keys = _as_list(keys)
    pairs = dict(value) if isinstance(value, dict) else {value: out}
    fn = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    d = _keyed(df, keys, _pos_chunk(pos, chunk_rows))
    w = Window.partitionBy(_K).orderBy(pos)
    names = {v: (f"_scan_inc{i}", f"_scan_loc{i}", f"_scan_tot{i}", f"_scan_carry{i}")
             for i, v in enumerate(pairs)}
    for v, (inc, loc, _, _) in names.items():
        d = d.withColumn(inc, fn(v).over(w.rowsBetween(UNB, 0)))
        if exclusive:
            d = d.withColumn(loc, fn(v).over(w.rowsBetween(UNB, -1)))
    summ = d.groupBy(_K).agg(*[F.max_by(inc, F.col(pos)).alias(tot) for inc, _, tot, _ in names.values()])
    cw = _carry_window(keys, -1)
    carry = summ.select(_K, *[fn(tot).over(cw).alias(car) for _, _, tot, car in names.values()])
    d = _join_back(d, carry)

    def comb(a, b):
        if how == "sum":
            return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        return F.least(a, b) if how == "min" else F.greatest(a, b)

    d = d.withColumns({pairs[v]: comb(F.col(loc if exclusive else inc), F.col(car))
                       for v, (inc, loc, _, car) in names.items()})
    drop = [c for n in names.values() for c in (n[0], n[3])] + ([n[1] for n in names.values()] if exclusive else [])
    return d.drop(_K, *drop)


def multi_scan(df: DataFrame, keys, pos: str, *, fill: dict | None = None, fill_exclusive: bool = False,
               nxt: list[str] | None = None, prv: list[str] | None = None, next_prefix: str = "next_",
               prev_prefix: str = "prev_", prv_two: bool = False, running: list | None = None,
               order: list | None = None, chunk: Column | None = None, totals: list | None = None,
               chunk_rows: int = CHUNK_ROWS, one_chunk: bool = False) -> DataFrame:
    """Several ordered scans over the same key and order in one pass: forward
    fills (``fill`` = {value: out}), the next row's columns (``nxt``), the
    previous row's columns (``prv``; with ``prv_two`` also those of the row
    before it, as ``prev_prefix + "2_" + col``) and running aggregates
    (``running`` = [(value, how, out, exclusive)], how in sum/min/max), and
    aggregates over the whole key (``totals`` = [(value, how, out)]).  One
    shuffle, one window node, one per-chunk summary and one join back,
    instead of one of each per scan.

    Instead of an integer ``pos`` the order may be given by ``order`` columns
    and a coarse, order-compatible ``chunk`` (e.g. timestamp, id and the
    day): a running sum of ones then numbers the rows in the same pass.

    ``one_chunk`` says that every key has a single chunk (:func:`by_chunks`
    finds those): the window runs per key, without summary and join back."""
    keys = _as_list(keys)
    fill, nxt, prv = dict(fill or {}), list(nxt or []), list(prv or [])
    running, totals = list(running or []), list(totals or [])
    d = df if one_chunk else _keyed(df, keys, _pos_chunk(pos, chunk_rows) if chunk is None else chunk)
    w = Window.partitionBy(*(keys if one_chunk else [_K])).orderBy(*(order or [pos]))
    cols, aggs, carry_cols = {}, [], []
    if order or nxt or prv:
        cols["_ms_rn"] = F.row_number().over(w)
    pos = "_ms_rn" if order else pos
    fnames = {v: (f"_ms_inc{i}", f"_ms_loc{i}", f"_ms_last{i}", f"_ms_fc{i}") for i, v in enumerate(fill)}
    for v, (inc, loc, last, _) in fnames.items():
        cols[inc] = F.last(v, ignorenulls=True).over(w.rowsBetween(UNB, 0))
        if fill_exclusive:
            cols[loc] = F.last(v, ignorenulls=True).over(w.rowsBetween(UNB, -1))
        aggs.append(F.max_by(inc, F.col(pos)).alias(last))
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    for i, (v, how, _, excl) in enumerate(running):
        cols[f"_ms_ri{i}"] = fns[how](v).over(w.rowsBetween(UNB, 0))
        if excl:
            cols[f"_ms_rl{i}"] = fns[how](v).over(w.rowsBetween(UNB, -1))
        aggs.append(F.max_by(f"_ms_ri{i}", F.col(pos)).alias(f"_ms_rt{i}"))
    aggs += [fns[how](v).alias(f"_ms_tt{i}") for i, (v, how, _) in enumerate(totals)]
    if nxt:
        st_n = F.struct(*[F.col(c).alias(c) for c in nxt], F.lit(True).alias("_present"))
        cols["_ms_nl"] = F.lead(st_n, 1).over(w)
        aggs.append(F.min_by(st_n, F.col("_ms_rn")).alias("_ms_first"))
    if prv:
        st_p = F.struct(*[F.col(c).alias(c) for c in prv], F.lit(True).alias("_present"))
        cols["_ms_pl"] = F.lag(st_p, 1).over(w)
        aggs.append(F.max_by(st_p, F.col("_ms_rn")).alias("_ms_lastrow"))
        if prv_two:
            cols["_ms_pl2"] = F.lag(st_p, 2).over(w)
            aggs.append(F.max_by("_ms_pl", F.col("_ms_rn")).alias("_ms_second"))
    if one_chunk:
        cols.update({f"_ms_ta{i}": fns[how](v).over(w.rowsBetween(UNB, Window.unboundedFollowing))
                     for i, (v, how, _) in enumerate(totals)})
        out = {o: F.col(f"_ms_ta{i}") for i, (_, _, o) in enumerate(totals)}
        out.update({fill[v]: F.col(loc if fill_exclusive else inc) for v, (inc, loc, _, _) in fnames.items()})
        out.update({o: F.col(f"_ms_rl{i}" if excl else f"_ms_ri{i}") for i, (_, _, o, excl) in enumerate(running)})
        out.update({next_prefix + c: F.col("_ms_nl")[c] for c in nxt})
        out.update({prev_prefix + c: F.col("_ms_pl")[c] for c in prv})
        if prv_two:
            out.update({f"{prev_prefix}2_{c}": F.col("_ms_pl2")[c] for c in prv})
        d = d.withColumns(cols).withColumns(out)
        return d.drop(*[c for c in d.columns if c.startswith("_ms_")])
    d = d.withColumns(cols)
    summ = d.groupBy(_K).agg(*aggs)
    cw_before, cw = _carry_window(keys, -1), _carry_window(keys, None)
    for v, (_, _, last, fc) in fnames.items():
        carry_cols.append(F.last(last, ignorenulls=True).over(cw_before).alias(fc))
    for i, (_, how, _, _) in enumerate(running):
        carry_cols.append(fns[how](f"_ms_rt{i}").over(cw_before).alias(f"_ms_rc{i}"))
    whole = cw.rowsBetween(UNB, Window.unboundedFollowing)
    carry_cols += [fns[how](f"_ms_tt{i}").over(whole).alias(f"_ms_ta{i}") for i, (_, how, _) in enumerate(totals)]
    if nxt:
        carry_cols.append(F.lead("_ms_first", 1).over(cw).alias("_ms_nc"))
    if prv:
        carry_cols.append(F.lag("_ms_lastrow", 1).over(cw).alias("_ms_pc"))
        if prv_two:   # the last chunk's row before its last, or the one before that chunk
            carry_cols += [F.lag("_ms_second", 1).over(cw).alias("_ms_sc"), F.lag("_ms_lastrow", 2).over(cw).alias("_ms_pc2")]
    d = _join_back(d, summ.select(_K, *carry_cols))
    out = {o: F.col(f"_ms_ta{i}") for i, (_, _, o) in enumerate(totals)}
    for v, (inc, loc, _, fc) in fnames.items():
        out[fill[v]] = F.coalesce(loc if fill_exclusive else inc, fc)
    for i, (_, how, o, excl) in enumerate(running):
        a, b = F.col(f"_ms_rl{i}" if excl else f"_ms_ri{i}"), F.col(f"_ms_rc{i}")
        if how == "sum":
            out[o] = F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        else:
            out[o] = F.least(a, b) if how == "min" else F.greatest(a, b)
    if nxt:
        pick = F.when(F.col("_ms_nl._present"), F.col("_ms_nl")).otherwise(F.col("_ms_nc"))
        out.update({next_prefix + c: pick[c] for c in nxt})
    if prv:
        pick = F.when(F.col("_ms_pl._present"), F.col("_ms_pl")).otherwise(F.col("_ms_pc"))
        out.update({prev_prefix + c: pick[c] for c in prv})
        if prv_two:
            before = F.when(F.col("_ms_sc._present"), F.col("_ms_sc")).otherwise(F.col("_ms_pc2"))
            pick = F.when(F.col("_ms_pl2._present"), F.col("_ms_pl2")).when(
                F.col("_ms_pl._present"), F.col("_ms_pc")).otherwise(before)
            out.update({f"{prev_prefix}2_{c}": pick[c] for c in prv})
    d = d.withColumns(out)
    return d.drop(_K, *[c for c in d.columns if c.startswith("_ms_")])


def shift(df: DataFrame, keys, pos: str, cols: list[str], *, direction: int = 1,
          prefix: str = "next_", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Attach the next (``direction=1``) or previous (``-1``) row's ``cols``
    within the key as ``prefix + col``; NULL past the ends."""
    if direction > 0:
        return multi_scan(df, keys, pos, nxt=cols, next_prefix=prefix, chunk_rows=chunk_rows)
    return multi_scan(df, keys, pos, prv=cols, prev_prefix=prefix, chunk_rows=chunk_rows)


def row_number(df: DataFrame, keys, order: list, chunk: Column, out: str, *, few_chunks: bool = False,
               sizes: DataFrame | None = None) -> DataFrame:
    """1-based row number within ``keys`` by ``order`` where ``chunk`` is a
    coarse, order-compatible bucket (e.g. the day of a timestamp): rows are
    numbered inside each (key, chunk) and offset by the row counts of the
    earlier chunks of the key.  ``few_chunks``: most keys have chunk 0 only, and
    are numbered by one window per key (:func:`by_chunks`); ``sizes`` (a table with
    the keys, row by row): so are those with few rows there (:func:`by_size`)."""
    keys = _as_list(keys)
    if few_chunks or sizes is not None:
        df, several = by_chunks(df, keys, chunk) if few_chunks else by_size(df, keys, sizes)
        one = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int"))
        return one if several is None else one.unionByName(row_number(several, keys, order, chunk, out))
    d = _keyed(df, keys, chunk)
    d = d.withColumn("_scan_local", F.row_number().over(Window.partitionBy(_K).orderBy(*order)))
    summ = d.groupBy(_K).agg(F.max("_scan_local").alias("_scan_n"))
    carry = summ.select(_K, F.coalesce(F.sum("_scan_n").over(_carry_window(keys, -1)), F.lit(0)).alias("_scan_carry"))
    return (_join_back(d, carry)
            .withColumn(out, (F.col("_scan_local") + F.col("_scan_carry")).cast("int"))
            .drop(_K, "_scan_local", "_scan_carry"))
