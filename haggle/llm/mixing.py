"""Mixing overlapping sources to target weights (operator 9).

Documents are summed by membership pattern (the set of sources they belong
to).  A min-cost flow routes each pattern's words to the quotas of its sources;
the first copy of a word costs nothing and every further copy one more, so
repeats are bought only where no fresh words can be routed.  What a pattern has
to give is then taken from its documents in a seeded order.

Scale.  Only (pattern, sum) rows take part in the flow; patterns that share no
source are solved apart, in parallel.  The seeded order is cut at a bin of a
hash, found in two steps from at most 256 sums a pattern each; only the
documents of that one bin are sorted.  The gap that the cut leaves (less than one
document) is filled by size classes, large ones first: of each class only the
smallest documents that could fill the gap are looked at, found by the same kind of cut.  The number
of Spark jobs doesn't depend on the input.  Texts are never shuffled, and a
source that holds a third of all rows is summed map-side like any other.  Where
patterns are few, as single sources mostly are, the tables with a row a pattern
are kept in a few parts: a job on them takes a few tasks, not one for every
shuffle partition.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.llm.components import components
from haggle.llm.spark import BROADCAST_ROWS, checkpoint, packed

STEP = 8         # bits of a bin number looked at together
BINS = 1 << 2 * STEP
FEW_PATTERNS = BROADCAST_ROWS // 64  # so many patterns, by up to 64 size classes, may be broadcast
TINY, TINY_TASKS = 256, 8  # tables of a row a pattern or bin take so many tasks where there are so few patterns
WORDS = r"[^\x20\x09-\x0D]+"


def route(caps: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[int]:
    """Words to take from each pattern: a min-cost maximum flow from patterns
    (caps[p] words a copy, at most ``repeats`` copies, copy k at cost k - 1)
    over members[p] to the quotas.  A path's cost is that of the copy it opens,
    so augmenting copy by copy keeps the flow cheapest."""
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    users: list[list[int]] = [[] for _ in quotas]
    for p, m in enumerate(members):
        for s in m:
            users[s].append(p)
    need = list(quotas)
    taken = [0] * len(caps)
    for _ in range(repeats):
        free = list(caps)
        while True:
            came: dict[tuple[str, int], tuple[str, int] | None] = {
                ("p", p): None for p, c in enumerate(free) if c > 0 and members[p]}
            queue, goal = deque(came), None
            while queue and goal is None:
                kind, x = queue.popleft()
                if kind == "p":
                    for s in members[x]:
                        if ("s", s) not in came:
                            came["s", s] = (kind, x)
                            if need[s] > 0:
                                goal = s
                                break
                            queue.append(("s", s))
                else:
                    for p in users[x]:
                        if flow[p][x] > 0 and ("p", p) not in came:
                            came["p", p] = (kind, x)
                            queue.append(("p", p))
            if goal is None:
                break
            path = [("s", goal)]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            first = path[0][1]
            amount = min(free[first], need[goal])
            for (kind, x), (_, y) in zip(path, path[1:]):
                if kind == "s":
                    amount = min(amount, flow[y][x])
            for (kind, x), (_, y) in zip(path, path[1:]):
                if kind == "p":
                    flow[x][y] += amount
                else:
                    flow[y][x] -= amount
            free[first] -= amount
            need[goal] -= amount
            taken[first] += amount
    return taken


def source_code(source: Column) -> Column:
    """A key that orders sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def described(docs: DataFrame, source: str, text: str, doc_id: str, seed: int, *more: Column) -> DataFrame:
    """pattern (sorted source keys), size (words), h (seeded order) and more of each row."""
    kind = dict(docs.dtypes)[source]
    keys = F.array_sort(F.array_distinct(F.transform(F.col(source), source_code))) \
        if kind.startswith("array") else F.array(source_code(F.col(source)))
    return docs.select(
        *more, F.coalesce(keys, F.array().cast("array<string>")).alias("pattern"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("h"))


def _kept(df: DataFrame, tiny: bool) -> DataFrame:
    """A checkpoint, of a few parts if df is tiny."""
    return checkpoint(df.coalesce(TINY_TASKS) if tiny else df)


def ranked(sources: DataFrame, key: str, tiny: bool = False) -> DataFrame:
    """sources plus rank (0, 1, ...) in the order of key, without one task that sees all rows."""
    placed = _kept(sources.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn(
        "_at", F.monotonically_increasing_id()), tiny)
    parts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return placed.join(before, F.shiftright("_at", 33) == F.col("_part")).withColumn(
        "rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_n", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, total: int, limit: float,
            tiny: bool = False) -> DataFrame:
    """sources (key, source_size) plus target: ``share`` of all words by weight
    (weights repeat in the order of keys); a target stops at ``limit`` times its
    source's size, and the excess goes to the others by weight until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = _kept(ranked(sources, "key", tiny).withColumn("w", weight).withColumn("cap", F.col("source_size") * limit), tiny)
    level, full = None, F.lit(False)
    while True:
        x = rows.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))),
                     F.count(F.when(full, 1))).first()
        if level is not None and x[2] == count:
            break
        count = x[2]
        level = max(share * total - (x[0] or 0.0), 0.0) / x[1] if x[1] else 0.0
        # the level never falls, so a full source stays full
        full = full | (F.col("w") * level > F.col("cap"))
    return _kept(rows.select("key", "source_size", "rank", F.when(full, F.col("cap")).otherwise(
        F.col("w") * level).alias("target")), tiny)


def wanted(patterns: DataFrame, sources: DataFrame, repeats: int, tiny: bool = False) -> DataFrame:
    """(pattern, cap, want): the flow's words for each pattern."""
    member = _kept(patterns.select("pattern", "cap", F.explode("pattern").alias("key")).join(
        sources.select("key", F.col("rank").alias("node"), F.round("target").cast("long").alias("quota")), "key"), tiny)
    first = member.groupBy("pattern").agg(F.min("node").alias("a"))
    shared = _kept(member.where(F.size("pattern") > 1).join(first, "pattern").where("a <> node").select(
        "a", F.col("node").alias("b")).distinct(), tiny)
    if shared.isEmpty():
        part = member.withColumn("part", F.col("node"))
    else:
        part = member.join(components(shared), "node", "left").withColumn("part", F.coalesce("component", "node"))

    def solve(table: pa.Table) -> pa.Table:
        names = [tuple(p) for p in table.column("pattern").to_pylist()]
        nodes, quotas, caps = (table.column(c).to_pylist() for c in ("node", "quota", "cap"))
        order_p, order_s = sorted(set(names)), sorted(set(nodes))
        at_p, at_s = ({x: i for i, x in enumerate(o)} for o in (order_p, order_s))
        cap, quota, members = [0] * len(order_p), [0] * len(order_s), [[] for _ in order_p]
        for p, s, q, c in sorted(zip(names, nodes, quotas, caps)):
            cap[at_p[p]], quota[at_s[s]] = c, q
            members[at_p[p]].append(at_s[s])
        return pa.table({"pattern": pa.array([list(p) for p in order_p], pa.list_(pa.string())),
                         "cap": pa.array(cap, pa.int64()),
                         "want": pa.array(route(cap, members, quota, repeats), pa.int64())})

    return part.select("part", "pattern", "cap", "node", "quota").groupBy("part").applyInArrow(
        solve, "pattern array<string>, cap long, want long")


def _small(df: DataFrame) -> DataFrame:
    """df for a join, broadcast only if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _crossed(rows: DataFrame, want: DataFrame, few: bool, tiny: bool) -> DataFrame:
    """Per pattern the first bin at which before + the running sum of size
    passes rest, with the sum before that bin.  At most 2 ** STEP bins a pattern."""
    bins = rows.groupBy("pattern", "bin").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("bin"))
    base = want.select("pattern", "rest", F.col("before").alias("base"))
    bins = bins.withColumn("upto", upto).join(F.broadcast(base) if few else base, "pattern")
    return _kept(bins.where("base + upto > rest").groupBy("pattern").agg(
        F.min("bin").alias("bin"), F.min(F.col("base") + F.col("upto") - F.col("n")).alias("before"),
        F.first("rest").alias("rest")), tiny)


def _cut(rows: DataFrame, want: DataFrame, few: bool, tiny: bool, steps: int = 2) -> DataFrame:
    """pattern, bin, before, rest: where the running sum of size over the bins (numbers of
    steps x STEP bits) passes rest (pattern, rest are given by want), step by step."""
    found = want.withColumn("before", F.lit(0))
    for step in reversed(range(steps)):
        if step < steps - 1:
            inside = found.select("pattern", F.col("bin").alias("part"))
            rows_here = rows.join(F.broadcast(inside) if few else inside, "pattern").where(
                F.shiftright("bin", STEP * (step + 1)) == F.col("part"))
        else:
            rows_here = rows
        found = _crossed(rows_here.withColumn("bin", F.shiftright("bin", STEP * step)), found, few, tiny)
    return found


def _hash_bin() -> Column:
    return F.pmod("h", F.lit(BINS))


def _filled(table: pa.Table) -> pa.Table:
    """Greedy choice of one pattern: classes from the largest sizes down, in a class the
    smallest first, each document that fits what is left of the gap."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "size", "h"))), key=lambda r: (-r[0], r[1], r[2]))
    gap, taken = table.column("gap")[0].as_py(), []
    for _, size, h in rows:
        if size <= gap:
            taken.append((h, size))
            gap -= size
    return pa.table({"pattern": pa.array([table.column("pattern")[0].as_py()] * len(taken), pa.list_(pa.string())),
                     "h": pa.array([h for h, _ in taken], pa.int64()), "size": pa.array([x for _, x in taken], pa.int64())})


def _fill(fit: DataFrame, few: bool, tiny: bool) -> DataFrame:
    """pattern, h, size: documents of fit (pattern, h, size, gap; none larger than its
    pattern's gap) that fill the gap.  A class holds the sizes from a power of 2 to the next.

    Of a class the smallest documents are enough, as far as their words pass the gap;
    they are found by a cut over 256 steps of size and the hash.  So the rows of a
    pattern that meet in one task hold at most the gap's words a class, and one bin more."""
    top = F.length(F.bin("size")) - 1
    placed = fit.withColumn("level", top.cast("int")).withColumn("group", F.col("pattern")).withColumn(
        "bin", (F.expr("shiftright(size * 256, level)") - 256) * BINS + _hash_bin())
    classed = placed.withColumn("pattern", F.concat("group", F.array(F.col("level").cast("string"))))
    want = _kept(classed.groupBy("pattern").agg(F.max("gap").alias("rest")), tiny)
    cut = _cut(classed.select("pattern", "bin", "size"), want, few, tiny, steps=3).select("pattern", F.col("bin").alias("last"))
    near = classed.join(F.broadcast(cut) if few else cut, "pattern", "left").where("last is null or bin <= last")
    return _kept(near.select(F.col("group").alias("pattern"), "level", "size", "h", "gap").groupBy("pattern").applyInArrow(
        _filled, "pattern array<string>, h long, size long"), tiny)


def cuts(slim: DataFrame, want: DataFrame, tiny: bool = False) -> tuple[DataFrame, DataFrame]:
    """(plans, picked).  plans: pattern, copies (of every document), bin: every
    document in a lower bin gets one copy more.  picked: pattern, h of the
    other documents that get one more."""
    rest = F.when(F.col("cap") > 0, F.col("want") - F.floor(F.col("want") / F.col("cap")) * F.col("cap")).otherwise(0)
    want = _kept(want.withColumn("copies", F.when(F.col("cap") > 0, F.floor(F.col("want") / F.col("cap")))
                                 .otherwise(0).cast("long")).withColumn("rest", rest.cast("long")), tiny)
    few = want.limit(FEW_PATTERNS + 1).count() <= FEW_PATTERNS
    cut = _cut(slim.withColumn("bin", _hash_bin()), want, few, tiny)
    plans = _kept(want.join(cut.drop("rest"), "pattern", "left").select(
        "pattern", "copies", F.coalesce("bin", F.lit(BINS)).alias("bin"), F.coalesce("before", F.lit(0)).alias("before"),
        F.when(F.col("bin").isNull(), 0).otherwise(F.col("rest")).alias("rest")), tiny)
    small = F.broadcast if few else lambda df: df  # tables of a row a pattern
    here = slim.withColumn("b", _hash_bin()).join(small(plans), "pattern")
    order = Window.partitionBy("pattern").orderBy("h")  # rows of equal h (repeats of a document) go together
    edge = here.where("b = bin").withColumn("upto", F.col("before") + F.sum("size").over(order))
    picked = _kept(edge.where("upto <= rest").select("pattern", "h", "size"), tiny)

    def gaps_left() -> DataFrame:
        got = picked.groupBy("pattern").agg(F.sum("size").alias("got"))
        return _kept(plans.join(small(got), "pattern", "left").select(
            "pattern", "bin", (F.col("rest") - F.col("before") - F.coalesce("got", F.lit(0))).alias("gap")).where("gap > 0"), tiny)

    gaps = gaps_left()
    # what may fill the gaps; repeats of a document are one
    units = checkpoint(slim.join(small(gaps), "pattern").where(
        (_hash_bin() >= F.col("bin")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap"))).groupBy(
        "pattern", "h").agg(F.sum("size").alias("size")))
    while True:  # once, or again where equal steps of size hid a smaller document
        left = units.join(small(gaps.select("pattern", "gap")), "pattern").where("size < 2 * gap").join(
            _small(picked.select("pattern", "h").distinct()), ["pattern", "h"], "left_anti")
        fit = left.where("size <= gap")
        if fit.isEmpty():  # none fits: at last the smallest that doesn't, where that comes nearer
            best = left.groupBy("pattern").agg(F.min(F.struct("size", "h")).alias("x"))
            picked = picked.unionByName(best.select("pattern", "x.h", "x.size"))
            break
        picked = _kept(picked.unionByName(_fill(fit, few, tiny)), tiny)
        gaps = gaps_left()
    return plans.select("pattern", "copies", "bin"), _kept(picked.select("pattern", "h").distinct(), tiny)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
        repeats: int = 2, source: str = "source", text: str = "text", doc_id: str = "doc_id",
        seed: int = 17) -> DataFrame:
    """docs plus size (words) and taken (words the mix takes, repeats counted).

    Whole documents are taken, each at most ``repeats`` times; a source's taken
    words miss its target by less than what the smallest unused document has,
    as far as the flow can meet the target.  ``source`` is one name or an array
    of names; null is a source of its own, the last one; a document of an empty
    or null array is never taken.  Null or wordless texts have size 0 and give
    nothing.  Rows that repeat a doc_id with the same text are taken or left
    together.  The result depends on rows and seed only.  Columns are kept; one
    that has an output's name is replaced."""
    rows = _planned(docs, weights, share, limit, repeats, source, text, doc_id, seed, packed(docs))[0]
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("size", "taken")]
    return rows.select(*own, "size", "taken")


def _planned(docs, weights, share, limit, repeats, source, text, doc_id, seed, *more) -> tuple[DataFrame, DataFrame]:
    """(more columns, pattern, size, taken of each row; the sources with their targets)."""
    slim = checkpoint(described(docs, source, text, doc_id, seed))
    patterns = checkpoint(slim.groupBy("pattern").agg(F.sum("size").alias("cap")))
    tiny = patterns.limit(TINY + 1).count() <= TINY
    patterns = _kept(patterns, tiny) if tiny else patterns
    total = patterns.agg(F.sum("cap")).first()[0] or 0
    sizes = patterns.select(F.explode("pattern").alias("key"), "cap").groupBy("key").agg(F.sum("cap").alias("source_size"))
    sources = targets(sizes, tuple(weights), share, total, limit, tiny)
    plans, picked = cuts(slim, wanted(patterns, sources, repeats, tiny), tiny)
    rows = described(docs, source, text, doc_id, seed, *more) if more else slim
    rows = rows.join(_small(plans), "pattern", "left").join(
        _small(picked.withColumn("picked", F.lit(1))), ["pattern", "h"], "left")
    one_more = (F.pmod("h", F.lit(BINS)) < F.col("bin")) | F.col("picked").isNotNull()
    copies = F.coalesce("copies", F.lit(0)) + F.when(one_more, 1).otherwise(0)
    return rows.withColumn("taken", (copies * F.col("size")).cast("long")).drop("copies", "bin", "picked", "h"), sources


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
               repeats: int = 2, source: str = "source", text: str = "text", doc_id: str = "doc_id",
               seed: int = 17) -> DataFrame:
    """One row per document of a single-source table: doc_id, size, source_size, target, taken."""
    rows, sources = _planned(docs, weights, share, limit, repeats, source, text, doc_id, seed, F.col(doc_id).alias("doc_id"))
    keyed = rows.select("doc_id", F.col("pattern")[0].alias("key"), "size", "taken")
    return keyed.join(_small(sources.select("key", "source_size", "target")), "key").select(
        "doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
                    repeats: int = 2, source: str = "source", text: str = "text", doc_id: str = "doc_id",
                    seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    rows = _planned(docs, weights, share, limit, repeats, source, text, doc_id, seed, packed(docs))[0]
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
