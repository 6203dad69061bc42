"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target: the sources share the total by weight, no target passes `cap` times
   the source's own size, and what is over is shared again by weight.
2. A source's documents stand in a fixed random order (a digest of doc_id), cut into blocks of
   neighbours. Its quota is whole passes over its blocks and a part of one more pass.
3. The block quotas of all sources are split over the output shards by a binary tree: at each node
   the left child's counts are one multivariate-hypergeometric draw, taken source by source from
   the conditional hypergeometric distribution, by inversion from its mode.
4. Each shard takes the next blocks in its sources' permuted order, so the shards' blocks are
   disjoint, and orders its documents by a digest of its own.
5. The part pass ends within a block. Of its documents those well before the end are taken, and of
   the CHOICES round the end the subset whose words come nearest to what the target still lacks.

All of it is DataFrame expressions. Windows run over tables with a row per source, per group of
blocks or per document of one block, never over all documents of a source. A node of the tree holds
only the sources that have blocks in it, so a level holds no more entries than there are blocks.

Defined results: null text has size 0; the null source is a source of its own and comes last; rows
that share a doc_id within a source share one draw; an empty table gives an empty table; a source
of size 0 has target 0; very long texts are only counted. A source whose documents are few and of
very unlike sizes may have no subset near its target; it gets the nearest. Extra columns pass through,
whatever their names. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh_name, materialize, result_name, word_count

#: Documents in a block at most on average, and words in an output shard.
BLOCK_DOCS = 256
SHARD_WORDS = 1 << 23
KEY_BITS = 60
GROUP_BITS = 10
#: Documents round the end of a part pass of which every subset is tried.
CHOICES = 12
#: Level of the tree from which its nodes are dealt over tasks.
WIDE_LEVEL = 10


def order_key(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest of doc_id: the place in the random order of its source."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _targets(sizes: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """Per source: size, weight and target, by filling up to the caps in order of cap over weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("ix", F.row_number().over(names) - 1)
    per = per.withColumn("weight", F.get(cycle, F.col("ix") % len(weights)).cast("long")).withColumn("limit", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "ix")
    upto, everything = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    left = F.sum("source_size").over(everything) - (F.sum("limit").over(upto) - F.col("limit"))
    share = F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight"))
    per = per.withColumns({"place": F.row_number().over(fill), "left": left, "share": share})
    per = per.withColumn("full", F.col("limit") * F.col("share") < F.col("weight") * F.col("left"))
    free = F.min(F.when(~F.col("full"), F.struct("place", "left", "share"))).over(everything)
    per = per.withColumn("free", free)
    is_free = F.col("free").isNotNull() & (F.col("place") >= F.col("free.place"))
    target = F.when(is_free, F.col("weight") * (F.col("free.left") / F.col("free.share"))).otherwise(F.col("limit").cast("double"))
    per = per.withColumn("target", target)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    # the least number of bits for which BLOCK_DOCS << bits reaches n_docs
    bits = F.when(F.col("n_docs") <= BLOCK_DOCS, 0).otherwise(F.length(F.bin(F.floor((F.col("n_docs") - 1) / BLOCK_DOCS).cast("long"))))
    return per.select("source", "ix", "source_size", "weight", "target", passes.cast("long").alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("rest"), bits.alias("bits"))


def _block(key: Column, bits: Column) -> Column:
    return F.call_function("shiftright", key, F.lit(KEY_BITS) - bits)


def _nearest_subset(units: Column, gap: Column) -> Column:
    """struct of end_key and fits for the units (key, size) of a block in order and the words still due.

    Units before end_key are taken, and those whose keys are in fits: of the CHOICES units round the
    place where the running total passes the gap, the subset that comes nearest; ties go to the smaller mask.
    """
    one = F.struct(units.alias("units"), gap.alias("gap"))

    def place(s: Column) -> Column:
        count = F.aggregate(
            s["units"],
            F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n")),
            lambda a, x: F.struct((a["total"] + x["size"]).alias("total"), F.when(a["total"] + x["size"] <= s["gap"], a["n"] + 1).otherwise(a["n"]).alias("n")),
            lambda a: a["n"],
        )
        start = F.greatest(F.lit(0), F.least(count - CHOICES // 2, F.size(s["units"]) - CHOICES))
        return F.struct(s["units"].alias("units"), s["gap"].alias("gap"), start.alias("start"))

    def window(s: Column) -> Column:
        before = F.aggregate(F.slice(s["units"], F.lit(1), s["start"]), F.lit(0).cast("long"), lambda a, x: a + x["size"])
        return F.struct(F.slice(s["units"], s["start"] + 1, F.lit(CHOICES)).alias("some"), (s["gap"] - before).alias("gap"))

    def choose(s: Column) -> Column:
        bit = lambda mask, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1

        def words(mask: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("sum"), mask.alias("mask"))
            step = lambda a, x: F.struct((a["sum"] + a["mask"].bitwiseAND(F.lit(1)) * x["size"]).alias("sum"), F.shiftright(a["mask"], 1).alias("mask"))
            return F.aggregate(s["some"], start, step, lambda a: a["sum"])

        masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(s["some"])) - 1)
        best = F.array_min(F.transform(masks, lambda m: F.struct(F.abs(words(m) - s["gap"]).alias("off"), m.alias("mask"))))["mask"]
        fits = F.filter(F.transform(s["some"], lambda x, i: F.when(bit(best, i), x["key"])), lambda k: k.isNotNull())
        return F.struct(s["some"][0]["key"].alias("end_key"), fits.alias("fits"))

    out = one
    for step in (place, window, choose):  # each bound once, so that its fields aren't computed anew at each use
        out = F.get(F.transform(F.array(out), step), F.lit(0))
    return out


def _boundary(keyed: DataFrame) -> DataFrame:
    """Per source with a part pass: the block in which it ends, the key up to which its documents are
    taken, and the keys beyond that are taken too.

    keyed: ix, key, size, block, rest. Two levels of running totals find the block; only its documents
    (rows of one key count as one) are gathered, a few hundred.
    """
    blocks = keyed.groupBy("ix", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("group", F.shiftright("block", GROUP_BITS))
    groups = blocks.groupBy("ix", "group").agg(F.sum("words").alias("group_words"))
    before_group = Window.partitionBy("ix").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("ix", "group", F.coalesce(F.sum("group_words").over(before_group), F.lit(0)).alias("base"))
    before = Window.partitionBy("ix", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(groups, ["ix", "group"]).withColumn("start", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = blocks.filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words")))
    inside = keyed.join(last.select("ix", "block", "start"), ["ix", "block"])
    units = inside.groupBy("ix", "block", "key").agg(F.sum("size").alias("size"), F.first(F.col("rest") - F.col("start")).alias("gap"))
    ends = units.groupBy("ix", F.col("block").alias("end_block")).agg(F.array_sort(F.collect_list(F.struct("key", "size"))).alias("units"), F.first("gap").alias("gap"))
    found = ends.select("ix", "end_block", _nearest_subset(F.col("units"), F.col("gap")).alias("s"))
    return found.select("ix", "end_block", "s.end_key", "s.fits")


def _log_factorial(n: Column) -> Column:
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 16, F.log(F.factorial(F.greatest(n, F.lit(0)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(u: Column, total: Column, marked: Column, draws: Column) -> Column:
    """Number of marked among `draws` of `total` without replacement, by inversion of u in [0, 1).

    The values are tried from the mode outwards, above and below in turn; all are longs.
    """
    total, marked, draws = (x.cast("long") for x in (total, marked, draws))
    mode = F.floor((draws + 1) * (marked + 1).cast("double") / (total + 2)).cast("long")
    low, high = F.greatest(F.lit(0).cast("long"), draws - (total - marked)), F.least(draws, marked)
    start = F.struct(u.alias("u"), F.least(F.greatest(mode, low), high).alias("m"), low.alias("low"), high.alias("high"), total.alias("total"), marked.alias("marked"), draws.alias("draws"))
    f = _log_factorial

    def walk(s: Column) -> Column:
        u, m, low, high, N, k, n = (s[c] for c in ("u", "m", "low", "high", "total", "marked", "draws"))
        p = F.exp(f(k) - f(m) - f(k - m) + f(N - k) - f(n - m) - f(N - k - n + m) - f(N) + f(n) + f(N - n))
        spread = F.sqrt(n.cast("double") * k / F.greatest(N, F.lit(1)) * (N - k) / F.greatest(N, F.lit(1)) * (N - n) / F.greatest(N - 1, F.lit(1)))
        steps = F.least(high - low, (12 * spread).cast("long") + 24)

        def step(a: Column, _: Column) -> Column:
            up, down = a["up"], a["down"]
            p_up = F.when(up < high, a["p_up"] * (k - up) * (n - up) / ((up + 1) * (N - k - n + up + 1))).otherwise(F.lit(0.0))
            p_down = F.when(down > low, a["p_down"] * down * (N - k - n + down) / ((k - down + 1) * (n - down + 1))).otherwise(F.lit(0.0))
            after_up = a["u"] - p_up
            found = F.when(a["x"].isNotNull(), a["x"]).when((up < high) & (after_up < 0), up + 1).when((down > low) & (after_up - p_down < 0), down - 1)
            return F.struct(
                (after_up - p_down).alias("u"),
                F.least(up + 1, high).alias("up"),
                p_up.alias("p_up"),
                F.greatest(down - 1, low).alias("down"),
                p_down.alias("p_down"),
                found.alias("x"),
            )

        first = F.struct((u - p).alias("u"), m.alias("up"), p.alias("p_up"), m.alias("down"), p.alias("p_down"), F.when(u - p < 0, m).alias("x"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), steps), first, step, lambda a: F.coalesce(a["x"], m))

    # the struct is bound once, so that its fields aren't computed anew at each use
    return F.get(F.transform(F.array(start), walk), F.lit(0))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def _tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Block counts per shard: (shard, ix, n). quotas: ix, quota; one row per source."""
    some = quotas.filter("quota > 0")
    nodes = some.groupBy().agg(F.array_sort(F.collect_list(F.struct("ix", F.col("quota").cast("long").alias("k")))).alias("ks"))
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), "ks")
    for level in range(levels):
        whole = F.aggregate("ks", F.lit(0).cast("long"), lambda a, s: a + s["k"])

        def draw(a: Column, s: Column) -> Column:
            x = hypergeometric(_uniform(F.lit(seed), a["node"], s["ix"]), a["rest"], s["k"], a["draws"])
            return F.struct(a["node"].alias("node"), (a["rest"] - s["k"]).alias("rest"), (a["draws"] - x).alias("draws"), F.concat(a["out"], F.array(x)).alias("out"))

        start = F.struct(F.col("node").alias("node"), whole.alias("rest"), F.ceil(whole / 2).cast("long").alias("draws"), F.array().cast("array<long>").alias("out"))
        left = F.aggregate("ks", start, draw, lambda a: a["out"])
        nodes = nodes.select("node", "ks", F.explode(F.array(F.struct(F.lit(0).alias("side"), left.alias("left")))).alias("h"))
        side = lambda count: F.filter(F.zip_with("ks", F.col("h.left"), lambda s, x: F.struct(s["ix"].alias("ix"), count(s, x).alias("k"))), lambda s: s["k"] > 0)
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), side(lambda s, x: x).alias("ks")),
            F.struct((F.col("node") * 2 + 1).alias("node"), side(lambda s, x: s["k"] - x).alias("ks")),
        )
        nodes = nodes.select(F.inline(both)).filter(F.size("ks") > 0)
        nodes = materialize(nodes.repartition("node") if level >= WIDE_LEVEL else nodes)  # each level is planned by itself
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.inline("ks")).withColumnRenamed("k", "n")


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: list[int] = (1, 2, 3),
    cap: int = 3,
    seed: int = 20,
    shard_words: int = SHARD_WORDS,
    to: str | None = None,
) -> DataFrame:
    """docs with `to` (`mix`, with underscores before it where docs has one): struct of size, source_size,
    target, and copies, the shards that take it.

    A document's words in the mix are size times the number of its copies. Needs doc_id, source
    and, unless `size` is given, text. No row of docs is moved: decisions come from small tables.
    """
    size = word_count(F.col("text")) if size is None else size
    key = order_key(F.col("doc_id"), seed)
    slim = materialize(docs.select(F.col("source"), key.alias("key"), size.cast("long").alias("size")))
    plan = materialize(_targets(slim, list(weights), cap))
    shape = plan.agg(F.sum("target").alias("words")).first()
    levels = max(0, math.ceil(math.log2(max(1.0, (shape["words"] or 0) / shard_words))))

    keyed = slim.join(plan.select("source", "ix", "bits", "rest"), slim["source"].eqNullSafe(plan["source"]))
    keyed = keyed.select("ix", "key", "size", "rest", _block(F.col("key"), F.col("bits")).alias("block"))
    plan = plan.join(_boundary(keyed.filter("rest > 0")), "ix", "left")
    per_pass = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    plan = plan.withColumn("quota", F.col("passes") * per_pass + F.coalesce(F.col("end_block") + 1, F.lit(0)))
    plan = materialize(plan)

    shares = _tree(plan.select("ix", "quota"), levels, seed)
    before = Window.partitionBy("ix").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    drawn = shares.select("ix", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("draw"))
    drawn = drawn.join(plan.select("ix", "bits"), "ix")
    drawn = drawn.withColumn("block", F.col("draw") % F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))).withColumn("turn", F.call_function("shiftright", F.col("draw"), F.col("bits")))
    drawn = drawn.groupBy("ix", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards"))
    drawn = materialize(drawn)

    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("row_source"), key.alias("key"), size.cast("long").alias("size"))
    rows = rows.join(plan, rows["row_source"].eqNullSafe(plan["source"])).withColumn("block", _block(F.col("key"), F.col("bits")))
    rows = rows.join(drawn, ["ix", "block"], "left")
    none = F.array().cast("array<int>")
    passes = F.col("passes").cast("int")
    shards = F.coalesce("shards", none)
    part = (F.col("key") < F.col("end_key")) | F.array_contains("fits", F.col("key"))
    copies = F.concat(F.slice(shards, F.lit(1), passes), F.when(part, F.slice(shards, passes + 1, F.lit(1))).otherwise(none))
    return rows.select("row.*", F.struct("size", "source_size", "target", copies.alias("copies")).alias(to or result_name(docs, "mix")))


def mixed(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """The mix itself: each document as often as it is drawn, by shard and shuffled within it."""
    name, copy, shard = (fresh_name(docs, x) for x in ("mix", "copy", "shard"))
    out = mix(docs, seed=seed, to=name, **options)
    out = out.select(*docs.columns, F.posexplode(f"{name}.copies").alias(copy, shard))
    out = out.repartition(shard)
    return out.sortWithinPartitions(shard, F.xxhash64(F.lit(seed), shard, "doc_id", copy)).select(*docs.columns)


def word_totals(docs: DataFrame) -> DataFrame:
    """Per document of docs: size, its source's size and target, and the words the mix takes."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    out = mix(sized, size=F.col("words"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.size("mix.copies")).alias("taken"))


#: The same in DuckDB SQL: the blocks and the tree deal out copies but don't change their number.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('20|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER o AS place,
         sum(source_size) OVER ()::BIGINT - (sum(3 * source_size) OVER o - 3 * source_size)::BIGINT AS lft,
         sum(w) OVER ()::BIGINT - (sum(w) OVER o - w)::BIGINT AS share
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (
  SELECT *, (SELECT min(place) FROM f WHERE NOT (cap * share < w * lft)) AS free FROM f),
t AS (
  SELECT source, source_size, CASE WHEN n_docs <= {BLOCK_DOCS} THEN 0 ELSE length(bin((n_docs - 1) // {BLOCK_DOCS})) END AS bits,
         CASE WHEN place >= free THEN w * ((SELECT lft::DOUBLE / share FROM g x WHERE x.place = x.free)) ELSE cap::DOUBLE END AS target
  FROM g),
p AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes, k >> (60 - bits)::INT AS block
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - passes * source_size AS rest FROM p),
b AS (SELECT source, block, min(rest) AS rest, sum(size)::BIGINT AS words FROM q WHERE rest > 0 GROUP BY ALL),
e AS (SELECT source, block, rest, words, sum(words) OVER (PARTITION BY source ORDER BY block) - words AS start FROM b),
u AS (
  SELECT q.source, q.block, k, sum(size)::BIGINT AS size, min(q.rest - start) AS gap
  FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source AND q.block = e.block AND start <= e.rest AND e.rest < start + words GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER w AS place, sum(size) OVER w AS run, count(*) OVER (PARTITION BY source) AS n FROM u WINDOW w AS (PARTITION BY source ORDER BY k)),
c AS (SELECT source, greatest(0, least(count(*) FILTER (run <= gap) - {CHOICES // 2}, max(n) - {CHOICES})) AS start FROM r GROUP BY source),
v AS (
  SELECT r.source, k, size, gap, place - start AS nth, coalesce(sum(size) FILTER (place <= start) OVER (PARTITION BY r.source), 0) AS base
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source),
y AS (SELECT source, max(nth) AS m, min(gap - base) AS gap FROM v WHERE nth BETWEEN 1 AND {CHOICES} GROUP BY source),
z AS (SELECT source, gap, unnest(generate_series(0, (1 << least(m, {CHOICES})::INT) - 1)) AS mask FROM y),
o AS (
  SELECT z.source, mask, abs(sum(CASE WHEN (mask >> (nth - 1)::INT) & 1 = 1 THEN size ELSE 0 END) - min(z.gap)) AS away
  FROM z JOIN v ON z.source IS NOT DISTINCT FROM v.source AND nth BETWEEN 1 AND {CHOICES} GROUP BY ALL),
a AS (SELECT source, arg_min(mask, (away, mask)) AS mask FROM o GROUP BY source),
h AS (
  SELECT a.source, min(k) AS end_key, coalesce(list(k) FILTER ((mask >> (nth - 1)::INT) & 1 = 1), []) AS fits
  FROM a JOIN v ON a.source IS NOT DISTINCT FROM v.source AND nth BETWEEN 1 AND {CHOICES} GROUP BY a.source)
SELECT q.doc_id, q.size, q.source_size, q.target,
       (q.size * (passes + CASE WHEN rest > 0 AND (k < end_key OR list_contains(fits, k)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q LEFT JOIN h ON q.source IS NOT DISTINCT FROM h.source
"""
