"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power a, normalised; a = 1 keeps the shares,
a = 0 makes the sources equal. Bisection finds the smallest a at which no source is
repeated more than `max_repeats` times, or the one at which the weights have a target
entropy. Weights become documents by block permutations: a hash of doc_id puts a source's
documents in an order, cut into blocks of a few hundred; a source goes through its whole
order as often as its budget allows and once more as far as the rest of the budget reaches.

The budget is a number of tokens, or by default the smallest that holds every document
at least once, so that nothing is dropped. Tokens are white-space separated words.

No step orders a whole source: running sums go over blocks, then inside each block.
Everything is a built-in function; sources are rows of a table, and the driver gets sums over it.

Edge cases: null and empty texts have no tokens and take no budget: they come as often as
the whole order does, at least once where the budget covers all; a source without tokens
has weight 0; a null source is the source ''; a null doc_id is ordered as ''; rows that
repeat a doc_id are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm.scratch import Scratch

BLOCK_DOCS = 512
STEPS = 50
#: Parts of the range of exponents in one pass for a target entropy.
SECTIONS = 32
#: Blocks of a strip, and rows that stand in one array.
STRIP = 4096
LIKE = 65_536
#: Sources (about 100 bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def order_key(seed: str) -> Column:
    """60 bits of a checksum: the place of a document in its source's permutation."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def source_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def tokens_of() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long")


def measure(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, n_tokens, key."""
    return docs.select("doc_id", source_of().alias("source"), tokens_of().alias("n_tokens"), order_key(seed).alias("key"))


def bisect(enough: Callable[[float], bool]) -> float:
    """The smallest exponent in [0, 1] that is enough."""
    low, high = 0.0, 1.0
    if enough(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def repeat_exponent(least: float, most: float, max_repeats: float) -> float:
    """A power keeps the order of the shares, so the smallest and the largest tell how often one
    source is repeated while another isn't."""
    return bisect(lambda a: least ** (a - 1) / most ** (a - 1) <= max_repeats)


def entropy_exponent(shares: DataFrame, entropy: float) -> float:
    """The exponent at which the weights' entropy is `entropy` of the most possible. A pass over the
    sources narrows the range by SECTIONS, so a few passes do, however many sources there are."""
    low, high, size = 0.0, 1.0, shares.count()
    for _ in range(-(-STEPS // (SECTIONS.bit_length() - 1))):
        at = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        power = lambda a: F.pow("q", F.lit(a))
        sums = shares.agg(*[f.alias(f"{x}{k}") for k, a in enumerate(at) for x, f in (("z", F.sum(power(a))), ("s", F.sum(power(a) * F.ln("q"))))]).first()
        # The entropy of weights q^a / z falls as the exponent grows.
        good = [log(sums[f"z{k}"]) - a * sums[f"s{k}"] / sums[f"z{k}"] <= entropy * log(size) for k, a in enumerate(at)]
        if good[0]:
            return low
        k = good.index(True) if True in good else SECTIONS
        low, high = at[k - 1], at[k]
    return high


def source_plan(sources: DataFrame, max_repeats: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """source, docs, tokens, weight, whole (times through the whole order), rest (tokens after that).
    sources: a written table. A few sums over it come to the driver, no source does."""
    n = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").withColumn("q", F.col("tokens") / F.lit(float(n)))
    least, most = shares.agg(F.min("q"), F.max("q")).first()
    a = 1.0 if not n else entropy_exponent(shares, entropy) if entropy is not None else repeat_exponent(least, most, max_repeats)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(n)), F.lit(a)))
    weight = F.coalesce(power / F.lit(sources.agg(F.sum(power)).first()[0] or 1.0), F.lit(0.0))
    if budget is None:
        budget = sources.agg(F.max(F.when(weight > 0, F.col("tokens") / weight))).first()[0]
    share = F.round(F.col("weight") * F.lit(float(budget or 0))).cast("long")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(1).cast("long")
    rest = F.when(F.col("tokens") > 0, F.col("share") - F.col("whole") * F.col("tokens")).otherwise(0).cast("long")
    return sources.withColumn("weight", weight).withColumn("share", share).withColumn("whole", whole).select("source", "docs", "tokens", "weight", "whole", rest.alias("rest"))


def placed(docs: DataFrame, scratch: Scratch, max_repeats: float | None, entropy: float | None, budget: int | None, seed: str) -> DataFrame:
    """doc_id, source, n_tokens, key, weight, whole, rest, place: the tokens before a document
    in its source's permutation."""
    rows = scratch.save(measure(docs, seed), "rows")
    sources = scratch.save(rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "sources")
    plan = scratch.save(source_plan(sources, max_repeats, entropy, budget), "plan")
    plan = F.broadcast(plan) if sources.count() <= BROADCAST_SOURCES else plan
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long")
    # Rows of one doc_id and size are interchangeable: one row until they have their places.
    like = rows.groupBy("source", "key", "doc_id", "n_tokens").agg(F.count("*").alias("like"))
    like = like.join(plan, "source").withColumn("block", F.shiftright(F.shiftright("key", 30) * blocks, 30))
    like = like.withColumn("n", F.col("n_tokens") * F.col("like"))
    sums = like.groupBy("source", "block").agg(F.sum("n").alias("n"))
    # A source's blocks go into strips, so that no task has all blocks of a source.
    strip = F.floor(F.col("block") / STRIP).alias("strip")
    strips = sums.groupBy("source", strip).agg(F.sum("n").alias("n"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select("source", "strip", F.coalesce(F.sum("n").over(earlier("source", "strip")), F.lit(0)).alias("ahead"))
    sums = sums.withColumn("strip", strip).select("source", "strip", "block", F.coalesce(F.sum("n").over(earlier("source", "strip", "block")), F.lit(0)).alias("inside")).join(strips, ["source", "strip"])
    sums = sums.select("source", "block", (F.col("ahead") + F.col("inside")).alias("before"))
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    found = like.join(sums, ["source", "block"]).withColumn("first", first)
    # Twice, so that no row holds the places of very many.
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("like") - 1, F.lit(LIKE).cast("long"))))
    found = found.withColumn("nth", F.explode(F.sequence("part", F.least(F.col("part") + LIKE, "like") - 1)))
    return found.withColumn("place", (F.col("first") + F.col("nth") * F.col("n_tokens")).cast("long")).drop("like", "n", "first", "part", "nth")


def mixture(docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: str = "mix") -> DataFrame:
    """doc_id, source, n_tokens, weight, place, copies of every document."""
    rows = placed(docs, Scratch(docs.sparkSession, "mixing"), max_repeats, entropy, budget, seed)
    copies = (F.col("whole") + F.when(F.col("place") < F.col("rest"), 1).otherwise(0)).cast("long")
    return rows.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "place", copies.alias("copies"))


def mix(docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mixture says. Where an order stops is one row
    for each source, so texts are not shuffled, but for rows that share their doc_id with
    the place where their source stops: these are numbered, fewest tokens first."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = placed(docs, scratch, max_repeats, entropy, budget, seed)
    more = F.col("place") < F.col("rest")
    rows = rows.groupBy("source", "key", "doc_id").agg(F.first("whole").alias("whole"), F.sum(F.when(more, 1).otherwise(0)).alias("come"), F.count("*").alias("all"))
    # The first rows in order of which not all come, and how many of them do.
    stop = F.min(F.when(F.col("come") < F.col("all"), F.struct("key", "doc_id", "come")))
    own = unlike(docs.columns)
    stops = rows.groupBy(F.col("source").alias(own("source"))).agg(F.first("whole").alias(own("whole")), stop.alias("stop"))
    most = F.when(F.col("stop.come") > 0, F.col("stop.come"))
    stops = stops.select(own("source"), own("whole"), F.struct("stop.key", "stop.doc_id").alias(own("at")), F.col("stop").isNotNull().alias(own("stops")), most.alias(own("most")))
    stops = scratch.save(stops, "stops")
    divided = not stops.where(F.col(own("most")).isNotNull()).isEmpty()
    stops = F.broadcast(stops) if stops.count() <= BROADCAST_SOURCES else stops
    tagged = docs.withColumn(own("key"), order_key(seed)).join(stops, source_of() == F.col(own("source")))
    at = F.struct(F.col(own("key")).alias("key"), F.col("doc_id").alias("doc_id"))
    more = ~F.col(own("stops")) | F.coalesce(at < F.col(own("at")), F.lit(False))
    whole_rows = tagged.withColumn(own("more"), more)
    if divided:
        at_stop = F.coalesce(F.col(own("most")).isNotNull() & (at == F.col(own("at"))), F.lit(False))
        shared = tagged.where(at_stop).withColumns({own("n"): tokens_of(), own("hash"): F.xxhash64("text")})
        taken = scratch.save(divided_rows(shared.select(F.col(own("source")).alias("source"), F.col(own("n")).alias("n"), F.col(own("hash")).alias("hash"), F.col(own("most")).alias("most"))), "taken")
        taken = taken.select(F.col("source").alias(own("s")), F.col("n").alias(own("t")), F.col("hash").alias(own("h")), F.col("take").alias(own("take")), F.col("all").alias(own("all")))
        same = (F.col(own("source")) == F.col(own("s"))) & (F.col(own("n")) == F.col(own("t"))) & F.col(own("hash")).eqNullSafe(F.col(own("h")))
        shared = shared.join(F.broadcast(taken) if taken.count() <= BROADCAST_SOURCES else taken, same)
        parted = (F.col(own("take")) > 0) & (F.col(own("take")) < F.col(own("all")))
        order = Window.partitionBy(own("source")).orderBy(own("hash"))  # equal texts, of which some come
        numbered = shared.where(parted).withColumn(own("more"), F.row_number().over(order) <= F.col(own("take")))
        numbered = shared.where(~parted).withColumn(own("more"), F.col(own("take")) > 0).unionByName(numbered)
        names = [*docs.columns, own("whole"), own("more")]
        whole_rows = whole_rows.where(~at_stop).select(*map(quoted, names)).unionByName(numbered.select(*map(quoted, names)))
    copies = (F.col(own("whole")) + F.col(own("more")).cast("long")).cast("int")
    return whole_rows.withColumn(own("copy"), F.explode(F.array_repeat(F.lit(0), copies))).select(*map(quoted, docs.columns))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def unlike(columns: list[str]) -> Callable[[str], str]:
    """Names that no column has."""
    mark = "own_"
    while any(c.lower().startswith(mark) for c in columns):
        mark = "_" + mark
    return lambda name: mark + name


def divided_rows(rows: DataFrame) -> DataFrame:
    """source, n, hash, all, take: of the rows (source, n, hash, most) that share the doc_id at which their source
    stops, how many come with each size and text, fewest tokens first. Counted before anything is put in order."""
    counts = rows.groupBy("source", "n", "hash", "most").agg(F.count("*").alias("all"))
    earlier = Window.partitionBy("source").orderBy("n", "hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("all").over(earlier), F.lit(0))
    return counts.select("source", "n", "hash", "all", F.least("all", F.greatest(F.col("most") - before, F.lit(0))).alias("take"))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n_tokens,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
q AS (SELECT source, docs, tokens, tokens / (SELECT sum(tokens) FROM s)::DOUBLE AS q FROM s WHERE tokens > 0),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT step, low, high, (SELECT max(pow(q, (low + high) / 2 - 1)) / min(pow(q, (low + high) / 2 - 1)) FROM q) <= 2.0 AS ok
        FROM bisect WHERE step < {STEPS})),
a AS (SELECT CASE WHEN (SELECT max(1 / q) / min(1 / q) FROM q) <= 2.0 THEN 0.0 ELSE (SELECT high FROM bisect WHERE step = {STEPS}) END AS a),
w AS (SELECT source, docs, tokens, pow(q, a) / (SELECT sum(pow(q, a)) FROM q, a) AS weight FROM q, a),
plan AS (SELECT *, round(weight * (SELECT max(tokens / weight) FROM w))::BIGINT AS share FROM w),
p AS (SELECT doc_id, d.source, n_tokens, key, coalesce(weight, 0) AS weight, s.tokens, coalesce(share, 0) AS share,
             sum(n_tokens) OVER (PARTITION BY d.source ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place
      FROM d JOIN s USING (source) LEFT JOIN plan USING (source))
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, coalesce(place, 0)::BIGINT AS place,
       CASE WHEN tokens > 0 THEN share // tokens + CASE WHEN coalesce(place, 0) < share % tokens THEN 1 ELSE 0 END ELSE 1 END::BIGINT AS copies
FROM p
"""
