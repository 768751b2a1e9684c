"""Mixing sources to target weights: fixed-length blocks of words, drawn by source.

DataFrame functions only. Each source's documents, in the order of a hash of their ids, make
one stream of words that is cut into blocks. Output shards have a fixed number of slots; the
sources of a shard's slots are a multinomial draw. What a source is drawn beyond its quota
goes to the sources that were drawn too little, so every source meets its target. The k-th
slot of a source takes the block at place k of a pseudorandom permutation of its blocks
(a swap-or-not shuffle, exact on any number of blocks; a new one for each pass). A source's
last block is cut to what its target lacks, so a source of few words meets it, too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import md5_int, running_start, table
from tidewatch.plans.materialize import broadcast_if_small, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights: of the sources by code point, null last, repeating. The share of all words
    that the mix has, as a fraction. cap: times a source's size that its target may reach.
    slots_per_task: slots that a task draws and permutes, more where that would make over
    most_tasks tasks; slots are few bytes but much work, so their bytes must not set it."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    block: int = 256
    slots: int = 64
    rounds: int = 12
    seed: str = "mix"
    rows_per_chunk: int = 4096
    slots_per_task: int = 16384
    most_tasks: int = 50_000


def source_plan(sized: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: rank, source_size, target, blocks, quota of blocks, and how many words
    the last of these blocks gives.

    Filling to a level: in the order of cap by weight a source is capped if its cap is at
    most its share of what the ones before leave.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in mix.weights])
    rows = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    rows = rows.withColumn(
        "w", F.element_at(weights, F.pmod("rank", F.lit(len(mix.weights))).cast("int") + 1)
    ).withColumn("c", F.col("source_size") * mix.cap)
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("words", F.sum("source_size").over(every) * F.lit(mix.share))
    order = Window.orderBy(F.col("c") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("c_before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    rows = rows.withColumn("w_after", F.sum("w").over(after))
    rows = rows.withColumn(
        "capped", F.col("c") * F.col("w_after") <= (F.col("words") - F.col("c_before")) * F.col("w")
    )
    left = F.col("words") - F.sum(F.when(F.col("capped"), F.col("c")).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every)
    rows = rows.withColumn("left", left).withColumn("open_w", open_w)
    rows = rows.withColumn(
        "target",
        F.when(F.col("capped"), F.col("c").cast("double")).otherwise(
            F.col("w") * F.col("left") / F.col("open_w")
        ),
    )
    rows = rows.withColumn("blocks", F.expr(f"(source_size + {mix.block - 1}) div {mix.block}"))
    passes = F.floor(F.col("target") / F.col("source_size"))
    # Words beyond whole passes, in full blocks and a rest.
    rest = F.floor(F.col("target") - passes * F.col("source_size") + 0.5).cast("long")
    filled = F.col("source_size") > 0
    rows = rows.withColumn("rest", F.when(filled, rest).otherwise(0))
    some = F.when(filled, passes * F.col("blocks")).otherwise(0)
    rows = rows.withColumn("quota", (some + F.expr(f"(rest + {mix.block - 1}) div {mix.block}")).cast("long"))
    last = F.when(F.col("rest") > 0, F.expr(f"(rest - 1) % {mix.block} + 1")).otherwise(F.lit(mix.block))
    return rows.withColumn("last_words", last.cast("long")).select(
        "source", "rank", "source_size", "target", "blocks", "quota", "last_words"
    )


def permuted(index: Column, n: Column, key: Column, rounds: int) -> Column:
    """Place of ``index`` in a pseudorandom permutation of 0 .. n-1 chosen by ``key``.

    A round pairs x with (k - x) mod n and swaps them or not by a hash of the larger one, so
    every round, and the whole, is a bijection.
    """

    def turn(r: Column) -> Column:
        name = F.concat_ws(":", key, r.cast("string"))
        return F.struct(name.alias("name"), (md5_int(name) % n).alias("shift"))

    def step(x: Column, r: Column) -> Column:
        def chosen(other: Column) -> Column:
            coin = F.md5(F.concat_ws(":", r["name"], F.greatest(x, other).cast("string")))
            return F.when(F.substring(coin, 1, 1) < "8", other).otherwise(x)

        # The partner goes through a one-element array, so that it is computed once.
        return F.get(F.transform(F.array(F.pmod(r["shift"] - x, n)), chosen), F.lit(0))

    turns = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), turn)
    return F.aggregate(turns, index.cast("long"), step)


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def placed_documents(sized: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """Documents with words, each with the place of its first word in its source's stream."""
    rows = max(1, sized.count())
    digits = max(1, -(-(rows // mix.rows_per_chunk).bit_length() // 4))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    known = broadcast_if_small(plan).withColumnRenamed("source", "plan_source")
    with_rank = sized.filter("size > 0").join(known, F.col("source").eqNullSafe(F.col("plan_source")))
    keyed = with_rank.withColumn("h", key).withColumn("chunk", F.substring("h", 1, digits))
    return running_start(keyed, ["rank"], "chunk", ["h", "doc_id", "size"], "size")


def _ranges(rows: DataFrame, length: str) -> DataFrame:
    """Add ``begin`` and ``end``: rows in the order of their rank, end to end, ``length`` long."""
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(length).over(before), F.lit(0))
    return rows.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col(length))


def _owned(rows: DataFrame, at: str, ranges: DataFrame) -> DataFrame:
    """Rows beside the range (begin, end, more) that ``at`` lies in, if there is one.

    Ranges are cut into buckets, about four for each, so that place meets range by equality.
    """
    n, top = ranges.filter("begin < end").agg(F.count(F.lit(1)), F.max("end")).first()
    width = max(1, (top or 0) // (4 * n + 1))
    cut = ranges.filter("begin < end").withColumn(
        "_bucket", F.explode(F.expr(f"sequence(begin div {width}, (end - 1) div {width})"))
    )
    cut = broadcast_if_small(written(cut, "mix-ranges"))
    placed = rows.withColumn("_at", F.expr(f"{at} div {width}"))
    inside = (F.col("_at") == F.col("_bucket")) & (F.col(at) >= F.col("begin")) & (F.col(at) < F.col("end"))
    return placed.join(cut, inside, "left").drop("_at", "_bucket", "begin", "end")


def drawn_slots(plan: DataFrame, mix: Mix) -> DataFrame:
    """Rows (shard, slot, rank, block, pass, cut): which block stands in which slot, and up to
    how many of its words.

    Sources are met as rows of tables, however many there are; nothing here depends on the
    number of documents but the range of slots.
    """
    spark = plan.sparkSession
    quotas = written(_ranges(plan.select("rank", "quota", "blocks", "last_words"), "quota"), "mix-quotas")
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    tasks = min(mix.most_tasks, total // mix.slots_per_task + 1)
    slots = spark.range(0, total, 1, max(tasks, spark.sparkContext.defaultParallelism)).select(
        F.expr(f"id div {mix.slots}").alias("shard"), F.expr(f"id % {mix.slots}").alias("slot")
    )
    draw = md5_int(F.concat_ws(":", F.lit(mix.seed), F.col("shard").cast("string"), F.col("slot").cast("string")), 15)
    slots = _owned(slots.withColumn("draw", draw % F.lit(max(1, total))), "draw", quotas.select("rank", "begin", "end"))
    counts = written(
        slots.groupBy("shard", "rank").agg(F.sort_array(F.collect_list("slot")).alias("places"))
        .withColumn("n", F.size("places")).withColumn("chunk", F.expr("shard div 1024")),
        "mix-counts",
    )
    drawn = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    sources = quotas.drop("begin", "end").join(drawn, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    sources = sources.withColumn("surplus", F.greatest(F.col("got") - F.col("quota"), F.lit(0)))
    sources = sources.withColumn("missing", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    sources = _ranges(sources, "surplus").withColumnRenamed("begin", "surplus_from").drop("end")
    sources = written(_ranges(sources, "missing"), "mix-sources")
    known = broadcast_if_small(sources)
    started = running_start(counts, ["rank"], "chunk", ["shard"], "n")
    placed = started.repartition(tasks, "shard", "rank").select(
        "shard", "rank", "start", F.posexplode("places").alias("j", "slot")
    )
    # What a source was drawn beyond its quota, one after the other, goes to those that lack.
    placed = placed.join(known.select("rank", "quota", "surplus_from"), "rank").withColumn("k", F.col("start") + F.col("j"))
    over = F.when(F.col("k") >= F.col("quota"), F.col("k") - F.col("quota") + F.col("surplus_from"))
    takers = sources.select(
        F.col("rank").alias("taker"), (F.col("got") - F.col("begin")).alias("taker_from"), "begin", "end"
    )
    placed = _owned(placed.withColumn("over", over).drop("quota", "surplus_from"), "over", takers)
    placed = placed.withColumn("k", F.coalesce(F.col("taker_from") + F.col("over"), F.col("k")))
    placed = placed.select("shard", "slot", F.coalesce("taker", "rank").alias("rank"), "k")
    placed = placed.join(known.select("rank", "quota", "blocks", "last_words"), "rank")
    placed = placed.withColumn("pass", F.expr("k div blocks"))
    key = F.concat_ws(":", F.lit(mix.seed), F.col("rank").cast("string"), F.col("pass").cast("string"))
    at = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), key, mix.rounds)
    words = F.when(F.col("k") == F.col("quota") - 1, F.col("last_words")).otherwise(F.lit(mix.block))
    return placed.select("shard", "slot", F.col("rank").cast("long"), at.alias("block"), "pass", words.alias("cut"))


def _pieces(placed: DataFrame, mix: Mix) -> DataFrame:
    """A row for each block that a document has words in, with its part of them."""
    b = mix.block
    rows = placed.withColumn(
        "block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})"))
    )
    first = F.greatest(F.col("start"), F.col("block") * b)
    return rows.withColumn("from", first - F.col("start")).withColumn(
        "words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - first
    )


def mixed_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """How many of each document's words the mix takes, repeats counted.

    Columns doc_id, size, source_size, target, taken; one row for each row of ``docs``. A
    null or empty text has size 0 and taken 0, and so has a source without words (target 0).
    Null is a source of its own, the last. Repeated rows are separate documents.
    """
    sized = written(sized_documents(docs), "mix-sizes")
    plan = written(source_plan(sized, mix), "mix-plan")
    whole = F.col("cut") == mix.block
    used = drawn_slots(plan, mix).groupBy("rank", "block").agg(
        F.count_if(whole).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("cut"))), F.lit(0)).alias("cut")
    )
    begin = F.col("start") + F.col("from") - F.col("block") * mix.block  # of the piece in its block
    cut = F.greatest(F.lit(0), F.least(begin + F.col("words"), F.coalesce("cut", F.lit(0))) - begin)
    pieces = _pieces(placed_documents(sized, plan, mix), mix).withColumn("rank", F.col("rank").cast("long"))
    kept = ["doc_id", "size", "source_size", "target"]
    taken = (
        pieces.join(used, ["rank", "block"], "left")
        .groupBy(*kept, "rank", "start")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0)) + cut).cast("long").alias("taken"))
        .select(*kept, "taken")
    )
    known = broadcast_if_small(plan).withColumnRenamed("source", "plan_source")
    empty = sized.filter("size = 0").join(known, F.col("source").eqNullSafe(F.col("plan_source")))
    return taken.unionByName(empty.select(*kept, F.lit(0).cast("long").alias("taken")))


def mixed_shards(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: rows (shard, slot, source, text), each text one block of words."""
    sized = written(sized_documents(docs), "mix-sizes")
    plan = written(source_plan(sized, mix), "mix-plan")
    texts = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.expr("array()")).alias("all")
    ).withColumn("size", F.size("all").cast("long"))
    pieces = _pieces(placed_documents(texts, plan, mix), mix)
    part = F.slice("all", F.col("from").cast("int") + 1, F.col("words").cast("int"))
    blocks = pieces.groupBy("source", F.col("rank").cast("long").alias("rank"), "block").agg(
        F.array_join(
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", part.alias("p")))), lambda s: s["p"])), " "
        ).alias("text")
    )
    slots = drawn_slots(plan, mix).join(blocks, ["rank", "block"])
    # A block cut short keeps its first words.
    text = F.when(F.col("cut") < mix.block, F.call_function("substring_index", F.col("text"), F.lit(" "), F.col("cut").cast("int"))).otherwise(F.col("text"))
    return slots.select("shard", "slot", "source", text.alias("text"))


def op2_mix(spark, sf_dir: str) -> DataFrame:
    return mixed_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _sql(mix: Mix = Mix()) -> str:
    b = mix.block
    rounds = []
    for r in range(mix.rounds):
        was = "perm" if r == 0 else f"r{r - 1}"
        key = f"key || ':{r}'"
        rounds.append(
            f"o{r} AS (SELECT *, ((('0x' || substr(md5({key}), 1, 12))::BIGINT % blocks - x) % blocks + blocks)"
            f" % blocks AS y FROM {was}),\n"
            f"r{r} AS (SELECT rank, blocks, cut, key, CASE WHEN substr(md5({key} || ':' || greatest(x, y)), 1, 1)"
            f" < '8' THEN y ELSE x END AS x FROM o{r})"
        )
    return rf"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INT] AS w, source_size * {mix.cap} AS c,
  sum(source_size) OVER ()::BIGINT * {mix.share}::DOUBLE AS words FROM s1),
s3 AS (SELECT *, coalesce(sum(c) OVER (ORDER BY c::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_before,
  sum(w) OVER (ORDER BY c::DOUBLE / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_after FROM s2),
s4 AS (SELECT *, c * w_after <= (words - c_before) * w AS capped FROM s3),
s5 AS (SELECT *, words - sum(CASE WHEN capped THEN c ELSE 0 END) OVER ()::BIGINT AS rest,
  sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()::BIGINT AS open_w FROM s4),
s6 AS (SELECT source, rank, source_size, CASE WHEN capped THEN c::DOUBLE ELSE w * rest / open_w END AS target,
  (source_size + {b - 1}) // {b} AS blocks FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target - floor(target / source_size) * source_size + 0.5)::BIGINT
  ELSE 0 END AS over FROM s6),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT * blocks ELSE 0 END
  + (over + {b - 1}) // {b} AS quota, CASE WHEN over > 0 THEN (over - 1) % {b} + 1 ELSE {b} END AS last_words FROM s7),
slots AS (SELECT rank, blocks, quota, last_words, unnest(range(quota)) AS k FROM plan),
perm AS (SELECT rank, blocks, CASE WHEN k = quota - 1 THEN last_words ELSE {b} END AS cut,
  '{mix.seed}:' || rank || ':' || (k // blocks) AS key, k % blocks AS x FROM slots),
{",".join(rounds)},
used AS (SELECT rank, x AS block, count(*) FILTER (cut = {b}) AS times,
  coalesce(max(cut) FILTER (cut < {b}), 0) AS cut FROM r{mix.rounds - 1} GROUP BY ALL),
placed AS (SELECT s.rid, s.doc_id, s.size, p.rank,
  coalesce(sum(s.size) OVER (PARTITION BY p.rank ORDER BY md5(coalesce(s.doc_id::VARCHAR, 'null')), s.doc_id, s.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE s.size > 0),
pieces AS (SELECT *, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) AS block FROM placed),
taken AS (SELECT rid, sum((least(start + size, (i.block + 1) * {b}) - greatest(start, i.block * {b}))
  * coalesce(times, 0) + greatest(0, least(start + size, i.block * {b} + coalesce(cut, 0))
  - greatest(start, i.block * {b})))::BIGINT AS taken FROM pieces i LEFT JOIN used u ON i.rank = u.rank AND i.block = u.block GROUP BY rid)
SELECT s.doc_id, s.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN taken t USING (rid)
"""


OP2_SQL = _sql()
