"""Mixing sources to target weights, DataFrame functions only.

The words of each source are packed into fixed-length blocks. The mix is a row of output shards of about
SLOTS_PER_SHARD slots each. Every shard draws its source counts from a multinomial over all its slots with the targets'
shares. Independent draws miss a target by the root of its size, and a source might be asked for more than its cap, so
totals are settled afterwards: the surplus of some sources, about that root, goes slot by slot to those that fell short.
Prefix sums of the counts number a source's slots; a slot's ordinal goes through that source's pseudorandom permutation
of block indices, a fresh one for each pass over the source, and slots meet blocks by a join on (source, index), which
carries the shard along.

Hot sources: documents of a source are spread over buckets of about BUCKET_DOCS documents and prefix sums are taken
inside a bucket; no window holds a whole source. Equal rows are told apart by a rank taken in two steps, so neither a
repeated doc_id nor a repeated document lands in one bucket. Cases: a null text has size 0 and is never taken; a null
source is a source of its own, last in order; repeated rows and null doc_ids are mixed row by row; an empty table, or
one without words, gives taken 0 throughout; extra columns don't matter; the result depends neither on the run nor on
how the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_WS, WS, let, materialize, read_table, small, words

BLOCK_WORDS = 64
SLOTS_PER_SHARD, SLOTS_PER_SOURCE = 1 << 12, 64  # a shard has at least so many slots, and so many for each source
MAX_PASSES = 3
BUCKET_DOCS = 4096
RANK_BLOCK = 12  # bits
SMALL_ROWS = 10_000
SEED = 11
#: Primes above any number of slots or blocks (2^61 - 1 and others near 2^60): each is coprime to every smaller modulus.
PRIMES = (2305843009213693951, 1152921504606846883, 1152921504606846869, 1152921504606846803)


def permuted(x: Column, n: Column, salt: Column) -> Column:
    """A permutation of 0..n-1 at x: multiplication by a prime that salt picks, then a shift that salt draws; exact in decimal arithmetic."""
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), F.pmod(salt, F.lit(len(PRIMES))).cast("int") + 1)
    factor = F.pmod(prime, n).cast("decimal(19,0)")
    shift = F.pmod(F.xxhash64(salt), n).cast("decimal(19,0)")
    return ((factor * x.cast("decimal(18,0)") + shift) % n.cast("decimal(19,0)")).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, source_docs, weight, target: weights 1, 2, 3 by rank; a target stops at MAX_PASSES times its size and the rest is shared anew by weight. One row per source; the windows run over these rows only."""
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    src = src.withColumn("source_id", F.row_number().over(by_rank)).withColumn("weight", (F.col("source_id") - 1) % 3 + 1)
    src = src.withColumn("_cap", MAX_PASSES * F.col("source_size"))
    # In order of cap / weight: the sources before the first that can bear the common level are capped.
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), "source_id")
    everything = Window.partitionBy()
    src = src.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.row_number().over(fill.rowsBetween(Window.unboundedPreceding, 0)), "_level"))).over(everything)["_level"])
    return src.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"))).drop("_cap", "_level")


def ranked(sized: DataFrame) -> DataFrame:
    """sized plus rank: 0, 1, ... among rows of equal doc_id and text hash. Within blocks of row numbers first, then over the blocks."""
    keys = ["doc_id", "text_hash"]
    df = sized.withColumn("_b", F.shiftright("_rid", RANK_BLOCK))
    blocks = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.sum("_n").over(before)).where("_before > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_block"), "_before")
    same = F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_hash") == F.col("text_hash")) & (F.col("_block") == F.col("_b"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_rid")) - 1
    return df.withColumn("rank", inside).join(blocks.hint("merge"), same, "left").withColumn("rank", F.col("rank") + F.coalesce("_before", F.lit(0))).select(*sized.columns, "rank")


def draw(counts: DataFrame) -> DataFrame:
    """source_id, blocks, shard, first, n: how many slots of each shard a source gets, and the source's slots in the shards before. From source_id, blocks, expected (blocks that the target takes, a real number); one row per source."""
    everything, by_id = Window.partitionBy(), Window.orderBy("source_id")
    before = lambda c: F.coalesce(F.sum(c).over(by_id.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    src = counts.withColumn("_sum", F.sum("expected").over(everything)).withColumn("_all", F.round("_sum").cast("long")).where("_all > 0")
    src = src.withColumn("_from", before("expected") / F.col("_sum")).withColumn("_to", F.sum("expected").over(by_id.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_sum"))
    whole = lambda c: F.floor(F.col(c) * F.col("_all") + 0.5)
    src = src.withColumn("quota", whole("_to") - whole("_from"))
    least = F.greatest(F.lit(SLOTS_PER_SHARD), SLOTS_PER_SOURCE * F.count("*").over(everything))
    src = src.withColumn("_shards", F.greatest(F.lit(1), F.floor(F.col("_all") / least)))
    cells = src.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shards") - 1)))

    # The multinomial: each slot's uniform number falls into the stretch of one source.
    edge = lambda k: F.floor(k * F.col("_all") / F.col("_shards"))
    slots = cells.groupBy("shard").agg(F.first(edge(F.col("shard") + 1) - edge(F.col("shard"))).alias("_slots"))
    slots = slots.select("shard", F.explode(F.sequence(F.lit(1), F.col("_slots").cast("int"))).alias("_draw"))
    uniform = (F.pmod(F.xxhash64("shard", "_draw", F.lit(SEED)), F.lit(1 << 53)) / float(1 << 53)).alias("_at")
    both = cells.select("shard", F.col("_from").alias("_at"), F.lit(0).alias("_draw"), "source_id")
    both = both.union(slots.select("shard", uniform, "_draw", F.lit(None).cast("int").alias("source_id")))
    met = F.last("source_id", ignorenulls=True).over(Window.partitionBy("shard").orderBy("_at", "_draw").rowsBetween(Window.unboundedPreceding, 0))
    drawn = both.select("shard", "_draw", met.alias("source_id")).where("_draw > 0").groupBy("shard", "source_id").agg(F.count("*").alias("n"))
    cells = cells.select("source_id", "blocks", "quota", "shard").join(drawn.hint("merge"), ["shard", "source_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _settled(materialize(cells, "drawn"))


def _settled(cells: DataFrame) -> DataFrame:
    """Draws whose totals are the quotas: a source with too many slots gives up the surplus, evenly over those it drew, and sources with too few take these slots in pseudorandom order. See draw()."""
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    src = cells.groupBy("source_id").agg(F.sum("n").alias("_total"), F.first("quota").alias("_quota"))
    src = src.withColumn("_over", F.greatest(F.col("_total") - F.col("_quota"), F.lit(0))).withColumn("_under", F.greatest(F.col("_quota") - F.col("_total"), F.lit(0)))
    src = src.withColumns({"_over_at": before("_over"), "_under_at": before("_under"), "_moved": F.sum("_over").over(Window.partitionBy())})
    src = materialize(src, "totals")
    upto = F.sum("n").over(Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.drop("quota").join(small(src.select("source_id", "_total", "_over", "_over_at", "_moved"), SMALL_ROWS), "source_id").withColumn("_upto", upto)
    cells = cells.withColumn("_hi", F.expr("if(_over = 0, 0, _upto * _over div _total)")).withColumn("_lo", F.expr("if(_over = 0, 0, (_upto - n) * _over div _total)"))
    given = cells.where("_hi > _lo").select("shard", "_moved", F.explode(F.sequence(F.col("_over_at") + F.col("_lo"), F.col("_over_at") + F.col("_hi") - 1)).alias("_k"))
    given = given.select("shard", permuted(F.col("_k"), F.col("_moved"), F.lit(SEED).cast("long")).alias("_unit"))
    wanted = src.where("_under > 0").select("source_id", F.explode(F.sequence(F.col("_under_at"), F.col("_under_at") + F.col("_under") - 1)).alias("_unit"))
    gained = given.join(wanted.hint("merge"), "_unit").groupBy("shard", "source_id").agg(F.count("*").alias("_gain"))
    cells = cells.join(gained.hint("merge"), ["shard", "source_id"], "left").withColumn("n", F.col("n") - (F.col("_hi") - F.col("_lo")) + F.coalesce("_gain", F.lit(0)))
    before_shard = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("source_id", "blocks", "shard", F.coalesce(F.sum("n").over(before_shard), F.lit(0)).alias("first"), "n")


def plan_mix(sized: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (_rid, doc_id, source, size, text_hash): the rows with source_size and target; pieces (_rid, first, last, shards: words first..last-1 of the document lie in a block that these shards use, one entry for each use); the draws (see draw)."""
    src = materialize(targets(sized), "sources")
    docs = ranked(sized).join(small(src, SMALL_ROWS), sized["source"].eqNullSafe(src["source"])).drop(src["source"])
    bucket = F.pmod(F.xxhash64("doc_id", "text_hash", "rank", F.lit(SEED)), F.ceil(F.col("source_docs") / BUCKET_DOCS))
    docs = materialize(docs.withColumn("bucket", bucket), "rows")
    inside = Window.partitionBy("source_id", "bucket").orderBy("doc_id", "text_hash", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.where("size > 0").withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    length = docs.where("size > 0").groupBy("source_id", "bucket").agg(F.sum("size").alias("words"))
    length = length.withColumn("n", F.ceil(F.col("words") / BLOCK_WORDS))
    before = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    length = materialize(length.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source_id", "bucket", "base", "n"), "buckets")
    counts = length.groupBy("source_id").agg(F.sum("n").alias("blocks")).join(src, "source_id")
    counts = counts.select("source_id", "blocks", (F.col("target") * F.col("blocks") / F.col("source_size")).alias("expected"))
    draws = materialize(draw(counts), "draws")

    slots = draws.where("n > 0").repartition(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id", "shard")
    slots = slots.withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    turn = F.floor(F.col("k") / F.col("blocks"))
    index = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.abs(F.xxhash64("source_id", turn, F.lit(SEED)) % (1 << 40)))
    slots = slots.where(turn < MAX_PASSES).select("source_id", index.alias("index"), "shard")

    # A block is used once in a pass, so the list is short.
    uses = slots.groupBy("source_id", "index").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    pieces = placed.join(small(length, SMALL_ROWS), ["source_id", "bucket"])
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)))
    pieces = pieces.select("_rid", "source_id", "base", "start", "size", block.alias("b"))
    pieces = pieces.select(
        "_rid", "source_id", (F.col("base") + F.col("b")).alias("index"),
        F.greatest(F.col("b") * BLOCK_WORDS - F.col("start"), F.lit(0)).alias("first"), F.least((F.col("b") + 1) * BLOCK_WORDS - F.col("start"), F.col("size")).alias("last"),
    )
    # Spark takes exploded rows for as few as they came from and would broadcast them; this side grows with the corpus.
    return docs, pieces.hint("merge").join(uses.hint("merge"), ["source_id", "index"]).select("_rid", "first", "last", "shards"), draws


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text) plus size, text_hash and _rid."""
    return docs.select("*", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("_rid"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: the c-th copy of a document (up to 3) has the words in blocks that the mix uses c times or more, with the white space that follows them; a copy of all words is the text itself. docs' columns."""
    text = F.coalesce(F.col("_row")["text"], F.lit(""))  # texts are written and shuffled inside their row only
    kept = materialize(with_sizes(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")).drop("text"), "sized")
    _, pieces, _ = plan_mix(kept.select("_rid", "doc_id", "source", "size", "text_hash"))
    kept = kept.select("_rid", "_row", "size")
    parts = pieces.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("first", "last", F.size("shards").alias("uses")))).alias("_parts"))
    df = kept.join(parts, "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_parts", lambda p: p["uses"])))))
    df = df.withColumn("_use", F.filter("_parts", lambda p: p["uses"] >= F.col("_copy")))
    n_used = F.aggregate("_use", F.lit(0).cast("long"), lambda a, p: a + p["last"] - p["first"])
    # Each word with the white space after it; white space before the first word goes.
    units = F.array_remove(F.split(F.regexp_replace(text, f"^{WS}+", ""), f"(?<={WS})(?={NOT_WS})"), "")
    some = let(units, lambda u: F.array_join(F.transform(F.col("_use"), lambda p: F.array_join(F.slice(u, (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int")), "")), ""))
    df = df.withColumn("_new", F.when(n_used == F.col("size"), text).otherwise(F.regexp_replace(some, f"{WS}+$", "")))
    cols = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return df.select(*[cols.get(f.name, F.col("_row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: source, and shards, the output shards that take words of the document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = materialize(with_sizes(docs).drop("text"), "sized")
    rows, pieces, _ = plan_mix(sized)
    taken = pieces.groupBy("_rid").agg(F.sum((F.col("last") - F.col("first")) * F.size("shards")).alias("taken"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("shards"))
    return rows.join(taken, "_rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))
