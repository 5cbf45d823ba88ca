"""Temperature mixing of sources, realised as budgeted block permutations.

Only DataFrame functions: nothing here runs Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.llm.shared import at_place, join_counted, tasks_for
from codestrata.session import stage

#: Fixed value: a token here is a run without ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Exponents tried per round; each round narrows the bracket by this factor.
SECTIONS = 32
ROUNDS = 6
#: Decimals the exponent and the weights are rounded to.
EXPONENT_DECIMALS, WEIGHT_DECIMALS = 6, 9
_LOCAL_BITS = 33
#: Copies of a row that are made from one array; more are made in steps.
RUN = 4096
#: Facts of the sources are broadcast up to this many bytes, and joined by exchange above.
BROADCAST_BYTES = 8 << 20


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def source_tokens(documents: DataFrame) -> DataFrame:
    """(source, tokens, docs) of the sources that have tokens; null is a source of its own."""
    return documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).filter("tokens > 0")


def _measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy and largest over smallest rate of repetition, per exponent, in one aggregation."""
    total = sources.agg(F.sum("tokens").alias("total")).first()["total"]
    a = F.col("a")
    per = (
        sources.select(F.explode(F.array(*map(F.lit, exponents))).alias("a"), (F.col("tokens") / F.lit(total)).alias("p"))
        .groupBy("a").agg(
            F.sum(F.pow("p", a)).alias("z"),
            F.sum(F.pow("p", a) * F.log("p")).alias("zl"),
            F.max(F.pow("p", a - 1)).alias("most"), F.min(F.pow("p", a - 1)).alias("least"),
        )
        .select("a", (F.log("z") - a * F.col("zl") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("repeats"))
    )
    found = {r["a"]: (r["entropy"], r["repeats"]) for r in per.collect()}  # one row per exponent
    return [found.get(e, (0.0, 1.0)) for e in exponents]


def find_exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """Exponent in [0, 1] by repeated division of the bracket.

    With ``entropy``, a share of the logarithm of the number of sources: the
    largest exponent whose weights reach it. With ``repeats``: the smallest
    exponent for which no source is repeated more than so many times as often as
    another. Both measures fall or rise with the exponent alone, so bisection is
    exact up to the last round's width. Sources that already meet the entropy
    give 1; where no exponent does, 0.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give either entropy or repeats")
    n = sources.count()
    if n < 2:
        return 1.0
    target = F.lit(entropy) if entropy is not None else None
    low, high = 0.0, 1.0
    if entropy is not None:
        goal = sources.agg((target * F.log(F.count(F.lit(1)))).alias("h")).first()["h"]
        reached = lambda m: m[0] >= goal  # noqa: E731  true up to the wanted exponent
        if reached(_measures(sources, [1.0])[0]):
            return 1.0
    else:
        reached = lambda m: m[1] > repeats
        if not reached(_measures(sources, [0.0])[0]):
            return 0.0
    for _ in range(ROUNDS):
        step = (high - low) / SECTIONS
        tried = [low + step * k for k in range(1, SECTIONS)]
        good = [reached(m) for m in _measures(sources, tried)]
        k = good.index(False) if False in good else len(good)
        low, high = ([low, *tried][k], [*tried, high][k])
    return round(low if entropy is not None else high, EXPONENT_DECIMALS)


def budgets(sources: DataFrame, exponent: float, tokens: int | None = None) -> DataFrame:
    """(source, tokens, docs, weight, budget) with weight proportional to share ** exponent.

    ``tokens`` is the size of the mixture; left out, it is the least size that
    uses every source once at least, so nothing is lost.
    """
    total = sources.agg(F.sum("tokens").alias("total")).first()["total"] or 1
    raw = sources.withColumn("_w", F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)))
    z = raw.agg(F.sum("_w").alias("z")).first()["z"] or 1.0
    weighted = raw.withColumn("_share", F.col("_w") / F.lit(z))
    if tokens is None:
        need = weighted.agg(F.max(F.col("tokens") / F.col("_share")).alias("need")).first()["need"]
        size = F.lit(need or 1.0)
    else:
        size = F.lit(float(tokens))
    # only the reported weight is rounded: a small source's would be rounded away
    budget = F.ceil(F.col("_share") * size - F.lit(1e-3)).cast("long")
    return weighted.select("source", "tokens", "docs", F.round("_share", WEIGHT_DECIMALS).alias("weight"), budget.alias("budget"))


def order_key(*parts: Column | str) -> Column:
    """Random but repeatable order of the documents of a source."""
    return F.md5(F.concat_ws("/", *parts).cast("binary"))


def repeated(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``name``; no array is longer than RUN or times / RUN."""
    first = F.col("_step") * RUN
    return (
        rows.withColumn("_times", times.cast("long")).filter("_times > 0")
        .withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / RUN))))
        .withColumn(name, F.explode(F.sequence(first, F.least(first + RUN, F.col("_times")) - 1)))
        .drop("_times", "_step")
    )


def running_tokens(documents: DataFrame, order: list[str], tasks: int | None = None) -> DataFrame:
    """Add ``before``: the tokens of the same source ahead of the row in ``order``.

    Rows are range-partitioned by source and order, so that a source of any size
    spreads over many tasks, and numbered inside each partition; sums per
    (source, partition), of which there are few, give the offsets; given ``tasks``,
    so many tasks at most pass them on.
    """
    placed = stage(
        documents.repartitionByRange("source", *order).sortWithinPartitions("source", *order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    inside = Window.partitionBy("_part", "source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "_part").agg(F.sum("n_tokens").alias("_sum"))
    pieces = (sums if tasks is None else sums.coalesce(tasks)).select(
        F.col("source").alias("_source"), F.col("_part").alias("_piece"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_ahead"),
    )
    return (
        placed.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(pieces, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_piece")), "left")
        .withColumn("before", F.col("_ahead") + F.col("_in"))
        .drop("_at", "_part", "_in", "_source", "_piece", "_ahead")
    )


def mix(
    documents: DataFrame, entropy: float | None = None, repeats: float | None = None, tokens: int | None = None,
    blocks: int = 64, seed: int = 17,
) -> DataFrame:
    """Which copy of which document the mixture holds, and where.

    ``documents`` has doc_id, source and n_tokens. Each source passes through its
    own stream: one whole permutation after another, each by its own hash order,
    as far as its budget reaches; a document is in if it begins within it. The
    stream is laid over ``blocks`` blocks of equal length, so every block holds
    the sources in the target weights; inside a block documents of all sources
    are permuted again. Returns doc_id, source, n_tokens, epoch (from 0), start
    (tokens of its source's stream before it), block and place (the order inside
    the block). Documents without tokens stay, once, at their place. Rows with
    equal doc_id count as documents of their own; null sources form a source,
    null ids and texts are ordinary values. An empty table gives an empty result.
    """
    named = stage(documents.select(F.col("doc_id").cast("long"), "source", "n_tokens", F.monotonically_increasing_id().alias("_row")))
    sources = stage(source_tokens(named))
    exponent = find_exponent(sources, entropy, repeats)
    plan = budgets(sources, exponent, tokens).withColumn("epochs", F.expr("(budget + tokens - 1) div tokens"))
    joined = named.join(
        plan.select(F.col("source").alias("_source"), F.col("tokens").alias("_all"), "budget", "epochs"),
        F.col("source").eqNullSafe(F.col("_source")), "left",
    ).drop("_source")
    seeded = F.lit(str(seed))
    copies = repeated(joined, F.greatest(F.coalesce(F.col("epochs"), F.lit(1)), F.lit(1)), "epoch")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = copies.withColumn("_key", order_key(seeded, F.col("epoch").cast("string"), doc))
    placed = running_tokens(keyed, ["epoch", "_key", "doc_id", "_row"])
    inside = F.col("before") < F.coalesce(F.col("budget"), F.lit(1))
    free = F.col("n_tokens") == 0
    kept = placed.filter(F.when(free, F.col("epoch") == 0).otherwise(inside))
    block = F.least(F.floor(F.col("before") * blocks / F.greatest(F.coalesce("budget", F.lit(1)), F.lit(1))), F.lit(blocks - 1))
    return kept.select(
        "doc_id", "source", "n_tokens", F.col("epoch").cast("int"), F.col("before").alias("start"), block.cast("int").alias("block"),
        order_key(seeded, F.lit("block"), F.col("epoch").cast("string"), doc).alias("place"),
    )


def mix_rows(
    documents: DataFrame, entropy: float | None = None, repeats: float | None = None, tokens: int | None = None, seed: int = 17,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of ``documents``, each as often as the mixture holds it, columns unchanged.

    The texts stay where they are read. A source's budget is a number of whole
    epochs, which is a count, and a part of one more, which holds the rows up to
    the last one that begins within it: one row of facts per source, found from
    narrow rows and joined to the texts (``broadcast_bytes`` decides how, not
    what). A row is known by its place, so rows with one doc_id, repeated rows and
    rows without doc_id are documents of their own; null sources form a source;
    documents without words stay once. An empty table gives an empty result, and
    column names cannot clash.
    """
    rows = at_place(documents)
    given = F.col("row")
    text, doc = given["text"].cast("string"), F.coalesce(given["doc_id"].cast("long").cast("string"), F.lit(""))
    known = rows.select(
        "row", given["source"].alias("source"), doc.alias("doc"), F.xxhash64(text).alias("tie"), "file", "at",
    )
    narrow = stage(known.select("source", "doc", "tie", "file", "at", token_count(text).alias("n_tokens")))
    tasks = tasks_for(narrow.count())  # of steps that have a row per source, or less than a row per document
    sources = stage(source_tokens(narrow).coalesce(tasks))
    size = sources.agg((F.sum(F.coalesce(F.octet_length("source"), F.lit(0))) + 256 * F.count(F.lit(1))).alias("size")).first()["size"] or 0
    plan = stage(
        budgets(sources, find_exponent(sources, entropy, repeats), tokens)
        .select("source", F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest"))
    )

    def with_plan(left: DataFrame, facts: DataFrame, values: list[str]) -> DataFrame:
        if size <= broadcast_bytes:
            right = F.broadcast(facts.select(F.col("source").alias("_source"), *values))
            return left.join(right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        return join_counted(left, facts, "source", values)

    counts = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("_rows")).coalesce(tasks)
    plan = stage(
        counts.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").coalesce(tasks)
    )
    key = order_key(F.lit(str(seed)), F.col("full").cast("string"), F.col("doc"))
    place = F.struct(key.alias("key"), "doc", "tie", "file", "at")
    last_epoch = with_plan(narrow.filter("n_tokens > 0"), plan, ["full", "rest"]).filter("rest > 0").withColumn("key", key)
    taken = running_tokens(last_epoch, ["key", "doc", "tie", "file", "at"], tasks).filter("before < rest").coalesce(tasks)
    ends = taken.groupBy("source").agg(F.max(F.struct("key", "doc", "tie", "file", "at")).alias("end")).withColumnRenamed("source", "_source")
    facts = stage(plan.join(ends.coalesce(tasks), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").coalesce(tasks))
    words = F.coalesce(text.rlike(TOKEN), F.lit(False))
    times = F.when(words, F.col("full") + F.coalesce(place <= F.col("end"), F.lit(False)).cast("long")).otherwise(1)
    return repeated(with_plan(known, facts, ["full", "end"]), times, "copy").select("row.*")
