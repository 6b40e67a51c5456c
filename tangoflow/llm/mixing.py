"""Mixing sources to target weights by entropy balancing (DataFrame functions
only).

Document rates minimise the relative entropy to "take everything once" under
one token constraint per source, ``sum(rate * size) = target``, and the bound
``rate <= cap``.  The dual has one variable per source, and its solution tilts
exponentially: ``rate = min(cap, exp(lam * size / mean size))``.  Newton
iterations on the dual run over the (source, size, number of documents)
histogram: one small aggregation each, kept in their bracket by bisection.
Sums are of scaled integers, so reruns agree to the bit.

Rounding: a document gets ``floor(rate)`` copies, and one more if its seeded
hash, less the rate's fraction, is below its source's threshold.  The
threshold is found by three histogram refinements of 4096 bins each.  The
words then still missing are filled in the same way from the later documents
that fit, pass by pass, until none does: a source misses its target by less
than any document that could have one more copy.

Nothing is partitioned by source alone: documents are pre-aggregated, and the
table of source states (one row per source, written, so its size is known to
Spark's own broadcast threshold) is joined to them, and so is the table of the
fill's keys (written too; a source's have fewer words than one document).

Cases: null and empty texts have size 0 and take 0 words; a null source is a
source of its own, last; repeated rows (same id and size) are rounded alike, and so
are rows of one size with a null id;
an empty table gives an empty mix; extra columns are ignored or, by
``mix_documents``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangoflow.llm.common import materialise, word_count

CAP = 3
SCALE = 1024  # sums of rates times sizes are kept in 1/1024 words
BITS = 12  # of the threshold's key per refinement, three refinements
MAX_STEPS = 60
TOLERANCE = 1e-7


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(key).alias(key), _source_key(F.col(source)).alias("__s"),
                       F.col(source).alias("__source"), word_count(F.col(text)).alias("size"))


def targets(sizes: DataFrame, cap: int = CAP, cycle: int = 3) -> DataFrame:
    """One row per source: ``source_size`` and ``target`` words.  Sources in
    code point order (null last) weigh 1, 2, ... ``cycle``, repeating; what a
    source can't take (over ``cap`` times its size) the others share by weight.

    Sorted by ``cap * size / weight`` the sources at their cap are the first
    ones, so running sums over the one-row-per-source table settle it."""
    per = sizes.groupBy("__s", "__source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("__source").asc_nulls_last())
    by_room = Window.orderBy("room", "__s")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    w = per.withColumn("weight", ((F.row_number().over(named) - 1) % cycle + 1).cast("double"))
    w = w.withColumn("limit", (F.col("source_size") * cap).cast("double")).withColumn(
        "room", F.try_divide("limit", "weight"))
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("share", F.try_divide(left, weights)).withColumn("full", F.col("room") <= F.col("share"))
    w = w.withColumn("level", F.min_by("share", F.when(~F.col("full"), F.col("room"))).over(everything))
    target = F.when(F.col("full"), F.col("limit")).otherwise(
        F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return w.select("__s", "source_size", target.alias("target"))


def _rate(lam: Column, size: Column, mean: Column, cap: int) -> Column:
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.try_divide(lam * size, mean), F.lit(50.0)))))


def solve(sizes: DataFrame, want: DataFrame, cap: int = CAP) -> DataFrame:
    """Newton on the dual: ``want`` plus ``mean`` and ``lam`` (null: every
    document of the source has the rate ``cap``)."""
    hist = materialise(sizes.where("size > 0").groupBy("__s", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    c = F.col
    stats = hist.groupBy("__s").agg(F.try_divide(F.sum(c("n") * c("size")), F.sum("n")).alias("mean"),
                                    F.min("size").alias("least"))
    ratio = F.log(F.try_divide(c("target"), c("source_size")))
    state = want.join(stats, "__s", "left").withColumn(
        "open", (c("source_size") > 0) & (c("target") < cap * c("source_size")))
    steepest = F.try_divide("mean", "least")
    state = state.withColumns({
        "lo": F.when(ratio < 0, ratio * steepest).otherwise(0.0),
        "hi": F.when(ratio < 0, 0.0).otherwise(F.log(F.lit(float(cap))) * steepest),
        "lam": F.when(c("open"), ratio), "miss": F.when(c("open"), 1.0).otherwise(0.0)})
    state = materialise(state, "mix-state")
    for _ in range(MAX_STEPS):
        x = hist.join(state.where("miss > 0").select("__s", "lam", "mean"), "__s")
        rate = _rate(c("lam"), c("size"), c("mean"), cap)
        words = c("n") * c("size") * rate
        slope = F.when(rate < cap, F.try_divide(words * c("size"), c("mean"))).otherwise(0.0)
        whole = lambda v: F.sum(F.round(v * SCALE).cast("long")) / F.lit(float(SCALE))
        sums = x.groupBy("__s").agg(whole(words).alias("words"), whole(slope).alias("slope"))
        y = state.join(sums, "__s", "left")
        off = F.coalesce(c("words") - c("target"), F.lit(0.0))
        y = y.withColumns({"lo": F.when(off < 0, c("lam")).otherwise(c("lo")),
                           "hi": F.when(off > 0, c("lam")).otherwise(c("hi")), "off": off})
        newton = c("lam") - F.try_divide("off", "slope")
        step = F.when((newton > c("lo")) & (newton < c("hi")), newton).otherwise((c("lo") + c("hi")) / 2)
        done = F.abs("off") <= F.greatest(TOLERANCE * c("target"), F.lit(0.01))
        y = y.withColumns({"lam": F.when(c("words").isNull() | done, c("lam")).otherwise(step),
                           "miss": F.when(c("words").isNull() | done, 0.0).otherwise(F.abs("off"))})
        state = materialise(y.select(*state.columns), "mix-state")
        if state.where("miss > 0").isEmpty():
            break
    return state.select("__s", "source_size", "target", "mean", "lam")


def _key_of(ident: Column, frac: Column) -> Column:
    """36 bits: the seeded hash in [0, 1) less the rate's fraction, from -1 to 1."""
    u = F.pmod(F.xxhash64(F.lit("mix"), ident), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    return F.floor((u - frac + 1) * F.lit(float(1 << (3 * BITS - 1)))).cast("long")


def _rated(df: DataFrame, key: str, cap: int) -> DataFrame:
    """``__base`` copies and ``__key`` (null: no further copy) added to rows
    that have size, mean and lam."""
    rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
    base = F.floor(rate).cast("int")
    open_ = (base < cap) & (F.col("size") > 0)
    return df.withColumn("__base", F.when(F.col("size") > 0, base).otherwise(0)).withColumn(
        "__key", F.when(open_, _key_of(F.col(key), rate - base)))


def _refine(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (source and ``need``) with ``below``: the first of the
    source's keys, in order, whose words don't fit ``need`` any more, and
    ``need`` less the words of the keys before it."""
    c = F.col
    held = [n for n in state.columns if n not in ("below", "need")]
    state = state.select(*held, F.lit(0).cast("long").alias("below"), "need")
    for level in (2, 1, 0):
        shift = level * BITS
        up = shift + BITS
        bins = (keyed.join(state.select("__s", "below"), "__s")
                .where(F.shiftright("__key", up) == F.shiftright("below", up))
                .groupBy("__s", F.shiftright("__key", shift).alias("bin")).agg(F.sum("size").alias("size")))
        run = Window.partitionBy("__s").orderBy("bin")
        sums = bins.join(state.select("__s", "need"), "__s").withColumn(
            "upto", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        fits = c("upto") <= c("need")
        cut = sums.groupBy("__s").agg(
            F.coalesce(F.min(F.when(~fits, c("bin"))), F.max("bin") + (1 if level == 0 else 0)).alias("bin"),
            F.max(F.when(~fits, 1).otherwise(0)).alias("over"),
            F.max(F.when(fits, c("upto"))).alias("some"), F.max("upto").alias("all"),
            F.max_by("size", "bin").alias("last"))
        # where all fits, the last bin is opened again at the next level, so its words are taken there
        used = F.when(c("over") == 1, F.coalesce("some", F.lit(0))).otherwise(
            c("all") if level == 0 else c("all") - c("last"))
        state = materialise(state.join(cut, "__s", "left").select(
            *held,
            F.coalesce(F.shiftleft("bin", shift), c("below")).alias("below"),
            (c("need") - F.coalesce(used, F.lit(0))).alias("need")), "mix-round")
    return state


def thresholds(sizes: DataFrame, solved: DataFrame, key: str, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """``solved`` plus ``below`` (a document whose key is less gets one more
    copy), and the further (source, key) that do.

    These fill what the first document that doesn't fit leaves missing: the
    keys after it whose words fit are refined in the same way, until none fits.
    A key that stops a pass has more words than then are missing, so each pass
    leaves less than a document that fitted before it; as keys are hashes, that
    is a logarithmic number of passes, over fewer keys each."""
    c = F.col
    rated = materialise(_rated(sizes.join(solved, "__s"), key, cap).where(c("size") > 0)
                        .groupBy("__s", "__key").agg(F.sum("size").alias("size"), F.sum(c("__base") * c("size")).alias("sure")),
                        "mix-keys")
    sure = rated.groupBy("__s").agg(F.sum("sure").alias("sure"))
    state = materialise(solved.join(sure, "__s", "left").select(
        *solved.columns, (c("target") - F.coalesce("sure", F.lit(0))).alias("need")), "mix-round")
    left = rated.where(c("__key").isNotNull()).select("__s", "__key", "size")
    state = _refine(left, state)
    states = state.select(*solved.columns, "below")
    state = state.select("__s", "below", "need")
    more = left.select("__s", "__key").where("false")
    while True:
        left = materialise(left.join(state, "__s").where((c("__key") >= c("below")) & (c("size") <= c("need")))
                           .select("__s", "__key", "size"), "mix-left")
        if left.isEmpty():
            break
        state = _refine(left, state.select("__s", "need"))
        more = more.unionByName(left.join(state, "__s").where(c("__key") < c("below")).select("__s", "__key"))
    return materialise(states, "mix-sources"), materialise(more.withColumn("__more", F.lit(1)), "mix-more")


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             cap: int = CAP) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The documents' sizes (written) and the tables of ``thresholds``."""
    sizes = materialise(sized(docs, key, text, source), "mix-docs")
    want = materialise(targets(sizes, cap), "mix-targets")
    return sizes, thresholds(sizes, solve(sizes, want, cap), key, cap)


def with_copies(sizes: DataFrame, plan: tuple[DataFrame, DataFrame], key: str, cap: int = CAP) -> DataFrame:
    """Rows of ``sizes`` with ``copies``, ``source_size`` and ``target``."""
    states, more = plan
    # rows without a key match nothing and are spread, should the join be shuffled
    at = F.coalesce("__key", -1 - F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)))
    rated = _rated(sizes.join(states, "__s"), key, cap).withColumn("__at", at).join(
        more.withColumnRenamed("__key", "__at"), ["__s", "__at"], "left")
    one = F.col("__key").isNotNull() & ((F.col("__key") < F.col("below")) | F.col("__more").isNotNull())
    return rated.withColumn("copies", F.col("__base") + F.when(one, 1).otherwise(0))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Key, size, source_size, target, copies and taken words per document."""
    sizes, plan = plan_mix(docs, key, text, source)
    return with_copies(sizes, plan, key).select(
        key, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    _, plan = plan_mix(docs, key, text, source)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[key].alias("__id"),
                       _source_key(docs[source]).alias("__s"), word_count(docs[text]).alias("size"))
    taken = with_copies(rows, plan, "__id")
    return taken.select(F.explode_outer(F.array_repeat(F.lit(1), F.col("copies"))).alias("__one"), "__row").where(
        F.col("__one").isNotNull()).select("__row.*")
