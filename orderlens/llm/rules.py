"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose signal (symbols a character, repeated words, repeated lines, long or
short words) exceeds a cutoff. Cutoffs come from labelled rows, separately for each stratum (the
language). For a rule, a stratum and a cutoff, of n good rows k would be rejected; the cutoff is
safe if a rule that falsely rejects the share ``risk`` would reject k or fewer of n with probability
``delta`` / (strata x rules) at most: the exact binomial test that the upper Clopper-Pearson bound
of the false rejection rate lies below ``risk``. Cutoffs are tried from the loosest to the strictest
and the trying ends at the first that is not safe (fixed sequence), so that with the Bonferroni
division over strata and rules all chosen cutoffs hold together with probability 1 - ``delta``.
Among the safe cutoffs the one that rejects most of the bad rows, less the good ones, is taken; a
rule that rejects no bad row of a stratum is off there, as is every rule of a stratum with too few
labels. The false rejections of all rules together are at most their number times ``risk``.

Everything is DataFrame functions. Counts are exact 64-bit numbers; windows of three words are
matched by hash and confirmed word by word.

Edge cases: a null text has no words and fails. A null stratum is a stratum. Labels without a row
or without an id are not used, of several labels of one id the smallest counts. Repeated rows get
repeated results. Empty tables give an empty result, or rules that are all off. Other columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, words
from orderlens.session import cut_lineage

RISK, DELTA = 0.004, 0.05
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Strata whose cutoffs are broadcast; more of them are met by a join.
BROADCAST_STRATA = 10_000

RATIO = [round(0.02 * i, 2) for i in range(1, 46)]


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Each rule's signal, larger is worse, and its cutoffs from the strictest to the loosest."""
    count = lambda name: F.col(name).cast("double")
    size, chars = F.greatest(count("n_words"), F.lit(1.0)), F.greatest(count("word_chars"), F.lit(1.0))
    return {
        "symbols": (count("n_symbols") / chars, RATIO),
        "repeats": (count("n_repeat_words") / size, RATIO),
        "lines": (count("n_dup_lines") / F.greatest(count("n_lines"), F.lit(1.0)), RATIO),
        "long_words": (count("word_chars") / size, [6 + 0.25 * i for i in range(40)]),
        "short_words": (size / chars, [round(0.2 + 0.02 * i, 2) for i in range(40)]),
    }


def shift(direction: str, value: Column, by: Column) -> Column:
    return F.call_function(f"shift{direction}", value, by)


def with_counts(rows: DataFrame) -> DataFrame:
    """``rows`` with the counts of its ``text``: whole texts, null as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = rows.withColumn("words_", words(text)).withColumn("lines_", F.when(text.contains("\n"), full))
    n = F.size("words_")
    split = split.withColumn("bits_", F.length(F.bin(n.cast("long"))))
    word = lambda i: F.get("words_", i)
    # the high bits of a window's hash, with its place in the low bits: equal windows sort together
    hashed = lambda i: shift("left", shift("right", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col("bits_")), F.col("bits_"))
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: hashed(i).bitwiseOR(i.cast("long")))
    marked = split.withColumn("sorted_", F.when(n >= 4, F.sort_array(windows)))
    place = lambda x: x.bitwiseAND(shift("left", F.lit(1).cast("long"), F.col("bits_")) - 1).cast("int")

    def same(i: Column, j: Column) -> Column:
        a, b = F.get("sorted_", i), F.get("sorted_", j)
        p, q = place(a), place(b)
        hashes = shift("right", a, F.col("bits_")) == shift("right", b, F.col("bits_"))
        return hashes & (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))

    last = F.size("sorted_") - 1
    found = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | ((i < last) & F.coalesce(same(i, i + 1), F.lit(False))))
    places = F.when(F.col("sorted_").isNotNull(), F.sort_array(F.transform(found, lambda i: place(F.get("sorted_", i)))))
    placed = marked.withColumn("places_", places)
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda s, p: F.struct(p.alias("at"), (s["n"] + F.least(F.lit(3), p - s["at"])).cast("long").alias("n"))
    covered = F.aggregate(F.col("places_"), start, step, lambda s: s["n"])
    return placed.select(
        *rows.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines_") - F.size(F.array_distinct("lines_")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size("lines_"), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.size("places_") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Stirling's series, after a shift by 8 that makes it exact to about 1e-13."""
    y = x + 8
    shifted = F.lit(0.0)
    for i in range(8):
        shifted = shifted + F.ln(x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + series - shifted


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), for k up to the mean n p; 1 above it.

    Terms fall from k downwards; what lies 50 standard deviations below counts for nothing.
    """
    k, n = k.cast("double"), n.cast("double")
    log_first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    steps = F.least(k, 100 + 50 * F.ceil(F.sqrt(k))).cast("int")
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] * (k - j + 1) * odds / (n - k + j)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    terms = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, start, add, lambda state: state["sum"])
    return F.when(k > n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_first + F.ln(total))))


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) of the rules that are on; ``counted`` has doc_id, stratum and counts."""
    held = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counted.join(held, "doc_id")
    chosen = rules()
    strata = rows.select("stratum").distinct().count()
    each = delta / max(1, strata * len(chosen))
    tables = []
    for rule, (signal, limits) in chosen.items():
        over = lambda kind, limit: F.sum(((F.col("quality") == kind) & (signal > limit)).cast("long"))  # noqa: E731, B023
        good, bad = (F.array(*[over(kind, limit) for limit in limits]) for kind in (1, 0))
        sums = rows.groupBy("stratum").agg(
            F.sum((F.col("quality") == 1).cast("long")).alias("n"), good.alias("good"), bad.alias("bad")
        )
        place = F.posexplode(F.array(*[F.lit(float(limit)) for limit in limits])).alias("place", "cutoff")
        tables.append(sums.select("*", place).select("stratum", F.lit(rule).alias("rule"), "place", "cutoff", "n", F.get("good", F.col("place")).alias("k"), F.get("bad", F.col("place")).alias("bad")))
    table = tables[0]
    for more in tables[1:]:
        table = table.union(more)
    safe = (F.col("n") > 0) & (binomial_at_most(F.col("k"), F.col("n"), risk) <= each)
    looser = Window.partitionBy("stratum", "rule").orderBy(F.desc("place"))
    tried = table.withColumn("safe", F.min(safe.cast("int")).over(looser) == 1).where("safe and bad > 0")
    best = tried.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), "cutoff")).alias("best"))
    return best.where("best.gain > 0").select("stratum", "rule", "best.cutoff")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``rejected_by`` (names of rules) and ``kept`` for every row."""
    rows = pick(docs, doc_id=id_col, text=text_col, stratum=stratum_col)
    rows = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit("null")))
    counted = cut_lineage(with_counts(rows).drop("text"))
    on = cut_lineage(cutoffs(counted, pick(labels, doc_id="doc_id", quality="quality"), risk, delta))
    limits = on.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    small = on.select("stratum").distinct().count() <= BROADCAST_STRATA
    met = counted.join(F.broadcast(limits) if small else limits, "stratum", "left")
    broken = [F.when(signal > F.col("limits")[rule], rule) for rule, (signal, _) in rules().items()]
    names = F.array_join(F.array_compact(F.array(*broken)), ",")
    done = met.withColumn("rejected_by", F.coalesce(names, F.lit(""))).withColumn("base_failed", base_failed())
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by",
    )


def op7_quality_rules(spark, folder: str) -> DataFrame:
    """Counts and verdicts of all documents; cutoffs from all labels."""
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    return judged(docs, labels)
