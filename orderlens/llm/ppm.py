"""Language-model scores by prediction by partial matching (PPM), pretrained on the corpus.

The trie holds how often each byte follows each context of up to ``ORDER`` bytes, counted over all
learned texts; a text is preceded by as many end marks and followed by one (byte FF, which UTF-8
does not have). A byte is predicted by the longest context that has been seen with it. A context
of n counts and q different bytes gives a byte with count c the probability c / (n + q) and an
escape q / (n + q) to the next shorter context (method C), where the bytes of the longer contexts
are excluded from counts and escape. Below the empty context all bytes not excluded are equal.

All contexts are kept, however many there are: their counts are tables, and the probability of each
run of ``ORDER`` + 1 bytes that any text has, learned or not, is found by joining that run with the
counts of its contexts. Exclusions depend on the context alone, so of a context no more is needed
than its counts in all, how many bytes it has and how often the next shorter context has those.
Scoring is a lookup by run of bytes: the ``broadcast_grams`` most frequent ones are broadcast, all
others meet their probability in a join, as rare words do. The parameter changes no score.

The base score is a unigram model over words with add-one smoothing. Counts of the ``frequent``
words are broadcast (bounded by the parameter); all other words of a document meet their counts in
a join, so no table of the vocabulary is held anywhere.

Edge cases: a null text is empty: one end token, one end mark. A row without id is learned from and
not held out. Repeated rows get repeated results. Without any learned text all bytes are equally
likely and no token is known. Very long texts are scored in runs of their own. Other columns of the
input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.bytesets import runs, text_bytes
from orderlens.llm.common import pick, remainder
from orderlens.session import cut_lineage

END, ORDER = 0xFF, 4
END_TOKEN = b""
BROADCAST_GRAMS, FREQUENT = 1 << 20, 200_000
HELD_WORDS, HELD_GRAMS = 300_000, 1 << 21


def padded(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with end marks around each text; where each predicted byte stands; its document."""
    docs, size = len(limits) - 1, np.diff(limits)
    owner = np.repeat(np.arange(docs), size + 1)
    at = np.arange(len(owner)) + ORDER * (owner + 1)
    out = np.full(len(owner) + ORDER * docs, END, np.uint8)
    text_at = np.ones(len(owner), bool)
    text_at[np.cumsum(size + 1) - 1] = False
    out[at[text_at]] = data
    return out, at, owner


def grams(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each predicted byte with the ``ORDER`` bytes before it, as one number; its document."""
    line, at, owner = padded(data, limits)
    line, code = line.astype(np.uint64), np.zeros(len(at), np.uint64)
    for back in range(ORDER, -1, -1):
        code = (code << np.uint64(8)) | line[at - back]
    return code, owner


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(token, gram, n): how often each word, the end token and each run of ``ORDER`` + 1 bytes is learned.

    Runs of bytes that only rows held out have are there with ``n`` = 0; words are those learned.
    Tasks count in memory of bounded size and give out what they have whenever it is full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokens(found: Counter) -> pa.RecordBatch:
            n = len(found)
            columns = [pa.array(list(found), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(found.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["token", "gram", "n"])

        def halves(batch: pa.RecordBatch) -> list[tuple[pa.RecordBatch, bool]]:
            learned = pc.fill_null(pc.invert(batch.column(1)), False)
            return [(part, kind) for part, kind in ((batch.filter(learned), True), (batch.filter(pc.invert(learned)), False)) if part.num_rows]

        def codes(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            columns = [pa.nulls(len(found[0]), pa.binary()), pa.array(found[0].astype(np.int64)), pa.array(found[1])]
            return pa.RecordBatch.from_arrays(columns, ["token", "gram", "n"])

        seen, kept = Counter(), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch, learned in (part for whole in batches for part in halves(whole)):
            data, limits = text_bytes(batch.column(0))
            parts = [kept]
            for first, end in runs(limits):
                low = limits[first]
                code, n = np.unique(grams(data[low : limits[end]], limits[first : end + 1] - low)[0], return_counts=True)
                parts.append((code, n if learned else np.zeros_like(n)))
                if sum(len(p[0]) for p in parts) > HELD_GRAMS:
                    parts = [summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            kept = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            if len(kept[0]) > HELD_GRAMS:
                yield codes(kept)
                kept = (kept[0][:0], kept[1][:0])
            if not learned:
                continue
            seen[END_TOKEN] += batch.num_rows
            raw = data.tobytes().lower()
            for first, end in zip(limits[:-1], limits[1:]):
                seen.update(raw[first:end].split())
                if len(seen) > HELD_WORDS:
                    yield tokens(seen)
                    seen.clear()
        if seen:
            yield tokens(seen)
        if len(kept[0]):
            yield codes(kept)

    found = rows.select("text", "held_out").mapInArrow(run, "token binary, gram long, n long")
    return found.groupBy("token", "gram").agg(F.sum("n").alias("n"))


def last(size: int):
    """The last ``size`` bytes of ``gram``."""
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1))


def bounded(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` as a join side with a row for each run of ``size`` bytes: up to two there are 65,536 at most."""
    return F.broadcast(rows) if size <= 2 else rows


def gram_logs(counts: DataFrame) -> DataFrame:
    """(gram, n, log): log10 of the probability of the last byte of each gram after those before it.

    ``counts`` (gram, n) has every gram to score, with ``n`` = 0 for those not learned.
    """
    tables = {ORDER + 1: counts.where("n > 0")}
    for size in range(ORDER, 0, -1):
        tables[size] = cut_lineage(tables[size + 1].groupBy(last(size).alias("gram")).agg(F.sum("n").alias("n")))

    def contexts(size: int) -> DataFrame:
        """Counts of each context in all, its different bytes, and how often the next shorter context has these."""
        shorter = tables[size].select(F.col("gram").alias("short"), F.col("n").alias("n_short"))
        rows = tables[size + 1].join(bounded(shorter, size), last(size) == F.col("short"))
        found = rows.groupBy(F.shiftright("gram", 8).alias("context"))
        return found.agg(F.sum("n").alias("total"), F.count("n").alias("kinds"), F.sum("n_short").alias("covered"))

    whole = F.col("total") + F.col("kinds")
    longest = contexts(ORDER)
    learned = tables[ORDER + 1].join(longest, F.shiftright("gram", 8) == F.col("context"))
    learned = learned.select("gram", "n", F.log10(F.col("n") / whole).alias("log"))

    zero = F.lit(0).cast("long")
    state = {"log": F.lit(0.0), "done": F.lit(False), "less": zero, "fewer": zero}
    rows = counts.where("n = 0").select("gram", *[value.alias(name) for name, value in state.items()])
    for size in range(ORDER, -1, -1):
        times = zero
        if size < ORDER:
            met = tables[size + 1].select(F.col("gram").alias("met"), F.col("n").alias("times"))
            rows, times = rows.join(bounded(met, size + 1), last(size + 1) == F.col("met"), "left"), F.coalesce("times", zero)
        if size:
            context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * size)) - 1))
            found = longest if size == ORDER else contexts(size)
            rows = rows.join(bounded(found, size), context == F.col("context"), "left")
            total, kinds, covered = (F.coalesce(name, zero) for name in ("total", "kinds", "covered"))
        else:
            every = tables[1].agg(F.coalesce(F.sum("n"), zero), F.count("n")).first()
            total, kinds, covered = F.lit(every[0]), F.lit(every[1]), zero
        # bytes of the longer context are excluded here
        weight, others = total - F.col("less") + kinds - F.col("fewer"), kinds - F.col("fewer")
        chance = F.when(times > 0, F.try_divide(times.cast("double"), weight)).when(others > 0, F.try_divide(others.cast("double"), weight))
        log = F.col("log") + F.when(F.col("done"), 0.0).otherwise(F.coalesce(F.log10(chance), F.lit(0.0)))
        rows = rows.select("gram", log.alias("log"), (F.col("done") | (times > 0)).alias("done"), covered.alias("less"), kinds.alias("fewer"))
    equal = F.when(F.col("done"), 0.0).otherwise(-F.log10(F.greatest(256 - F.col("fewer"), F.lit(1)).cast("double")))
    return learned.union(rows.select("gram", zero.alias("n"), (F.col("log") + equal).alias("log")))


def byte_logs(codes: np.ndarray, logs: np.ndarray, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text, the sum of the ``logs`` of its grams among ``codes`` (sorted); text, gram and times of the others."""
    code, owner = grams(data, limits)
    distinct, back = np.unique(code, return_inverse=True)
    at = np.minimum(np.searchsorted(codes, distinct), max(len(codes) - 1, 0))
    hit = codes[at] == distinct if len(codes) else np.zeros(len(distinct), bool)
    log = np.where(hit, logs[at], 0.0) if len(codes) else np.zeros(len(distinct))
    sums = np.bincount(owner, log[back], minlength=len(limits) - 1)
    missed = np.flatnonzero(~hit[back])
    # by text and gram; the numbers of the grams of a run are few
    pair, times = np.unique(owner[missed] * len(distinct) + back[missed], return_counts=True)
    return sums, pair // max(len(distinct), 1), distinct[pair % max(len(distinct), 1)], times


def most_frequent(rows: DataFrame, limit: int) -> DataFrame:
    """The rows with the largest ``n``: as many whole bands of an eighth of a doubling as fit into ``limit``."""
    band = F.floor(F.log2("n") * 8)
    cut, room = None, limit
    for row in sorted(rows.groupBy(band.alias("band")).count().collect(), key=lambda r: -r.band):
        room -= row["count"]
        if room < 0:
            break
        cut = row.band
    return rows.where(F.lit(False) if cut is None else band >= cut)


def gram_tokens(code: np.ndarray) -> list[bytes]:
    """Keys of grams in the join: a tab, which no word has, and the bytes."""
    raw = np.full((len(code), ORDER + 2), ord("\t"), np.uint8)
    raw[:, 1:] = code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - ORDER - 1 :]
    return raw.view(f"V{ORDER + 2}").ravel().tolist()


def gram_token(gram):
    """The key of ``gram_tokens`` of a column."""
    return F.unhex(F.concat(F.lit("09"), F.lpad(F.hex(gram), 2 * (ORDER + 1), "0")))


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", broadcast_grams: int = BROADCAST_GRAMS, frequent: int = FREQUENT) -> DataFrame:
    """Base and model scores of every row; rows where the column ``held_out`` is true are not learned.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("held_out", held_out)
    counts = cut_lineage(corpus_counts(rows))
    vocabulary = counts.where(F.col("token").isNotNull()).select("token", "n")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    top = most_frequent(vocabulary, frequent).toArrow()
    known = dict(zip(top.column("token").to_pylist(), np.log10(top.column("n").to_numpy() + 1.0).tolist()))
    logs = cut_lineage(gram_logs(counts.where(F.col("gram").isNotNull()).select("gram", "n")))
    near = most_frequent(logs.select("gram", "log", (F.col("n") + 1).alias("n")), broadcast_grams).select("gram", "log").toArrow().sort_by("gram")
    model = near.column("gram").to_numpy().astype(np.uint64), near.column("log").to_numpy()
    shared = spark.sparkContext.broadcast((known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, model = shared.value
        for batch in batches:
            data, limits = text_bytes(batch.column(0))
            ppm, others = np.zeros(batch.num_rows), [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for first, end in runs(limits):
                low = limits[first]
                ppm[first:end], at, code, times = byte_logs(*model, data[low : limits[end]], limits[first : end + 1] - low)
                others.append((at + first, code, times))
            raw, size = data.tobytes().lower(), np.diff(limits)
            ids, digests, held = (batch.column(i).to_pylist() for i in (1, 2, 3))
            owner, token, n, head, sure, base = [], [], [], [], [], []
            for i, (first, end) in enumerate(zip(limits[:-1], limits[1:])):
                found = Counter(raw[first:end].split())
                found[END_TOKEN] += 1
                mine, sum_log = 0, 0.0
                for word, times in found.items():
                    log = logs.get(word)
                    if log is None:
                        owner.append(i)
                        token.append(word)
                        n.append(times)
                    else:
                        mine += times
                        sum_log += times * log
                # the document's own row: a word with a blank is no token, so it meets no count
                owner.append(i)
                token.append(b" %d %d" % (ids[i] or 0, digests[i]))
                n.append(0)
                head.append((len(owner) - 1, found.total()))
                sure.append(mine)
                base.append(sum_log)
            for at, code, times in others:
                owner.extend(at.tolist())
                token.extend(gram_tokens(code))
                n.extend(times.tolist())
            at = np.array([h[0] for h in head], np.int64)
            count = len(owner)

            def spread(values, kind) -> pa.Array:
                out = np.zeros(count, kind)
                out[at] = values
                return pa.array(out)

            owner = np.array(owner, np.int64)
            columns = [
                batch.column(1).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), batch.column(3).take(pa.array(owner)),
                pa.array(token, pa.binary()), pa.array(n, pa.int64()), spread(1, np.int64), spread([h[1] for h in head], np.int64),
                spread(sure, np.int64), spread(base, np.float64), spread(ppm, np.float64), spread(size, np.int64),
            ]
            yield pa.RecordBatch.from_arrays(columns, fields)

    fields = ["doc_id", "digest", "held_out", "token", "times", "copies", "tokens", "known", "logs", "ppm", "bytes"]
    source = rows.select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "held_out")
    parts = source.mapInArrow(
        run,
        "doc_id long, digest long, held_out boolean, token binary, times long, copies long, tokens long, known long, logs double, ppm double, bytes long",
    )
    chances = logs.select(gram_token(F.col("gram")).alias("token"), F.lit(0).cast("long").alias("n"), "log")
    met = parts.join(vocabulary.withColumn("log", F.lit(0.0)).unionByName(chances), "token", "left")
    one = met.groupBy("doc_id", "digest", "held_out").agg(
        F.sum("copies").alias("copies"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("known") + F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("logs") + F.when(F.col("n") > 0, F.col("times") * F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("logs"),
        F.sum(F.col("ppm") + F.col("times") * F.coalesce("log", F.lit(0.0))).alias("ppm"),
        F.sum("bytes").alias("bytes"),
    )
    # equal rows came together; each gets its own line again
    each = one.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    copies = F.col("copies")
    tokens = (F.col("tokens") / copies).cast("long")
    return each.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("known") / copies).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") / copies - tokens * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("ppm") / copies).alias("score"),
        (F.when(F.col("bytes") > 0, -F.col("ppm") / F.col("bytes")) * float(np.log2(10))).alias("bits_per_byte"),
    )


def op9_ppm(spark, folder: str) -> DataFrame:
    """Scores of all documents; the model learns from those whose remainder is not 2."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return score(docs, held).drop("bits_per_byte")
