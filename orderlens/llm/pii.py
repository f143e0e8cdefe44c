"""Personal data: fixed patterns, and terms that give the found entities away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern and check (``KINDS``).
Each found value is a protected entity. The corpus tells how much a term t (a word of three letters or
more, outside of addresses) reveals of an entity e: with c documents that hold both, n(t) that hold t, n(e)
that hold e, of N,

    PMI(t, e) = log2(c N / (n(t) n(e))),   disclosure = PMI(t, e) / log2(N / n(e)).

Disclosure is 1 if every document with the term holds the entity. A term that discloses some entity by
``remove`` or more stands for it, and is taken out of all documents, whether they hold the entity or not. One
that discloses it by ``generalise`` or more is replaced by a general tag wherever it stands in
the documents that hold the entity. A pair must be seen in ``support`` different texts, so that copies of one
text prove nothing. Since c is at most n(e), no term with n(t) > N^(1-g) n(e)^g, g being ``generalise``,
can reach it; such pairs, and entities of a single text, are left out before anything is counted.

Patterns, positions, Luhn sums, counts and replacements are DataFrame
functions; nothing runs in Python. Positions are code points, ends exclusive.

Edge cases: a null text is empty and has no spans. Repeated rows get repeated results. Rows without
id are searched like any other. Other columns of the input pass through ``sanitised`` and are not
read by ``found``. An empty table gives an empty result. Very long texts and texts of very many matches are
read whole, in time that grows little more than they do. Spans of one start are ordered by kind, ties
between terms do not occur; of overlapping spans the first is replaced, the others go with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pick, quoted
from orderlens.session import cut_lineage, small_side

#: Kind and pattern, in the order in which spans of one start are listed. The possessive form and
#: the look-behind only save time: no match starts within the run of characters that the attempt
#: at its beginning has used up. Fixed values.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TERM = r"\p{L}{3,}"
SUPPORT, GENERALISE, REMOVE = 2, 0.75, 0.95
#: Characters of the pieces that a text is cut into before parts of it are taken.
PIECE = 1024
#: Terms up to this number are broadcast; more of them meet the texts in a shuffled join.
BROADCAST_TERMS = 300_000
SPAN = "struct<start:int,order:int,stop:int,kind:string,entity:string>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    backwards = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    size = F.length(digits(value))
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        low = lambda p: part(p) & (F.when(part(p), p.cast("decimal(38,0)")).otherwise(F.lit(999)) <= 255)
        return F.forall(F.split(value, r"\."), lambda p: low(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", ""))))
    if kind == "card":
        return size.between(12, 19) & luhn(digits(value))
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def canonical(kind: str, value: Column) -> Column:
    return digits(value) if kind in ("card", "phone") else F.lower(value)


def running(values: Column, join) -> Column:
    """Running results of ``join`` over an array of numbers, by doubling steps: no array grows element by element."""
    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")

    def step(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: F.when(i >= back, join(x, F.get(sums, i - back))).otherwise(x))

    looped = F.aggregate(F.sequence(F.lit(0), steps - 1), values, step)
    return F.when(steps > 0, looped).when(F.size(values) > 0, values).otherwise(F.array().cast("array<int>"))


def with_ends(rows: DataFrame, text: Column, pattern: str, matches: str) -> DataFrame:
    """``rows`` with ``{matches}ends``: where each of the matches ends in the text; from what lies between them.

    Arrays meet element by element (``zip_with``): a lambda that looks into another array would have it
    made anew for each element wherever Spark merges the two steps.
    """
    some = F.size(matches) > 0
    before = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    sizes = F.zip_with(matches, before, lambda m, gap: F.length(m) + F.length(gap))
    sized = rows.withColumn(f"{matches}sizes", F.when(some, sizes))
    return sized.withColumn(f"{matches}ends", F.when(some, running(F.col(f"{matches}sizes"), lambda a, b: a + b))).drop(f"{matches}sizes")


def with_base(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``base_``: the spans of all kinds in order, null where there are none."""
    value = F.coalesce(F.col(text), F.lit(""))
    seen = {"email": value.contains("@"), "phone": value.rlike(r"\+[0-9]"), "card": value.rlike(r"[0-9][\x20-]?[0-9]")}
    matched = rows
    for kind, pattern in KINDS:
        some = seen.get(kind, value.rlike(r"[0-9]\.[0-9]"))
        matched = matched.withColumn(f"{kind}_", F.when(some, F.regexp_extract_all(value, F.lit(pattern), F.lit(0))))
    parts, nothing = [], F.array().cast(f"array<{SPAN}>")
    for order, (kind, pattern) in enumerate(KINDS):
        matched = with_ends(matched, value, pattern, f"{kind}_")
        span = lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), F.lit(order).alias("order"), end.alias("stop"), F.lit(kind).alias("kind"), m.alias("entity")  # noqa: B023
        ).cast(SPAN)
        kept = F.filter(F.zip_with(f"{kind}_", f"{kind}_ends", span), lambda s: valid(kind, s["entity"]))  # noqa: B023
        named = F.transform(kept, lambda s: s.withField("entity", canonical(kind, s["entity"])))  # noqa: B023
        parts.append(F.when(F.size(f"{kind}_") > 0, named).otherwise(nothing))
    spans = F.when(F.greatest(*[F.coalesce(F.size(f"{kind}_"), F.lit(0)) for kind, _ in KINDS]) > 0, F.array_sort(F.concat(*parts)))
    held = matched.withColumn("base_", F.when(F.size(spans) > 0, spans))
    return held.drop(*[f"{kind}_{end}" for kind, _ in KINDS for end in ("", "ends")])


def digest(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    value = F.coalesce(text, F.lit(""))
    return [F.xxhash64(value).alias("h1_"), F.xxhash64(F.lit(1), value).alias("h2_")]


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    value = F.coalesce(text, F.lit(""))
    plain_words = F.regexp_extract_all(value, F.lit(TERM), F.lit(0))
    beside = F.filter(F.regexp_extract_all(value, F.lit(f"{KINDS[0][1]}|{TERM}"), F.lit(0)), lambda w: ~w.contains("@"))
    return F.array_distinct(F.transform(F.when(value.contains("@"), beside).otherwise(plain_words), lambda w: F.lower(w)))


def mentions(base: DataFrame) -> DataFrame:
    """(h1_, h2_, base_, rows): each text with spans once, and how many documents have it."""
    return base.where("base_ is not null").groupBy("h1_", "h2_").agg(F.first("base_").alias("base_"), F.count(F.lit(1)).alias("rows"))


def disclosures(rows: DataFrame, mentioning: DataFrame, support: int = SUPPORT, least: float = GENERALISE, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(kind, entity, term, disclosure) of the pairs that reveal ``least`` or more.

    ``rows`` has all texts (h1_, h2_, text), ``mentioning`` those with spans.
    """
    total = float(max(rows.count(), 1))
    # distinct as rows: structs of one array would be compared each with each
    each = mentioning.select("h1_", "h2_", "rows", F.explode("base_").alias("m")).select("h1_", "h2_", "rows", "m.kind", "m.entity").distinct()
    entities = each.groupBy("kind", "entity").agg(F.sum("rows").alias("with_entity"), F.count(F.lit(1)).alias("texts"))
    shared = cut_lineage(each.join(entities.where(F.col("texts") >= support).drop("texts"), ["kind", "entity"]))
    holders = small_side(shared.select("h1_", "h2_").distinct())
    held = rows.join(holders, ["h1_", "h2_"], "left_semi").select("h1_", "h2_", terms(F.col("text")).alias("terms"))
    held = held.groupBy("h1_", "h2_").agg(F.first("terms").alias("terms")).select("h1_", "h2_", F.explode("terms").alias("term"))
    held = cut_lineage(held)
    often = held.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).select("term")
    often = cut_lineage(often)
    small = often.count() <= broadcast_terms
    # each document has a term once here, so counting needs no more than partial sums by term
    spoken = rows.select(F.explode(terms(F.col("text"))).alias("term")).join(F.broadcast(often) if small else often, "term")
    spoken = spoken.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    limit = F.pow(F.lit(total), 1 - least) * F.pow(F.col("with_entity"), F.lit(least)) * (1 + 1e-9)
    met = held.join(F.broadcast(spoken) if small else spoken, "term").join(shared, ["h1_", "h2_"]).where(F.col("with_term") <= limit)
    pairs = met.groupBy("kind", "entity", "term", "with_entity", "with_term").agg(F.sum("rows").alias("together"), F.count(F.lit(1)).alias("texts"))
    information = F.log2(F.lit(total) / F.col("with_entity"))
    pmi = F.log2(F.col("together") * F.lit(total) / (F.col("with_term") * F.col("with_entity")))
    revealed = F.when(information > 0, pmi / information).otherwise(0.0)
    found = pairs.where(F.col("texts") >= support).withColumn("disclosure", F.least(revealed, F.lit(1.0)))
    return found.where(F.col("disclosure") >= least).select("kind", "entity", "term", "disclosure")


def findings(rows: DataFrame, remove: float = REMOVE, **how) -> DataFrame:
    """(h1_, h2_, base_, hits_) of each text with spans or revealing terms; ``hits_`` are its terms and what becomes of them."""
    mentioning = cut_lineage(mentions(with_base(rows).select("h1_", "h2_", "base_")))
    revealing = cut_lineage(disclosures(rows, mentioning, **how))
    worst = revealing.groupBy("term").agg((F.max("disclosure") >= remove).alias("removed"))
    said = rows.select("h1_", "h2_", F.explode(terms(F.col("text"))).alias("term")).join(small_side(worst, BROADCAST_TERMS), "term").distinct()
    beside = mentioning.select("h1_", "h2_", F.explode("base_").alias("m")).select("h1_", "h2_", "m.kind", "m.entity")
    beside = beside.join(revealing, ["kind", "entity"]).select("h1_", "h2_", "term")
    said = said.where("removed").unionByName(said.where("not removed").join(beside, ["h1_", "h2_", "term"], "left_semi"))
    hits = said.groupBy("h1_", "h2_").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("hits_"))
    return mentioning.drop("rows").join(hits, ["h1_", "h2_"], "full")


def with_spans(rows: DataFrame, text: str = "text", **how) -> DataFrame:
    """``rows`` with ``base_`` and ``spans_`` (base and terms), plain and sorted."""
    marked = rows.select("*", *digest(F.col(text)))
    known = small_side(findings(marked.select("h1_", "h2_", F.col(text).alias("text")), **how))
    joined = marked.join(known, ["h1_", "h2_"], "left").drop("h1_", "h2_")
    value = F.coalesce(F.col(text), F.lit(""))
    beside = f"{KINDS[0][1]}|{TERM}"
    told = joined.withColumn("words_", F.when(F.col("hits_").isNotNull(), F.regexp_extract_all(value, F.lit(beside), F.lit(0))))
    told = with_ends(told, value, beside, "words_")
    order = lambda removed: F.when(removed, len(KINDS) + 1).otherwise(len(KINDS))

    def span(word: Column, end: Column) -> Column:
        removed = F.try_element_at("hits_", F.lower(word))
        kind = F.when(removed, "removed").otherwise("generalised")
        return F.when(removed.isNotNull() & ~word.contains("@"), F.struct((end - F.length(word)).alias("start"), order(removed).alias("order"), end.alias("stop"), kind.alias("kind")))

    found = F.filter(F.zip_with("words_", "words_ends", span), lambda s: s.isNotNull())
    every = F.when(F.col("hits_").isNotNull(), F.array_sort(F.concat(plain(F.col("base_")), F.coalesce(found.cast(PLAIN), F.array().cast(PLAIN)))))
    told = told.withColumn("spans_", F.coalesce(every, plain(F.col("base_")))).withColumn("base_", plain(F.col("base_")))
    return told.drop("words_", "words_ends", "hits_")


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


PLAIN = "array<struct<start:int,order:int,stop:int,kind:string>>"


def plain(spans: Column) -> Column:
    short = F.transform(spans, lambda s: F.struct(s["start"], s["order"], s["stop"], s["kind"]))
    return F.coalesce(short.cast(PLAIN), F.array().cast(PLAIN))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row: doc_id, base (spans), spans (base and terms), each sorted."""
    rows = with_spans(pick(docs, doc_id=id_col, text=text_col), **how)
    return rows.select("doc_id", F.col("base_").alias("base"), F.col("spans_").alias("spans"))


def with_replaced(rows: DataFrame, text: str, spans: str, name: str) -> DataFrame:
    """``rows`` with the text in which each span is replaced by the tag of its kind, or taken out; overlapping ones at once.

    The text is cut into pieces first, so that taking a part of it does not count through all that lies before.
    """
    some = F.size(spans) > 0
    cut = rows.withColumn("pieces_", F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    cut = cut.withColumn("upto_", F.when(some, running(F.transform(spans, lambda s: s["stop"]), F.greatest)))

    def part(a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        held = F.array_join(F.slice("pieces_", first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(held, a - first * PIECE + 1, b - a)).otherwise("")

    def written(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("upto_", i - 1)).otherwise(0)
        tag = F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", "[context]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.when(s["start"] >= before, F.concat(part(before, s["start"]), tag)).otherwise("")

    last = F.element_at("upto_", -1)
    out = F.concat(F.array_join(F.transform(spans, written), ""), part(last, F.length(text)))
    return cut.withColumn(name, F.when(some, out).otherwise(F.col(text))).drop("pieces_", "upto_")


def sanitised(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with personal data and revealing terms replaced in the text; null texts stay null."""
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row_"), quoted(text_col).alias("text_"))
    ready = with_replaced(with_spans(packed, "text_", **how), "text_", "spans_", "new_")
    return ready.select(*[F.col("new_").alias(text_col) if c == text_col else F.col("row_").getField(c).alias(c) for c in docs.columns])


def op2_pii(spark, folder: str) -> DataFrame:
    """Spans of personal data in all documents, as counts and digests."""
    rows = found(spark.read.parquet(f"{folder}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(kind) for kind, _ in KINDS], F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans")
    )
