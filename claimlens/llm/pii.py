"""Personal data: base patterns with exact places, and bootstrapped contextual extraction of further identifiers.

Base entities are seeds. One to three words in front of a seed, alone or with the word behind it, are lexical patterns.
A pattern is as good as the share of its uses, over the whole corpus, that hold a known value; a value is as good as the
patterns that hold it and, if it looks like a plain word, the share of its own uses that lie in them. Every round scores
the patterns of the known values, takes the values of the good ones, and hands these to the next round.
Built from column expressions and joins alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import whole_text
from claimlens.session import small_side, written

KINDS = ("email", "ip", "card", "phone")
FOUND = "found"
# The contract's patterns in forms that read a text once: possessive, and begun only where a match may begin.
_MAIL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold before its pattern is tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# A run ends behind = or :. A known entity is one run, begun by MARK, its blanks and parting signs replaced.
RUN = r"[^\x20\x09-\x0D=:]++[=:]?|[=:]"
MARK, FILLED, PARTING = "\x01", "_", " =:"
EDGES = "\"'`.,;!?()[]{}<>"
# Defaults of the bootstrap.
ROUNDS = 3
LEAST_SEEDS = 3
CONFIDENT = 0.5
# The rounds end where no value's score rises by more.
SETTLED = 0.01
LEAST_CHARS = 5
# Words that may be looked for inside a row, by number and by signs; more are met by a join.
LISTED, LISTED_CHARS = 4_096, 256 * 1024


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` looks at it, also inside functions of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost matches, in code points.

    Matches and the pieces between them alternate, so lengths add up to places."""
    values = F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0))
    gaps = F.split(text, f"(?:{pattern})", -1)

    def starts(parts: Column) -> Column:
        steps = F.transform(parts["values"], lambda value, i: F.length(F.get(parts["gaps"], i)) + F.when(i > 0, F.length(F.get(parts["values"], i - 1))).otherwise(0))
        return bound(steps, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, 1, i + 1), F.lit(0), lambda total, x: total + x)))

    def spans(parts: Column) -> Column:
        return bound(
            starts(parts),
            lambda at: F.transform(parts["values"], lambda value, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(value)).alias("end"), value.alias("value"))),
        )

    return bound(F.struct(values.alias("values"), gaps.alias("gaps")), spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
    )
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        trimmed = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", ""))
        return F.forall(trimmed, lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: valid(kind, s["value"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: str) -> dict[str, Column]:
    """Per kind the array of its spans in a text column that holds no null."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = {}
    for kind, pattern in PATTERNS.items():
        spans = F.filter(located(F.col(text), pattern), _test(kind))
        must = F.col("has_digit") if kind != "email" else F.lit(True)
        if NEEDS[kind]:
            must &= F.instr(text, NEEDS[kind]) > 0
        found[kind] = F.when(must, spans).otherwise(none)
    return found


def marked(text: Column, spans: Column) -> Column:
    """The text with every base span, or several that overlap, made one run that begins with MARK; places stay as they are."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def filled(value: Column) -> Column:
        return F.concat(F.lit(MARK), F.translate(F.substring(value, 2, F.length(value)), PARTING, FILLED * len(PARTING)))

    def joined(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["end"] + 1, s["start"] - acc["end"])
        value = filled(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        rest = F.translate(F.substring(text, acc["end"] + 1, s["end"] - acc["end"]), PARTING, FILLED * len(PARTING))
        more = F.when(s["start"] >= acc["end"], F.concat(before, value)).when(s["end"] > acc["end"], rest).otherwise("")
        return F.struct(F.concat(acc["text"], more).alias("text"), F.greatest(acc["end"], s["end"]).alias("end"))

    begun = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))
    return F.aggregate(ordered, begun, joined, lambda acc: F.concat(acc["text"], F.substring(text, acc["end"] + 1, F.length(text))))


def examined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, row_key (of id and text), base spans of each kind, and the text with its base spans marked."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    keyed = rows.withColumns(
        {
            "row_key": F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5("text"))),
            "has_digit": F.col("text").rlike("[0-9]"),
        }
    )
    found = keyed.withColumns(base_spans("text"))
    plain = F.translate("text", MARK, "")
    taken = F.concat(*KINDS)
    # A text that holds the mark itself teaches nothing and is left as it is.
    safe = F.when(F.length(plain) < F.length("text"), plain).when(F.size(taken) > 0, marked(F.col("text"), taken)).otherwise(F.col("text"))
    return found.select("doc_id", "row_key", *KINDS, safe.alias("marked"), (F.length(plain) == F.length("text")).alias("readable"))


def runs_of(text: str = "marked") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({RUN})"), F.lit(1))


def listed(df: DataFrame, column: str) -> list[str] | None:
    """The values of a column without nulls, if they are few enough to be looked for inside each row; else None."""
    few = [r[0] for r in df.select(column).distinct().limit(LISTED + 1).collect()]
    return few if len(few) <= LISTED and sum(map(len, few)) <= LISTED_CHARS else None


def contexts(rows: DataFrame, *carry: str, led: list[str] | None = None, held: list[str] | None = None) -> DataFrame:
    """One row a run of the marked texts: ``carry``, i (its number), value (trimmed), and the runs l1, l2, l3 before and r1 behind it.

    With ``led`` only runs behind one of these words, with ``held`` only those of these values: all others never become rows."""

    def around(r: Column, i: Column) -> Column:
        return F.struct(
            i.alias("i"),
            F.btrim(F.get(r, i), F.lit(EDGES)).alias("value"),
            F.get(r, i - 1).alias("l1"),
            F.get(r, i - 2).alias("l2"),
            F.get(r, i - 3).alias("l3"),
            F.get(r, i + 1).alias("r1"),
        )

    def each(r: Column) -> Column:
        if led is not None:
            numbers = F.filter(F.array_compact(F.transform(r, lambda w, i: F.when(w.isin(led), i + 1))), lambda i: i < F.size(r))
        elif held is not None:
            numbers = F.array_compact(F.transform(r, lambda w, i: F.when(F.btrim(w, F.lit(EDGES)).isin(held), i)))
        else:
            return F.transform(r, lambda w, i: around(r, i))
        return F.transform(numbers, lambda i: around(r, i))

    return rows.where("readable").select(*carry, F.inline(bound(runs_of(), each)))


def patterns() -> Column:
    """The lexical patterns of a row of ``contexts`` as hashes: 1, 2 or 3 runs before; 1 or 2 before and one behind. What lacks a run is NULL."""
    made = []
    for kind, runs in enumerate([("l1",), ("l2", "l1"), ("l3", "l2", "l1"), ("l1", "r1"), ("l2", "l1", "r1")]):
        whole = F.lit(True)
        for run in runs:
            whole &= F.col(run).isNotNull()
        made.append(F.when(whole, F.xxhash64(F.lit(kind), *runs)))
    return F.array(*made)


def induced(known_places: DataFrame, least_seeds: int) -> DataFrame:
    """(pattern, kind, l1, good): patterns of at least ``least_seeds`` different known values, with the scores of their places. None holds an entity."""
    free = known_places
    for run in ("l1", "l2", "l3", "r1"):
        free = free.withColumn(run, F.when(~F.contains(run, F.lit(MARK)), F.col(run)))
    each = free.select("value", "score", "l1", F.posexplode(patterns()).alias("kind", "pattern")).where("pattern is not null")
    values = each.groupBy("pattern", "value").agg(F.sum("score").alias("n"), F.min("l1").alias("l1"), F.min("kind").alias("kind"))
    sums = values.groupBy("pattern").agg(F.sum("n").alias("good"), F.count(F.lit(1)).alias("support"), F.min("l1").alias("l1"), F.min("kind").alias("kind"))
    return sums.where(F.col("support") >= least_seeds).select("pattern", "kind", "l1", "good")


def in_patterns(rows: DataFrame, asked: DataFrame, *carry: str) -> DataFrame:
    """The rows of ``contexts`` in any of the patterns ``asked`` (pattern, l1, ...), one for each. Runs behind no last word of a pattern go first."""
    ends = asked.select("l1").distinct()
    few = listed(ends, "l1")
    near = contexts(rows, *carry, led=few) if few is not None else contexts(rows, *carry).join(small_side(ends), "l1")
    return near.withColumn("pattern", F.explode(patterns())).join(small_side(asked.drop("l1"), computed=True), "pattern")


def word_uses(rows: DataFrame, words: DataFrame, column: str, of: Callable[[Column], Column], whole: bool) -> DataFrame:
    """(column, uses): how often each of ``words`` (column, distinct) is ``of`` a run; without ``whole`` the last run of a text is left out."""
    few = listed(words, column)

    def wanted(r: Column) -> Column:
        runs = r if whole else F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))
        values = F.transform(runs, of)
        return values if few is None else F.filter(values, lambda w: w.isin(few))

    each = rows.where("readable").select(F.explode(bound(runs_of(), wanted)).alias(column))
    met = each if few is not None else each.join(small_side(words, computed=True), column)
    return met.groupBy(column).agg(F.count(F.lit(1)).alias("uses"))


def rated(rows: DataFrame, asked: DataFrame, confident: float) -> DataFrame:
    """(pattern, l1, rate): the share of a pattern's uses that hold known values, of those with ``confident`` or more.

    A single word's uses are a count of words. Longer patterns whose uses in the texts with base entities alone are too many
    are left out first: their uses over all texts are no fewer."""
    single, longer = asked.where("kind = 0"), asked.where("kind > 0")
    alone = word_uses(rows, single.select("l1"), "l1", lambda w: w, whole=False)
    found = single.join(alone, "l1").select("pattern", "l1", "good", "uses")
    for texts, name in ((rows.where(F.size(F.concat(*KINDS)) > 0), "some"), (rows, "all")):
        if longer.isEmpty():
            break
        uses = in_patterns(texts, longer.select("pattern", "l1")).groupBy("pattern").agg(F.count(F.lit(1)).alias("uses"))
        counted = longer.drop("uses").join(uses, "pattern", "left")
        longer = written(counted.where(F.col("good") >= confident * F.coalesce("uses", F.lit(0))), f"{name}_uses")
    else:
        found = found.union(longer.select("pattern", "l1", "good", "uses"))
    return found.select("pattern", "l1", F.least(F.col("good") / F.col("uses"), F.lit(0.999)).alias("rate")).where(F.col("rate") >= confident)


def bootstrapped(rows: DataFrame, rounds: int, least_seeds: int, confident: float) -> DataFrame:
    """(row_key, i): the runs taken for identifiers.

    Each round: patterns with at least ``least_seeds`` different known values; of these the ones whose uses hold known values,
    each counted by its score (entities 1), for a share of ``confident`` or more; their values, scored 1 - product(1 - share).
    A value without a digit counts only as far as its uses lie in these patterns. Values scored ``confident`` or more are known from then on."""
    spark = rows.sparkSession
    seeds = rows.where(F.size(F.concat(*KINDS)) > 0)
    known_places = seed_places = contexts(seeds).where(F.contains("value", F.lit(MARK))).withColumn("score", F.lit(1.0))
    known = spark.createDataFrame([], "value string, score double")
    found = spark.createDataFrame([], "row_key string, i int, value string")
    for _ in range(rounds):
        asked = written(induced(known_places, least_seeds), "patterns")
        good = written(rated(rows, asked, confident), "confident")
        if good.isEmpty():
            break
        # A value of several patterns at one place has the best of them there.
        held = in_patterns(rows, good, "row_key").where(~F.contains("value", F.lit(MARK)) & (F.length("value") >= LEAST_CHARS) & ~F.col("value").rlike("[=:]$"))
        places = written(held.groupBy("row_key", "i", "value").agg(F.max("rate").alias("rate")), "places")
        scores = places.groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("rate"))))).alias("score"), F.count(F.lit(1)).alias("inside"))
        values = written(scores, "values")
        # Only what looks like a plain word is counted over the corpus.
        plain = written(values.where(~F.col("value").rlike("[0-9]")).select("value"), "plain")
        totals = word_uses(rows, plain, "value", lambda w: F.btrim(w, F.lit(EDGES)), whole=True)
        share = F.when(F.col("uses").isNull(), 1.0).otherwise(F.col("inside") / F.col("uses"))
        now = written(values.join(totals, "value", "left").where(F.col("score") * share >= confident).select("value", (F.col("score") * share).alias("score")), "known")
        found = written(found.union(places.join(now.select("value"), "value").select("row_key", "i", "value")).distinct(), "found")
        better = now.join(known.withColumnRenamed("score", "before"), "value", "left").where(F.col("score") > F.coalesce("before", F.lit(0.0)) + SETTLED)
        if better.isEmpty():
            break
        known = written(known.union(now).groupBy("value").agg(F.max("score").alias("score")), "known")
        known_places = seed_places.unionByName(contexts(rows, held=listed(known, "value")).join(small_side(known, computed=True), "value"))
    return found.select("row_key", "i").distinct()


def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(row_key, extra): the spans of the found runs, without quotes and stops around them."""
    text = F.col("marked")
    gaps, runs = F.split(text, f"(?:{RUN})", -1), F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))
    numbers = found.groupBy("row_key").agg(F.sort_array(F.collect_set("i")).alias("numbers"))
    lengths = rows.join(numbers, "row_key").dropDuplicates(["row_key"]).select("row_key", "numbers", gaps.alias("gaps"), runs.alias("runs"))

    def total(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda t, p: t + F.length(p))

    def span(i: Column) -> Column:
        run = F.get("runs", i)
        start = total(F.col("gaps"), i + 1) + total(F.col("runs"), i) + F.length(run) - F.length(F.ltrim(run, F.lit(EDGES)))
        return F.struct(
            F.lit(len(KINDS)).alias("order"), F.lit(FOUND).alias("kind"), start.alias("start"), (start + F.length(F.btrim(run, F.lit(EDGES)))).alias("end")
        )

    return lengths.select("row_key", F.transform("numbers", span).alias("extra"))


def find(
    docs: DataFrame,
    rounds: int = ROUNDS,
    least_seeds: int = LEAST_SEEDS,
    confident: float = CONFIDENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, row_key, and ``spans``: (order, kind, start, end) of base entities and found identifiers, sorted.

    Base spans stay whatever the bootstrap finds; found spans never overlap them. A found identifier is one run of at
    least LEAST_CHARS signs. A missing or empty text has no
    spans; rows that repeat have each their spans; an empty table gives no rows; further columns are ignored."""
    rows = written(examined(docs, doc_id, text), "examined")
    extra = placed(rows, bootstrapped(rows, rounds, least_seeds, confident))

    def as_spans(kind: str, order: int) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = F.concat(*[as_spans(k, i) for i, k in enumerate(KINDS)])
    joined = rows.join(extra.withColumnRenamed("row_key", "_key"), F.col("row_key") == F.col("_key"), "left")
    none = F.array().cast("array<struct<order:int,kind:string,start:int,end:int>>")
    return joined.select("doc_id", "row_key", F.array_sort(F.concat(base, F.coalesce("extra", none))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, their sha256, and all spans as text."""

    def as_text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != FOUND)
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets. Spans that overlap are replaced as one, up to the
    furthest end, by the kind of the one that begins first (of those the longest)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def replaced(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["end"]
        kept = F.concat(acc["text"], F.substring(text, acc["end"] + 1, s["start"] - acc["end"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.when(apart, kept).otherwise(acc["text"]).alias("text"), F.greatest(acc["end"], -s["back"]).alias("end"))

    begun = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))
    return F.aggregate(ordered, begun, replaced, lambda acc: F.concat(acc["text"], F.substring(text, acc["end"] + 1, F.length(text))))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **settings) -> DataFrame:
    """The documents with the spans of their texts replaced and ``n_chars`` counted anew; other columns unchanged.

    Only documents with spans are touched: they meet their spans by id and text."""
    found = find(docs, doc_id=doc_id, text=text, **settings).where(F.size("spans") > 0).select("row_key", "spans").distinct()
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.md5(whole_text(text))))
    with_spans = written(found, "spans")
    rows = docs.select(key.alias("key"), F.col(text).alias("text"), F.struct("*").alias("row"))
    joined = rows.join(with_spans, F.col("key") == F.col("row_key"), "left")
    touched = F.col("spans").isNotNull()
    cleaned = joined.withColumn("clean", F.when(touched, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))

    def column(name: str) -> Column:
        if name == text:
            return F.col("clean").alias(name)
        if name == n_chars:
            return F.when(touched, F.length("clean")).otherwise(F.col(f"row.{name}")).cast(docs.schema[name].dataType).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return cleaned.select(*[column(c) for c in docs.columns])
