"""Operator 4 [native]: benchmark decontamination by template canonicalisation.

Texts and benchmark items are cut into tokens; numbers, names (capitalised words) and units (after a number)
become typed placeholders. Windows of eight template tokens are hash-joined. For each pair of a
document and an item that share enough windows, the slots of the matched windows are laid side by side. They
are consistent if nearly all of an item value's slots hold one value of the document, and most slots of
a document value stand for one value of the item. The pair is a leak if, at one place of the document, windows with consistent slots
reach the coverage, or if windows that are the same word for word reach VERBATIM, whatever the slots say. Where words were put in or left out, parts
of a copy lie side by side with different shifts; their slots must be consistent together, unless one part alone reaches VERBATIM.
So questions with exchanged parameters are found, too.

A window with too few plain tokens (rich in numbers, names or units) has a template that says too little; it is joined by its tokens
as they stand instead. So sums, date lists and questions of proper names match word for word. A pair may reach the
coverage on the windows joined by template alone, as exchanged parameters leave no other, or on all windows.

Defined cases: null texts count as empty and match nothing; an item shorter than a window is one window of its length; an
item without tokens matches nothing; an item all of whose windows are joined by their tokens matches exact copies only; repeated rows of a document count once; equal item ids are told apart by
text, as items of their own; rows with a null doc_id are documents by their texts, each distinct one reported once with a null doc_id; very long texts are read whole; a pair that leaks at several places is reported once, by its best place; other columns
don't take part; an empty table on either side gives no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.storage import materialize, small_enough

WINDOW = 8
#: At least this share of an item's windows must be in the document.
COVERAGE = 0.4
#: The template of a window with fewer plain tokens than this share says too little: its tokens are compared instead.
PLAIN = 0.5
#: At least this share of the slots must hold the value that most slots of the same item value hold.
CONSISTENT = 0.9
#: At least this share of the slots must stand for the item value that most slots with the same document value stand for.
APART = 0.5
#: Windows that are the same word for word leak at this share of the item's windows even if the slots are not consistent.
VERBATIM = 0.75
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}+"
# Units of measure and money.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "months", "miles", "mile", "feet", "foot", "inches", "inch", "meters", "metres", "kilometers", "grams", "kilograms", "litres", "liters", "euros", "euro", "dollars", "dollar", "cents", "percent", "mph", "kmh", "w", "kw", "v", "hz")
NUMBER, UNIT, NAME = 1, 2, 3
#: Benchmark windows are broadcast up to this many rows (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
BROADCAST_PAIRS = 20_000
#: Leaking ids are broadcast up to this many rows (8 bytes each).
BROADCAST_IDS = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def template(toks: Column) -> Column:
    """Each token's code: 1 to 3 for the placeholders, else a hash of the lower-cased token. Digits sort before ``:``, letters after it."""

    def code(t: Column, i: Column) -> Column:
        low = F.lower(t)
        unit = low.isin(*UNITS) & (F.get(toks, i - 1) < ":")
        name = (t != F.upper(t)) | (F.length(t) == 1)
        return (
            F.when(t < ":", F.lit(NUMBER).cast("long"))
            .when(t == low, F.when(unit, F.lit(UNIT).cast("long")).otherwise(F.xxhash64(t)))
            .when(name & (t.substr(1, 1) != low.substr(1, 1)), F.lit(NAME).cast("long"))
            .otherwise(F.xxhash64(low))
        )

    return F.transform(toks, code)


def windows(codes: Column, size: Column) -> Column:
    """Hash of every window of ``size`` codes; none if there are fewer."""
    n = F.size(codes) - size + 1
    return F.when((n > 0) & (size > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.slice(codes, i + 1, size)))).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, toks, codes, size (of its windows), one row for each distinct item."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("item_key", F.xxhash64("item_id", "text")).withColumn("toks", tokens(F.col("text"))).withColumn("codes", template(F.col("toks")))
    return rows.withColumn("size", F.least(F.size("toks"), F.lit(WINDOW))).where(F.col("size") > 0).select("item_key", "item_id", "toks", "codes", "size")


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, verbatim: float = VERBATIM) -> DataFrame:
    """The leaking pairs: doc_id, item_id, matched (windows of the item), n_windows, coverage, n_slots, n_changed (slots with another value).

    Rows without a doc_id are documents by their texts: each text's leaks are listed once, with a null doc_id.
    """
    out = _leaks(docs, benchmark, coverage, verbatim)
    nameless = docs.where(F.col("doc_id").isNull())
    if nameless.limit(1).count():
        out = out.unionByName(_leaks(nameless.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, coverage, verbatim).withColumn("doc_id", F.lit(None).cast("long")))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns kept; those without a doc_id are judged by their texts."""
    leaking = materialize(_leaks(docs, benchmark).select("doc_id").distinct(), "leaking-ids")
    named = docs.join(F.broadcast(leaking) if small_enough(leaking, BROADCAST_IDS) else leaking, "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.where(F.col("doc_id").isNull())
    if not nameless.limit(1).count():
        return named
    by_text = materialize(_leaks(nameless.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("leaking_text")).distinct(), "leaking-texts")
    clean = nameless.join(by_text, F.xxhash64(nameless["text"]) == by_text["leaking_text"], "left_anti").select(*docs.columns)
    return named.where(F.col("doc_id").isNotNull()).unionByName(clean)


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, verbatim: float = VERBATIM) -> DataFrame:
    """The leaking pairs of documents that have a doc_id.

    All counts are of the windows joined by template if these reach the coverage, else of all windows.
    Documents are scanned once for windows and once more, those with a candidate only, for slots.
    """
    items = materialize(_items(benchmark), "leak-items")
    plain = F.size(F.filter(F.slice("codes", F.col("at") + 1, F.col("size")), lambda c: (c < NUMBER) | (c > NAME)))
    marks = items.select("item_key", "toks", "codes", "size", F.posexplode(windows(F.col("codes"), F.col("size"))).alias("at", "template"))
    marks = marks.withColumn("exact", plain < F.col("size") * PLAIN).withColumn("window", F.when(F.col("exact"), F.xxhash64(F.slice("toks", F.col("at") + 1, F.col("size")))).otherwise(F.col("template")))
    marks = materialize(marks.select("item_key", "at", "size", "exact", "window"), "leak-windows")
    needed = marks.groupBy("item_key").agg(F.countDistinct("window").alias("n_all"), F.countDistinct(F.when(~F.col("exact"), F.col("window"))).alias("n_plain"))
    sizes = sorted((r.size, r.exact) for r in marks.select("size", "exact").distinct().collect())  # at most 2 * WINDOW values
    keys = marks.select("window").distinct()
    bounded = small_enough(keys, BROADCAST_WINDOWS)
    keys = F.broadcast(keys) if bounded else keys
    scan = docs.select("doc_id", tokens(F.col("text")).alias("toks")).withColumn("codes", template(F.col("toks")))
    each = F.concat(*[windows(F.col("toks" if exact else "codes"), F.lit(s)) for s, exact in sizes]) if sizes else F.array().cast("array<bigint>")
    # a document's windows meet the item windows one by one; equal windows of a document count once
    seen = scan.select("doc_id", F.explode(F.array_distinct(each)).alias("window")).join(keys, "window", "left_semi")
    seen = materialize(seen, "leak-seen")
    pairs = seen.join(marks.select("item_key", "exact", "window").distinct(), "window").distinct().groupBy("doc_id", "item_key").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("exact")).alias("plain"))
    pairs = pairs.join(needed, "item_key")
    by_plain = (F.col("n_plain") > 0) & (F.col("plain") >= coverage * F.col("n_plain"))
    pairs = pairs.where(by_plain | (F.col("all") >= coverage * F.col("n_all")))
    pairs = pairs.select("doc_id", "item_key", F.when(by_plain, F.col("plain")).otherwise(F.col("all")).alias("matched"), F.when(by_plain, F.col("n_plain")).otherwise(F.col("n_all")).alias("n_windows"), by_plain.alias("by_template"))
    pairs = materialize(pairs, "leak-pairs")
    return _consistent(docs, items, marks, sizes, pairs, needed, coverage, verbatim)


def _consistent(docs: DataFrame, items: DataFrame, marks: DataFrame, sizes: list[tuple[int, bool]], pairs: DataFrame, needed: DataFrame, coverage: float, verbatim: float) -> DataFrame:
    """Keep the pairs that reach the coverage at some place of the document, by windows with consistent slots or word for word."""
    wanted = pairs.select("doc_id").distinct()
    if small_enough(wanted, BROADCAST_PAIRS):
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").distinct()
    texts = texts.withColumn("toks", tokens(F.col("text"))).withColumn("codes", template(F.col("toks"))).select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", "toks", "codes")
    texts = materialize(texts, "leak-texts")
    found = None
    for size, exact in sizes:
        part = texts.select("doc_key", "doc_id", "toks", F.posexplode(windows(F.col("toks" if exact else "codes"), F.lit(size))).alias("d_at", "window")).withColumn("d_toks", F.slice("toks", F.col("d_at") + 1, size)).drop("toks")
        part = part.join(marks.where((F.col("size") == size) & (F.col("exact") == exact)).drop("size"), "window")
        # where an item's windows lie in the text: the same offset for one copy of the passage
        part = part.withColumn("shift", F.col("d_at") - F.col("at"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched long, n_windows long, coverage double, n_slots long, n_changed long")
    item_toks = items.select("item_key", "item_id", F.col("toks").alias("i_toks"), F.col("codes").alias("i_codes"), "size")
    steps = found.join(item_toks, "item_key").join(pairs.select("doc_id", "item_key", "by_template"), ["doc_id", "item_key"])
    zipped = F.filter(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct((F.col("at") + i).alias("k"), F.get("i_codes", F.col("at") + i).alias("kind"), F.get("i_toks", F.col("at") + i).alias("ours"), F.get("d_toks", i).alias("theirs"))), lambda z: z["kind"].between(NUMBER, NAME))
    same = F.forall("slots", lambda z: z["ours"] == z["theirs"])
    steps = steps.select("doc_id", "doc_key", "item_key", "item_id", "shift", "window", "exact", (~(F.col("by_template") & F.col("exact"))).alias("counts"), F.size("i_toks").alias("reach"), zipped.alias("slots")).withColumn("same", same)
    steps = materialize(steps, "leak-steps")
    place = ["doc_id", "doc_key", "item_key", "item_id", "reach", "shift"]
    whole = steps.groupBy(*place).agg(F.countDistinct(F.when(F.col("counts"), F.col("window"))).alias("here"))
    slots = steps.where("counts").select(*place, F.explode("slots").alias("s")).select(*place, "s.*").distinct()
    slots = materialize(slots, "leak-slots")
    places = whole.join(_agreement(slots, place), place, "left").na.fill(0, ["n_slots", "n_changed"]).na.fill(True, ["consistent"])
    places = materialize(places, "leak-places")
    # words put in or left out move the shift: windows count together if their shifts are at most the item's length apart
    nth = F.floor(F.col("shift") / F.col("reach"))
    spots = F.explode(F.array(nth, nth + 1)).alias("spot")
    spot = ["doc_key", "item_key", "spot"]
    covered = steps.join(places.select("doc_key", "item_key", "shift", "consistent"), ["doc_key", "item_key", "shift"]).select("doc_key", "item_key", "window", "exact", "same", "consistent", spots)
    covered = covered.groupBy(*spot, "window").agg(F.max("exact").alias("exact"), F.max("same").alias("same"), F.max("consistent").alias("consistent"))
    covered = covered.groupBy(*spot).agg(F.count_if(F.col("consistent") & ~F.col("exact")).alias("plain"), F.count_if("consistent").alias("all"), F.count_if("same").alias("same")).join(needed, "item_key")
    # the slots of all consistent parts of a spot together, and the share of the part that reaches furthest
    parts = places.where("consistent").select(*place, spots)
    together = _agreement(slots.join(parts, place).select(*spot, "kind", "k", "ours", "theirs").distinct(), spot).select(*spot, F.col("consistent").alias("together"))
    alone = parts.join(places.select(*place, "here"), place).groupBy(*spot).agg(F.max("here").alias("alone"))
    covered = covered.join(together, spot, "left").join(alone, spot, "left")
    agreed = F.coalesce("together", F.lit(True)) | (F.coalesce("alone", F.lit(0)) >= verbatim * F.when(F.col("n_plain") > 0, F.col("n_plain")).otherwise(F.col("n_all")))
    by_slots = ((F.col("n_plain") > 0) & (F.col("plain") >= coverage * F.col("n_plain"))) | (F.col("all") >= coverage * F.col("n_all"))
    reached = (by_slots & agreed) | (F.col("same") >= max(coverage, verbatim) * F.col("n_all"))
    places = places.select("*", spots).join(covered.where(reached).select(*spot), spot, "left_semi")
    best = places.groupBy("doc_id", "item_key", "item_id").agg(F.max(F.struct("consistent", "here", "n_slots", (-F.col("n_changed")).alias("kept"))).alias("b"))
    out = best.join(pairs, ["doc_id", "item_key"])
    return out.select("doc_id", "item_id", "matched", "n_windows", F.round(F.col("matched") / F.col("n_windows"), 6).alias("coverage"), F.col("b.n_slots").alias("n_slots"), (-F.col("b.kept")).alias("n_changed"))


def _agreement(slots: DataFrame, by: list[str]) -> DataFrame:
    """n_slots, n_changed and consistent of each group of slots (kind, ours, theirs)."""
    values = slots.groupBy(*by, "kind", "ours", "theirs").agg(F.count(F.lit(1)).alias("n"))
    changed = F.sum(F.when(F.col("ours") != F.col("theirs"), F.col("n")).otherwise(0))
    by_ours = values.groupBy(*by, "kind", "ours").agg(F.max("n").alias("most"), F.sum("n").alias("n"), changed.alias("changed"))
    by_ours = by_ours.groupBy(*by).agg(F.sum("most").alias("most_theirs"), F.sum("n").alias("n_slots"), F.sum("changed").alias("n_changed"))
    by_theirs = values.groupBy(*by, "kind", "theirs").agg(F.max("n").alias("most")).groupBy(*by).agg(F.sum("most").alias("most_ours"))
    consistent = (F.col("most_theirs") >= CONSISTENT * F.col("n_slots")) & (F.col("most_ours") >= APART * F.col("n_slots"))
    return by_ours.join(by_theirs, by).select(*by, "n_slots", "n_changed", consistent.alias("consistent"))
