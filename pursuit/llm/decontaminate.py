"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a benchmark question matches a copy of
it with other values. Windows of template tokens are hash-joined; over each run of matching windows
the values in the slots of both sides must stand in a one-to-one relation. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, without_texts

WIDTH = 10
#: Items of fewer than WIDTH + SLACK tokens have windows shorter by SLACK than themselves, or their own length if those would be under SHORTEST.
SLACK = 3
#: Items of fewer tokens are not looked for.
SHORTEST = 5
#: A window counts only with so many literal tokens, and this many of them different.
LITERALS = 3
#: A stretch of so many tokens with all values equal counts, whatever the slots of the run around it.
VERBATIM = 20
BROADCAST_ROWS = 500_000
#: Scripts without blanks between words: each character is a token.
#: (Thai, Lao, Myanmar, Khmer, kana, Han, by code point, which is tested faster than by script.)
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
#: Units that may follow a number (fixed values).
UNITS = "mm|cm|m|km|in|inch|inches|ft|feet|foot|yd|yards?|miles?|mg|g|kg|lbs?|pounds?|oz|ounces?|tons?|ml|l|liters?|litres?|gallons?|s|sec|seconds?|min|minutes?|h|hr|hours?|days?|weeks?|months?|years?|percent|dollars?|euros?|cents?|usd|eur|degrees?|mph|kmh|kwh|watts?|volts?|amps?|hz|khz|mhz|ghz|kb|mb|gb|tb"


def marked(text: Column) -> Column:
    """Tokens without punctuation, lower-cased; numbers, units and names keep their value after #, ~ and @.

    A name is a capitalised word that doesn't begin a sentence or line.
    """

    def named(t: Column) -> Column:
        return F.regexp_replace(t, r"[\x20\t](?=\p{Lu})(?<=[\p{L}\p{N},;:].)", "$0@")

    def numbered(t: Column) -> Column:
        numbers = F.regexp_replace(t, r"(?<![\p{L}\p{N}@])[\p{Sc}]?(\p{Nd}[\p{Nd}.,:/]*)", "#$1")
        numbers = F.regexp_replace(numbers, rf"(?i)(#[^\s#]+\s*?)(?<![\p{{L}}#@])({UNITS})(?![\p{{L}}])", "$1 ~$2")
        return F.when(t.rlike(r"\p{Nd}"), numbers).otherwise(t)

    def spaced(t: Column) -> Column:
        return F.when((F.octet_length(t) > F.length(t)) & t.rlike(UNSPACED), F.regexp_replace(t, UNSPACED, " $0 ")).otherwise(t)

    def plain(t: Column) -> Column:
        return F.when(t.contains("#") | t.contains("~") | t.contains("@"), F.translate(t, "#~@", "   ")).otherwise(t)

    # each step is bound, so that none is computed again for every use of its result
    t = let(F.coalesce(text, F.lit("")), lambda t: let(plain(t), lambda t: let(spaced(t), lambda t: let(named(t), numbered))))
    return F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}\s#~@]+", ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(marked(text), r"\s+"), lambda t: t != "")


def template(token: Column) -> Column:
    first = F.left(token, F.lit(1))
    return F.when(first.isin("#", "~", "@"), first).otherwise(token)


def literal(token: Column) -> Column:
    """The token's template with names as lower-cased words, which is the same in a copy in capitals or small letters."""
    return F.when(F.left(token, F.lit(1)).isin("#", "~"), F.left(token, F.lit(1))).otherwise(F.ltrim(token, F.lit("@")))


def slots(part: Column, marks: tuple[str, ...] = ("#", "~", "@")) -> Column:
    return F.filter(part, lambda t: F.left(t, F.lit(1)).isin(*marks))


#: Forms of a window: with names as slots, and with names as words.
FORMS = ((template, ("#", "~", "@")), (literal, ("#", "~")))


def _key(width: Column, shape: Column, pos: Column) -> Column:
    return F.xxhash64(width, F.slice(shape, pos + 1, width))


def item_windows(benchmark: DataFrame, any_case: bool, item_col: str, text_col: str) -> DataFrame:
    """(item_id, width, i_pos, form, key, i_slots) of every item, at every token, where enough tokens are literal."""
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(text_col)).alias("toks")).where(F.size("toks") >= SHORTEST)
    width = F.when(F.size("toks") >= WIDTH + SLACK, WIDTH).when(F.size("toks") >= SHORTEST + SLACK, F.size("toks") - SLACK).otherwise(F.size("toks"))
    items = items.withColumn("width", width)
    out = None
    for form, (shape, marks) in enumerate(FORMS[: 1 + any_case]):
        rows = items.withColumn("shape", F.transform("toks", lambda t: F.xxhash64(shape(t))))  # noqa: B023
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("toks") - F.col("width"))).alias("i_pos"))
        part = F.slice("toks", F.col("i_pos") + 1, F.col("width"))
        words = F.size(F.array_distinct(F.filter(part, lambda t: ~F.left(t, F.lit(1)).isin(*marks))))  # noqa: B023
        rows = rows.where(words >= LITERALS).select("item_id", "width", "i_pos", F.lit(form).alias("form"), _key(F.col("width"), F.col("shape"), F.col("i_pos")).alias("key"), slots(part, marks).alias("i_slots"))
        out = rows if out is None else out.union(rows)
    return out


def document_keys(docs: DataFrame, widths: list[int], any_case: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, same, key): the keys of all windows of each document, at every token; ``same`` tells texts of one id apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("same"), tokens(F.col(text_col)).alias("toks"))

    def keys(shape: Column) -> Column:
        found = [F.when(F.size(shape) >= w, F.transform(F.sequence(F.lit(0), F.size(shape) - w), lambda at: _key(F.lit(w), shape, at))).otherwise(F.array().cast("array<long>")) for w in widths]  # noqa: B023
        return found[0] if len(found) == 1 else F.concat(*found)

    shapes = [F.transform("toks", lambda t: F.xxhash64(shape(t))) for shape, _ in FORMS[: 1 + any_case]]  # noqa: B023
    rows = rows.select("doc_id", "same", *(x.alias(f"shape{k}") for k, x in enumerate(shapes)))
    found = keys(F.col("shape0"))
    if any_case:  # the forms differ only where a name is
        found = F.when(F.col("shape0") == F.col("shape1"), found).otherwise(F.concat(found, keys(F.col("shape1"))))
    return rows.select("doc_id", "same", F.explode(found).alias("key"))


def document_windows(docs: DataFrame, widths: list[int], any_case: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, same, form, pos, key, d_slots): a row for each window, at every token."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("same"), tokens(F.col(text_col)).alias("toks"))
    found = []
    for form, (shape, marks) in enumerate(FORMS[: 1 + any_case]):
        hashes = F.transform("toks", lambda t: F.xxhash64(shape(t)))  # noqa: B023
        for w in widths:
            at = lambda pos: F.struct(F.lit(form).alias("form"), pos.alias("pos"), _key(F.lit(w), F.col(f"shape{form}"), pos).alias("key"), slots(F.slice("toks", pos + 1, w), marks).alias("d_slots"))  # noqa: B023, E731
            found.append(F.when(F.size("toks") >= w, F.transform(F.sequence(F.lit(0), F.size("toks") - w), at)))
        rows = rows.withColumn(f"shape{form}", hashes)
    rows = rows.select("doc_id", "same", F.explode(F.concat(*[F.coalesce(f, F.array()) for f in found])).alias("w"))
    return rows.select("doc_id", "same", "w.*")


def one_to_one(pairs: Column) -> Column:
    """Whether (d, i) pairs map both ways to one value."""
    n = F.size(F.array_distinct(pairs))
    return (F.size(F.array_distinct(F.transform(pairs, lambda p: p["d"]))) == n) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"]))) == n)


def _equal(pairs: Column) -> Column:
    return F.forall(pairs, lambda p: p["d"] == p["i"])


def runs_of(hits: DataFrame) -> DataFrame:
    """(doc_id, same, item_id, windows, pairs, tokens) of each run: matching windows of one shift, each touching or overlapping the next."""
    line = ["doc_id", "same", "item_id", "form", "shift"]
    order = Window.partitionBy(*line).orderBy("pos")
    fresh = F.coalesce((F.col("pos") - F.lag("pos").over(order) > F.col("width")).cast("int"), F.lit(0))
    rows = hits.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    pairs = F.array_distinct(F.flatten(F.collect_set("pairs")))
    return rows.groupBy(*line, "run").agg(F.countDistinct("pos").alias("windows"), pairs.alias("pairs"), (F.max("pos") - F.min("pos") + F.max("width")).alias("tokens"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", any_case: bool = False) -> DataFrame:
    """(doc_id, same, item_id, windows, kind) for each document and item with a common run.

    A run is a maximal row of windows at one shift that match in template and touch or overlap. It
    counts if the values of all its slots are in one-to-one relation. A part of it of 20 tokens with
    all values equal counts in any case. kind is ``exact`` if a run or such a part has only equal
    values, else ``reparameterised``; windows is the longest run's. Runs of 10 tokens are found
    at any place (of items under 13 tokens: runs of 3 fewer than the item has, of those under 8 the
    whole item). Names are told by capitals; with ``any_case``, windows are also matched with names as
    lower-cased words, so that a copy in capitals or small letters is found.

    The texts' window keys are probed first; only documents with a known key are read again, for
    places and slots. Null and blank texts have no windows; items under 5 tokens and windows with fewer than 3 distinct
    literal tokens match nothing. Null ids are kept. Repeated rows and texts give one row per id and
    text. An empty benchmark or table gives no rows. Extra columns are not read.
    """
    items = cut(item_windows(benchmark, any_case, item_col, item_text), "items")
    widths = [int(r[0]) for r in items.select("width").distinct().orderBy("width").collect()]
    if not widths:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("same")).where("false").withColumns({"item_id": F.lit(None).cast(benchmark.schema[item_col].dataType), "windows": F.lit(0).cast("long"), "kind": F.lit("")})
    small = items.count() <= BROADCAST_ROWS
    known, side = items.select("key").distinct(), items.select("item_id", "width", "i_pos", "form", "key", "i_slots")
    keys = document_keys(docs, widths, any_case, id_col, text_col)
    near = cut(keys.join(F.broadcast(known) if small else known, "key", "left_semi").select("doc_id", "same").distinct(), "near")
    near = near.toDF("near_id", "near_text")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = own.join(near, F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.xxhash64("text") == F.col("near_text")), "left_semi")
    windows = document_windows(own, widths, any_case, "doc_id", "text")
    hits = windows.join(F.broadcast(side) if small else side, ["key", "form"])
    hits = hits.select("doc_id", "same", "item_id", "form", "pos", "width", (F.col("pos") - F.col("i_pos")).alias("shift"), F.arrays_zip(F.col("d_slots").alias("d"), F.col("i_slots").alias("i")).alias("pairs"))
    hits = cut(hits.dropDuplicates(["doc_id", "same", "item_id", "form", "shift", "pos"]), "hits")
    runs = runs_of(hits).where(one_to_one(F.col("pairs"))).withColumn("exact", _equal(F.col("pairs")))
    whole = runs_of(hits.where(_equal(F.col("pairs")))).where(F.col("tokens") >= VERBATIM).withColumn("exact", F.lit(True))
    kind = F.when(F.max("exact"), "exact").otherwise("reparameterised")
    return runs.union(whole).groupBy("doc_id", "same", "item_id").agg(F.max("windows").alias("windows"), kind.alias("kind"))


def without_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that ``found`` doesn't name, with their own columns, whatever their names.

    Ids and texts are compared, nulls included, so that of rows with one id only those with the leak go.
    """
    return without_texts(docs, found.select("doc_id", "same"), id_col, text_col)
