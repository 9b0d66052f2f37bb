"""Benchmark decontamination: typed templates, hash-joined windows, slot consistency. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .shared import SPACE, Scratch, checked_broadcast

WIDTH, STRIDE = 8, 4
#: Least words of a window that are no placeholders.
LITERALS = 4
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-"
#: Units of measure, fixed values of the method.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "g", "kg", "mg", "ton", "tons", "pound", "pounds",
    "ounce", "ounces", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute",
    "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro",
    "euros", "cent", "cents", "usd", "eur", "degrees", "celsius", "fahrenheit", "watt", "watts", "volt", "volts", "mph", "kmh",
)


def templates(rows: DataFrame, id_col: str) -> DataFrame:
    """id, t (template words), s (what stands in each slot, else ''). A word is stripped of marks; one that begins with
    a digit becomes a number, a unit after a number a unit, and one with a capital before lower-case letters that does
    not begin a sentence a name; others go to lower case. Null text has no words."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    raw = rows.select(F.col(id_col).alias("id"), words.alias("w"))

    def form(w, i):
        bare = F.btrim(w, F.lit(MARKS))
        number = (bare >= "0") & (bare < ":")
        before = F.when(i > 0, F.element_at("w", F.greatest(i, F.lit(1)))).otherwise(F.lit("."))
        name = (bare >= "A") & (bare < "[") & (F.substring(bare, 2, 1) >= "a") & ~F.substring(before, -1, 1).isin(".", "!", "?")
        low = F.lower(bare)
        unit = (low <= "yards") & low.isin(*UNITS) & (F.btrim(before, F.lit(MARKS)) >= "0") & (F.btrim(before, F.lit(MARKS)) < ":")
        return F.when(number, F.concat(F.lit("\x01"), bare)).when(name, F.concat(F.lit("\x03"), low)).when(unit, F.concat(F.lit("\x02"), low)).otherwise(low)

    marked = raw.select("id", F.filter(F.transform("w", form), lambda x: x != "").alias("m"))
    # generators part the steps: else the analyzer may put one expression into the other's lambda and run it per word
    marked = marked.select("id", F.explode(F.array(F.struct("m"))).alias("x")).select("id", F.col("x.m").alias("m"))
    typed = marked.select(
        "id",
        F.transform("m", lambda x: F.when(x < "\x04", F.substring(x, 1, 1)).otherwise(x)).alias("t"),
        F.transform("m", lambda x: F.when(x < "\x04", F.substring(x, 2, 1 << 20)).otherwise(F.lit(""))).alias("s"),
    )
    return typed.select("id", F.explode(F.array(F.struct("t", "s"))).alias("x")).select("id", "x.t", "x.s", F.size("x.t").alias("n"))


def _apart(rows: DataFrame, keep: list[str], **made) -> DataFrame:
    """keep and the made columns, computed once a row (see templates on generators)."""
    return rows.select(*keep, F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("x")).select(*keep, "x.*")


def windows(tokens: DataFrame, kinds: list[tuple[int, bool]], keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n, span, exact, pos, h and `keep`: the hash of each window of span words at every place, for all kinds (span,
    exact): of its template, or (exact) of its words with what stands in the slots. Hashes of longer windows are made
    of two shorter ones each."""
    held = ["id", "n", *keep]
    chains = {False: F.transform("t", lambda x: F.xxhash64(x)), True: F.zip_with("t", "s", lambda x, y: F.xxhash64(x, y))}
    used = sorted({e for _, e in kinds})
    out = _apart(tokens, list(dict.fromkeys([*held, "t", "s"])), **{f"h1_{int(e)}": chains[e] for e in used})
    have = [f"h1_{int(e)}" for e in used]
    parts, todo = set(), [w for w, _ in kinds if w > 1]
    while todo:  # w is half + rest, half the greatest power of two below w
        w = todo.pop()
        if w > 1 and w not in parts:
            parts.add(w)
            half = 1 << ((w - 1).bit_length() - 1)
            todo += [half, w - half]
    for w in sorted(parts):
        half = 1 << ((w - 1).bit_length() - 1)
        size = F.greatest(F.col("n") - (w - 1), F.lit(0))
        made = {
            f"h{w}_{int(e)}": F.zip_with(F.slice(f"h{half}_{int(e)}", 1, size), F.slice(f"h{w - half}_{int(e)}", F.lit(half + 1), size), lambda x, y: F.xxhash64(x, y))
            for e in used
        }
        out = _apart(out, [*held, *have], **made)
        have += list(made)
    each = F.array(*[F.struct(F.lit(w).alias("span"), F.lit(e).alias("exact"), F.col(f"h{w}_{int(e)}").alias("hs")) for w, e in kinds])
    out = out.select(*held, F.explode(each).alias("x")).select(*held, "x.span", "x.exact", F.posexplode("x.hs").alias("at", "h"))
    return out.select(*held, "span", "exact", (F.col("at") + 1).alias("pos"), "h")


def _item_windows(items: DataFrame, width: int, kinds: list[tuple[int, bool]]) -> DataFrame:
    """item_id, first, item_n, item_pos, span, exact, h: the windows that items are looked up by. A window with fewer
    than LITERALS words that are no placeholders (or than its own words, if it is shorter), or of one or two words, is
    looked up with its slots' values, others by their templates. Of an item's forms beyond the first only the first
    window differs."""
    out = windows(items, kinds, ("s", "first")).where((F.col("span") == F.least("n", F.lit(width))) & ((F.col("first") == 0) | (F.col("pos") == 1)))
    literal = F.size(F.filter(F.slice("s", F.col("pos"), F.col("span")), lambda v: v == ""))
    poor = (F.col("span") < 3) | (literal < F.least(F.lit(LITERALS), F.col("span")))
    return out.where(F.col("exact") == poor).select(F.col("id").alias("item_id"), "first", F.col("n").alias("item_n"), F.col("pos").alias("item_pos"), "span", "exact", "h").distinct()


def _forms(items: DataFrame) -> DataFrame:
    """id, n, t, s, first: items, and again with the first word as a name or a unit: which of them it is depends on the
    word before, so a copy inside a document may have either."""
    word = F.element_at("t", 1)
    as_slot = [
        F.when(fits, F.struct(F.lit(i).alias("first"), F.concat(F.array(F.lit(mark)), F.slice("t", 2, F.size("t"))).alias("t"), F.concat(F.array(word), F.slice("s", 2, F.size("s"))).alias("s")))
        for i, mark, fits in ((1, "\x03", (word >= "a") & (word < "{")), (2, "\x02", word.isin(*UNITS)))
    ]
    plain = F.struct(F.lit(0).alias("first"), F.col("t"), F.col("s"))
    forms = F.when(F.element_at("s", 1) == "", F.array_compact(F.array(plain, *as_slot))).otherwise(F.array(plain))
    return items.where("n > 0").select("id", "n", F.explode(forms).alias("x")).select("id", "n", "x.*")


def row_key(id_col: str) -> Column:
    """What tells rows apart: id and text, nulls included (fields of a struct that are null compare as equal)."""
    return F.struct(F.col(id_col).alias(id_col), F.xxhash64("text").alias("h"))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """(doc_id, item_id, hits, consistent, doc, item): documents and benchmark items with aligned template windows; doc and
    item are their row_key.

    All windows of the items meet all windows of the documents, and each alignment found is then compared over its
    whole length. Windows of it count (hits) if their templates are equal and hold enough literal words, or if they are
    equal with the slots' values. The pair counts if such windows cover width + stride - 1 words of the alignment
    (`width`, if the item has fewer than width + 2 * stride words; all of an item shorter than `width`), so each shared
    run of that many template words is found wherever it begins, and each whole copy of an item. It is consistent if
    the item's values map one to one to the document's along the covered words, or if windows equal with their values
    cover as many words alone.

    Null or empty texts share nothing; repeated rows and items count once a pair. Rows and items are told apart by id and
    text: several texts under one id, or null ids, are rows each. Extra columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = scratch.save(_forms(templates(benchmark.select(row_key("item_id").alias("item_id"), "text"), "item_id")), "items")
    spans = [r["span"] for r in items.select(F.least("n", F.lit(width)).alias("span")).distinct().collect()]  # at most width values
    if not spans:
        of = {f.name: f for f in (*docs.select("doc_id", row_key("doc_id").alias("doc")).schema, *benchmark.select("item_id", row_key("item_id").alias("item")).schema)}
        schema = StructType([of["doc_id"], of["item_id"], StructField("hits", LongType()), StructField("consistent", BooleanType()), of["doc"], of["item"]])
        return spark.createDataFrame([], schema)
    theirs = scratch.save(_item_windows(items, width, [(w, e) for w in sorted(spans) for e in (False, True)]), "windows")
    kinds = sorted((r["span"], r["exact"]) for r in theirs.select("span", "exact").distinct().collect())
    hashed = docs.select(row_key("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("doc_id"), "text")  # one number while windows are looked up
    ours = windows(templates(hashed, "doc_id"), kinds).select(F.col("id").alias("doc_id"), "pos", "h", F.col("span").alias("w"), F.col("exact").alias("e"))
    met = ours.join(checked_broadcast(theirs), "h").where("w = span and e = exact")
    found = scratch.save(met.select("doc_id", "item_id", "first", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "found")

    again = hashed.join(checked_broadcast(scratch.save(found.select("doc_id").distinct(), "ids")), "doc_id", "left_semi")
    own = templates(again.select(F.struct("doc", "doc_id").alias("row"), "text"), "row").select("id.doc", "id.doc_id", "t", "s", "n")
    other = items.select(F.col("id").alias("item_id"), "first", F.col("t").alias("bt"), F.col("s").alias("bs"), F.col("n").alias("item_n"))
    pairs = own.join(checked_broadcast(found), "doc_id").join(checked_broadcast(other), ["item_id", "first"])
    lo = F.greatest(F.lit(1), 1 - F.col("shift"))
    size = F.greatest(F.least("item_n", F.col("n") - F.col("shift")) - lo + 1, F.lit(0))
    kept = ["doc", "item_id", "item_n"]
    pairs = _apart(pairs, kept, dt=F.slice("t", lo + F.col("shift"), size), ds=F.slice("s", lo + F.col("shift"), size), bt=F.slice("bt", lo, size), bs=F.slice("bs", lo, size))
    span = F.least("item_n", F.lit(width))
    starts = F.when(F.size("dt") >= span, F.sequence(F.lit(1), F.size("dt") - span + 1)).otherwise(F.array().cast("array<int>"))
    alike = F.filter(starts, lambda i: F.slice("dt", i, span) == F.slice("bt", i, span))
    pairs = _apart(pairs, [*kept, "ds", "bs"], alike=alike)
    exact = F.filter("alike", lambda i: F.slice("ds", i, span) == F.slice("bs", i, span))
    pairs = _apart(pairs, [*kept, "ds", "bs", "alike"], exact=exact)
    literal = F.filter("alike", lambda i: (span > 2) & (F.size(F.filter(F.slice("bs", i, span), lambda v: v == "")) >= F.least(F.lit(LITERALS), span)))
    pairs = _apart(pairs, [*kept, "ds", "bs", "exact"], good=F.array_union(literal, "exact"))

    def words(places):
        return F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(i, i + span - 1))))

    pairs = _apart(pairs, [*kept, "ds", "bs"], hits=F.size("good"), cover=words("good"), sure=F.size(words("exact")))
    slots = F.filter(F.array_distinct(F.transform("cover", lambda j: F.struct(F.element_at("ds", j).alias("d"), F.element_at("bs", j).alias("b")))), lambda v: (v["d"] != "") | (v["b"] != ""))
    pairs = _apart(pairs, [*kept, "hits", "sure"], size=F.size("cover"), slots=slots)
    need = F.when(F.col("item_n") < width + 2 * stride, span).otherwise(F.lit(width + stride - 1))
    mapped = (F.size(F.array_distinct("slots.d")) == F.size("slots")) & (F.size(F.array_distinct("slots.b")) == F.size("slots"))
    out = pairs.where(F.col("size") >= need).groupBy("doc", F.col("item_id").alias("item")).agg(F.max("hits").alias("hits"), F.max(mapped | (F.col("sure") >= need)).alias("consistent"))
    return scratch.save(out.select("doc.doc_id", "item.item_id", "hits", "consistent", "doc", "item"), "pairs")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_id (the least of its items), hits (of its best).
    Rows are judged by their own text, whatever their id; item_id is null where only items without an id are held."""
    found = leaks(docs, benchmark, width, stride).where("consistent")
    by_doc = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"), F.max("hits").alias("hits"))
    out = docs.select("doc_id", row_key("doc_id").alias("doc")).join(by_doc, "doc", "left")
    return out.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("hits", F.lit(0)).alias("hits")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage; rows that share an id, or have none, are judged one by one."""
    gone = leaks(docs, benchmark).where("consistent").select(F.col("doc").alias("__doc")).distinct()
    rows = docs.withColumn("__doc", row_key("doc_id"))
    return rows.join(gone, "__doc", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
