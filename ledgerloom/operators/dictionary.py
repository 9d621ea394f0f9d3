"""The self-extending word dictionary: seed, variants, lookups, correction, learning rules and cleanup.

Entries: raw_form (key), canonical_form, category, weight, source, verified, ignored, supplier_id, usage_count.
Corrections run over distinct tokens: guards and the exact lookup are joins; only misses reach the fuzzy lookup.
Learning is a result of its own and never feeds back inside a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions import text as X
from ledgerloom.functions.similarity import ratio_column
from ledgerloom.sources.scratch import apart

# Fixed values -------------------------------------------------------------------------------------------------------
VARIANTS = (("o", "0"), ("0", "o"), ("i", "1"), ("1", "i"), ("l", "1"), ("1", "l"), ("s", "5"), ("5", "s"), ("b", "8"), ("8", "b"), ("rn", "m"), ("cl", "d"), ("vv", "w"))
CONFUSIONS = (
    ("0", "O"), ("O", "0"), ("1", "I"), ("I", "1"), ("1", "L"), ("L", "1"), ("5", "S"), ("S", "5"), ("8", "B"), ("B", "8"), ("6", "G"), ("G", "6"),
    ("2", "Z"), ("Z", "2"), ("4", "A"), ("A", "4"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"),
    ("ri", "n"), ("fi", "A"), ("e", "é"), ("e", "è"), ("e", "ê"), ("e", "ë"), ("a", "à"), ("a", "â"), ("a", "ä"), ("u", "ù"), ("u", "û"), ("u", "ü"),
    ("i", "î"), ("i", "ï"), ("o", "ô"), ("o", "ö"), ("c", "ç"), (" ", ""),
)
VARIANT_CATEGORIES = ("PRODUCT", "BRAND", "MATERIAL", "HEADER", "DOCUMENT")
EXACT_WEIGHT = 0.7
MAX_DISTANCE, MIN_RATIO = 2, 0.80
LONG = 24
# --------------------------------------------------------------------------------------------------------------------


def first_replaced(text: Column, old: str, new: str) -> Column:
    """The first occurrence of old replaced; null if there is none."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + len(old))))


def seed(entries: DataFrame) -> DataFrame:
    """DIC1, SET3: the first entry of each key. entries: ord, raw, canonical, category."""
    keyed = entries.withColumn("raw_form", X.dictionary_key("raw")).where("raw_form <> ''")
    return keyed.groupBy("raw_form").agg(F.min_by(F.struct("canonical", "category"), "ord").alias("b"), F.min("ord").alias("ord")).select("raw_form", F.upper("b.canonical").alias("canonical_form"), "b.category", "ord")


def ocr_variants(entries: DataFrame) -> DataFrame:
    """DIC2: variants of seed entries by one confusion each; words only. entries: raw_form, canonical_form, category."""
    base = F.lower("raw_form")
    each = F.array_compact(F.array(*[first_replaced(base, a, b) for a, b in VARIANTS]))
    at = entries.where(F.col("category").isin(*VARIANT_CATEGORIES)).select(F.explode(F.array_distinct(each)).alias("variant"), F.col("raw_form").alias("base"), "canonical_form", "category")
    return at.where((F.length("variant") >= 3) & (F.col("variant") != F.lower("base")) & G.is_dictionary_candidate("variant", F.lit("designation")))


def seed_with_variants(entries: DataFrame) -> DataFrame:
    """SET3: seeds and variants, seeds first, the first of each key."""
    own = seed(entries)
    more = ocr_variants(own).select(X.dictionary_key("variant").alias("raw_form"), "canonical_form", "category", F.lit(1).alias("level"), F.col("base").alias("by"))
    both = own.select("raw_form", "canonical_form", "category", F.lit(0).alias("level"), F.col("raw_form").alias("by")).unionByName(more).where("raw_form <> ''")
    return both.groupBy("raw_form").agg(F.min_by(F.struct("canonical_form", "category", "level"), F.struct("level", "by")).alias("b")).select("raw_form", "b.canonical_form", "b.category", "b.level")


def confusion_candidates(token: Column, limit: int = 6) -> Column:
    """DIC12: the token and its single confusions in code-point order, at most limit; long tokens alone. Each confusion is looked for as it is written and, at its
    first place, in any case."""
    def anywhere(a: str, b: str) -> Column:
        at = F.locate(a.lower(), F.lower(token))
        return F.when(at > 0, F.concat(F.substring(token, F.lit(1), at - 1), F.lit(b), F.substring(token, at + len(a), F.length(token))))

    each = [c for a, b in CONFUSIONS for c in (first_replaced(token, a, b), anywhere(a, b))]
    return F.when(F.length(token) > 20, F.array(token)).otherwise(F.slice(F.array_sort(F.array_distinct(F.array_compact(F.array(token, *each)))), 1, limit))


def usable(dictionary: DataFrame) -> DataFrame:
    return dictionary.where((F.col("verified")) & (~F.col("ignored")) & (F.col("weight") > EXACT_WEIGHT))


def verified(dictionary: DataFrame) -> DataFrame:
    """What the fuzzy lookup searches: verified entries that are not ignored, of any weight."""
    return dictionary.where(F.col("verified") & ~F.col("ignored"))


def _deletions(c: Column) -> Column:
    """The string and what is left of it after deleting one or two characters."""
    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(v))), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))

    one = F.array_distinct(cut(c))
    return F.array_distinct(F.concat(F.array(c), one, F.flatten(F.transform(one, cut))))


def _cuts(n: Column) -> list[tuple[Column, Column]]:
    """Starts and lengths of three even pieces of a string of n characters."""
    third = F.floor(n / 3).cast("int")
    return [(F.lit(1), third), (third + 1, third), (2 * third + 1, (n - 2 * third).cast("int"))]


def _pieces(c: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("at"), F.substr(c, a, k).alias("piece")) for i, (a, k) in enumerate(_cuts(F.length(c)))])


def _places(c: Column, n: Column) -> Column:
    """Where the pieces of an entry of n characters may stand in a string within MAX_DISTANCE edits of it."""
    each = []
    for i, (a, k) in enumerate(_cuts(n)):
        for shift in range(-MAX_DISTANCE, MAX_DISTANCE + 1):
            each.append(F.when(a + shift >= 1, F.struct(F.lit(i).alias("at"), F.substr(c, F.greatest(F.lit(1), a + shift), k).alias("piece"))))
    return F.array_distinct(F.array_compact(F.array(*each)))


def near_entries(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """key, raw_form, canonical_form, weight, distance of the entries within 2 edits of each key.

    Strings within 2 edits share a string got by deleting up to 2 characters of each, so candidates come from an equi-join on
    such strings: no key meets an entry that shares none. Longer strings than LONG have too many of them; of such a string, cut into
    three pieces, two edits leave one piece as it is, at most two places away, so they meet by pieces and places instead. A string near the limit takes both ways."""
    short = lambda df, c: df.where(F.length(c) <= LONG)
    entry = ("raw_form", "canonical_form", "weight")
    words = short(keys, "key").select("key", F.explode(_deletions(F.col("key"))).alias("d"))
    known = short(entries, "raw_form").select(*entry, F.explode(_deletions(F.col("raw_form"))).alias("d"))
    far = lambda df, c: df.where(F.length(c) > LONG - MAX_DISTANCE)
    pieces = far(entries, "raw_form").select(*entry, F.explode(_pieces(F.col("raw_form"))).alias("p")).select(*entry, F.col("p.at").alias("at"), F.col("p.piece").alias("d"), F.length("raw_form").alias("n"))
    places = far(keys, "key").select("key", F.explode(F.sequence(F.length("key") - MAX_DISTANCE, F.length("key") + MAX_DISTANCE)).alias("n"))
    places = places.select("key", "n", F.explode(_places(F.col("key"), F.col("n"))).alias("p")).select("key", "n", F.col("p.at").alias("at"), F.col("p.piece").alias("d"))
    pairs = words.join(known, "d").drop("d").unionByName(places.join(pieces, ["n", "at", "d"]).select("key", *entry)).distinct()
    return pairs.withColumn("distance", F.levenshtein("key", "raw_form", MAX_DISTANCE)).where("distance >= 0")


def fuzzy_lookup(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JN18: key, canonical_form, weight of the best verified entry within 2 edits and 80% similarity."""
    scored = near_entries(keys, verified(dictionary)).withColumn("ratio", ratio_column("key", "raw_form") / 100).where(F.col("ratio") >= MIN_RATIO)
    scored = scored.withColumn("score", F.col("ratio") * (1 - 0.05 * F.col("distance")))
    best = scored.groupBy("key").agg(F.max_by(F.struct("canonical_form", "score", "raw_form"), F.struct("score", F.col("weight"), F.col("raw_form"))).alias("b"))
    return best.select("key", "b.canonical_form", F.least(F.col("b.score") * 0.95, F.lit(0.95)).alias("weight"))


def correct_tokens(tokens: DataFrame, dictionary: DataFrame, field: str = "designation") -> DataFrame:
    """DIC3: token, corrected, method, confidence for distinct tokens (one column, token)."""
    t = F.col("token")
    blank, protected = F.coalesce(F.trim(t), F.lit("")) == "", G.is_protected(t, F.lit(field))
    open_ = ~blank & ~protected & G.is_dictionary_candidate(t, F.lit(field)) & G.is_normalizable_field(F.lit(field))
    at = apart(tokens.select("token").distinct()).withColumn("open", open_).withColumn("key", F.when(F.col("open"), X.dictionary_key("token")))
    exact = usable(dictionary).select(F.col("raw_form").alias("key"), F.col("canonical_form").alias("exact"), F.col("weight").alias("exact_weight"))
    at = at.join(exact, "key", "left")
    missing = at.where("open and exact is null").select("key").distinct()
    fuzzy = fuzzy_lookup(missing, dictionary).select("key", F.col("canonical_form").alias("fuzzy"), F.col("weight").alias("fuzzy_weight"))
    at = at.join(fuzzy, "key", "left")
    return at.select(
        "token", F.coalesce("exact", "fuzzy", "token").alias("corrected"),
        F.when(blank, "PASSTHROUGH").when(protected, "PROTECTED").when(~F.col("open"), "PROTECTED").when(F.col("exact").isNotNull(), "EXACT").when(F.col("fuzzy").isNotNull(), "FUZZY").otherwise("PASSTHROUGH").alias("method"),
        F.when(blank, 0.0).when(~F.col("open"), 1.0).otherwise(F.coalesce("exact_weight", "fuzzy_weight", F.lit(0.5))).alias("confidence"),
    )


def normalise_texts(texts: DataFrame, dictionary: DataFrame, field: str = "designation") -> DataFrame:
    """DIC4, DIC5: id, text, normalised. Tokens between white space are corrected; white space stays."""
    parts = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\s+|\S+)"), 1)).alias("pos", "token"))
    fixed = correct_tokens(parts.where(F.trim("token") != "").select("token"), dictionary, field).select("token", "corrected")
    joined = parts.join(fixed, "token", "left").withColumn("new", F.coalesce("corrected", "token"))
    whole = joined.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda z: z["new"]), "").alias("normalised"))
    return texts.join(whole, "id", "left").select("id", "text", F.coalesce("normalised", "text").alias("normalised"))


def upsert(known: DataFrame, new: DataFrame) -> DataFrame:
    """DIC8, SNK5: manual entries stay; the heavier or newly verifying canonical form wins; flags and weights merge."""
    fields = ("canonical_form", "category", "weight", "source", "verified", "ignored", "supplier_id")
    side = lambda df, p: df.select("raw_form", *[F.col(c).alias(f"{p}_{c}") for c in fields])
    at = side(known, "o").join(side(new, "n"), "raw_form", "full")
    o, n = F.col("o_canonical_form").isNotNull(), F.col("n_canonical_form").isNotNull()
    manual = o & (F.col("o_source") == "MANUAL")
    take = n & (~o | (~manual & ((F.col("n_weight") > F.col("o_weight")) | (F.col("n_verified") & ~F.col("o_verified")))))
    take = F.coalesce(take, F.lit(False))
    pick = lambda c: F.when(take, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    both = o & n & ~manual
    return at.select(
        "raw_form", pick("canonical_form"), F.coalesce("o_category", "n_category").alias("category"),
        F.when(both, F.greatest("o_weight", "n_weight")).otherwise(F.when(o, F.col("o_weight")).otherwise(F.col("n_weight"))).alias("weight"), pick("source"),
        F.when(both, F.col("o_verified") | F.col("n_verified")).otherwise(F.coalesce("o_verified", "n_verified")).alias("verified"),
        F.when(both, F.col("o_ignored") & F.col("n_ignored")).otherwise(F.coalesce("o_ignored", "n_ignored")).alias("ignored"), F.coalesce("o_supplier_id", "n_supplier_id").alias("supplier_id"),
    )


def absent(known: DataFrame, new: DataFrame) -> DataFrame:
    """SNK6, SET4: new entries whose key is not known."""
    return new.join(known.select("raw_form"), "raw_form", "left_anti")


def learn_external(tokens: DataFrame, answers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """DIC6: entries from external corrections (token, canonical, category, confidence) of unknown candidates: kept from
    0.70, unverified, weight at most 0.75, never over an existing key."""
    open_ = tokens.where(G.is_dictionary_candidate("token", F.lit("designation"))).withColumn("raw_form", X.dictionary_key("token"))
    at = absent(dictionary, open_).join(answers, "token").where("confidence >= 0.70")
    return at.groupBy("raw_form").agg(F.max_by(F.struct(F.upper("canonical").alias("canonical_form"), "category", F.least("confidence", F.lit(0.75)).alias("weight")), F.struct("confidence", "canonical")).alias("b")).select(
        "raw_form", "b.*", F.lit("MODEL").alias("source"), F.lit(False).alias("verified"), F.lit(False).alias("ignored")
    )


def statistics(dictionary: DataFrame) -> DataFrame:
    """AGG15: total, unverified, ignored and counts by source and category, in one pass over grouping sets."""
    d = dictionary.select("source", "category", F.col("verified").cast("int").alias("v"), F.col("ignored").cast("int").alias("i"))
    sets = d.groupingSets([[], ["source"], ["category"]], "source", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("v")).alias("unverified"), F.sum("i").alias("ignored"), F.grouping_id().alias("g")
    )
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "source").otherwise("category")
    return sets.select(kind.alias("kind"), F.coalesce("source", "category", F.lit("")).alias("value"), "n", "unverified", "ignored")


def cleanup_flags(dictionary: DataFrame) -> DataFrame:
    """DIC10: entries with would_ignore, from their raw and canonical forms."""
    bad = G.looks_generated("raw_form", F.col("source")) | G.looks_generated("canonical_form", F.col("source"))
    return dictionary.withColumn("would_ignore", ~F.col("ignored") & bad)


def count_usage(dictionary: DataFrame, uses: DataFrame) -> DataFrame:
    """DIC9: usage counters raised by the uses (raw_form) of a run."""
    n = uses.groupBy("raw_form").agg(F.count(F.lit(1)).alias("__n"))
    return dictionary.join(n, "raw_form", "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def renormalised(lines: DataFrame, dictionary: DataFrame, prefer_raw: bool, only_containing: str | None = None) -> DataFrame:
    """DIC11: line_item_id, before, after of lines whose designation changes. The job form prefers the raw designation, the batch
    form the current one."""
    pick = F.coalesce(F.nullif("raw_designation", F.lit("")), "designation") if prefer_raw else F.coalesce(F.nullif("designation", F.lit("")), "raw_designation")
    at = lines.where(G.contains_text(F.col("designation"), F.col("raw_designation"), only_containing)) if only_containing else lines
    done = normalise_texts(at.select(F.col("line_item_id").alias("id"), pick.alias("text")).where("text is not null"), dictionary)
    own = at.select("line_item_id", F.col("designation").alias("before"))
    return own.join(done, F.col("line_item_id") == F.col("id")).where("not (before <=> normalised)").select("line_item_id", "before", F.col("normalised").alias("after"))
