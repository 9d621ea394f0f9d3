"""Supplier detection, profiles, pattern mining and alias mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions import text as X
from ledgerloom.functions.similarity import ratio_column
from ledgerloom.operators.containment import contained

# Fixed values -------------------------------------------------------------------------------------------------------
ISSUER_LABELS = ("fournisseur", "vendeur", "emetteur", "émetteur", "société", "societe", "raison sociale", "de :", "de:", "from:")
RECIPIENT_LABELS = ("client", "acheteur", "destinataire", "à :", "a:", "to:", "bon de commande", "commande", "réception", "reception")
VISIBLE_REFS = (r"\b[A-Z]\d{6,}\b", r"\b[A-Z]{2,4}\d{4,}\b")
NAME_PATTERNS = (
    r"(?:FOURNISSEUR|RAISON SOCIALE|VENDEUR|SOCIETE|SOCIÉTÉ)\s*[:\-]?\s*([A-ZÀ-Ÿ][A-ZÀ-Ÿa-zà-ÿ0-9\s&\.\-]{3,60})",
    r"(?:DE\s*:)\s*([A-ZÀ-Ÿ][A-ZÀ-Ÿa-zà-ÿ0-9\s&\.\-]{3,60})",
)
TITLES, TITLES_ONLY = r"^(BON|FACTURE|COMMANDE|LIVRAISON|RECEPTION|N[°O])", r"^(BON|FACTURE|COMMANDE|LIVRAISON|RECEPTION)"
#: A word's ends are letters, digits or underscores; marks do not count.
WORD = r"(?<![\p{L}\p{N}_])([A-ZÀ-Ÿ]{3,20})(?![\p{L}\p{N}_])"
GENERIC_WORDS = (
    "BON", "DE", "COMMANDE", "LIVRAISON", "FACTURE", "DATE", "REF", "REFERENCE", "TOTAL", "TVA", "HT", "TTC", "PRIX", "QTE",
    "DESIGNATION", "ARTICLE", "MONTANT", "NET",
)
COLUMNS = {
    "ref_produit": ("réf", "ref", "reference", "référence", "article", "code", "cod", "art", "produit", "item"),
    "designation": ("désignation", "designation", "description", "libellé", "libelle", "intitulé", "intitule", "produit", "article"),
    "qty": ("quantité", "quantite", "qté", "qte", "qt", "nb", "nbre", "quantit", "qnt"),
    "unit": ("unité", "unite", "um", "u.m", "mesure", "unit"),
    "prix_unitaire": ("prix unit", "p.u", "pu", "prix u", "prix ht", "prix un", "tarif", "p.u.ht", "pu ht"),
    "tva_rate": ("tva", "t.v.a", "taxe", "%tva", "taux tva"),
    "remise": ("remise", "rem", "% rem", "rabais", "discount", "%rem"),
    "total_ligne": ("montant ht", "total ht", "montant", "total", "total ligne", "net ht", "tot ht", "montant net"),
}
TOKEN = r"\b([A-Z]{1,6}[\-\.]?[A-Z0-9]{2,}(?:[\-\.][A-Z0-9]+)*)\b"
PROMOTE_AT, KEEP, TOP = 3, 12, 8
ENRICH_AT, CREATE_AT = 0.35, 0.20
SAME_NAME = 0.85
# --------------------------------------------------------------------------------------------------------------------


def containing_supplier(texts: DataFrame, suppliers: DataFrame) -> DataFrame:
    """JN15: the first confirmed supplier by name whose name, ids or aliases a text contains, accents and case aside. texts: doc_id, text; suppliers: name, identifiers (array)."""
    up = lambda c: F.upper(X.fold_accents(c))
    own = suppliers.select("name", F.explode(F.array_distinct(F.transform("identifiers", up))).alias("needle")).where("needle <> ''").groupBy("needle").agg(F.min("name").alias("name"))
    hits = contained(texts.select("doc_id", up("text").alias("text")), own)
    return hits.join(own, "needle").groupBy("doc_id").agg(F.min("name").alias("supplier_name"))


def ratios_of_at_least(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """pairs with their ratio in percent where it is least or more. What cannot reach it by its edit distance does not reach the scorer."""
    room = (1 - least / 100) * (F.length(a) + F.length(b)) + 1e-9
    at = pairs.where((F.abs(F.length(a) - F.length(b)) <= room) & (F.levenshtein(a, b) <= room))
    return at.withColumn("ratio", ratio_column(a, b)).where(F.col("ratio") >= least)


def _alike(detected: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of upper-cased detected names and profile names (detected, up) with a ratio of SAME_NAME or more: distinct names of lengths that allow it."""
    d, n = detected.where("detected <> ''").distinct(), names.where("up <> ''").distinct()
    far = (2 - SAME_NAME) / SAME_NAME
    reach = F.sequence(F.floor(F.length("detected") / far).cast("int"), F.ceil(F.length("detected") * far).cast("int"))
    near = d.withColumn("len", F.explode(reach)).join(n.withColumn("len", F.length("up")), "len")
    return ratios_of_at_least(near, "detected", "up", 100 * SAME_NAME).select("detected", "up")


def profile_scores(texts: DataFrame, profiles: DataFrame, buyers: tuple[str, ...] = ()) -> DataFrame:
    """JN16: doc_id, name, score of the best profile. profiles: name (unique), siret, vat_number, name_aliases, keywords, ref_patterns; texts: doc_id, text, detected_name. The weights of the
    checks that count are summed and divided by their number; keywords count wherever a profile has some. Of equal scores the last name counts. Known buyers are no suppliers.

    Names, aliases, ids and keywords are found in one scan of the texts; every distinct pattern is tried once a text. What a text says for sure of a profile (name, alias, id, like name)
    makes a pair. All other profiles differ by their keywords and patterns only: of each class of equal ones, a text needs the last name that is in none of its pairs."""
    own = profiles.where(~G.is_known_buyer("name", buyers)).withColumn("name", F.coalesce("name", F.lit("")))
    kept = lambda c: F.array_sort(F.filter(F.coalesce(c, F.array()), lambda v: v.isNotNull()))
    own = own.select("name", "siret", "vat_number", "name_aliases", kept(F.col("keywords")).alias("keywords"), F.array_distinct(kept(F.col("ref_patterns"))).alias("ref_patterns"))
    own = own.withColumn("class", F.sha2(F.to_json(F.struct("keywords", "ref_patterns")), 256))
    known = texts.select("doc_id", F.col("text").alias("raw"), F.upper("text").alias("text"), F.upper("detected_name").alias("detected"))

    # needles of upper-cased texts, and of texts as they are
    long_ = lambda v: F.length(v) >= 3
    named = own.select("name", F.upper("name").alias("needle"), F.lit("name_").alias("check")).where(F.length("name") >= 3)
    aliased = own.select("name", F.explode(F.filter(F.coalesce("name_aliases", F.array()), long_)).alias("v")).select("name", F.upper("v").alias("needle"), F.lit("alias").alias("check"))
    ids = [own.select("name", F.col(c).alias("needle"), F.lit(c).alias("check")).where("needle <> ''") for c in ("siret", "vat_number")]
    words = own.select("class", "keywords").distinct().select("class", F.explode("keywords").alias("v")).where("v <> ''").select("class", F.upper("v").alias("needle"))
    upper = contained(known.select("doc_id", "text"), named.select("needle").union(aliased.select("needle")).union(words.select("needle")))
    plain = contained(known.select("doc_id", F.col("raw").alias("text")), ids[0].select("needle").union(ids[1].select("needle")))

    # pairs by certain checks
    like = known.select("doc_id", "detected").join(_alike(known.select("detected"), own.select(F.upper("name").alias("up"))), "detected").join(own.select("name", F.upper("name").alias("up")), "up").select("doc_id", "name", F.lit("like").alias("check"))
    sure = upper.join(named.unionByName(aliased), "needle").select("doc_id", "name", "check").distinct().unionByName(plain.join(ids[0].unionByName(ids[1]), "needle").select("doc_id", "name", "check").distinct()).unionByName(like)
    marks = ("name_", "like", "alias", "siret", "vat_number")
    pairs = sure.groupBy("doc_id", "name").agg(*[F.max(F.col("check") == m).alias(m) for m in marks]).join(own.select("name", "class"), "name")

    # classes by keywords and patterns
    classes = own.groupBy("class").agg(F.first("keywords").alias("keywords"), F.first("ref_patterns").alias("ref_patterns"))
    n_words = classes.select("class", F.size("keywords").alias("n_words"))
    said = words.groupBy("class", "needle").agg(F.count(F.lit(1)).alias("n"))
    heard = upper.join(said, "needle").groupBy("doc_id", "class").agg(F.sum("n").alias("words"))
    patterns = classes.select("class", F.explode("ref_patterns").alias("pattern"))
    tried = known.select("doc_id", "text").join(patterns.select("pattern").distinct(), F.regexp_like("text", "pattern")).select("doc_id", "pattern")
    matched = tried.join(patterns, "pattern").select("doc_id", "class").distinct().withColumn("pattern", F.lit(True))
    of_class = heard.join(matched, ["doc_id", "class"], "full").select("doc_id", "class", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("pattern", F.lit(False)).alias("pattern"))

    # of each class the last name that is in no pair: one of the last k + 1 for k pairs
    ranked = own.select("class", "name", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("name"))).alias("rank"))
    per = pairs.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("k"))
    free = of_class.join(per, ["doc_id", "class"], "left").select("doc_id", "class", F.explode(F.sequence(F.lit(1), F.coalesce("k", F.lit(0)).cast("int") + 1)).alias("rank"))
    free = free.join(ranked, ["class", "rank"]).join(pairs.select("doc_id", "name"), ["doc_id", "name"], "left_anti").groupBy("doc_id", "class").agg(F.max("name").alias("name"))
    every = pairs.select("doc_id", "name", "class", *marks).unionByName(free.select("doc_id", "name", "class", *[F.lit(False).alias(m) for m in marks]))
    at = every.join(n_words, "class").join(of_class, ["doc_id", "class"], "left")

    part = F.coalesce("words", F.lit(0)) / F.greatest("n_words", F.lit(1))
    checks = [
        (F.col("name_"), F.lit(0.70)), (F.col("like"), F.lit(0.30)), (F.col("alias"), F.lit(0.50)), (F.col("siret"), F.lit(0.90)), (F.col("vat_number"), F.lit(0.90)),
        (F.col("n_words") > 0, part * 0.40), (F.coalesce("pattern", F.lit(False)), F.lit(0.30)),
    ]
    total, used = F.lit(0.0), F.lit(0)
    for counted, weight in checks:
        total, used = total + F.when(counted, weight).otherwise(0.0), used + counted.cast("int")
    scored = at.withColumn("score", F.least(F.lit(1.0), total / F.greatest(used, F.lit(1)))).where("score > 0")
    return scored.groupBy("doc_id").agg(F.max_by(F.struct("name", "score"), F.struct("score", F.col("name"))).alias("b")).select("doc_id", "b.name", "b.score")


def detection(score: Column, detected_name: Column, enrich_at: float = ENRICH_AT, cold_start_min: float = CREATE_AT) -> Column:
    """SUP4: ENRICH a known profile, CREATE one, or GENERIC."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= enrich_at, "ENRICH").when(F.coalesce(detected_name, F.lit("")) == "", "GENERIC").when(s < cold_start_min, "GENERIC").otherwise("CREATE")


def _unknown(name: Column, buyers: tuple[str, ...]) -> Column:
    return ~G.is_known_buyer(name, buyers)


def _in_capitals(line: Column, titles: str, buyers: tuple[str, ...]) -> Column:
    """A line of capitals: two words and five characters at least, no title of a document, no known buyer."""
    v = F.trim(line)
    return (v == F.upper(v)) & (F.size(F.split(v, r"(?U)\s+")) >= 2) & (F.length(v) >= 5) & ~v.rlike(titles) & _unknown(v, buyers)


def roles(lines: DataFrame, buyers: tuple[str, ...] = ()) -> DataFrame:
    """SUP1, SUP2: issuer and recipient candidates of texts. lines: doc_id, line_no (from 1), line; buyers: known buyers in lower case, which are no issuers.

    A label in the first 30 lines names what follows its line's first colon, if that has three characters, else the next of these lines, if it has and holds no label. The first line of
    capitals of the first 15 is an issuer too. Returns doc_id, role, name, confidence, line_no."""
    low = F.lower(F.col("line"))
    at = lines.where("line_no <= 30").withColumn("next", F.trim(F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))))
    holds = lambda c, labels: F.exists(F.array(*[F.lit(v) for v in labels]), lambda v: c.contains(v))
    after = F.trim(F.regexp_extract("line", "(?s):(.*)$", 1))
    follows = (F.length("next") >= 3) & ~holds(F.lower("next"), (*ISSUER_LABELS, *RECIPIENT_LABELS))
    name = F.substring(F.when(F.length(after) >= 3, after).when(follows, F.col("next")), 1, 80)
    issuer = at.where(holds(low, ISSUER_LABELS)).select("doc_id", F.lit("ISSUER").alias("role"), name.alias("name"), F.lit(0.80).alias("confidence"), "line_no").where(_unknown(F.col("name"), buyers))
    recipient = at.where(holds(low, RECIPIENT_LABELS)).select("doc_id", F.lit("RECIPIENT").alias("role"), name.alias("name"), F.lit(0.75).alias("confidence"), "line_no")
    caps = at.where("line_no <= 15").where(_in_capitals(F.col("line"), TITLES, buyers)).groupBy("doc_id").agg(F.min_by(F.struct("line", "line_no"), "line_no").alias("c"))
    caps = caps.select("doc_id", F.lit("ISSUER").alias("role"), F.substring(F.trim("c.line"), 1, 100).alias("name"), F.lit(0.55).alias("confidence"), "c.line_no")
    return issuer.unionByName(recipient).unionByName(caps).where("name <> ''")


def supplier_names(lines: DataFrame, buyers: tuple[str, ...] = ()) -> DataFrame:
    """SUP1-SUP3, SRT6: doc_id, name, found_by: the issuer of the highest confidence, the first among equals; without one, what follows a label anywhere in the
    first 20 lines; else the first line of capitals of the first 15, a number's heading included."""
    issuer = roles(lines, buyers).where("role = 'ISSUER'").groupBy("doc_id").agg(F.min_by("name", F.struct(-F.col("confidence"), F.col("line_no"))).alias("by_role"))
    head = lines.where("line_no <= 20").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("head"))
    tidy = lambda p: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract("head", "(?iU)" + p, 1), r"(?U)^\s+|\s+$", "")), "[.,;]+$", "")
    usable = lambda v: F.when((F.length(v) >= 3) & _unknown(v, buyers), v)
    caps = lines.where("line_no <= 15").where(_in_capitals(F.col("line"), TITLES_ONLY, buyers)).groupBy("doc_id").agg(F.min_by("line", "line_no").alias("caps"))
    at = head.join(issuer, "doc_id", "left").join(caps, "doc_id", "left")
    at = at.select("doc_id", "by_role", F.coalesce(*[usable(tidy(p)) for p in NAME_PATTERNS]).alias("by_label"), F.substring(F.trim("caps"), 1, 100).alias("by_capitals"))
    found_by = F.when(F.col("by_role").isNotNull(), "ROLE").when(F.col("by_label").isNotNull(), "LABEL").otherwise("CAPITALS")
    return at.select("doc_id", F.coalesce("by_role", "by_label", "by_capitals").alias("name"), found_by.alias("found_by")).where("name is not null")


def column_layout(lines: DataFrame) -> DataFrame:
    """SUP5: doc_id, line_no, detected_header and columns (name, x_position) of the first line of a document with most column vocabularies, at least 3. A column stands where the first word of its
    vocabulary that occurs in the line begins; columns in the order of their places."""
    low = F.lower(F.col("line"))
    place = lambda words: F.coalesce(*[F.nullif(F.locate(w, low), F.lit(0)) for w in words]) - 1
    each = F.array(*[F.struct(place(words).alias("x_position"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(COLUMNS.items())])
    at = lines.withColumn("columns", F.array_sort(F.filter(each, lambda c: c["x_position"].isNotNull()))).where(F.size("columns") >= 3)
    best = at.groupBy("doc_id").agg(F.max_by(F.struct("line_no", "line", "columns"), F.struct(F.size("columns"), -F.col("line_no"))).alias("b"))
    columns = F.transform("b.columns", lambda c: F.struct(c["name"].alias("name"), c["x_position"].alias("x_position")))
    return best.select("doc_id", "b.line_no", F.trim("b.line").alias("detected_header"), columns.alias("columns"))


def mine_patterns(texts: DataFrame, key: str, top: int = TOP) -> DataFrame:
    """AGG11: key, pattern, n, place: generalised patterns of a document's code-like tokens that occur twice in it, by their number, the first seen among equals. texts has one
    row a key. Tokens begin with letters, of upper-cased text, and have a digit and 4 to 20 characters."""
    tokens = texts.select(key, F.posexplode(F.regexp_extract_all(F.upper("text"), F.lit("(?U)" + TOKEN), 1)).alias("pos", "token"))
    tokens = tokens.where(F.col("token").rlike(r"(?U)\d") & F.length("token").between(4, 20))
    seen = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).where("n >= 2")
    found = seen.withColumn("pattern", X.generalised("token")).groupBy(key, "pattern").agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "pos"))
    return found.withColumn("place", place).where(F.col("place") <= top).drop("pos")


def header_keywords(texts: DataFrame, key: str, stop_words: tuple[str, ...] = GENERIC_WORDS, top: int = 15) -> DataFrame:
    """AGG12: key, word, n, place: the most common words of 3 to 20 capitals in the first 500 characters, upper-cased, the first seen among equals; then the generic ones
    go, so there may be fewer than top. texts has one row a key; a known buyer's name belongs to stop_words."""
    words = texts.select(key, F.posexplode(F.regexp_extract_all(F.upper(F.substring("text", 1, 500)), F.lit(WORD), 1)).alias("pos", "word"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "pos"))
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).withColumn("place", place)
    return counted.where((F.col("place") <= top) & ~F.col("word").isin(*stop_words)).drop("pos")


def promoted_patterns(evidence: DataFrame, promote_at: int = PROMOTE_AT, keep: int = KEEP) -> DataFrame:
    """AGG13: supplier_key, pattern, documents, promoted_by, place: patterns of a supplier seen in promote_at documents, in the order of their promotion, the first keep of them. evidence:
    supplier_key, pattern, doc_id (documents come in its order) and, where it is there, pos, the place of a pattern in its document. promoted_by is the document that promotes."""
    once = evidence.groupBy("supplier_key", "pattern", "doc_id").agg((F.min("pos") if "pos" in evidence.columns else F.min("pattern")).alias("pos"))
    seen = once.withColumn("n", F.row_number().over(Window.partitionBy("supplier_key", "pattern").orderBy("doc_id")))
    found = seen.groupBy("supplier_key", "pattern").agg(F.max("n").cast("long").alias("documents"), F.max(F.when(F.col("n") == promote_at, F.struct("doc_id", "pos"))).alias("by")).where("by is not null")
    place = F.row_number().over(Window.partitionBy("supplier_key").orderBy("by.doc_id", "by.pos", "pattern"))
    return found.withColumn("place", place).where(F.col("place") <= keep).select("supplier_key", "pattern", "documents", F.col("by.doc_id").alias("promoted_by"), "place")


def raised_confidence(evidence: DataFrame, start: float = 0.4, step: float = 0.05, promote_at: int = PROMOTE_AT, keep: int = KEEP) -> DataFrame:
    """AGG13: supplier_key, changes, confidence: a profile's confidence rises with every document that promotes a pattern, to 1 at most. A pattern that finds no room among the kept ones
    is promoted again by every later document that shows it. evidence as for promoted_patterns(); suppliers whose patterns promote nothing have no row."""
    once = evidence.groupBy("supplier_key", "pattern", "doc_id").agg(F.lit(1).alias("one")).drop("one")
    seen = once.withColumn("n", F.row_number().over(Window.partitionBy("supplier_key", "pattern").orderBy("doc_id"))).where(F.col("n") >= promote_at)
    kept = promoted_patterns(evidence, promote_at, keep).select("supplier_key", "pattern", F.lit(True).alias("kept"))
    changing = seen.join(kept, ["supplier_key", "pattern"], "left").where((F.col("n") == promote_at) | F.col("kept").isNull())
    per = changing.groupBy("supplier_key").agg(F.countDistinct("doc_id").alias("changes"))
    return per.withColumn("confidence", F.least(F.lit(1.0), F.round(start + step * F.col("changes"), 9)))


def visible_references(text: Column | str, patterns: tuple[str, ...] = VISIBLE_REFS) -> Column:
    """AGG14: the number of distinct references in a text as it is, by a supplier's own patterns or the generic ones."""
    t = text if isinstance(text, Column) else F.col(text)
    found = [F.regexp_extract_all(t, F.lit("(?U)" + p), F.lit(0)) for p in patterns]
    return F.coalesce(F.size(F.array_distinct(F.flatten(F.array(*found)))), F.lit(0))


def mine_aliases(orders: DataFrame, invoices: DataFrame, least: float = 50.0) -> DataFrame:
    """JN21: internal_ref, external_ref, score (the best), n: references of lines of a job that are close in quantity and price and have similar descriptions. Both: job_id, ord, ref, designation, qty,
    price. An order line takes the invoice line with the highest ratio of its sorted words, the first among equals, if it is least or more; pairs of equal references go then. Spaces
    and case of references do not count.

    A ratio r of n and m characters leaves (1 - r)(n + m) insertions and deletions, so at most as many edits, which the JVM counts. Only pairs within that are scored, once a distinct pair."""
    f = invoices.select("job_id", *[F.col(c).alias(f"f_{c}") for c in ("ord", "ref", "designation", "qty", "price")])
    near = orders.join(f, "job_id").where("abs(qty - f_qty) <= 0.5 and abs(price - f_price) <= 0.02")
    words = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.lower(F.coalesce(c, F.lit("None"))), r"(?U)\s+"), lambda w: w != "")), " ")
    near = near.withColumn("__a", words("designation")).withColumn("__b", words("f_designation"))
    pairs = near.select("__a", "__b").distinct()
    scored = ratios_of_at_least(pairs, "__a", "__b", least).withColumnRenamed("ratio", "score")
    best = near.join(scored, ["__a", "__b"]).groupBy("job_id", "ord").agg(F.max_by(F.struct("ref", "f_ref", "score"), F.struct("score", -F.col("f_ord"))).alias("b"))
    clean = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("")))
    found = best.where("b.ref <> b.f_ref").select(clean(F.col("b.ref")).alias("internal_ref"), clean(F.col("b.f_ref")).alias("external_ref"), "b.score")
    return found.groupBy("internal_ref", "external_ref").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
