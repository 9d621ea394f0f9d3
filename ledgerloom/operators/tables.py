"""Word boxes of pages to table lines, in one pass: the words of a page come together once, and rows, header, column ranges and cells are arrays of that page.

Pages are bounded by what is printed on one; no step after the grouping moves a row. Regular expressions are tried on a whole row first and on its words only in rows that may be
a header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions import text as X

# Fixed values -------------------------------------------------------------------------------------------------------
COLUMN_HEADERS = {
    "ref_produit": (r"R[ÉE]F[.\s]*(?:PRODUIT|ART(?:ICLE)?)?", r"CODE\s*(?:ARTICLE|PRODUIT)?", r"R[ÉE]F\.?", r"ARTICLE"),
    "designation": (r"D[ÉE]SIGNATION", r"LIBELL[ÉE]", r"DESCRIPTION"),
    "qty": (r"(?:QT[ÉE]|QUANTIT[ÉE]|QTE|NB)\b", r"QT[ÉE]\.?"),
    "unit": (r"UNIT[ÉE]", r"U\.?M\.?", r"MESURE"),
    "prix_unitaire": (r"PRIX\s*U(?:NIT\.?)?(?:\s*H\.?T\.?)?", r"P\.?\s*U\.?\s*H\.?T\.?", r"P\.?U\.?", r"PRIX\s*UN"),
    "tva_rate": (r"T\.?V\.?A\.?", r"TVA\s*%"),
    "total_ligne_ht": (r"TOTAL\s*H\.?T\.?", r"MONTANT\s*H\.?T\.?", r"TOTAL\s*LIGNE", r"TOTAL\s*HT"),
}
ROW_GAP = 6
SEARCH_ROWS = 120
# --------------------------------------------------------------------------------------------------------------------


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def page_rows(words: DataFrame, keys: list[str], gap: int = ROW_GAP) -> DataFrame:
    """WIN2: keys and rows, an array of (row, words, line), rows by vertical centre; a row's anchor is its first word. words: keys, ord, text, x, y, w, h, conf."""
    word = F.struct((F.col("y") + F.col("h") / 2.0).alias("c"), "x", "ord", "text", "w", "conf")
    per = words.groupBy(*keys).agg(F.array_sort(F.collect_list(word)).alias("ws"))
    state = F.struct(F.lit(0).alias("i"), F.lit(-1e9).alias("anchor"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, w: Column) -> Column:
        new = F.abs(w["c"] - acc["anchor"]) > gap
        return F.struct((acc["i"] + 1).alias("i"), F.when(new, w["c"]).otherwise(acc["anchor"]).alias("anchor"), F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"))

    def row(starts: Column):
        def made(first: Column, number: Column) -> Column:
            own = F.slice("ws", first + 1, F.coalesce(F.try_element_at(starts, number + 2), F.size("ws")) - first)
            own = F.array_sort(F.transform(own, lambda w: F.struct(w["x"].alias("x"), w["ord"].alias("ord"), w["text"].alias("text"), w["w"].alias("w"), w["conf"].alias("conf"))))
            return _let(own, lambda ws: F.struct(number.alias("row"), ws.alias("words"), F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("line")))
        return made

    starts = F.aggregate("ws", state, step, lambda a: a["starts"])
    return per.select(*keys, _let(starts, lambda s: F.transform(s, row(s))).alias("rows"))


def word_rows(words: DataFrame, keys: list[str], gap: int = ROW_GAP) -> DataFrame:
    """WIN2, one row a word: keys, row, ord, text, x, w, conf."""
    at = page_rows(words, keys, gap).select(*keys, F.explode("rows").alias("r"))
    return at.select(*keys, F.col("r.row").alias("row"), F.explode("r.words").alias("z")).select(*keys, "row", "z.ord", "z.text", "z.x", "z.w", "z.conf")


def _named(words: Column) -> Column:
    """The columns (name, x_min, x_max) that a row's words name; spans of one word before those of two and three, then the leftmost."""
    def span(texts: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(texts) - 1), lambda i: F.when(i + n <= F.size(texts), F.array_join(F.slice(texts, i + 1, n), " ")))

    def placed(at: Column, name: str, n: int) -> Column:
        return _let(at, lambda i: F.when(i > 0, F.struct(F.lit(name).alias("name"), words[i - 1]["x"].cast("double").alias("x_min"), (words[i + n - 2]["x"] + words[i + n - 2]["w"]).cast("double").alias("x_max"))))

    def found(spans: Column, name: str, patterns: tuple[str, ...]) -> Column:
        place = lambda n: F.array_position(F.transform(spans[n - 1], lambda s: s.rlike("|".join(patterns))), F.lit(True)).cast("int")
        return F.coalesce(*[placed(place(n), name, n) for n in (1, 2, 3)])

    up = F.transform(words, lambda w: F.upper(w["text"]))
    spans = _let(up, lambda t: F.array(*[span(t, n) for n in (1, 2, 3)]))
    return _let(spans, lambda s: F.array_compact(F.array(*[found(s, name, ps) for name, ps in COLUMN_HEADERS.items()])))


def with_columns(pages: DataFrame, page_width: Column | None = None) -> DataFrame:
    """WIN3, WIN4: pages of page_rows() with head, the header row's number, and columns (name, x_min, x_max, low, high) from left to right. The header is the first row of SEARCH_ROWS that names
    three columns, else the first that names two; pages without one go. A column reaches to the midpoints to its neighbours, 0 and the page width at the ends."""
    hits = lambda line: sum((F.when(line.rlike("|".join(ps)), 1).otherwise(0) for ps in COLUMN_HEADERS.values()), F.lit(0))
    likely = F.filter(F.slice("rows", 1, SEARCH_ROWS), lambda r: hits(F.upper(r["line"])) >= 2)
    named = F.transform(likely, lambda r: F.struct(r["row"].alias("row"), _named(r["words"]).alias("columns")))
    first = lambda rows, n: F.try_element_at(F.filter(rows, lambda r: F.size(r["columns"]) >= n), F.lit(1))
    end = page_width if page_width is not None else F.lit(float("inf"))

    def ranged(cs: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before, after = F.try_element_at(cs, F.nullif(i, F.lit(0))), F.try_element_at(cs, i + 2)
            low, high = F.coalesce((before["x_max"] + c["x_min"]) / 2, F.lit(0.0)), F.coalesce((c["x_max"] + after["x_min"]) / 2, end)
            return F.struct(c["name"].alias("name"), c["x_min"].alias("x_min"), c["x_max"].alias("x_max"), low.alias("low"), high.alias("high"))
        return F.transform(cs, one)

    ordered = lambda h: F.transform(F.array_sort(F.transform(h["columns"], lambda c: F.struct(c["x_min"].alias("x_min"), c["name"].alias("name"), c["x_max"].alias("x_max")))), lambda c: c)
    head = _let(named, lambda rows: F.coalesce(first(rows, 3), first(rows, 2)))
    at = pages.withColumn("h", head).where("h is not null")
    return at.withColumn("head", F.col("h.row")).withColumn("columns", _let(ordered(F.col("h")), ranged)).drop("h")


def table_cells(pages: DataFrame, keys: list[str]) -> DataFrame:
    """EXT6, AGG20: keys, row and a struct (text, confidence) for every kind of column: the rows below the header and above the first row that ends a table, that hold a number. A cell's words are
    those with their centre in the column's range, from left to right."""
    body = F.filter("rows", lambda r: r["row"] > F.col("head"))
    stop = lambda rows: F.try_element_at(F.filter(rows, lambda r: G.is_table_stop(r["line"])), F.lit(1))["row"]
    kept = _let(body, lambda rows: _let(F.coalesce(stop(rows), F.lit(2**31 - 1)), lambda s: F.filter(rows, lambda r: (r["row"] < s) & G.has_number(F.transform(r["words"], lambda w: w["text"])))))
    at = pages.select(*keys, "columns", F.explode(kept).alias("r"))

    def cell(name: str) -> Column:
        column = F.try_element_at(F.filter("columns", lambda c: c["name"] == name), F.lit(1))
        inside = _let(column, lambda c: F.filter(F.col("r.words"), lambda w: (w["x"] + w["w"] / 2.0 >= c["low"]) & (w["x"] + w["w"] / 2.0 < c["high"])))
        mean = lambda ws: F.aggregate(ws, F.lit(0.0), lambda a, w: a + w["conf"]) / F.size(ws) / 100
        return _let(inside, lambda ws: F.when(F.size(ws) > 0, F.struct(F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("text"), mean(ws).alias("confidence"))))

    return at.select(*keys, F.col("r.row").alias("row"), *[cell(name).alias(name) for name in COLUMN_HEADERS])


def cell_lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """EXT7: line items of table cells with their confidences; rows without anything useful go."""
    value = {n: F.col(f"{n}.text") for n in COLUMN_HEADERS}
    confs = [F.col(f"{n}.confidence") for n in ("ref_produit", "designation", "qty", "prix_unitaire", "total_ligne_ht")]
    conf = F.coalesce(F.least(*confs), F.lit(0.5))
    out = cells.select(
        *keys, "row", X.safe_reference(value["ref_produit"]).alias("ref_produit"), value["designation"].alias("designation"), X.quantity(value["qty"])["value"].alias("qty"), value["unit"].alias("unit"),
        X.money(value["prix_unitaire"])["value"].alias("prix_unitaire"), X.number(F.regexp_replace(value["tva_rate"], "%", "")).alias("tva_rate"),
        X.money(value["total_ligne_ht"])["value"].alias("total_ligne_ht"), conf.alias("confidence"), (conf < 0.70).alias("low"),
    )
    return out.where(G.valid_product_line(F.col("ref_produit"), F.col("prix_unitaire"), F.col("qty"), F.col("designation")))


def table_lines(words: DataFrame, keys: list[str], page_width: Column | None = None) -> DataFrame:
    """WIN2-WIN4, EXT6, EXT7: the line items of the pages' tables."""
    return cell_lines(table_cells(with_columns(page_rows(words, keys), page_width), keys), keys)
