"""PII: patterns find the protected entities, corpus co-occurrence finds the terms that give them away.

Only DataFrame functions. A term t of the documents that hold an entity e discloses
PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e))) bits of e's information log2(N / n(e)); counts are of documents and cover the
whole corpus. Terms whose share of that information reaches a threshold are generalised, or removed at a
higher one, wherever they stand in the documents that hold the entity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import stored

# Possessive and guarded forms of the contract's patterns: they match the same and never go back over a run.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Share of an entity's information from which its terms are generalised, and removed; chance at which a pair may still be one of independents; letters of a term (single ones tell nothing).
GENERALISE, REMOVE, CHANCE, LETTERS = 0.8, 0.95, 0.01, 2
SPAN = "struct<kind:string,start:int,end:int,value:string>"
#: Matches walked together.
BLOCK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    n = F.length(d)
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(F.substr(d, i, F.lit(1)).cast("int"))).otherwise(F.substr(d, i, F.lit(1)).cast("int")))
    return n.between(16, 19) & (total % 10 == 0)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.rlike(x, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: Column, kind: str) -> Column:
    """All matches as spans: what lies between the matches gives their places, in code points.

    Matches are walked in blocks, within which places are counted from the block's start, so that arrays
    are extended by blocks and the work stays near the number of matches.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    span = lambda s, e, v: F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), v.alias("value"))
    start = lambda a, x: a["at"] + F.length(x["gap"])
    within = lambda block: F.aggregate(
        block,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, x: F.struct(
            (start(a, x) + F.length(x["hit"])).alias("at"),
            F.concat(a["spans"], F.array(span(start(a, x), start(a, x) + F.length(x["hit"]), x["hit"]))).alias("spans"),
        ),
    )
    blocks = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda k: within(F.slice(m, k * BLOCK + 1, F.lit(BLOCK))))
    walked = lambda parts: F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<array<{SPAN}>>)").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + p["at"]).alias("at"),
            F.concat(a["spans"], F.array(F.transform(p["spans"], lambda s: span(a["at"] + s["start"], a["at"] + s["end"], s["value"])))).alias("spans"),
        ),
        lambda a: F.flatten(a["spans"]),
    )
    # a transform over an array of one value evaluates the matches once
    return F.flatten(F.transform(F.array(both), lambda m: F.when(F.size(m) > 0, walked(blocks(m))).otherwise(none)))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind, then start."""
    likely = {
        "email": F.contains(text, F.lit("@")),
        "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")),
        "phone": F.contains(text, F.lit("+")) & F.rlike(text, F.lit(r"\+[0-9]")),
    }
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    part = lambda k: F.when(likely[k], F.filter(located(text, F.lit(PATTERNS[k]), k), lambda s: _valid(k, s["value"]))).otherwise(none)
    return F.concat(*(part(k) for k in PATTERNS))


def _terms(x: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(x), r"[^\p{L}]+")), lambda t: F.length(t) >= LETTERS)


def _chance(n: Column, mean: Column) -> Column:
    """Log of an upper bound on the chance that an independent pair with ``mean`` documents expected shares n and more, given that it shares one.

    Chance of n and more: mean ** n / n! at most, with Stirling's lower bound for n!. A pair of one document is never telling.
    """
    return n * F.log(mean / n) + n - 0.5 * F.log(2 * math.pi * n) - F.log(-F.expm1(-mean))


def _outside() -> Column:
    """The text with a blank in place of every base span."""
    return F.aggregate(
        F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["out"], F.when(s["start"] > a["at"], F.substr("text", a["at"] + 1, s["start"] - a["at"])).otherwise(F.lit("")), F.lit(" ")).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1, F.length("text"))),
    )


def _entity(s: Column) -> Column:
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"])))


def disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal data in every whole text, and the terms that disclose it.

    One row per input row: doc_id, text, base (spans of kinds email, ip, card, phone, by kind, then start;
    code points, end exclusive), terms (spans of kind term, by start, with the share of an entity's
    information they disclose in ``share``), and the columns named in ``keep``. ``text`` is null where
    nothing was found: that text stays as it is.

    A null text is empty. Repeated rows and null ids are ordinary rows, other columns are ignored, an
    empty table gives an empty result. A pair of entity and term counts where independence
    would bring its documents together with a chance of CHANCE at most: from 200 documents on, two that hold both
    and no others are enough. Words are runs of letters: a script without blanks gives whole runs as terms.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    rows = base.withColumn("base", base_spans(F.col("text"))).withColumn("text", F.when(F.size("base") > 0, F.col("text")))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "entities")
    some = rows.where("text is not null")
    total = rows.count()
    held = stored(some.select("row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")), "held")
    held = stored(held.join(held.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e").between(2, total - 1)), "entity"), "judged")
    words = stored(base.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= 2), "words")
    # a term of more documents than this can't reach the share, even if it stood in all documents of the entity
    most = lambda n_e: total * (n_e / total) ** GENERALISE * (1 + 1e-9)
    bound = most(held.agg(F.max("n_e")).first()[0] or 1) if total else 0
    often = words.where(F.col("n_t") > max(bound, total / 1000)).select("term")  # a thousand times a text's terms at most
    own = some.join(held.select("row").distinct(), "row", "left_semi").select("row", F.explode(_terms(_outside())).alias("term"))
    own = own.join(F.broadcast(often), "term", "left_anti").join(words.where(F.col("n_t") <= bound), "term")
    both = stored(own.join(held, "row").where(F.col("n_t") <= most(F.col("n_e"))).select("row", "entity", "term", "n_e", "n_t"), "both")
    size = F.lit(float(max(total, 1)))
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t")).where(F.log(F.lit(CHANCE)) >= _chance(F.col("n_te"), F.col("n_t") * F.col("n_e") / size))
    share = F.log2(size * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(size / F.col("n_e"))
    telling = pairs.withColumn("share", share).where(F.col("share") >= GENERALISE).select("entity", "term", "share")
    mine = both.join(telling, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("telling"))
    out = rows.join(mine, "row", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}])(?:"), F.array_join(F.array_sort(F.map_keys("telling")), "|"), F.lit(r")(?![\p{L}])"))
    spans = F.when(F.col("telling").isNotNull(), located(F.col("text"), pattern, "term")).otherwise(F.expr(f"CAST(array() AS array<{SPAN}>)"))
    clear = lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    with_share = F.transform(F.filter(spans, clear), lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), F.coalesce(F.element_at("telling", F.lower(t["value"])), F.lit(GENERALISE)).alias("share")))
    return out.select("doc_id", "text", "base", with_share.alias("terms"), *(F.col(f"_keep_{c}").alias(c) for c in keep))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with entities replaced by their kind, disclosing terms by ``[TERM]`` or, from REMOVE on, by nothing.

    Spans that overlap an earlier one go with it. Null texts are empty; see ``disclosures``.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    found = disclosures(docs.select(F.col(id_col).alias("doc_id"), whole.alias("text"), whole.alias("whole")), keep=("whole",))
    put = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("put"))),
    )
    text = F.aggregate(
        F.array_sort(put),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substr("whole", a["at"] + 1, s["start"] - a["at"]), s["put"])).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr("whole", a["at"] + 1, F.length("whole"))),
    )
    return found.select("doc_id", text.alias("text"))


def op8_privacy(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    found = disclosures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    many = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda *parts: F.concat_ws(",", *(F.transform(p, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for p in parts))
    return found.select("doc_id", *(many(k) for k in PATTERNS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("base", "terms").alias("spans"), F.size("terms").cast("long").alias("n_term"))
