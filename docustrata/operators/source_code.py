"""Procedures, declarations, events, markers, uses, dependencies and references of source files.

Input: files (doc_id, file_ord, name, kind, source_path, text). Everything that depends on one file only
is computed inside its row, over the array of its lines, so no operator here shuffles lines; only
the joins between files (calls, references) do, and they move tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import spark
from ..functions.text import bound, js_trim, lines
from . import rules

KEY = ("doc_id", "file_ord", "file_name")
#: Lines of an unterminated procedure that count as its body after its first one.
OPEN_BODY = 80
#: A handler's name: control, then event.
HANDLER = r"^(.+)_([A-Za-z][A-Za-z0-9]*)\z"


def _group(x: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(x, spark(pattern), i), F.lit(""))


def _hit(x: Column, pattern: str) -> Column:
    return F.rlike(x, F.lit(spark(pattern)))


def module_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(bas|cls|frm)\z", "")


def exploded(rows: DataFrame, keep: list[str | Column], column: Column, name: str, place: str | None = None) -> DataFrame:
    """A row per element (which none of them lacks) of an array, with its place where that is named.

    By the outer form: before the inner one Spark puts a filter on the array's size, for which it makes the array a second time, and
    anew in each element all that it was made from.
    """
    made = F.posexplode_outer(column).alias(place, name) if place else F.explode_outer(column).alias(name)
    return rows.select(*keep, made).where(F.col(name).isNotNull())


def _files(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "file_ord", F.col("name").alias("file_name"), module_name(F.col("name")).alias("module"), lines(F.coalesce("text", F.lit(""))).alias("lines"))


def module_kind(name: Column) -> Column:
    """form, class, document or standard, by a file's name."""
    return F.when(name.endswith(".frm"), "form").when(name.endswith(".cls"), "class").when(_hit(name, r"ThisWorkbook|Sheet[0-9]+"), "document").otherwise("standard")


def modules(files: DataFrame) -> DataFrame:
    """One row per file: module, kind (form, class, document, standard), source_path."""
    name = F.col("name")
    kind = module_kind(name)
    return files.select("doc_id", "file_ord", name.alias("file_name"), module_name(name).alias("module"), kind.alias("kind"), "source_path")


def source_lines(files: DataFrame) -> DataFrame:
    """One row per line: line (from 1), text."""
    return exploded(_files(files), [*KEY, "module"], F.col("lines"), "text", "p").select(*KEY, "module", (F.col("p") + 1).alias("line"), "text")


def parameters(listed: Column) -> Column:
    """The parts between the commas of a bracketed list, trimmed, without empty ones."""
    inner = F.regexp_replace(F.coalesce(listed, F.lit("")), r"^\(|\)\z", "")
    return F.filter(F.transform(F.split(inner, ","), js_trim), lambda x: x != "")


def _procedure_parts(files: DataFrame) -> DataFrame:
    """Files with ``procs``: line, line_end, text and the groups of the start pattern (parts) of every procedure.

    Lines without a key word are passed over by a plain pattern, and one replacement gives all groups of a start.
    """
    key_word = lambda x: F.rlike(x, F.lit("(?i)sub|function|property"))
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    said = F.filter(numbered, lambda m: key_word(m["text"]))
    marks = F.filter(
        F.transform(said, lambda m: F.struct(m["line"].alias("line"), m["text"].alias("text"), _hit(m["text"], rules.PROCEDURE).alias("starts"), _hit(m["text"], rules.PROCEDURE_END).alias("ends"))),
        lambda m: m["starts"] | m["ends"],
    )
    found = _files(files).withColumn("marks", marks)
    closed = lambda i: F.get("marks", i + 1)
    groups = lambda x: F.split(F.regexp_replace(x, spark(rules.PROCEDURE) + r"[\s\S]*", "$1\x01$3\x01$4\x01$5\x01$6"), "\x01", -1)
    procs = F.transform(
        F.filter(
            F.transform("marks", lambda m, i: F.struct(m["line"].alias("line"), m["text"].alias("text"), m["starts"].alias("starts"), F.when(~closed(i)["starts"], closed(i)["line"]).alias("line_end"))),
            lambda m: m["starts"],
        ),
        lambda m: F.struct(m["line"].alias("line"), m["line_end"].alias("line_end"), m["text"].alias("text"), groups(m["text"]).alias("parts")),
    )
    return found.withColumn("procs", procs).drop("marks")


def procedures(files: DataFrame, with_body: bool = False) -> DataFrame:
    """One row per procedure, in order: proc_ord, name, kind, scope, signature, parameters, return_type, line_start, line_end.

    A procedure ends at the first end line before the next start; without one line_end is null. With
    ``with_body`` also body: its lines, or OPEN_BODY more than the first where it has no end.
    """
    part = lambda i: F.nullif(F.get("m.parts", F.lit(i)), F.lit(""))
    out = exploded(_procedure_parts(files), [*KEY, "module", "lines"], F.col("procs"), "m", "proc_ord").select(
        *KEY,
        "module",
        "proc_ord",
        part(2).alias("name"),
        F.when(part(1).startswith("Property"), "Property").otherwise(part(1)).alias("kind"),
        F.coalesce(part(0), F.lit("Implicit")).alias("scope"),
        js_trim(F.col("m.text")).alias("signature"),
        parameters(part(3)).alias("parameters"),
        part(4).alias("return_type"),
        F.col("m.line").alias("line_start"),
        F.col("m.line_end").alias("line_end"),
        "lines",
    )
    if with_body:
        out = out.withColumn("body", F.array_join(F.slice("lines", F.col("line_start"), F.coalesce("line_end", F.col("line_start") + OPEN_BODY) - F.col("line_start") + 1), "\n"))
    return out.drop("lines")


def _declared(files: DataFrame, pattern: str, unless: str | None) -> DataFrame:
    rows = source_lines(files)
    rows = rows.where(_hit(F.col("text"), pattern))
    if unless:
        rows = rows.where(~_hit(F.col("text"), unless))
    part = lambda i: _group(F.col("text"), pattern, i)
    return rows.select(*KEY, "module", part(2).alias("name"), F.coalesce(part(1), F.lit("Implicit")).alias("scope"), part(3).alias("type"), "line", js_trim(F.col("text")).alias("statement"))


def variables(files: DataFrame) -> DataFrame:
    """The first variable of every declaring line: name, scope, type, line, statement."""
    return _declared(files, rules.VARIABLE, rules.NOT_VARIABLE).where(F.lower("name") != "declare")


def constants(files: DataFrame) -> DataFrame:
    """The first constant of every declaring line: name, scope, type, line, statement."""
    return _declared(files, rules.CONSTANT, None)


def declares(files: DataFrame) -> DataFrame:
    """Lines that declare an external procedure: line, statement."""
    return source_lines(files).where(_hit(F.col("text"), rules.DECLARE)).select(*KEY, "module", "line", js_trim(F.col("text")).alias("statement"))


def events(procs: DataFrame) -> DataFrame:
    """Procedures named like handlers: control_name and event_name are parted by the last ``_``."""
    pattern = HANDLER
    part = lambda i: F.regexp_extract("name", pattern, i)
    return procs.where(F.rlike("name", F.lit(pattern))).select(*KEY, "module", "proc_ord", F.col("name").alias("procedure"), part(1).alias("control_name"), part(2).alias("event_name"))


def _words(pattern: str) -> list[str]:
    """Of a pattern ``\\b(a|b|...)`` the longest word of each alternative, in lower case: one of them is in every match. Empty where the pattern is of another form."""
    inner, depth, parts = re.match(r"\\b\((.*)\)(?:\\b)?$", pattern), 0, [""]
    for c in re.findall(r"\\.|\[[^]]*\]|.", inner.group(1) if inner else ""):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        elif c in "?*":
            parts[-1] = parts[-1][:-1] + " "  # what may lack
        elif not depth:
            parts[-1] += c if c.isalpha() else " "
    words = [max(re.findall("[A-Za-z]+", part), key=len, default="").lower() for part in parts]
    return words if inner and all(words) and depth == 0 else []


def _may_match(low: Column, pattern: str) -> Column:
    """Whether a text, in lower case, holds a word that the pattern needs: a plain search before an expression is tried."""
    test = F.lit(not _words(pattern))
    for w in _words(pattern):
        test |= F.contains(low, F.lit(w))
    return test


def _matching(x: Column, low: Column, rule_set) -> Column:
    """Names of the rules that match, sorted."""
    return F.array_sort(F.filter(F.array(*(F.when(_may_match(low, pattern) & _hit(x, pattern), F.lit(name)) for name, pattern in rule_set)), lambda n: n.isNotNull()))


def line_markers(rows: DataFrame, rule_set=rules.RISKS) -> DataFrame:
    """One row per line and rule that match: rule_ord, category, reason. No join: the rules are in the row's expression."""
    marks = F.filter(F.array(*(F.when(_hit(F.col("text"), p), F.struct(F.lit(i).alias("rule_ord"), F.lit(c).alias("category"), F.lit(why).alias("reason"))) for i, (c, p, why) in enumerate(rule_set))), lambda m: m.isNotNull())
    return exploded(rows, ["*"], marks, "m").select("*", "m.*").drop("m")


def risk_markers(files: DataFrame) -> DataFrame:
    out = line_markers(source_lines(files))
    return out.select(*KEY, "module", "line", "rule_ord", "category", js_trim(F.col("text")).alias("text"), "reason")


def procedure_uses(procs_with_body: DataFrame) -> DataFrame:
    """Adds uses: the labels of the rules that the body matches, by label."""
    low = procs_with_body.withColumn("_low", F.lower("body"))
    return low.withColumn("uses", _matching(F.col("body"), F.col("_low"), rules.USES)).drop("_low")


def _rule_matches(x: Column, number: int, category: str, pattern: str, own: tuple[int, ...], reason: str) -> Column:
    every = F.arrays_zip(*(F.regexp_extract_all(x, F.lit(spark(pattern)), F.lit(g)).alias(f"g{g}") for g in own))

    def row(m, i):
        value = js_trim(F.coalesce(*(F.nullif(m[f"g{g}"], F.lit("")) for g in own)))
        return F.struct(F.lit(category).alias("category"), value.alias("value"), F.struct(F.lit(number).alias("rule"), i.alias("match")).alias("ord"), F.lit(reason).alias("reason"))

    return F.transform(every, row)


def rule_matches(x: Column, rule_set=rules.DEPENDENCIES) -> Column:
    """All matches of all rules as (category, value, ord, reason); the value is the first of a rule's groups that is not empty; its last one never is."""
    return F.concat(*(_rule_matches(x, i, *rule) for i, rule in enumerate(rule_set)))


def dependencies(files: DataFrame) -> DataFrame:
    """What the sources depend on, each (category, value) of a file once, with the place and the reason of its first match."""
    found = exploded(files, ["doc_id", "file_ord", F.col("name").alias("file_name")], rule_matches(F.coalesce("text", F.lit(""))), "d").select(*KEY, "d.*")
    place = F.struct("file_ord", "ord")
    return found.groupBy("doc_id", "category", "value", "file_name").agg(F.min(place).alias("ord"), F.min_by("reason", place).alias("reason"))


def reference_dependencies(references: DataFrame) -> DataFrame:
    """Project references (doc_id, source, ord, kind, name, lib_id, raw) as dependencies, each (value, source) once; they come after those of the sources."""
    value = F.coalesce("name", "lib_id", "raw")
    rows = references.select("doc_id", F.lit("VBA reference").alias("category"), value.alias("value"), F.col("source").alias("file_name"), "ord", F.concat("kind", F.lit(" project reference")).alias("reason"))
    late = F.struct(F.lit(2**31 - 1).alias("file_ord"), F.struct(F.lit(len(rules.DEPENDENCIES)).alias("rule"), F.col("ord").cast("int").alias("match")).alias("ord"))
    return rows.withColumn("ord", late).groupBy("doc_id", "category", "value", "file_name").agg(F.min("ord").alias("ord"), F.min_by("reason", "ord").alias("reason"))


def module_summary(files: DataFrame) -> DataFrame:
    """Of every module: numbers of procedures, handlers and dependencies, and its longest procedure.

    All of it is made inside a file's row, in one pass over its text for each rule: nothing is joined or shuffled.
    """
    found = _procedure_parts(files).select("doc_id", "file_ord", "file_name", "module", "lines", "procs")
    name = lambda p: F.get(p["parts"], F.lit(2))
    said = F.array_distinct(F.transform(rule_matches(F.array_join("lines", "\n")), lambda d: F.struct(d["category"].alias("c"), d["value"].alias("v"))))
    longest = F.coalesce(F.array_max(F.transform("procs", lambda p: p["line_end"] - p["line"] + 1)), F.lit(0))
    long = lambda x, n: x.cast("long").alias(n)
    return found.select("doc_id", "module", module_kind(F.col("file_name")).alias("kind"), long(F.size("procs"), "n_procedures"), long(F.size(F.filter("procs", lambda p: F.rlike(name(p), F.lit(HANDLER)))), "n_events"), long(F.size(said), "n_dependencies"), long(longest, "longest"))


def tokens(x: Column) -> Column:
    """Distinct identifiers of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower))


def calls(procs_with_body: DataFrame) -> DataFrame:
    """Edges from procedures to the procedures of the same document that their bodies name: callee.

    An equi-join on identifiers: a name is a whole identifier, so a word match is the same.
    """
    names = procs_with_body.select("doc_id", F.col("name").alias("callee")).distinct().withColumn("token", F.lower("callee"))
    said = exploded(procs_with_body, [*KEY, "module", "proc_ord", "name"], tokens(F.col("body")), "token")
    return said.join(names, ["doc_id", "token"]).where("name <> callee").drop("token")


def call_edges(procs_with_body: DataFrame) -> DataFrame:
    """Calls with the callee's module: that of the first procedure of this name, else ``unknown``."""
    owners = procs_with_body.groupBy("doc_id", F.col("name").alias("callee")).agg(F.min_by("module", F.struct("file_ord", "proc_ord")).alias("callee_module"))
    return calls(procs_with_body).join(owners, ["doc_id", "callee"], "left").withColumn("callee_module", F.coalesce("callee_module", F.lit("unknown")))


_WORD = "[A-Za-z0-9_]+"


def _short(gap: Column) -> Column:
    """What stands between words, a long one by its digest."""
    return F.when(F.length(gap) <= 32, gap).otherwise(F.md5(gap))


def postings(x: Column) -> Column:
    """Every word of a text (pos, token in lower case) with what stands before and after it, and whether a word stands on either side."""
    both = F.struct(F.regexp_extract_all(x, F.lit(_WORD), F.lit(0)).alias("words"), F.split(x, _WORD, -1).alias("gaps"))

    def listed(t):
        return F.transform(t["words"], lambda w, i: F.struct(i.alias("pos"), F.lower(w).alias("token"), _short(F.get(t["gaps"], i)).alias("before"), _short(F.get(t["gaps"], i + 1)).alias("after"), (i > 0).alias("follows"), (i < F.size(t["words"]) - 1).alias("leads")))

    # an expression inside a function of an element is made anew for each: the two lists are made once
    return bound(both, listed)


#: Bits of a sketch: those of ``bitmap_construct_agg``.
SLOTS = 1 << 15


def _slot(x: Column) -> Column:
    """A word's bit, whatever digits are in it: names are often numbered, and numbers would fill a sketch."""
    return F.pmod(F.xxhash64(F.translate(x, "0123456789", "")), F.lit(SLOTS))


def sketch(rows: DataFrame, word: str) -> Column:
    """Which bits the words of a table have, as one value of a fixed size; null where there are none. Read by ``in_sketch``."""
    byte = lambda all_, i: F.conv(F.hex(F.substr(all_, i + 1, F.lit(1))), 16, 10).cast("int")
    bits = lambda all_: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SLOTS // 8 - 1)), lambda i: bound(byte(all_, i), lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(v, b) == 1))))
    found = rows.agg(F.count(word).alias("n"), F.bitmap_construct_agg(_slot(F.col(word))).alias("b"))
    return found.select(F.when(F.col("n") > 0, bits(F.col("b")))).scalar()


def in_sketch(word: Column, words: Column) -> Column:
    """Whether a word may be one of those of a sketch: true of each of them, and of few others where these differ by more than their digits."""
    return F.get(words, _slot(word).cast("int"))


def phrase_matches(texts: DataFrame, phrases: DataFrame, by: str, text: str, phrase: str, owner: list[str]) -> DataFrame:
    """Texts (by, owner, text) that hold a phrase (by, phrase) between word boundaries, whatever its case: distinct (by, owner, phrase).

    Words and their places are joined, never texts: each word of a phrase meets its postings with the same neighbours, and a phrase
    stands where all of its words do at one distance. A phrase of marks alone must fill the gap between two words. An empty phrase stands nowhere.
    Of the texts' words only those are shuffled that a sketch of the phrases lets pass, and where there are no phrases none are made.
    """
    wanted = phrases.where(F.col(phrase) != "").select(by, phrase).distinct()
    words = wanted.select(by, phrase, postings(F.col(phrase)).alias("w")).withColumn("n", F.size("w"))
    each = words.select(by, phrase, "n", F.explode("w").alias("w")).select(by, phrase, "n", F.col("w.pos").alias("at"), F.col("w.token").alias("token"), F.col("w.before").alias("first"), F.col("w.after").alias("last"))
    marks = words.where("n = 0").select(by, phrase, _short(F.col(phrase)).alias("before"))

    def posts(phrases, word):
        known = sketch(phrases, word)
        made = exploded(texts, [by, *owner], F.when(known.isNotNull(), postings(F.coalesce(text, F.lit("")))), "p").select(by, *owner, "p.*")
        return made.where(in_sketch(F.col(word), known))

    met = posts(each, "token").join(each.hint("merge"), [by, "token"])  # as large as the texts' own words may be: never sent to the driver
    # marks before its first word or behind its last one must fill a gap; a gap inside it must be the same
    before = F.when(F.col("at") > 0, F.col("before") == F.col("first")).otherwise((F.col("first") == "") | F.col("follows") & (F.col("before") == F.col("first")))
    after = (F.col("at") < F.col("n") - 1) | (F.col("last") == "") | F.col("leads") & (F.col("after") == F.col("last"))
    at = met.where(before & after).groupBy(by, *owner, phrase, "n", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("hits"))
    between = posts(marks, "before").where("follows").join(marks.hint("merge"), [by, "before"]).select(by, *owner, phrase)
    return at.where("hits = n").select(by, *owner, phrase).unionByName(between).distinct()


def module_references(files: DataFrame) -> DataFrame:
    """Pairs of modules of a document where the first one's text names the second: (doc_id, module, reference).

    Names that are one identifier meet by token, all others as phrases; no text is shuffled, nor are words that no name resembles.
    """
    texts = files.select("doc_id", module_name(F.col("name")).alias("module"), F.coalesce("text", F.lit("")).alias("text"))
    names = texts.select("doc_id", F.col("module").alias("reference")).distinct()
    plain = F.rlike("reference", F.lit(rf"^{_WORD}\z"))
    named = names.where(plain).withColumn("token", F.lower("reference"))
    said = exploded(texts, ["doc_id", "module"], tokens(F.col("text")), "token").where(in_sketch(F.col("token"), sketch(named, "token")))
    by_token = said.join(named.hint("merge"), ["doc_id", "token"]).select("doc_id", "module", "reference")
    phrases = phrase_matches(texts, names.where(~plain), "doc_id", "text", "reference", ["module"])
    return by_token.unionByName(phrases).where("module <> reference").distinct()
