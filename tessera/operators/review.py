"""Review of whole documents (T22-T24, T27): what is wrong with each, as rows of document, section and code.

A document's sections become rows once, and every check reads those rows: alphabets by field, languages by section with a majority over the
document, headings in order, repeated sections and paragraphs in one pass each, and what strays from the prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alphabets
from ..functions.text import let, stems, stems_of, words, written_in, written_in_russian
from . import documents

#: Layouts that hold no prose of their own, words from which a section may stray, and sections from which a document is judged for it.
STRUCTURAL, STRAYS, SECTIONS = ("cover", "closing", "section"), 25, 3
#: How Russian is named in a prompt.
NAMES_RUSSIAN = r"(?iU)(?<!\w)(?:rus|russian|русск\w*|рус)"
#: Words that carry no topic, in the languages of prompts.
STOP = ["the", "and", "for", "with", "about", "that", "this", "from", "uchun", "bilan", "haqida", "для", "про", "это", "как"]


def overlap(these: Column, those: Column) -> Column:
    """Whether two sets of stems share a word: one is the other but for its ending, never by fewer than three letters."""
    size = lambda a, b: F.greatest(F.lit(3), F.least(F.length(a), F.length(b)) - 1)
    alike = lambda a, b: (F.length(a) >= size(a, b)) & (F.length(b) >= size(a, b)) & (F.substring(a, F.lit(1), size(a, b)) == F.substring(b, F.lit(1), size(a, b)))
    return F.exists(these, lambda a: F.exists(those, lambda b: alike(a, b)))


def missing(subtopics: Column, text_stems: Column, stop: list[str]) -> Column:
    """The subtopics of whose stems a text has fewer than half."""

    def absent(topic: Column) -> Column:
        wanted = stems(topic, stop)
        return (F.size(wanted) > 0) & (F.size(F.filter(wanted, lambda w: overlap(F.array(w), text_stems))) * 2 < F.size(wanted))

    return F.filter(F.coalesce(subtopics, F.array().cast("array<string>")), absent)


def _text(s: Column, notes: bool = False) -> Column:
    """What a reader sees of a section, a part a line; blank parts are left out."""
    items = F.flatten(F.transform(F.coalesce(s["items"], F.array()), lambda x: F.array(x["label"], x["text"], x["value"])))
    parts = F.concat(F.array(s["heading"], s["body"]), items, F.coalesce(s["columns"], F.array().cast("array<string>")), *([F.array(s["notes"])] if notes else []))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


def _blank(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")) == ""


def check(docs: DataFrame, fmt: str = "pdf", stop: list[str] | None = None) -> DataFrame:
    """doc_id, section (from 0, null for the whole) and code, each once.

    docs: doc_id, locale, prompt, request (null unless a revision), expected (sections, maybe null), subtopics (array, maybe null), title, sections (heading, body, notes, items,
    columns, layout), questions. Codes: script, section_count, empty_section, wrong_language, foreign_passage, continued_heading, repeated_heading, duplicate_section,
    duplicate_paragraph, missing_subtopics, off_topic. Null text is blank; a null prompt names nothing.
    """
    stop = STOP if stop is None else stop
    whole = docs.withColumn("prompt", F.coalesce("prompt", F.lit("")))
    brief = F.when(written_in_russian(F.col("prompt")), "ru").otherwise(written_in(F.col("prompt"), 4))
    anchor = F.array_union(stems(F.col("prompt"), stop), stems(F.coalesce("title", F.lit("")), stop))
    # What a prompt and a title say is made below the explode, once for a document: a filter above it would make the anchor for each word of a section.
    s = whole.withColumns({"brief": brief, "anchor": anchor, "_n": F.size(F.coalesce("sections", F.array()))})
    s = s.select("doc_id", "locale", "prompt", "request", "brief", "anchor", "_n", F.posexplode("sections").alias("no", "s"))
    s = s.select("*", _text(F.col("s")).alias("text"), (_blank(F.col("s.body")) & (F.size(F.coalesce("s.items", F.array())) == 0)).alias("bare"), F.coalesce("s.layout", F.lit("")).alias("layout"))
    s = s.withColumn("empty", _blank(F.col("text"))).withColumn("counted", ~F.col("empty") & ~F.col("bare") & ~F.col("layout").isin(*STRUCTURAL))
    code = lambda df, name: df.select("doc_id", F.col("no").cast("int").alias("section"), F.lit(name).alias("code"))
    of_document = lambda df, name: df.select("doc_id", F.lit(None).cast("int").alias("section"), F.lit(name).alias("code"))

    fields = alphabets.fields(whole).join(whole.select("doc_id", "locale"), "doc_id")
    script = alphabets.violations(fields, F.col("locale")).select("doc_id", F.when(F.col("path").startswith("sections/"), F.regexp_extract("path", r"^sections/(\d+)/", 1).cast("int")).alias("section"), F.lit("script").alias("code"))
    counts = of_document(whole.filter(F.col("expected").isNotNull() & (F.size(F.coalesce("sections", F.array())) != F.col("expected"))), "section_count")
    found = [script, counts, code(s.filter(F.col("empty") | (F.lit(fmt != "pptx") & F.col("bare"))), "empty_section")]

    told = s.filter((F.col("layout") != "quote") & ~F.col("empty")).select("doc_id", "no", "locale", "request", "brief", F.concat_ws("\n", "prompt", "request").rlike(NAMES_RUSSIAN).alias("named"), written_in(_text(F.col("s"), True)).alias("is"))
    other = F.col("is").isNotNull() & (F.col("is") != F.col("locale"))
    plain = other & (F.col("is").eqNullSafe(F.col("brief")) | ((F.col("is") == "ru") & ~F.col("named")))
    per = Window.partitionBy("doc_id")  # over a document's sections
    told = told.withColumn("_plain", plain).withColumn("_other", other & ~plain).withColumn("_translated", F.col("request").isNotNull() & (F.count_if("_plain").over(per) * 2 > F.count("*").over(per)))
    found.append(told.filter(F.col("_plain") | F.col("_other")).select("doc_id", F.col("no").cast("int").alias("section"), F.when(F.col("_plain") & ~F.col("_translated"), "wrong_language").otherwise("foreign_passage").alias("code")))

    h = s.filter(~F.col("empty")).select("doc_id", "no", "counted", F.array_join(words(F.col("s.heading")), " ").alias("h"))
    h = h.withColumn("_on", F.last(F.nullif("h", F.lit("")), ignorenulls=True).over(per.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)))
    goes_on = (F.col("h") != "") & F.col("h").eqNullSafe(F.col("_on")) & F.lit(fmt != "pptx")
    h = h.withColumn("_goes", goes_on).withColumn("_own", (F.col("h") != "") & F.col("counted") & ~F.col("_goes"))
    h = h.withColumn("_first", F.min(F.when(F.col("_own"), F.col("no"))).over(Window.partitionBy("doc_id", "h")))
    found += [code(h.filter("_goes"), "continued_heading"), code(h.filter(F.col("_own") & (F.col("no") != F.col("_first"))), "repeated_heading")]

    sections = whole.select("doc_id", F.coalesce("sections", F.array()).alias("sections"))
    prose = lambda x: ~F.coalesce(x["layout"], F.lit("")).isin(*STRUCTURAL)
    stands = lambda x: prose(x) & ~(_blank(x["body"]) & (F.size(F.coalesce(x["items"], F.array())) == 0))
    texts = F.transform("sections", lambda x: F.when(stands(x), _text(x)))
    found.append(code(documents.alike_parts(sections.select("doc_id", texts.alias("parts")), documents.section_runs, documents.SECTION, documents.SECTION_ALIKE, 1), "duplicate_section"))
    lines = lambda x: F.concat(F.split(F.coalesce(x["body"], F.lit("")), "\n", -1), F.transform(F.coalesce(x["items"], F.array()), lambda i: F.coalesce(i["text"], F.lit(""))))
    each = F.flatten(F.transform("sections", lambda x, no: F.transform(F.when(prose(x), lines(x)).otherwise(F.array().cast("array<string>")), lambda p: F.struct(p.alias("part"), no.alias("group")))))
    paragraphs = sections.select("doc_id", each.alias("p")).select("doc_id", F.transform("p", lambda x: x["part"]).alias("parts"), F.transform("p", lambda x: x["group"]).alias("groups"))
    again = documents.alike_parts(paragraphs, documents.paragraph_runs, documents.PARAGRAPH, documents.PARAGRAPH_ALIKE, documents.PARAGRAPH)
    found.append(again.join(paragraphs, "doc_id").select("doc_id", F.get("groups", F.col("no")).cast("int").alias("section"), F.lit("duplicate_paragraph").alias("code")))

    same = brief == F.col("locale")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.array_join(F.transform(F.coalesce("sections", F.array()), lambda x: _text(x, True)), "\n"))
    found.append(of_document(whole.filter(same & (F.size(F.coalesce("subtopics", F.array())) > 0)).filter(F.size(missing(F.col("subtopics"), stems(text, stop), stop)) > 0), "missing_subtopics"))
    strays = let(words(F.col("text")), lambda w: (F.size(w) >= STRAYS) & ~overlap(stems_of(w, stop), F.col("anchor")))
    found.append(code(s.filter((F.col("brief") == F.col("locale")) & (F.col("_n") >= SECTIONS) & (F.size("anchor") > 0)).filter(strays), "off_topic"))

    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()
