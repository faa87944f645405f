"""Alphabets of a text, word by word, in column expressions (T7-T14): Uzbek and Russian Cyrillic in Latin letters, words that mix both, and
every field of a document in the alphabet of its language.

Letters of no table go, where a name of the letter could stand for them; texts aren't composed first, as Spark has no normal forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CYRILLIC, let

# ---- Fixed values: letters in Latin, vowels before which a letter changes, letters that look alike, and what a word is. ----
UZBEK = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "x", "ц": "s", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "ʼ", "ы": "i", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ў": "o‘", "қ": "q", "ғ": "g‘", "ҳ": "h",
}
RUSSIAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "ў": "o‘", "қ": "q", "ғ": "g‘", "ҳ": "h", "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ә": "a", "ң": "ng", "ө": "o", "ү": "u", "ұ": "u", "һ": "h", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "ђ": "dj", "џ": "dz",
    "ѕ": "dz", "ѓ": "gj", "ќ": "kj", "ӣ": "i", "ӯ": "u", "ҷ": "j", "ҙ": "z", "ҡ": "q", "ҫ": "s", "ӑ": "a", "ӗ": "e", "ӳ": "u", "ѣ": "e", "ѳ": "f", "ѵ": "i", "ӏ": "i",
}
UZBEK_VOWELS, RUSSIAN_VOWELS = "аеёиоуэюяў", "аеёиоуыэюяў"
TWINS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I"}
_LETTERS = r"\p{L}\p{N}_Ѐ-ԯ'‘’ʻʼ`"
WORD = r"[\p{L}\p{N}_Ѐ-ԯ'‘’ʻʼ`]+|[^\p{L}\p{N}_Ѐ-ԯ'‘’ʻʼ`]+"
UZBEK_ONLY = "[ЎўҚқҒғҲҳ]"
# ---- End of fixed values. ----

_LATIN_TWINS = {x: c for c, x in TWINS.items() if c not in "іІ"}


def _spelled(word: Column, table: dict[str, str], vowels: str, drop: bool) -> Column:
    """A word letter by letter; е is ye where a word begins and after a vowel; a capital makes its first letter one, all of them in a word of capitals."""
    of = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def letters(w: Column) -> Column:
        chars, loud = w["chars"], w["loud"]

        def letter(c: Column, i: Column) -> Column:
            low = F.lower(c)
            soft = (low == "е") & ((i == 0) | F.lower(F.get(chars, i - 1)).isin(*vowels))
            other = F.when(c.rlike(CYRILLIC), "").otherwise(c) if drop else c
            known = F.when(soft, "ye").otherwise(F.try_element_at(of, low))
            return let(known, lambda v: F.when(v.isNull(), other).when(c == low, v).when(loud, F.upper(v)).otherwise(F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, F.lit(2), F.length(v)))))

        return F.array_join(F.transform(chars, letter), "")

    loud = (word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) > 1)
    return let(F.struct(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)).alias("chars"), loud.alias("loud")), letters)


def _spelled_small(text: Column, table: dict[str, str], vowels: str, drop: bool, start: str = "^") -> Column:
    """`_spelled` where every letter is a small one, as a few passes over the whole: `start` matches before the first letter of a word."""
    one = {c: x for c, x in table.items() if len(x) == 1}
    none = "".join(c for c, x in table.items() if not x)
    out = F.translate(F.regexp_replace(text, f"(?:{start}|(?<=[{vowels}]))е", "ye"), "".join(one) + none, "".join(one.values()))
    for c, x in table.items():
        if len(x) > 1:
            out = F.replace(out, F.lit(c), F.lit(x))
    return F.regexp_replace(out, CYRILLIC, "") if drop else out


def to_latin(word: Column) -> Column:
    """A word of Uzbek Cyrillic in Latin letters; what is in no table stays."""
    return F.when(word == F.lower(word), _spelled_small(word, UZBEK, UZBEK_VOWELS, False)).otherwise(_spelled(word, UZBEK, UZBEK_VOWELS, False))


def russian_to_latin(word: Column) -> Column:
    """A word of Russian, or of another Cyrillic alphabet, as English writes it."""
    return F.when(word == F.lower(word), _spelled_small(word, RUSSIAN, RUSSIAN_VOWELS, True)).otherwise(_spelled(word, RUSSIAN, RUSSIAN_VOWELS, True))


def settle(word: Column) -> Column:
    """A word that mixes the alphabets in the one most of its letters are of, Cyrillic where both have as many.

    There Latin runs of nothing but look-alikes become Cyrillic; in a Latin word single Cyrillic look-alikes become Latin.
    """
    c, l = F.regexp_count(word, F.lit(CYRILLIC)), F.regexp_count(word, F.lit("[A-Za-z]"))
    looks = "".join(_LATIN_TWINS)
    cyrillic = F.transform(F.regexp_extract_all(word, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda r: F.when(r.rlike(f"^[{looks}]+$"), F.translate(r, looks, "".join(_LATIN_TWINS.values()))).otherwise(r))
    one = F.transform(F.regexp_extract_all(word, F.lit(f"{CYRILLIC}+|{CYRILLIC.replace('[', '[^', 1)}+"), F.lit(0)), lambda r: F.when(F.length(r) == 1, F.translate(r, "".join(TWINS), "".join(TWINS.values()))).otherwise(r))
    return F.when((c == 0) | (l == 0), word).when(c >= l, F.array_join(cyrillic, "")).otherwise(F.array_join(one, ""))


def _by_word(text: Column, fix) -> Column:
    """The text with its words that hold Cyrillic letters through `fix`; a text without any is not taken apart."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.when(w.rlike(CYRILLIC), let(settle(w), fix)).otherwise(w))
    return F.when(text.rlike(CYRILLIC), F.array_join(words, "")).otherwise(text)


def clean(text: Column) -> Column:
    """Uzbek in Latin letters: mixed words settled, Cyrillic ones spelled, one apostrophe in o‘ and g‘."""
    latin = _by_word(text, lambda w: F.when(w.rlike(CYRILLIC), to_latin(w)).otherwise(w))
    # Without Latin letters and capitals no word is mixed or loud, and the text is spelled as a whole.
    small = (text == F.lower(text)) & ~text.rlike("[A-Za-z]")
    latin = F.when(small, _spelled_small(text, UZBEK, UZBEK_VOWELS, False, f"(?<![{_LETTERS}])")).otherwise(latin)
    return F.regexp_replace(latin, r"(?<=[oOgG])['’ʻ`´](?=[\p{L}\p{N}_])", "‘")


def to_script(text: Column, locale: Column) -> Column:
    """A text in the alphabet of its language: Russian keeps both but settles words that mix them, Uzbek and English have no Cyrillic left."""
    rest = lambda t: _by_word(t, lambda w: F.when(w.rlike(CYRILLIC), russian_to_latin(w)).otherwise(w))
    english = _by_word(text, lambda w: F.when(~w.rlike(CYRILLIC), w).when(w.rlike(UZBEK_ONLY), to_latin(w)).otherwise(russian_to_latin(w)))
    return F.when(locale == "ru", _by_word(text, lambda w: w)).when(locale == "uz", let(clean(text), rest)).when(locale == "en", let(english, rest)).otherwise(let(text, rest))


def fields(docs: DataFrame) -> DataFrame:
    """doc_id, path and text of every field that a reader of a nested document sees, by one explode.

    docs: doc_id, title, sections (heading, body, notes, items (label, text, value), columns), questions (stem, answer, explanation, topic, options). A null isn't there.
    """
    at = lambda *parts: F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    one = lambda path, text: F.struct(path.alias("path"), text.alias("text"))

    def section(s: Column, i: Column) -> Column:
        own = F.array(*[one(at("sections", i, k), s[k]) for k in ("heading", "body", "notes")])
        items = F.flatten(F.transform(F.coalesce(s["items"], F.array()), lambda x, j: F.array(*[one(at("sections", i, "items", j, k), x[k]) for k in ("label", "text", "value")])))
        return F.concat(own, items, F.transform(F.coalesce(s["columns"], F.array()), lambda x, j: one(at("sections", i, "columns", j), x)))

    def question(q: Column, i: Column) -> Column:
        own = F.array(*[one(at("questions", i, k), q[k]) for k in ("stem", "answer", "explanation", "topic")])
        return F.concat(own, F.transform(F.coalesce(q["options"], F.array()), lambda x, j: one(at("questions", i, "options", j), x)))

    every = F.concat(F.array(one(at("title"), F.col("title"))), F.flatten(F.transform(F.coalesce("sections", F.array()), section)), F.flatten(F.transform(F.coalesce("questions", F.array()), question)))
    return docs.select("doc_id", F.explode(F.filter(every, lambda f: f["text"].isNotNull())).alias("f")).select("doc_id", "f.path", "f.text")


def violations(found: DataFrame, locale: Column) -> DataFrame:
    """The fields of `fields` that are in the wrong alphabet; Russian may have both."""
    return found.filter(locale.isin("uz", "en") & F.col("text").rlike(CYRILLIC)).select("doc_id", "path")


def enforce(found: DataFrame, locale: Column) -> DataFrame:
    """doc_id, path, text in its alphabet, whether that was corrected, and whether it is still wrong."""
    rows = found.withColumn("_locale", locale).withColumn("_to", to_script(F.col("text"), F.col("_locale")))
    fixed = (F.col("_to") != F.col("text")) & (F.col("text").rlike(CYRILLIC) | (F.col("_locale") == "ru"))
    return rows.select("doc_id", "path", F.col("_to").alias("text"), fixed.alias("fixed"), (F.col("_locale").isin("uz", "en") & F.col("_to").rlike(CYRILLIC)).alias("wrong"))
