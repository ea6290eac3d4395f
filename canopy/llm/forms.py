"""Visually identical text with different characters (problem 2).

Every value is exploded to positioned code points, which meet two broadcast tables built
by rule from the Unicode character database: decompositions (canonical ones, and those
compatibility ones that look the same) joined with look-alike letters, and compositions.
Combining marks are ordered by class, letters and marks are recomposed, and the strings
are rebuilt. The values are partitioned by row once; all later steps stay in that
partitioning. A run of ASCII is a fixed point of all steps and travels as one segment.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.session import cut

# Letters that look like a Latin letter in common typefaces, by script.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G", "Ӏ": "I", "Ѵ": "V", "ѵ": "v",
    # Greek
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L",
    # Latin and other
    "ɡ": "g", "ɑ": "a", "ı": "i", "ǀ": "l",
    # Hyphens
    "‐": "-", "‑": "-",
}
#: Compatibility decompositions by tag that change how a text looks, kept as they are.
OTHER_LOOK = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>", "<small>")
#: Characters with no look of their own that aren't of category Cf.
INVISIBLE = ("͏", "ᅟ", "ᅠ", "ㅤ", "ﾠ", "឴", "឵", *map(chr, range(0x180B, 0x1810)), *map(chr, range(0xFE00, 0xFE10)))
#: Code points beyond ASCII with assigned characters: planes 0 to 3, and the tags.
ASSIGNED = [*range(0x80, 0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200)]
JAMO = (0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28)


def _class(ch: str) -> int:
    """Combining class; the vowels and finals of conjoining Hangul bind to what stands before them."""
    if 0x1161 <= ord(ch) <= 0x1175 or 0x11A8 <= ord(ch) <= 0x11C2:
        return 1
    return unicodedata.combining(ch)


def _expand(ch: str) -> str:
    """What `ch` is replaced by: '' if invisible, ' ' if a space, else its parts in looks."""
    kind = unicodedata.category(ch)
    if ch in INVISIBLE or kind == "Cf":
        return ""
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
        return " "
    parts = unicodedata.decomposition(ch)
    if 0xAC00 <= ord(ch) < 0xAC00 + 11172:
        return unicodedata.normalize("NFD", ch)
    if parts:
        tag, codes = (parts.split(" ", 1) if parts[0] == "<" else ("", parts))
        text = "".join(chr(int(x, 16)) for x in codes.split())
        if tag in OTHER_LOOK or (tag and text[0] == " ") or (tag == "<compat>" and ch == "ſ"):
            return ch
        return "".join(map(_expand, text))
    return LOOK_ALIKES.get(ch, ch)


@cache
def decompositions() -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, [(part, combining class), ...]) for each character that isn't its own only part of class 0."""
    out = []
    for code in ASSIGNED:
        ch = chr(code)
        if unicodedata.category(ch) in ("Cn", "Co"):
            continue
        text = _expand(ch)
        if text != ch or _class(ch):
            out.append((ch, [(x, _class(x)) for x in text]))
    return out


@cache
def compositions() -> list[tuple[str, dict[str, str]]]:
    """(starter, {text + mark: composed}) with all compositions that can follow from the starter.

    The composed letters are in the form's own letters, so the letters of look-alike
    scripts compose into Latin ones where such exist.
    """
    pairs: dict[str, dict[str, str]] = {}
    for code in ASSIGNED:
        ch = chr(code)
        full = unicodedata.normalize("NFD", ch)
        if len(full) < 2 or unicodedata.normalize("NFC", full) != ch or 0xAC00 <= code < 0xAC00 + 11172:
            continue
        first = unicodedata.normalize("NFC", full[:-1])
        text = "".join(map(_expand, full))
        if len(first) == 1 and text == full:
            pairs.setdefault(full[0], {})[first + full[-1]] = ch
    lead, vowel, final, syllable, ls, vs, fs = JAMO
    for i in range(ls):
        own = pairs.setdefault(chr(lead + i), {})
        for j in range(vs):
            lv = chr(syllable + (i * vs + j) * fs)
            own[chr(lead + i) + chr(vowel + j)] = lv
            own |= {lv + chr(final + k): chr(ord(lv) + k) for k in range(1, fs)}
    return sorted(pairs.items())


#: A run of ASCII up to its last character, or one code point.
SEGMENT = r"(?s)[\x00-\x7F]+(?=[\x00-\x7F])|."


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Both tables; their sizes are those of the Unicode database and never grow with the data."""
    d = spark.createDataFrame(decompositions(), "seg string, parts array<struct<ch: string, ccc: int>>")
    c = spark.createDataFrame(compositions(), "head string, known map<string, string>")
    return F.broadcast(d.coalesce(1)), F.broadcast(c.coalesce(1))


def _compose(head: Column, marks: Column, known: Column) -> Column:
    """The letter with its marks: each mark that composes and isn't blocked is taken in."""
    zero = F.struct(head.alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc, m):
        # F.element_at on a null map is null, so letters without compositions keep all marks.
        joined = F.when(acc["last"] < m["ccc"], F.try_element_at(known, F.concat(acc["letter"], m["ch"])))
        return F.when(joined.isNotNull(), F.struct(joined.alias("letter"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["letter"].alias("letter"), F.concat(acc["rest"], m["ch"]).alias("rest"), m["ccc"].alias("last"))
        )

    return F.aggregate(marks, zero, step, lambda acc: F.concat(acc["letter"], acc["rest"]))


def tidy(text: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return F.trim(F.regexp_replace(text, r"[\s]+", " "))


def visual_forms(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(*key, form): one row per row of `df` whose text isn't null, with its consistent form.

    `key` must be unique in `df` and not called seg, pos, sub, ch, ccc, run, parts, head or
    known. Values that look the same have equal forms: compatibility forms that look alike,
    look-alike letters (as Latin ones), spaces of any kind, number and outer place,
    invisible characters and the order of combining marks don't matter; letter case,
    accents and visible punctuation do. A form can be empty. Values of ASCII only are
    their own form up to white space. Texts of any length are taken whole.
    """
    known = df.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("_text"))
    plain = known.where(~F.col("_text").rlike(r"[^\x00-\x7F]")).select(*key, tidy(F.col("_text")).alias("form"))
    d, c = _tables(df.sparkSession)
    rich = known.where(F.col("_text").rlike(r"[^\x00-\x7F]")).repartition(*key)
    points = rich.select(*key, F.posexplode(F.regexp_extract_all("_text", F.lit(SEGMENT), F.lit(0))).alias("pos", "seg")).join(d, "seg", "left")
    parts = points.select(*key, "pos", F.posexplode_outer(F.coalesce("parts", F.array(F.struct(F.col("seg").alias("ch"), F.lit(0).alias("ccc"))))).alias("sub", "part"))
    parts = parts.where("part is not null").select(*key, "pos", "sub", "part.ch", "part.ccc")
    runs = parts.withColumn("run", F.sum((F.col("ccc") == 0).cast("int")).over(Window.partitionBy(*key).orderBy("pos", "sub")))
    # A run is a letter with its marks; ordered by class, then place, as canonical ordering asks.
    letters = runs.groupBy(*key, "run").agg(F.sort_array(F.collect_list(F.struct("ccc", "pos", "sub", "ch"))).alias("own"))
    bare = F.col("own")[0]["ccc"] != 0
    letters = letters.select(*key, "run", F.when(bare, F.lit("")).otherwise(F.col("own")[0]["ch"]).alias("head"), F.when(bare, F.col("own")).otherwise(F.slice("own", 2, F.greatest(F.size("own") - 1, F.lit(0)))).alias("own"))
    letters = letters.join(c, "head", "left").select(*key, "run", F.when(F.size("own") == 0, F.col("head")).otherwise(_compose(F.col("head"), F.col("own"), F.col("known"))).alias("letter"))
    built = letters.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "letter"))), lambda x: x["letter"]), "").alias("form"))
    # A text of invisible characters only has no code point left.
    built = rich.select(*key).join(built, key, "left").select(*key, tidy(F.coalesce("form", F.lit(""))).alias("form"))
    return plain.unionByName(built)


def look_alike_pairs(values: DataFrame, by: list[str], row: str, value: str) -> DataFrame:
    """(*by, a, b), a < b: rows of `values` equal in `by` (one of them the form) whose values aren't.

    Equal values are first put together, and only the different spellings of a form are
    paired, so a form that a third of all rows hold in one spelling makes no pairs of its
    own. Rows with a null in `by` or value are left out.
    """
    values = values.dropna(subset=[*by, value])
    spellings = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    many = spellings.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(*by)
    rows = cut(values.join(many, by))
    spellings = rows.select(*by, value).distinct()
    pairs = spellings.withColumnRenamed(value, "_v1").join(spellings.withColumnRenamed(value, "_v2"), by).where("_v1 < _v2")
    first = pairs.join(rows.select(*by, F.col(row).alias("_a"), F.col(value).alias("_v1")), [*by, "_v1"])
    both = first.join(rows.select(*by, F.col(row).alias("_b"), F.col(value).alias("_v2")), [*by, "_v2"])
    return both.select(*by, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def work_forms(works: DataFrame) -> DataFrame:
    """(field, work_id, value, form) of the titles and author lists of works rows.

    Titles that are null or blank, also after tidying, and null and empty lists are left
    out. value and form of a list are strings that lists share only if they have equal
    elements in equal places (a null element equals a null element only).
    """
    title, nothing = F.lit(-1), F.lit("\u0000")
    cells = F.concat(F.array(F.struct(title.alias("place"), F.col("title").alias("text"))), F.transform(F.coalesce("authors", F.array()), lambda x, i: F.struct(i.alias("place"), x.alias("text"))))
    each = works.select("work_id", F.inline(cells))
    forms = visual_forms(each, ["work_id", "place"], "text")
    lists = F.sort_array(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "text", "form"))))
    built = each.join(forms, ["work_id", "place"], "left").groupBy("work_id").agg(
        F.max(F.when(F.col("place") < 0, F.col("text"))).alias("title"), F.max(F.when(F.col("place") < 0, F.col("form"))).alias("title_form"), lists.alias("names")
    )
    json = lambda part: F.to_json(F.transform("names", lambda x: F.coalesce(x[part], nothing)))
    fields = F.array(
        F.struct(F.lit("title").alias("field"), F.when(F.col("title_form") != "", F.col("title")).alias("value"), F.col("title_form").alias("form")),
        F.struct(F.lit("authors").alias("field"), F.when(F.size("names") > 0, json("text")).alias("value"), json("form").alias("form")),
    )
    return built.select("work_id", F.inline(fields)).where("value is not null").select("field", "work_id", "value", "form")


def look_alike_works(works: DataFrame) -> DataFrame:
    """(field, work_a, work_b): rows whose titles or author lists look the same and differ."""
    pairs = look_alike_pairs(cut(work_forms(works)), ["field", "form"], "work_id", "value")
    return pairs.select("field", F.col("a").alias("work_a"), F.col("b").alias("work_b"))
