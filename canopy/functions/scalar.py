"""Scalar functions of the work model as Column expressions.

Null inputs give null unless a docstring says otherwise. Everything stays in the JVM but
the removal of diacritics, for which Spark has no normaliser.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: prefixes that stand before a DOI, in either letter case.
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)"
#: Version of the query fingerprint; raising it outdates every stored collection.
FINGERPRINT_VERSION = 3
# Venue types that say where a work is hosted, not where it was published.
HOSTS = ("repository", "ebook platform")
REPOSITORY_NOTE = "venue from repository copy"


def trimmed(text: Column) -> Column:
    """`text` without white space of any kind around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fields(text: Column) -> Column:
    """The words of `text` between runs of white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def extract_doi(doi: Column) -> Column:
    """The DOI without one resolver or scheme prefix; letter case is kept."""
    return F.regexp_replace(trimmed(doi), DOI_PREFIX, "")


def invert_name(name: Column) -> Column:
    """'First M Last' as 'Last, First M'; names with a comma or of one word stay."""
    name = trimmed(name)
    words = fields(name)
    inverted = F.concat_ws(" ", F.concat(F.element_at(words, -1), F.lit(",")), F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    return F.when(name.isNull() | name.contains(",") | (F.size(words) < 2), name).otherwise(inverted)


def invert_abstract(index: Column) -> Column:
    """Text of a map from word to positions; places without a word are empty, null is ''.

    Of two words at one place the one that comes later in the alphabet stays.
    """
    cells = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    at = F.map_from_entries(F.filter(F.transform(F.array_sort(cells), lambda c: c), lambda c: c["p"] >= 0))
    last = F.coalesce(F.array_max(F.transform(cells, lambda c: c["p"])), F.lit(0))
    dense = F.size(F.array_distinct(F.transform(cells, lambda c: c["p"]))) == last + 1
    ordered = F.array_join(F.transform(F.array_sort(cells), lambda c: c["w"]), " ")
    gappy = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(""))), " ")
    single = F.size(cells) == F.size(F.array_distinct(F.transform(cells, lambda c: c["p"])))
    return F.coalesce(F.trim(F.when(dense & single, ordered).otherwise(gappy)), F.lit(""))


def page_range(first: Column, last: Column) -> Column:
    """'first-last', or the first page alone if the last is null, empty or the same."""
    alone = F.coalesce(last, F.lit("")).isin("") | (last == first)
    return F.when(F.coalesce(first, F.lit("")) == "", None).when(alone, first).otherwise(F.concat_ws("-", first, last))


def venue_source(primary: Column, locations: Column) -> Column:
    """The source to cite: the primary one unless it is a repository or missing; else the
    first journal or conference among the locations; else the primary one.

    primary: struct with a source struct (display_name, type, ...); locations: array of such.
    """
    sources = F.transform(locations, lambda x: x["source"])
    better = F.get(F.filter(sources, lambda s: s["type"].isin("journal", "conference")), F.lit(0))
    own = primary["source"]
    return F.when(own.isNotNull() & (F.coalesce(own["type"], F.lit("")) != "repository"), own).otherwise(F.coalesce(better, own))


def first_institution(authorships: Column) -> Column:
    """The first institution with a name, in the order of authors."""
    names = F.flatten(F.transform(authorships, lambda a: F.coalesce(F.transform(a["institutions"], lambda i: i["display_name"]), F.array().cast("array<string>"))))
    return F.get(F.filter(names, lambda n: n != ""), F.lit(0))


def keep_longest(a: Column, b: Column) -> Column:
    """The string of more bytes, of equally long ones the smaller."""
    longer = F.when(F.octet_length(a) > F.octet_length(b), a).when(F.octet_length(b) > F.octet_length(a), b).otherwise(F.least(a, b))
    return F.coalesce(longer, a, b)


def work_key(ids: Column) -> Column:
    """The smallest identifier, null without identifiers."""
    return F.array_min(ids)


def id_of(ids: Column, source: str) -> Column:
    """The value of the first identifier of a source, in order of the alphabet."""
    own = F.filter(F.array_sort(ids), lambda x: F.startswith(x, F.lit(f"{source}:")))
    return F.substring_index(F.get(own, F.lit(0)), f"{source}:", -1) if ":" not in source else F.regexp_replace(F.get(own, F.lit(0)), f"^{re.escape(source)}:", "")


def simple_label(authors: Column, year: Column, venue: Column, volume: Column, page: Column, doi: Column) -> Column:
    """'Author, year, venue, V<volume>, P<page>, DOI <doi>' of what is known; null if nothing is."""
    parts = [F.replace(F.get(authors, F.lit(0)), F.lit(","), F.lit("")), year.cast("string"), venue, F.concat(F.lit("V"), volume), F.concat(F.lit("P"), page), F.concat(F.lit("DOI "), doi)]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def simple_id(authors: Column, year: Column) -> Column:
    """Lower-case first word of the first author, and the year; null without either."""
    first = F.substring_index(F.get(authors, F.lit(0)), " ", 1)
    return F.lower(F.concat(F.replace(first, F.lit(","), F.lit("")), year.cast("string")))


def add_simple_id(ids: Column, authors: Column, year: Column) -> Column:
    """The identifiers with 'simple:<simple id>' among them, sorted; unchanged without one."""
    extra = F.array_compact(F.array(F.concat(F.lit("simple:"), non_empty(simple_id(authors, year)))))
    return F.array_sort(F.array_union(F.array_compact(F.coalesce(ids, F.array().cast("array<string>"))), extra))


def permalink(link: Column, doi: Column) -> Column:
    return F.coalesce(non_empty(link), F.concat(F.lit("https://doi.org/"), non_empty(doi)))


def filename(node_id: Column, title: Column, label: Column) -> Column:
    """A slug of the title (or label) of at most 60 characters, a hash of the id, and '.md'."""
    name = F.coalesce(non_empty(title), non_empty(label), F.lit("article"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s_-]", ""), r"[\s_-]+", "-")
    slug = F.regexp_replace(F.left(F.regexp_replace(slug, "^-+|-+$", ""), F.lit(60)), "-+$", "")
    return F.concat(F.coalesce(non_empty(slug), F.lit("article")), F.lit("-"), F.left(F.sha2(node_id, 256), F.lit(8)), F.lit(".md"))


def viewer_size(rootness: Column, trunkness: Column, leafness: Column) -> Column:
    return F.greatest(rootness, trunkness, leafness)


def normalize_query(query: Column) -> Column:
    """Trimmed, in lower case, with single blanks."""
    return F.regexp_replace(F.lower(trimmed(query)), r"(?U)\s+", " ")


def query_fingerprint(query: Column, limit: Column) -> Column:
    """Hex SHA-256 of the version, the limit and the normalised query as compact JSON."""
    text = F.to_json(F.struct(F.lit(FINGERPRINT_VERSION).alias("version"), limit.cast("long").alias("limit"), normalize_query(query).alias("query")))
    # The characters that the fingerprint's JSON writes as escapes.
    for char in "&<>\u2028\u2029":
        text = F.replace(text, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return F.sha2(text, 256)


def display_query(query: Column) -> Column:
    """A query of more than 40 bytes as its first 37 characters and '...'."""
    return F.when(F.octet_length(query) > 40, F.concat(F.left(query, F.lit(37)), F.lit("..."))).otherwise(query)


def sanitize_latex(text: Column) -> Column:
    """% & _ # behind a backslash, unless an odd run of backslashes stands there already."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)([%&_#])", r"$1\\$2")


def normalize_score(score: Column, top: Column) -> Column:
    """0 for a score or maximum of 0 or less, 1 at the maximum or above, else log1p(score) / log1p(maximum)."""
    return F.when((score <= 0) | (top <= 0), 0.0).when(score >= top, 1.0).otherwise(F.log1p(score) / F.log1p(top))


def citable_venue(venue: Column, venue_type: Column) -> Column:
    """The venue unless it only hosts the work, '' otherwise."""
    return F.when(F.coalesce(venue_type, F.lit("")).isin(*HOSTS), "").otherwise(F.coalesce(venue, F.lit("")))


def bib_entry_type(kind: Column, venue: Column, venue_type: Column) -> Column:
    """The BibTeX entry type by type and venue type; without either by whether there is a venue."""
    kind, place = F.coalesce(kind, F.lit("")), F.coalesce(venue_type, F.lit(""))
    return (
        F.when((kind == "conference-paper") | (place == "conference"), "inproceedings")
        .when(kind == "book", "book")
        .when(kind == "report", "techreport")
        .when(kind == "book-chapter", "incollection")
        .when(kind == "dissertation", "phdthesis")
        .when(place == "repository", "misc")
        .when(citable_venue(venue, venue_type) != "", "article")
        .otherwise("misc")
    )


def strip_marks(text: str) -> str:
    """`text` without combining marks, composed."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def without_diacritics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(strip_marks, na_action="ignore")


def cite_key(text: Column) -> Column:
    """`text` as a citation key: no diacritics, other characters as '_', lower case."""
    key = F.regexp_replace(without_diacritics(text), r"[^a-zA-Z0-9_-]+", "_")
    return F.coalesce(non_empty(F.lower(F.regexp_replace(key, "^_+|_+$", ""))), F.lit("article"))


def citation_key(authors: Column, year: Column, doi: Column, ids: Column, label: Column) -> Column:
    """The first known of simple id, DOI, catalogue number, key and label, as a citation key."""
    number = F.regexp_replace(id_of(ids, "openalex"), r"^https://openalex\.org/", "")
    source = F.coalesce(non_empty(simple_id(authors, year)), F.concat(F.lit("doi_"), extract_doi(non_empty(doi))), non_empty(number), non_empty(work_key(ids)), non_empty(label), F.lit("article"))
    return cite_key(source)


def key_suffix(n: int) -> str:
    """1 as a, 26 as z, 27 as aa: the n-th suffix in bijective base 26; '' for n below 1."""
    out = ""
    while n > 0:
        n, digit = divmod(n - 1, 26)
        out = chr(ord("a") + digit) + out
    return out


def wrap_text(text: str, limit: int) -> str:
    """Greedy lines of at most `limit` bytes; a longer word stands alone."""
    lines: list[str] = []
    size = 0
    for word in text.split():
        width = len(word.encode())
        if lines and size + width + 1 <= limit:
            lines[-1] += " " + word
            size += width + 1
        elif lines and size == 0:
            lines[-1] += word
            size = width
        else:
            lines.append(word)
            size = width
    return "\n".join(lines)
