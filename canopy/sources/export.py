"""Rendering works: JSON, BibTeX, markdown and file names.

Renderers take rows that the caller has bounded (a category list, a search result, one
collection that a person asked for) and return text. Whole tables are written as JSON by
write_json without passing the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import scalar as S

FORMATS = ("json", "bibtex", "simple", "markdown", "reference", "filename")
# Fixed value: the order of BibTeX fields; others follow by the alphabet.
FIELD_ORDER = ["author", "title", "journal", "booktitle", "series", "publisher", "institution", "school", "howpublished", "year", "volume", "number", "pages", "doi", "url", "note", "keywords", "abstract"]
SEPARATOR = "\n\n---\n\n"
_BARE = {"year", "volume", "number"}


def bib_fields(works: DataFrame, abstracts: bool = True) -> DataFrame:
    """`works` with base_key, entry_type and fields (map of BibTeX field to value)."""
    latex = lambda c: S.sanitize_latex(S.non_empty(c))
    venue = S.non_empty(S.citable_venue(F.col("venue"), F.col("venue_type")))
    kind = S.bib_entry_type(F.col("type"), F.col("venue"), F.col("venue_type"))
    hosted = F.coalesce("venue_type", F.lit("")) == "repository"
    only = lambda *kinds: kind.isin(*kinds)
    issuer = F.coalesce("institution", "publisher")
    pages = F.replace(F.replace(F.col("page"), F.lit("-"), F.lit("--")), F.lit("----"), F.lit("--"))
    cells = {
        "author": F.when(F.size("authors") > 0, F.array_join("authors", " and ")),
        "title": latex(F.col("title")),
        "journal": F.when(only("article"), latex(venue)),
        "booktitle": F.when(only("inproceedings", "incollection"), latex(venue)),
        "series": F.when(only("book") & (F.col("venue_type") == "book series"), latex(venue)),
        "publisher": F.when(only("book", "incollection"), latex(F.col("publisher"))),
        "institution": F.when(only("techreport"), latex(issuer)),
        "school": F.when(only("phdthesis"), latex(issuer)),
        "howpublished": F.when(only("misc") & hosted, latex(F.col("venue"))),
        "year": F.col("year").cast("string"),
        "volume": S.non_empty(F.col("volume")),
        "number": S.non_empty(F.col("issue")),
        "pages": S.non_empty(pages),
        "doi": S.extract_doi(S.non_empty(F.col("doi"))),
        "url": S.permalink(F.col("permalink"), F.col("doi")),
        "note": F.when(hosted & ~only("phdthesis", "techreport"), F.lit(S.REPOSITORY_NOTE)),
        "keywords": F.when(F.size("keywords") > 0, F.array_join(F.transform("keywords", S.sanitize_latex), ", ")),
        "abstract": S.sanitize_latex(S.non_empty(F.array_join(S.fields(F.col("abstract")), " "))) if abstracts else F.lit(None).cast("string"),
    }
    fields = F.map_filter(F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    key = S.citation_key(F.col("authors"), F.col("year"), F.col("doi"), F.col("ids"), F.col("label"))
    return works.select("*", key.alias("base_key"), kind.alias("entry_type"), fields.alias("fields"))


def cite_keys(base: Iterable[str]) -> list[str]:
    """Keys in order: of a base, it alone, it with a, b, ...; the first that isn't taken yet."""
    taken: set[str] = set()
    streams: dict[str, Iterator[str]] = {}
    out = []
    for key in base:
        options = streams.setdefault(key, map(partial(_told_apart, key), count()))
        out.append(next(k for k in options if k not in taken))
        taken.add(out[-1])
    return out


def _told_apart(key: str, n: int) -> str:
    return key + S.key_suffix(n)


def format_entry(kind: str, key: str, fields: dict[str, str]) -> str:
    """One BibTeX entry with aligned fields; whole numbers of year, volume and number stand bare."""
    rank = {k: i for i, k in enumerate(FIELD_ORDER)}
    names = sorted(fields, key=lambda k: (rank.get(k, len(rank)), k))
    width = max(map(len, names), default=0)
    value = lambda k: fields[k] if k in _BARE and re.fullmatch(r"[+-]?\d+", fields[k]) else "{" + fields[k] + "}"
    return "\n".join([f"@{kind}{{{key},", *[f"    {k:<{width}} = {value(k)}," for k in names], "}"]) + "\n"


def to_bibtex(works: DataFrame, abstracts: bool = True) -> tuple[str, list[dict]]:
    """(text, infos) of works in their order; infos: id, citekey, title, year, first_author."""
    rows = bib_fields(works, abstracts).collect()
    keys = cite_keys(r["base_key"] for r in rows)
    text = "\n".join(format_entry(r["entry_type"], k, r["fields"]) for r, k in zip(rows, keys))
    infos = [{"id": min(r["ids"] or [r["label"]]), "citekey": k, "title": r["title"] or "", "year": r["year"], "first_author": (r["authors"] or [""])[0]} for r, k in zip(rows, keys)]
    return text, infos


def _yaml(value) -> str:
    """A scalar as YAML: quoted where it wouldn't be read back as the same string."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    plain = re.fullmatch(r"[^\W\d][^\n:#\[\]{},&*!|>'\"%@`]*", value) and value.strip() == value and value.lower() not in ("true", "false", "null", "yes", "no", "on", "off")
    return value if plain else json.dumps(value, ensure_ascii=False)


def front_matter(work: dict) -> str:
    lines = ["---"]
    for c in ("title", "venue", "volume", "issue", "page", "doi", "permalink", "times_cited"):
        if work.get(c) is not None:
            lines.append(f"{c}: {_yaml(work[c])}")
    if work.get("keywords"):
        lines += ["keywords:", *[f"    - {_yaml(k)}" for k in work["keywords"]]]
    return "\n".join([*lines, f"rich: {_yaml(bool(work.get('rich')))}", "---"])


def reference(work: dict) -> str:
    """A work as one line of a reference list; a stub as its label."""
    if not work.get("rich"):
        return work["label"]
    text = ", ".join(work.get("authors") or []) + f', "{work.get("title") or ""}", ' + (f"*{work['venue']}*" if work.get("venue") else "")
    for c, lead in (("volume", ", vol. "), ("issue", ", no. "), ("page", ", pp. "), ("year", ", "), ("doi", ". doi: ")):
        if work.get(c):
            text += f"{lead}{work[c]}"
    return text + "."


def _link(work: dict) -> str:
    return work.get("permalink") or (f"https://doi.org/{work['doi']}" if work.get("doi") else "")


def markdown_simple(work: dict) -> str:
    link = _link(work)
    text = f"# {work.get('title') or work['label']}\n" + (f"**link**: [{link}]({link})\n" if link else "")
    text += "\n" + (S.wrap_text("**keywords**: " + ", ".join(work["keywords"]), 80) if work.get("keywords") else "") + "\n\n"
    return text + (f"## Abstract\n\n{S.wrap_text(work['abstract'], 80)}\n" if work.get("abstract") else "")


def markdown_full(work: dict, references: Iterable[dict] = ()) -> str:
    text = f"{front_matter(work)}\n\n# {work.get('title') or work['label']}\n\n"
    if work.get("abstract"):
        text += f"## Abstract\n\n{S.wrap_text(work['abstract'], 80)}\n"
    references = list(references)
    if references:
        text += "\n## References\n\n" + "".join(S.wrap_text(reference(r), 80) + "\n\n" for r in references if r.get("rich"))
    return text


def render(works: DataFrame, format: str, references: DataFrame | None = None) -> str:
    """Works in their order as text of a format of FORMATS.

    references: (source, ...work columns) of works by their id, for markdown.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if format == "bibtex":
        return to_bibtex(works)[0]
    if format == "filename":
        node = F.col("id") if "id" in works.columns else S.work_key(F.col("ids"))
        return "".join(r[0] + "\n" for r in works.select(S.filename(node, F.col("title"), F.col("label"))).collect())
    rows = [r.asDict(recursive=True) for r in works.collect()]
    if format == "json":
        return json.dumps(rows, indent=2, ensure_ascii=False, default=str)
    cited: dict[str, list[dict]] = {}
    if references is not None and format == "markdown":
        for r in references.collect():
            cited.setdefault(r["source"], []).append(r.asDict(recursive=True))
    one = {"simple": markdown_simple, "reference": reference}.get(format)
    return "".join((one(w) if one else markdown_full(w, cited.get(w.get("id"), ()))) + SEPARATOR for w in rows)


def write_json(df: DataFrame, path: str, compress: bool = True) -> None:
    """All rows as JSON lines, gzip-compressed unless told otherwise."""
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)
