"""Schemas of raw records, works and stored tables."""

from __future__ import annotations

#: Columns of a flat work.
WORK = (
    "label string, ids array<string>, authors array<string>, year int, title string, venue string, type string, venue_type string, publisher string, "
    "institution string, volume string, issue string, page string, doi string, permalink string, times_cited int, keywords array<string>, abstract string, rich boolean"
)
WORK_COLUMNS = [c.split()[0] for c in WORK.split(", ")]
SOURCE = "struct<id: string, display_name: string, type: string, host_organization_name: string>"
LOCATION = f"struct<is_oa: boolean, landing_page_url: string, pdf_url: string, source: {SOURCE}>"
#: A raw record as the catalogue serves it.
RAW = (
    "id string, ids map<string, string>, doi string, title string, type string, publication_year int, cited_by_count int, referenced_works array<string>, "
    "authorships array<struct<author_position: string, author: struct<id: string, display_name: string, orcid: string>, is_corresponding: boolean, institutions: array<struct<display_name: string>>>>, "
    "keywords array<struct<id: string, display_name: string, score: double>>, abstract_inverted_index map<string, array<int>>, "
    f"biblio struct<volume: string, issue: string, first_page: string, last_page: string>, primary_location {LOCATION}, locations array<{LOCATION}>"
)
TABLES = {
    "collections": "id string, query_hash string, query string, result_limit long, parameters string, name string, work_count long, created_at timestamp, updated_at timestamp",
    "works": WORK,
    "terms": "label string, terms array<array<string>>",
    "nodes": "collection_id string, id string, work_label string, category string, rootness double, trunkness double, leafness double",
    "links": "collection_id string, source string, target string, weight double",
}
