"""Queries and oracles of this subpackage, by name."""

from __future__ import annotations

from folio.llm import chat_format, filter_audit, html_extract, license_scan, line_cleaning, mixing, packing, phrase_mining, simhash_dedup, substring_dedup, suffix_dedup, url_filter, vector_search

QUERIES: dict = {}
SQL: dict = {}
for _module in (chat_format, filter_audit, html_extract, license_scan, line_cleaning, mixing, packing, phrase_mining, simhash_dedup, substring_dedup, suffix_dedup, url_filter, vector_search):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
