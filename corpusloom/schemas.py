"""Schemas of the engine's tables, as DDL."""

DOCS = "doc_id long, text string"
META = "doc_id long, link string, title string, path string"
TOKENS = "doc_id long, pos int, token string"
LEMMAS = "token string, lemma string"
TERMS = "term_id long, term string, df long, cf long"
POSTINGS = "term string, doc_id long, tf int, positions array<int>"
RESULTS = "rank_pos int, doc_id long, rank float, stage int"
