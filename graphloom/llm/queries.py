"""The registered queries of this subpackage and their SQL."""

from . import byte_bpe, decontamination, html_extraction, language_id, near_dedup, pii, quality, sharding, toxicity, warc

MODULES = (decontamination, byte_bpe, toxicity, language_id, html_extraction, near_dedup, pii, sharding, warc, quality)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
