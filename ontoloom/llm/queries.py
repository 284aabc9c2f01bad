"""Queries of this subpackage, each over its whole table, and their SQL."""

from ontoloom.llm import chat, decontaminate, langid, packing, quality, secrets, simhash, substrings, urlfilter, warc

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_decontaminate": decontaminate.query,
    "op3_warc": warc.query,
    "op4_substring_dedup": substrings.query,
    "op5_quality_rules": quality.query,
    "op6_chat_format": chat.query,
    "op7_simhash": simhash.query,
    "op8_packing": packing.query,
    "op9_url_filter": urlfilter.query,
    "op10_language_id": langid.query,
}

ORACLE_SQL = {
    "op1_secret_scan": secrets.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_substring_dedup": substrings.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op9_url_filter": urlfilter.ORACLE,
}
