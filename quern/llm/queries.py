"""The queries of this package, and SQL for those that SQL can express."""

from quern.llm import brown, chat, debruijn, decontam, langid, packing, quality, sigtree, urlfilter, warc


def queries() -> dict:
    return {
        "op1_chat_formatting": chat.op1_chat_formatting,
        "op2_lm_scoring": brown.op2_lm_scoring,
        "op3_substring_dedup": debruijn.op3_substring_dedup,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_ngram_jaccard_join": sigtree.op5_ngram_jaccard_join,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_warc": warc.op7_warc,
        "op8_url_filters": urlfilter.op8_url_filters,
        "op9_packing": packing.op9_packing,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat.OP1_SQL,
        "op3_substring_dedup": debruijn.OP3_SQL,
        "op5_ngram_jaccard_join": sigtree.OP5_SQL,
        "op7_warc": warc.OP7_SQL,
        "op8_url_filters": urlfilter.OP8_SQL,
    }
