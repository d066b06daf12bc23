"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, ngram_join, packing, quality, rules, secrets, sharding, url_filter, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_extendible_sharding": sharding.op1_extendible_sharding,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_chat_formatting": chat.op6_chat_formatting,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_warc": warc.op10_warc,
        "pipeline": _pipeline,
    }


def oracle_sql():
    return {
        "op1_extendible_sharding": sharding.OP1_SQL,
        "op2_decontamination": decontaminate.OP2_SQL,
        "op3_ngram_jaccard": ngram_join.OP3_SQL,
        "op8_quality_rules": rules.OP8_SQL,
        "op9_secret_scan": secrets.OP9_SQL,
        "op10_warc": warc.OP10_SQL,
    }
