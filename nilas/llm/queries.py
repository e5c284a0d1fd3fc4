"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from nilas.llm import alignment, decontaminate, html_text, mixing, ngram_join, periods, pii, quality, sharding, substring, toxicity, url_filter, warc
from nilas.llm.common import ship


def _with_package(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_sharding": sharding.op2_sharding,
    "op3_warc": warc.op3_warc,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_html_text": html_text.op6_html_text,
    "op7_quality_cascade": quality.op7_quality_cascade,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_personal_data": pii.op9_personal_data,
    "op10_mixing": mixing.op10_mixing,
    "op11_substring_dedup": substring.op11_substring_dedup,
    "op12_periodic_runs": periods.op12_periodic_runs,
    "op13_alignment": alignment.op13_alignment,
}
QUERIES = {name: _with_package(query) for name, query in QUERIES.items()}
ORACLES = {
    "op1_ngram_jaccard": ngram_join.SQL,
    "op3_warc": warc.SQL,
    "op5_url_filter": url_filter.SQL,
    "op7_quality_cascade": quality.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op11_substring_dedup": substring.SQL,
}
