"""The operators' queries and their SQL."""

from penstroke.llm import chat, sentence_spans, urls
from penstroke.llm.alignment import op11_byte_owners
from penstroke.llm.decontaminate import op1_qgram_decontamination
from penstroke.llm.jaccard import op7_parity_jaccard
from penstroke.llm.language import op3_language_mixture
from penstroke.llm.packing import op8_length_buckets
from penstroke.llm.quality import op10_quality_rules
from penstroke.llm.secrets import op5_secret_scan
from penstroke.llm.sharding import op6_lookup_sharding
from penstroke.llm.substrings import op9_suffix_dedup
from penstroke.llm.whitening import op13_digit_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_qgram_decontamination, sentence_spans.op2_sentence_spans, op3_language_mixture, urls.op4_url_rules, op5_secret_scan,
        op6_lookup_sharding, op7_parity_jaccard, op8_length_buckets, op9_suffix_dedup, op10_quality_rules, op11_byte_owners,
        chat.op12_shape_formatting, op13_digit_whitening,
    )
}
ORACLES = {"op2_sentence_spans": sentence_spans.ORACLE, "op4_url_rules": urls.ORACLE, "op12_shape_formatting": chat.ORACLE}
