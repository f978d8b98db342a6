"""The registered queries of this subpackage; none of them can be expressed as one SQL statement as a whole."""

from __future__ import annotations

from domainforge.llm.decontaminate import op3_benchmark_decontamination
from domainforge.llm.extract import op9_html_extraction
from domainforge.llm.jaccard_join import op6_ngram_jaccard_join
from domainforge.llm.lm_scoring import op10_lm_scoring
from domainforge.llm.order_minhash import op7_order_minhash
from domainforge.llm.packing import op5_best_fit_packing
from domainforge.llm.quality import op8_quality_classifier
from domainforge.llm.sanitise import op2_private_data
from domainforge.llm.secrets import op1_secret_scan
from domainforge.llm.warc import ORACLE as WARC_SQL
from domainforge.llm.warc import op4_warc_normaliser

_ALL = (
    op1_secret_scan,
    op2_private_data,
    op3_benchmark_decontamination,
    op4_warc_normaliser,
    op5_best_fit_packing,
    op6_ngram_jaccard_join,
    op7_order_minhash,
    op8_quality_classifier,
    op9_html_extraction,
    op10_lm_scoring,
)
QUERIES = {f.__name__: f for f in _ALL}
#: The others train models, run a tokenizer or walk a graph; they are tested by brute force.
ORACLES: dict[str, str] = {"op4_warc_normaliser": WARC_SQL}
