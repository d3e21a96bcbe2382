"""The corpus operators' queries and the SQL of those that SQL can express."""

from . import line_dedup, ngram_join, substring_dedup, topk, url_filter
from .language import op5
from .line_dedup import op8
from .mixing import op9
from .ngram_join import op4
from .packing import op7
from .quality import op2
from .substring_dedup import op6
from .topk import op10
from .toxicity import op1
from .url_filter import op3

QUERIES = {
    "op1_toxicity": op1,
    "op2_quality_rules": op2,
    "op3_url_filter": op3,
    "op4_ngram_jaccard_join": op4,
    "op5_language_id": op5,
    "op6_substring_dedup": op6,
    "op7_best_fit_packing": op7,
    "op8_line_dedup": op8,
    "op9_source_mixing": op9,
    "op10_exact_top_k": op10,
}
ORACLES: dict[str, str] = {
    "op3_url_filter": url_filter.ORACLE,
    "op4_ngram_jaccard_join": ngram_join.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
}
