"""Registered queries of the training-data operators and the SQL of those that DuckDB can express."""
from . import decontaminate, fim, hard_negatives, licenses, line_dedup
from .decontaminate import op10_benchmark_decontamination
from .fim import op11_fill_in_middle
from .hard_negatives import op13_hard_negatives
from .html_text import op9_html_extraction
from .langid import op4_language_id
from .licenses import op8_license_scans
from .line_dedup import op12_line_dedup
from .pieces import op5_sentencepiece
from .quality import op6_quality_rules
from .secrets import op1_secret_scans
from .sharding import op7_sharding
from .simhash import op2_simhash_near_dedup
from .urls import op3_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_simhash_near_dedup,
        op3_url_filters,
        op4_language_id,
        op5_sentencepiece,
        op6_quality_rules,
        op7_sharding,
        op8_license_scans,
        op9_html_extraction,
        op10_benchmark_decontamination,
        op11_fill_in_middle,
        op12_line_dedup,
        op13_hard_negatives,
    )
}

ORACLE = {
    "op8_license_scans": licenses.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
