"""The queries of this package and their SQL, for __spark_entry__.py."""

from .collocations import OP12_SQL, op12_collocations
from .decontamination import OP6_SQL, op6_decontamination
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_extract import op3_html_extraction
from .licenses import op9_license_scans
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import OP8_SQL, op8_mixing
from .ngram_join import OP2_SQL, op2_ngram_join
from .quality import op10_quality
from .sharding import OP7_SQL, op7_sharding
from .topk_search import OP13_SQL, op13_topk_search
from .toxicity import op4_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_license_scans": op9_license_scans,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_topk_search": op13_topk_search,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op2_ngram_join": OP2_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_sharding": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_topk_search": OP13_SQL,
}
