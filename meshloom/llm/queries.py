"""The registered queries of this package, and SQL for those that SQL can express."""

from meshloom.llm.filter_audit import OP13_SQL, op13_radix_tries
from meshloom.llm.fingerprint import op3_scaled_sketch
from meshloom.llm.jaccard_join import op5_adaptive_prefix
from meshloom.llm.langid import op7_ftrl_language
from meshloom.llm.license_scan import op2_license_blocks
from meshloom.llm.line_dedup import OP4_SQL, op4_site_lines
from meshloom.llm.mixing import op9_sainte_lague
from meshloom.llm.packing import op10_sum_of_squares
from meshloom.llm.periodic_runs import op11_lyndon_runs
from meshloom.llm.quality import op6_compression_quality
from meshloom.llm.sharding import op8_external_shuffle
from meshloom.llm.simhash import op12_ball_hashing
from meshloom.llm.topk_search import OP1_SQL, op1_norm_buckets

QUERIES = {
    f.__name__: f
    for f in (
        op1_norm_buckets,
        op2_license_blocks,
        op3_scaled_sketch,
        op4_site_lines,
        op5_adaptive_prefix,
        op6_compression_quality,
        op7_ftrl_language,
        op8_external_shuffle,
        op9_sainte_lague,
        op10_sum_of_squares,
        op11_lyndon_runs,
        op12_ball_hashing,
        op13_radix_tries,
    )
}

ORACLES = {"op1_norm_buckets": OP1_SQL, "op4_site_lines": OP4_SQL, "op13_radix_tries": OP13_SQL}
