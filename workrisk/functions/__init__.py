"""Column-expression helpers (JVM-side, codegen friendly; no Python UDFs)."""

from workrisk.functions.codes import (broad_code, clean_onet_code, clean_soc_code, major_code,
                                      minor_code, occ_from_onet, onet_from_occ)
from workrisk.functions.numeric import (clip, clip_upper, dirty_to_double, nan_to_null, null_max,
                                        safe_div, sum0)
from workrisk.functions.categories import (category_order, risk_category, tech_stratum)

__all__ = [
    "broad_code", "clean_onet_code", "clean_soc_code", "major_code", "minor_code",
    "occ_from_onet", "onet_from_occ", "clip", "clip_upper", "dirty_to_double", "nan_to_null",
    "null_max", "safe_div", "sum0", "category_order", "risk_category", "tech_stratum",
]
