from .time import (time_bucket, trunc_time, minute_slice, round_time, overlaps,  # noqa: F401
                   seconds_between, parse_time)
from .arith import (per_unit, safe_div, hit_ratio, pct, bit_set, bitmask_decode, decode_packed,  # noqa: F401
                    split_word, block_class)
from .text import (code_label, flags_to_list, contains_ci, short_text, format_number_locale,  # noqa: F401
                   nvl_text)
from .agg import first_value_by, last_value_by, single_or_count, load_average  # noqa: F401
