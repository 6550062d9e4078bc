"""Column functions. None of them needs a Python worker."""

from .aggregates import (  # noqa: F401
    absolute_delta_sum, count_where, distinct_extra, ordered_distinct_text, percentage, sum_where,
)
from .arrays import position_of  # noqa: F401
from .dates import date_precision, iso_date, month_id, month_number, month_of_id, year_of_id, year_token  # noqa: F401
from .hashing import fingerprint, record_id  # noqa: F401
from .locators import locator_order, locator_position  # noqa: F401
from .notes import fields_note, location_note, quality_notes, severity_rule_note  # noqa: F401
from .numbers import count_token, decimal_token, exact_pair, guarded_cast, known_sum, normal_number, to_scale7, within  # noqa: F401
from .text import (  # noqa: F401
    any_blank, encode_key, is_blank, missing_token, spaced_key, trimmed_or_null, try_encode_key,
)
