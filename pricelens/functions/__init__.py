"""Scalar rules as native Column expressions (no Python UDFs)."""

from .numeric import cents, nonzero, round_half_up  # noqa: F401
from .pricing import (amounts, card_mrp, clean_price, discount_pct, effective_mrp,  # noqa: F401
                      join_price_parts, sanity_price, unit_label, unit_price, value_score)
from .sizes import extract_size, extract_size_extended  # noqa: F401
from .text import (absolute_url, brand_guess, bullets_description, card_name, clean_product_name,  # noqa: F401
                   clean_text, first_json_key, is_price_fragment, json_brand, longest, observed_minutes,
                   plus_query, space_replace, strip_text)
