"""Column expressions (SURVEY section B). Everything here is a built-in Spark expression."""

from ._util import blank, nullif_blank, pystrip  # noqa: F401
from .cards import alert_card, days_label, html_escape, is_urgent  # noqa: F401
from .classify import (  # noqa: F401
    PROPERTY_TYPES, TYPE_ALIASES, categorize_property_type, resolve_type_alias,
)
from .parse import (  # noqa: F401
    MAX_PRICE, MIN_PRICE, STATES, VALID_PRICE_FLOOR, absolute_url, date_only, days_until, discount_value,
    extract_postcode, extract_state, format_amount, is_valid_price, listing_id_from_url, parse_amount,
    parse_any_date, parse_auction_date, parse_date_anywhere, price_value, price_value_all, round_coord, short_address,
    size_number, size_value, strip_weekday, validate_auction_date, validate_price,
)
from .text import (  # noqa: F401
    DEFAULT_LOCATION, chat_search_text, clean_location, listing_search_text, norm_address, norm_size,
    norm_text, observation_hash, property_slug, resolve_scheme, scheme_from_address, scheme_from_header,
    search_text, stable_key,
)
