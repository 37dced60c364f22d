"""Schemas of the library's tables, as DDL."""

PRODUCTS = "id bigint, sku string, name string, category string, brand string, model string, image_url string, product_url string, retailer string, slug string, parent_asin string, family_id string, capacity_gb int, created_at timestamp, updated_at timestamp"
PRICE_HISTORY = "id bigint, product_id bigint, price decimal(10,2), regular_price decimal(10,2), in_stock boolean, fetched_at timestamp"
ALERTS = "id bigint, product_id bigint, email string, target_price decimal(10,2), confirmed boolean, confirmed_at timestamp, triggered boolean, confirm_token string, unsubscribe_token string, created_at timestamp"
EMAIL_SEND_LOG = "id bigint, email string, send_type string, sent_at timestamp"
MARKET_STATS = "segment string, current_avg_price decimal(10,2), baseline_avg_price decimal(10,2), pct_change decimal(6,1), product_count int, computed_at timestamp"
RETAILER_OFFERS = "product_id bigint, retailer string, retailer_sku string, match_method string, product_url string, price decimal(10,2), in_stock boolean, fetched_at timestamp"
SEARCH_INDEX = "sku string, name string, slug string, category string, brand string, current_price double, all_time_low double, image_url string, search string"
MANIFEST = "url string, hash string, lastmod string"
