"""Schemas of the tables: pages, observations, items, runs. Pages and observations may also have search_term: the term they were found by."""

PAGES = "run_id bigint, category_idx int, category string, page int, url string, html string, fetched_at timestamp"
OBSERVATIONS = "run_id bigint, seq bigint, item_id string, raw_json string, scraped_at timestamp, zip_code string, radius_miles int, category string"
ITEMS = "id bigint, item_id string, raw_json string, scraped_at timestamp, zip_code string, radius_miles int, category string, created_at timestamp, search_terms array<string>"
RUNS = "id bigint, started_at timestamp, completed_at timestamp, zip_code string, radius_miles int, test_mode boolean, items_found int, items_added int, items_updated int, errors int, status string"

#: Payload fields that reports and models read.
PAYLOAD = "lead string, bidAmount decimal(18,2), shippingOffered boolean, auction_ref string, auction_data struct<eventName:string,eventCity:string,eventState:string>"
#: Search radii that a run may use, in miles (fixed values).
RADII = (10, 25, 50, 100, 250, 500)
