"""Schemas of tables and documents. Reads state their schema; nothing is inferred."""

from __future__ import annotations

# Tables. A child row belongs to one item, and no item has two in a table.
RAW_ITEMS = "id long, url string, title string, rss_summary string, published_date timestamp_ntz, feed_source string, date_found timestamp_ntz, status string, relevance_score double, relevance_flags string"
ARTICLE_CONTENT = "id long, item_id long, html string, clean_text string, scraped_at timestamp_ntz, scrape_success boolean, error_message string"
AI_EXTRACTIONS = (
    "id long, item_id long, company string, company_description string, deal_type string, deal_amount string, investors string, transaction_type string, capital_sources string, sectors string, "
    "strategic_significance string, market_implications string, capital_type string, location string, sector string, project_type string, ai_summary string, confidence_score double, "
    "extracted_at timestamp_ntz, model_used string, summary_complete boolean"
)
MASTER_LIST = (
    "id long, item_id long, company string, investors string, investment_amount string, deal_type string, capital_type string, project_type string, sector string, transaction_type string, "
    "capital_sources string, sectors string, location string, summary string, human_notes string, curated_by string, curated_at timestamp_ntz, published boolean, published_at timestamp_ntz"
)
REJECTED_ITEMS = "id long, item_id long, rejected_at timestamp_ntz, rejection_reason string"
TABLES = {"raw_items": RAW_ITEMS, "article_content": ARTICLE_CONTENT, "ai_extractions": AI_EXTRACTIONS, "master_list": MASTER_LIST, "rejected_items": REJECTED_ITEMS}

# Documents.
SERIES = "series_id string, ticker string, name string, description string, units string, type string, last_updated string, data_points long, latest_value double, latest_close double, data array<struct<date:string,value:double,open:double,high:double,low:double,close:double,volume:long>>"
RECESSIONS = "description string, source string, recessions array<struct<start:string,end:string,label:string>>"
MANIFEST = "last_updated string, series_count long, instruments_count long, series map<string,long>, instruments map<string,long>"
CONFIG = "rss_feeds array<struct<name:string,url:string,enabled:boolean>>, keywords struct<high_priority:array<string>,exclude:array<string>>, scraping struct<timeout_seconds:long,user_agent:string>"
FEED_ENTRY = "title string, link string, summary string, published string"
FEED_ITEM = "title string, link array<struct<_VALUE:string,_href:string,_rel:string>>, description string, summary string, pubDate string, published string, updated string"
UPDATE = "message struct<text:string,caption:string,chat:struct<id:long>,from:struct<id:long,username:string>,entities:array<struct<type:string,offset:int,length:int>>>"
