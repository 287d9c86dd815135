"""Fixed configuration values of the article collection.

Everything here is data: which feeds are collected, how many entries each
contributes, and the thresholds of the daily run. The values must stay equal to
those of the system whose results this package reproduces.
"""

# News feeds, name -> address.
NEWS_FEEDS = {
    "bbc_world": "http://feeds.bbci.co.uk/news/world/rss.xml",
    "guardian_world": "https://www.theguardian.com/world/rss",
    "al_jazeera": "https://www.aljazeera.com/xml/rss/all.xml",
    "techcrunch": "https://techcrunch.com/feed/",
    "wired": "https://www.wired.com/feed/rss",
    "the_verge": "https://www.theverge.com/rss/index.xml",
    "ars_technica": "http://feeds.arstechnica.com/arstechnica/index",
    "bloomberg": "https://feeds.bloomberg.com/markets/news.rss",
    "financial_times": "https://www.ft.com/rss/home",
    "forbes": "https://www.forbes.com/real-time/feed2/",
    "nature_news": "https://www.nature.com/nature.rss",
    "scientific_american": "http://rss.sciam.com/ScientificAmerican-Global",
    "new_scientist": "https://www.newscientist.com/feed/home/",
    "who_news": "https://www.who.int/rss-feeds/news-english.xml",
    "medium_trending": "https://medium.com/feed/tag/trending",
    "medium_culture": "https://medium.com/feed/tag/culture",
    "npr_news": "https://feeds.npr.org/1001/rss.xml",
    "cnn_international": "http://rss.cnn.com/rss/edition.rss",
    "dw_english": "https://rss.dw.com/rdf/rss-en-all",
    "france24": "https://www.france24.com/en/rss",
    "rt_news": "https://www.rt.com/rss/news/",
    "china_daily": "http://www.chinadaily.com.cn/rss/world_rss.xml",
    "reddit_worldnews": "https://www.reddit.com/r/worldnews/.rss",
    "hackernews": "https://hnrss.org/frontpage",
}

# Publication feeds, in order.
PUBLICATION_FEEDS = [
    "https://towardsdatascience.com/feed",
    "https://medium.com/feed/hackernoon",
    "https://medium.com/feed/the-startup",
    "https://medium.com/feed/better-programming",
    "https://medium.com/feed/better-humans",
    "https://medium.com/feed/the-mission",
    "https://medium.com/feed/personal-growth",
    "https://medium.com/feed/thrive-global",
    "https://uxdesign.cc/feed",
    "https://medium.com/feed/swlh",
    "https://medium.com/feed/change-becomes-you",
    "https://medium.com/feed/global-perspectives",
]

# API categories, name -> (max_limit, priority).
API_CATEGORIES = {
    "top_stories": (15, 1),
    "trending": (12, 2),
    "business": (8, 3),
    "technology": (8, 4),
    "world": (8, 5),
    "sports": (6, 6),
    "entertainment": (6, 7),
    "science": (5, 8),
    "automobile": (4, 9),
    "politics": (6, 10),
}

# Domains whose pages are worth a look for image metadata.
TRUSTED_DOMAINS = [
    "bbc.com",
    "cnn.com",
    "reuters.com",
    "bloomberg.com",
    "techcrunch.com",
    "theverge.com",
    "wired.com",
    "forbes.com",
]

# Entries taken per source and overall.
NEWS_FEED_CAP = 3
PUBLICATION_FEED_CAP = 2
LISTING_CAP = 5
UNKNOWN_CATEGORY_CAP = 5
DIGEST_SIZE = 50

# Constant fields of two of the sources.
LISTING_URL = "https://medium.com/tag/trending"
LISTING_BASE = "https://medium.com"
LISTING_SOURCE = "medium.com"
LISTING_TAG = "trending"
API_SOURCE = "inshorts.com"

# Store upkeep and reports.
DAYS_PER_MONTH = 30
RETENTION_MONTHS = 2
RECENT_DAYS = 7
RECENT_LIMIT = 100
STATS_OLD_DAYS = 60
TOP_SOURCES = 10
PURGE_SAMPLE = 5
COVERAGE_GOAL_PERCENT = 95.0
PREVIEW_CHARS = 150
MAX_PAGE_URL_CHARS = 200

# Partitions of the addresses a store knows, for new versions of its index.
STORE_BUCKETS = 16
