"""Fixed values.

Word lists, patterns and constants that decide results, so they have to equal the values the
listings data was curated with. They are configuration, not logic.
"""

# Whitespace characters removed at both ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Display window and limits.
WINDOW_DAYS = 30
MAX_TAGS = 3
MIN_SEARCH_TERM = 2
MIN_ACT_LENGTH = 4
MIN_VENUE_KEY = 4
SPOTLIGHT_MIN_QUALITY = 2
SPOTLIGHT_MAX = 4
MAX_NAME_LENGTH = 100
MAX_COMMENT_LENGTH = 2000
MAX_EMAIL_LENGTH = 254
MAX_PAGES_TOTAL = 28
MAX_PAGES_PER_SEED = 12
MAX_CRAWL_DEPTH = 2
MAX_SEEDS = 5
MIN_PAGE_TEXT = 4000
PAGE_TEXT_CHARS = 38_000
HTML_CHARS = 600_000
IMAGE_HTML_CHARS = 900_000
ALT_CHARS = 140
MIN_IMAGE_SIDE = 80
STRUCTURED_ITEMS = 100

# Score weights.
EXPLORATION_FLOOR = 0.15
DECAY_PER_WEEK = 0.85

UNKNOWN_HOST = "(unknown host)"
BLANK_LABEL = "—"
UNTITLED = "—"

# Characters cut from the end of links found in text.
LINK_JUNK = ").,]}\"'"
RESULT_LINK_JUNK = ").,]}\"'>"

STOP_WORDS = (
    "the", "and", "for", "with", "from", "into", "this", "that", "your", "live", "music", "show", "shows", "tour",
    "tickets", "ticket", "event", "events", "gig", "gigs", "concert", "concerts", "presents", "presented", "night",
    "feat", "featuring", "support", "supports", "brisbane", "queensland", "australia", "gold", "coast", "city",
)

DECORATION_TOKENS = (
    "logo", "favicon", "sprite", "icon", "spinner", "placeholder", "tracking", "pixel", "advert", "banner", "header-",
    "footer-", "sidebar", "promo", "social", "share-", "arrow", "navbar",
)
AD_PATTERN = r"(?i)(?:^|[/_\-])ads?(?:[/_\-.]|$)"
FILE_EXTENSION_PATTERN = r"(?i)\.[a-z0-9]{1,5}$"
BINARY_PATTERN = r"(?i)\.(pdf|zip|jpg|jpeg|png|gif|webp|svg|mp4|mp3|wav|m4a|doc|docx)(\?|$)"
PAGING_PATTERN = r"(?:[?&](?:page|paged|pg|p)=\d+|/page/\d+|/p/\d+)"
LINK_LINE_PATTERN = r"(?im)^link:\s*(https?://\S+)"
#: an empty title or snippet ends with its line, so it does not take in the next block
RESULT_BLOCK_PATTERN = r"(?is)title:[^\S\n]*(.*?)\nsnippet:[^\S\n]*(.*?)\nlink:\s*(https?://\S+)"
NUMBERED_LINE_PATTERN = r"(?m)^\s*\d+[\.)]\s*(.+)$"
FENCE_PATTERN = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
BARE_JSON_PATTERN = r"(\{[\s\S]*\}|\[[\s\S]*\])"
EMAIL_PATTERN = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$"
)
TRAILING_BRACKETS_PATTERN = r"(?:[\[(][^\[\]()]*[\])]\s*)+$"
COVER_PATTERN = (
    r"(?i)(tribute\s+to|tribute\s+band|tribute\s+show|covers?\s+(night|show|act|band)|cover\s+songs?|"
    r"celebration\s+of\s+(the\s+)?music\s+of)"
)
GENERIC_ACT_PATTERN = (
    r"(?i)^(live\s+music|weekly\s+sessions?|acoustic\s+sessions?|open\s+mic(\s+night)?|jam\s+session|karaoke|"
    r"dj\s+set|house\s+dj|resident\s+dj|sunday\s+sessions?|friday\s+sessions?|entertainment|variety\s+show)$"
)
NON_BAND_TAGS = ("tribute", "open mic", "dj set")

# Whole path segments of pages that list no events.
NON_EVENT_SEGMENTS = (
    "cart", "carts", "basket", "baskets", "checkout", "checkouts", "order", "orders", "wishlist", "wishlists",
    "gift-card", "gift-cards", "giftcard", "giftcards", "voucher", "vouchers",
    "account", "accounts", "my-account", "myaccount", "login", "log-in", "signin", "sign-in", "signup", "sign-up",
    "register", "registration", "logout", "log-out", "password", "reset-password", "profile",
    "terms", "terms-and-conditions", "terms-of-service", "tos", "legal", "privacy", "privacy-policy", "cookie",
    "cookies", "disclaimer", "refund", "refunds", "returns", "shipping", "delivery", "postage", "faq", "faqs", "help",
    "support", "sitemap", "search", "404",
    "careers", "career", "jobs", "vacancies", "press", "media-kit", "donate", "donation", "donations",
    "win", "competition", "competitions", "giveaway", "giveaways", "sweepstake", "sweepstakes",
)
FOOD_WORDS = (
    "food", "foods", "menu", "menus", "dining", "drinks", "drink", "catering", "brunch", "degustation", "buffet", "eats",
)
EVENT_SIGNALS = (
    "/e/", "event", "ticket", "gig", "/show", "shows", "concert", "live-music", "livemusic", "whats-on", "whatson",
    "what-s-on", "gig-guide", "gigguide", "calendar", "eventbrite", "bandsintown", "songkick", "ticketmaster",
    "moshtix", "oztix", "allevents.", "meetup.",
)
LOW_VALUE_FRAGMENTS = (
    "/about", "/contact", "/gallery", "/photos", "/blog", "/news", "/team", "/staff", "/history", "/our-story",
    "/location", "/find-us", "/directions", "/parking", "/hire", "/venue-hire", "/function", "/functions", "/wedding",
    "/weddings", "/merch", "/shop", "/store", "/product", "/products", "/membership", "/subscribe", "/newsletter",
    "/accommodation", "/rooms", "/stay",
)
SOCIAL_EVENT_FRAGMENT = "facebook.com/events/"
EVENT_LINK_FRAGMENTS = (
    "/e/", "event", "ticket", "/gig", "/show", "concert", "live-music", "livemusic", "eventbrite", "bandsintown",
    "songkick", "ticketmaster", "moshtix", "oztix",
)
LISTING_LINK_FRAGMENTS = ("allevents.", "meetup.", "bandsintown", "whats-on", "whatson", "calendar", "concerts")
SEED_KEYWORDS = (
    "event", "ticket", "whats-on", "whatson", "gig", "show", "calendar", "concert", "live-music", "bookings",
)
AGGREGATOR_FRAGMENTS = (
    "facebook.", "instagram.", "twitter.", "x.com", "youtube.", "youtu.be", "spotify.", "tiktok.", "eventbrite.",
    "ticketek.", "ticketmaster.", "moshtix.", "oztix.", "bandsintown.", "songkick.", "eventfinda.", "allevents.",
    "meetup.", "tripadvisor.", "wikipedia.", "google.", "bing.", "reddit.", "linktr.ee", "linktree.", "yelp.",
    "timeout.",
)
LISTING_HREF_HINTS = (
    "whats-on", "whatson", "what-s-on", "/gigs", "/gig-guide", "gig-guide", "/events", "/event", "/shows", "/show",
    "/calendar", "/programme", "/program", "/lineup", "/line-up", "/tour", "/tickets", "/live-music", "upcoming",
)
LISTING_PHRASES = (
    "what's on", "whats on", "gig guide", "gigs", "events", "shows", "calendar", "programme", "program", "line up",
    "lineup", "upcoming", "tickets", "live music",
)

# Image content types.
CONTENT_TYPE_EXTENSIONS = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif",
    "image/avif": ".avif",
}
EXTENSION_CONTENT_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif",
    ".avif": "image/avif",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# Step error classes, first match wins: (class, fragments of the lower-cased text).
ERROR_CLASSES = (
    ("rate_limit", ("rate limit", "rate_limit", "too many requests", "429")),
    ("quota", ("insufficient_quota", "billing", "exceeded your current quota")),
    ("authentication", ("401", "unauthorized", "invalid api key", "authentication", "permission denied")),
    ("timeout", ("timeout", "timed out", "connection refused", "connect error")),
    ("unavailable", ("503", "502", "service unavailable")),
    ("bad_json", ("could not extract valid json",)),
)

# Counter names of a merge and the labels they carry in a report.
CHANGE_LABELS = {
    "added": "added (new rows)",
    "skipped": "skipped as duplicate",
    "removed_past": "past events pruned",
    "removed_exclusion": "removed by event exclusions",
    "removed_dedupe": "removed by llm semantic dedupe",
    "removed_orphan_venues": "orphan venues removed",
    "total_after": "total rows after merge",
}
