"""Word sets and maps of the feedback domain."""

from __future__ import annotations

# ---- Fixed values: results depend on exactly these words, so they are stated as they are.

#: Terms of the product that are aspects wherever they occur as a word.
DOMAIN_TERMS = (
    "ui", "ux", "app", "bug", "ads", "api", "otp", "pin", "login", "signup", "logout", "password", "account", "profile", "notification",
    "notifications", "update", "updates", "crash", "crashes", "battery", "storage", "memory", "speed", "performance", "loading", "camera", "audio",
    "video", "screen", "button", "menu", "settings", "search", "filter", "feed", "chat", "message", "call", "payment", "subscription", "premium",
    "customer service", "support", "refund",
)

#: Chunks that name no aspect.
EMPTY_ASPECTS = (
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "this", "that",
    "these", "those", "everything", "something", "anything", "nothing", "someone", "anyone", "everyone", "nobody", "somebody", "whoever", "whatever",
    "time", "way", "lot", "bit", "all", "one", "two", "more", "people", "money", "a lot", "english", "reason", "stuff", "thing", "things", "issue",
    "issues", "problem", "problems", "experience", "feature", "features",
)

#: Surface form to canonical aspect, at extraction.
CANONICAL_ASPECTS = {
    "this app": "app",
    "the app": "app",
    "your app": "app",
    "my app": "app",
    "an app": "app",
    "this application": "app",
    "the application": "app",
    "videos": "video",
    "messages": "message",
    "updates": "update",
    "ads": "ad",
    "crashes": "crash",
    "bugs": "bug",
    "reviews": "review",
    "features": "feature",
    "accounts": "account",
    "payments": "payment",
    "notifications": "notification",
    "subscriptions": "subscription",
}

#: Surface form to canonical aspect when issues are ranked; None drops the mention.
RANKING_ASPECTS = {
    "the search results": "search",
    "the search": "search",
    "search results": "search",
    "searches": "search",
    "the new ui": "ui",
    "new ui": "ui",
    "this update": "update",
    "the latest update": "update",
    "latest update": "update",
    "no driver": "driver availability",
    "worst experience": "user experience",
    "the keyboard": "keyboard",
    "the app": None,
    "this app": None,
    "the platform": None,
    "the day": None,
    "worst app": None,
    "1 star": None,
    "years": None,
}

#: An aspect with one of these anywhere in it is no product feature.
NOISE_SUBSTRINGS = (
    "yogesh", "rawat", "lockup", "biased", "unfair", "this point", "the platform", "everything", "something", "nothing", "anything", "a lot", "a bit",
    "the way", "this app", "star", "stars", "rating", "review", "reviews", "the day", "the week", "the month", "the year", "yesterday", "today",
    "tonight",
)

#: Aspects that are a product's own name.
BRANDS = (
    "amazon", "netflix", "spotify", "instagram", "whatsapp", "youtube", "uber", "twitter", "duolingo", "chatgpt", "teams",
)

#: Brand words that carry no topic in text vectors.
VECTOR_BRANDS = (
    "spotify", "whatsapp", "instagram", "netflix", "amazon", "duolingo", "uber", "youtube", "teams", "twitter", "chatgpt", "google", "apple",
    "microsoft", "meta",
)

GENERIC_WORDS = (
    "good", "bad", "ok", "okay", "great", "nice", "love", "hate", "best", "worst", "fine", "awesome", "terrible", "poor", "excellent", "amazing",
    "horrible", "perfect", "trash", "rubbish", "garbage", "wow", "yes", "no", "meh", "cool", "lol", "hmm",
)

QUESTION_STOP_WORDS = (
    "the", "a", "an", "is", "are", "has", "have", "what", "which", "app", "most", "more", "about", "with", "for", "how", "many", "any", "of", "in",
    "on", "at", "to", "and", "or", "do", "does",
)

POSSESSIVES = ("my", "your", "his", "her", "its", "our", "their")

# ---- Our own values.

#: (token, valence, subjectivity): a small lexicon of our own for the built-in sentiment scorer.
SENTIMENT = (
    ("amazing", 2.8, 0.9), ("awful", -2.8, 1.0), ("awesome", 3.1, 1.0), ("bad", -2.5, 0.7), ("best", 3.2, 0.3), ("broken", -2.0, 0.4), ("crash", -1.9, 0.2),
    ("easy", 1.9, 0.8), ("excellent", 2.7, 1.0), ("fast", 1.2, 0.6), ("good", 1.9, 0.6), ("great", 3.1, 0.8), ("hate", -2.7, 0.9), ("horrible", -2.5, 1.0),
    ("love", 3.2, 0.6), ("nice", 1.8, 1.0), ("perfect", 2.7, 1.0), ("poor", -2.1, 0.6), ("slow", -1.3, 0.4), ("terrible", -2.1, 1.0), ("useless", -1.8, 0.5), ("worst", -3.1, 1.0),
)

#: Common words of several languages that carry no topic in text vectors (our own short list).
TOPIC_STOP_WORDS = (
    "the", "and", "for", "are", "was", "were", "has", "have", "had", "not", "but", "you", "your", "with", "this", "that", "they", "from", "its",
    "all", "can", "will", "would", "there", "their", "what", "which", "when", "who", "how", "der", "die", "das", "und", "ist", "nicht", "ein", "eine",
    "mit", "von", "les", "des", "une", "est", "pas", "que", "pour", "los", "las", "una", "por", "con", "del",
)
