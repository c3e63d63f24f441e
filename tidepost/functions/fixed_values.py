"""Word lists, labels, thresholds that results depend on.

Everything here is data. Each list is a default for a parameter of the
operator that uses it, so a caller can swap in another language.
"""

# Sentiment lexicon, positive terms.
POSITIVE_TERMS = (
    "bagus", "baik", "hebat", "mantap", "keren", "luar biasa", "sukses",
    "senang", "gembira", "bahagia", "puas", "berhasil", "menang", "top",
    "aman", "lancar", "setuju", "dukung", "bangga", "terima kasih",
)

# Sentiment lexicon, negative terms.
NEGATIVE_TERMS = (
    "buruk", "jelek", "parah", "gagal", "kecewa", "marah", "sedih",
    "bohong", "korupsi", "curang", "hoax", "palsu", "rugi", "bahaya",
    "tolak", "protes", "demo", "rusuh", "benci", "malu",
)

# Stopwords of the topic operators.
TOPIC_STOPWORDS = (
    "dan", "yang", "di", "ke", "dari", "ini", "itu", "untuk", "dengan",
    "pada", "adalah", "atau", "juga", "akan", "ada", "saya", "kamu",
    "kami", "mereka", "dia", "anda", "nya", "ya", "tidak", "bisa",
    "sudah", "belum", "harus", "dalam", "oleh", "sebagai", "seperti",
    "jika", "maka", "agar", "tapi", "karena", "sehingga", "namun",
    "lagi", "masih", "lebih", "sangat", "sekali", "paling", "saat",
    "setelah", "sebelum", "antara", "hingga", "sampai", "tanpa",
    "bukan", "hanya", "saja", "cuma", "pun", "kah", "lah", "dong",
)

# Stopwords of the context-word discovery.
CONTEXT_STOPWORDS = (
    "dan", "yang", "di", "ke", "dari", "ini", "itu", "untuk", "pada", "adalah",
    "sebagai", "dengan", "karena", "yg", "gak", "bisa", "ada", "lagi", "tapi",
    "kalo", "ya", "mau", "udah", "sdh", "tdk", "aja", "saja", "juga", "akan",
    "bukan", "sudah", "atau", "saat", "oleh", "dalam", "tidak", "tak", "dgn",
    "the", "and", "to", "of", "in", "is", "for", "on", "with", "at", "by",
    "http", "https", "com", "co", "id", "www", "rt",
)

# Spellings a sentiment model may use for its labels.
POSITIVE_LABELS = ("positive", "positif", "pos", "label_1")
NEGATIVE_LABELS = ("negative", "negatif", "neg", "label_0")

# Account names that are never kept.
BLOCKED_ACCOUNTS = ("grok",)

# Prefixes put before a short keyword.
KEYWORD_PREFIXES = ("berita", "update")

# Markers of a blocked or consent page, matched in any case.
BLOCK_MARKERS = (
    "Setuju", "Agree", "Before you continue", "unusual traffic", "robot",
    "consent", "form action", "recaptcha", 'class="yKMVIe"',
)

# Text and markup probes of the page report, matched in any case
# only where the second member is True.
PAGE_PROBES = (
    ("Google", False), ("captcha", True), ('class="g"', False),
    ("<html", True), ("<input", False),
)

# Selectors of result containers on a saved search page.
RESULT_CONTAINERS = ("div.g", "div.tF2Cxc", "div.v7W49e", "div[data-header-feature]")

# Selectors inside a saved page of post cards.
POST_CARD = "article[data-testid='tweet']"
POST_TEXT = "div[data-testid='tweetText']"
POST_USER = "div[data-testid='User-Name'] a"
POST_BUTTONS = (
    "button[data-testid='reply']",
    "button[data-testid='retweet']",
    "button[data-testid='like']",
)
POST_BUTTON_GROUP = "div[role='group']"
PROFILE_BASE = "https://x.com/"
EMPTY_RESULT_TEXT = "No results for"

# Request-rate levels per minute.
RATE_LIMIT = 30
RATE_WARNING = 20
RATE_DANGER = 25
