"""Every constant that decides what a query returns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    title_repeat: int = 2
    coordination: float = 1.6
    title: float = 1.2
    host: float = 2.2
    subdomain_host: float = 0.8
    phrase: float = 0.8
    body_phrase: float = 0.4
    absent_term: float = 0.35
    snippet_words: int = 34


@dataclass(frozen=True)
class Deep:
    expansion_terms: int = 6
    expansion_hits: int = 6
    score_blend: float = 1.5
    rrf_k: int = 60
    df_ceiling: float = 0.35
    max_sub_queries: int = 3


@dataclass(frozen=True)
class Ranking:
    geo_boost: float = 1.8
    lang_boost: float = 2.4
    vertical_boost: float = 1.9
    vertical_penalty: float = 3.0
    curated: float = 1.2
    discovered: float = 0.3
    authority: float = 1.8
    damping: float = 0.85
    iterations: int = 25
    curated_floor: float = 0.55
    semantic: float = 0.6
    semantic_candidates: int = 400


@dataclass(frozen=True)
class Quality:
    min_doc_chars: int = 80
    max_shingle_dup: float = 0.35
    min_words: int = 120
    max_link_density: float = 0.45
    max_blocked_ratio: float = 0.15


@dataclass(frozen=True)
class Crawl:
    max_text_chars: int = 20_000
    max_links: int = 200
    max_per_host: int = 6
    min_text_chars: int = 100
    min_words: int = 30
    max_bytes: int = 2_000_000


@dataclass(frozen=True)
class Api:
    per_minute: int = 60
    window_ms: int = 60_000
    max_limit: int = 50
    max_offset: int = 10_000
    ui_default: int = 10
    ui_max: int = 25


@dataclass(frozen=True)
class Storage:
    budget_mb: int = 500
    per_host: int = 2
    fill_minutes: int = 25
    sitemap_per_host: int = 400
    discover_rounds: int = 6
    sitemaps: int = 8
    sitemap_urls: int = 5000
    max_record_bytes: int = 2_000_000


@dataclass(frozen=True)
class Config:
    bm25: Bm25 = field(default_factory=Bm25)
    deep: Deep = field(default_factory=Deep)
    ranking: Ranking = field(default_factory=Ranking)
    quality: Quality = field(default_factory=Quality)
    crawl: Crawl = field(default_factory=Crawl)
    api: Api = field(default_factory=Api)
    storage: Storage = field(default_factory=Storage)


CONFIG = Config()

# Word lists, host lists and tables that decide results. ---------

STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these "
    "they this to was will with from have has been were you your "
    "de la le les des du der die das und ein eine für mit che per con una uno del della più el los las por"
).split()

QUESTION_NOISE = (
    "how why what who whom whose when where which please can could would should does do did is are was were "
    "tell explain give show need want help me you i us about work works use used using make made mean means happen"
).split()

#: In this order; the first that matches wins, else ``lookup``.
INTENTS = (
    ("how", r"(?i)^\s*how\b"),
    ("why", r"(?i)^\s*why\b"),
    ("what", r"(?i)^\s*what\b"),
    ("who", r"(?i)^\s*who\b"),
    ("when", r"(?i)^\s*when\b"),
    ("where", r"(?i)^\s*where\b"),
    ("best", r"(?i)\b(best|top|vs|versus|compare|comparison|alternative|alternatives|recommend)\b"),
)

BLOCKED_HOST_PREFIXES = "account accounts investor investors skills maintainers locate careers jobs support help status billing checkout my dashboard".split()

BLOCKED_HOSTS = (
    "x.com twitter.com facebook.com instagram.com linkedin.com tiktok.com pinterest.com discord.com reddit.com "
    "accounts.google.com doubleclick.net googlesyndication.com adservice.google.com aboutads.info adsrvr.org amazon-adsystem.com"
).split()

BLOCKED_PATH_PATTERNS = "/subscribe /login /signin /sign-in /register /account /privacy /terms /cookie /user-agreement /aboutads /newsletter /advertise /careers /press".split()

BLOCKED_PATH_SEGMENTS = (
    "user users u profile profiles author authors members tag tags category categories feed rss sitemap "
    "from item items comments thread submit drafts servicelogin accounts intl ads adwords preferences "
    "search signin signup store shop cart checkout investors investor apps app download downloads imghp"
).split()

#: Script name -> ranges of a character class; all but Latin are refused.
SCRIPTS = {
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "hebrew": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}",
    "cyrillic": r"\x{0400}-\x{04FF}\x{0500}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
    "cjk": r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}",
    "devanagari": r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "bengali": r"\x{0980}-\x{09FF}",
    "tamil": r"\x{0B80}-\x{0BFF}",
    "telugu": r"\x{0C00}-\x{0C7F}",
    "kannada": r"\x{0C80}-\x{0CFF}",
    "malayalam": r"\x{0D00}-\x{0D7F}",
    "gujarati": r"\x{0A80}-\x{0AFF}",
    "punjabi": r"\x{0A00}-\x{0A7F}",
    "oriya": r"\x{0B00}-\x{0B7F}",
    "sinhala": r"\x{0D80}-\x{0DFF}",
    "myanmar": r"\x{1000}-\x{109F}\x{AA60}-\x{AA7F}",
    "khmer": r"\x{1780}-\x{17FF}",
    "lao": r"\x{0E80}-\x{0EFF}",
    "tibetan": r"\x{0F00}-\x{0FFF}",
    "georgian": r"\x{10A0}-\x{10FF}\x{2D00}-\x{2D2F}",
    "armenian": r"\x{0530}-\x{058F}",
    "ethiopic": r"\x{1200}-\x{137F}",
}
LATIN = r"A-Za-z\x{00C0}-\x{024F}"

LATIN_LANGS = (
    "en de fr es it pt nl sv no nb nn da fi is et lv lt pl cs sk sl hr hu ro tr az ca eu gl id ms vi sw tl so af sq mt cy ga la eo ht jv"
).split()

SCRIPT_OF_LANG = {
    "arabic": "ar fa ur he iw ps sd ug yi".split(),
    "cyrillic": "ru uk be bg sr mk mn kk ky".split(),
    "cjk": "zh ja ko yue cmn".split(),
    "devanagari": "hi mr ne sa bn pa".split(),
    "thai": "th lo my km".split(),
    "greek": "el hy ka".split(),
}

COUNTRY_TLDS = {
    "US": ["us", "com"], "GB": ["uk", "co.uk"], "CA": ["ca"], "AU": ["au"], "NZ": ["nz"],
    "DE": ["de"], "AT": ["at"], "CH": ["ch"], "FR": ["fr"], "BE": ["be"], "NL": ["nl"],
    "IT": ["it"], "ES": ["es"], "PT": ["pt"], "IE": ["ie"], "SE": ["se"], "NO": ["no"],
    "DK": ["dk"], "FI": ["fi"], "PL": ["pl"], "CZ": ["cz"], "GR": ["gr"], "TR": ["tr"],
    "BR": ["br"], "MX": ["mx"], "AR": ["ar"], "CL": ["cl"], "CO": ["co"],
    "IN": ["in"], "SG": ["sg"], "MY": ["my"], "ID": ["id"], "PH": ["ph"], "VN": ["vn"],
    "JP": ["jp"], "KR": ["kr"], "CN": ["cn"], "TW": ["tw"], "HK": ["hk"],
    "ZA": ["za"], "NG": ["ng"], "KE": ["ke"], "GH": ["gh"], "EG": ["eg"], "MA": ["ma"],
    "TN": ["tn"], "DZ": ["dz"], "SA": ["sa"], "AE": ["ae"], "QA": ["qa"], "IL": ["il"],
}

COUNTRY_LANGS = {
    "IT": ["it", "en"], "DE": ["de", "en"], "AT": ["de", "en"], "CH": ["de", "fr", "it", "en"],
    "FR": ["fr", "en"], "BE": ["fr", "nl", "en"], "NL": ["nl", "en"], "ES": ["es", "en"],
    "MX": ["es", "en"], "AR": ["es", "en"], "CL": ["es", "en"], "CO": ["es", "en"],
    "PT": ["pt", "en"], "BR": ["pt", "en"], "PL": ["pl", "en"], "CZ": ["cs", "en"],
    "SE": ["sv", "en"], "NO": ["no", "en"], "DK": ["da", "en"], "FI": ["fi", "en"],
    "GR": ["el", "en"], "TR": ["tr", "en"], "JP": ["ja", "en"], "KR": ["ko", "en"],
    "CN": ["zh", "en"], "IN": ["en", "hi"], "US": ["en"], "GB": ["en", "cy"],
    "CA": ["en", "fr"], "AU": ["en"], "NZ": ["en"], "IE": ["en", "ga"], "ZA": ["en"],
    "NG": ["en"], "KE": ["en", "sw"], "EG": ["ar", "en"], "SA": ["ar", "en"],
    "AE": ["ar", "en"], "IL": ["he", "en"], "QA": ["ar", "en"],
}

SHORT_HOSTS = "tiktok.com instagram.com snapchat.com reels.facebook.com".split()

#: Pages of well-known sites, whose homepages may be kept as short cards.
CURATED_URLS = """
https://www.google.com https://www.bing.com https://en.wikipedia.org/wiki/Main_Page https://github.com https://stackoverflow.com
https://news.ycombinator.com https://developer.mozilla.org https://stackoverflow.blog https://blog.cloudflare.com https://netflixtechblog.com
https://aws.amazon.com/blogs/ https://kubernetes.io/blog/ https://blog.rust-lang.org https://blog.python.org https://nodejs.org/en/blog
https://react.dev/blog https://www.apple.com/newsroom/ https://blogs.microsoft.com/blog/ https://engineering.fb.com https://openai.com/news/
https://www.bbc.com/news https://www.reuters.com https://apnews.com https://www.npr.org https://www.theguardian.com/international
https://www.aljazeera.com https://edition.cnn.com https://www.nbcnews.com https://www.cbsnews.com https://abcnews.go.com https://news.sky.com
https://www.france24.com/en/ https://www.dw.com/en/top-stories/s-9097 https://www3.nhk.or.jp/nhnews/en/ https://www.cbc.ca/news
https://arstechnica.com https://www.theverge.com https://techcrunch.com https://www.wired.com https://www.engadget.com https://www.vice.com/en
https://www.politico.com https://www.axios.com https://www.theatlantic.com https://www.nasa.gov https://www.esa.int https://www.nature.com/news
https://www.science.org https://phys.org https://www.quantamagazine.org https://www.smithsonianmag.com https://www.nih.gov
https://www.britannica.com https://www.merriam-webster.com https://www.wolframalpha.com https://www.khanacademy.org https://www.coursera.org
https://ocw.mit.edu https://www.gutenberg.org https://archive.org https://www.loc.gov https://www.ansa.it https://www.corriere.it
https://www.repubblica.it https://www.rainews.it https://www.treccani.it/enciclopedia/ https://www.instagram.com https://www.tiktok.com/about
https://x.com https://www.facebook.com https://www.reddit.com https://www.pinterest.com https://www.linkedin.com https://www.threads.net
https://mastodon.social https://bsky.app https://www.tumblr.com https://www.snapchat.com https://discord.com https://www.twitch.tv
https://vimeo.com https://www.dailymotion.com https://open.spotify.com https://soundcloud.com https://bandcamp.com https://www.mixcloud.com
https://www.imdb.com https://letterboxd.com https://dev.to https://hashnode.com https://www.producthunt.com https://lobste.rs
https://sourceforge.net https://gitlab.com https://bitbucket.org https://codepen.io https://www.npmjs.com https://pypi.org
https://hub.docker.com https://www.kaggle.com https://replit.com https://caniuse.com https://www.edx.org https://www.freecodecamp.org
https://www.smashingmagazine.com https://css-tricks.com https://developer.chrome.com/docs https://owasp.org https://www.openstreetmap.org
https://it.wikipedia.org/wiki/Italia https://www.tripadvisor.com https://www.airbnb.com https://www.booking.com https://www.zillow.com
https://www.allrecipes.com https://www.yelp.com https://www.ebay.com https://www.spiegel.de https://www.lemonde.fr https://elpais.com
https://www.rtlnieuws.nl https://www.aftonbladet.se https://www.nrk.no https://yle.fi https://www3.nhk.or.jp
""".split()

#: Further starting points; their hosts are trusted, but not curated.
SEED_URLS = """
https://text.npr.org https://www.thehindu.com/news/international/ https://www.scmp.com/news https://github.com/explore
https://stackoverflow.com/questions https://developer.mozilla.org/en-US/docs/Web https://html.spec.whatwg.org/multipage/
https://www.w3.org/TR/ https://webkit.org https://developer.chrome.com/docs/devtools https://www.rfc-editor.org
https://arxiv.org/list/cs.SE/recent https://www.youtube.com https://www.python.org https://doc.rust-lang.org/book/ https://go.dev/doc/
https://it.wikipedia.org/wiki/Cucina_italiana https://it.wikipedia.org/wiki/Campionato_di_Italia https://www.ansa.it/scienza/index.html
https://www.corriere.it/cronache/index.shtml https://en.wikipedia.org/wiki/Search_engine https://www.youtube.com/watch?v=aqz-KE-bpKQ
https://www.youtube.com/watch?v=dQw4w9WgXcQ https://www.youtube.com/watch?v=jNQXAC9IVRw https://vimeo.com/76979871
https://commons.wikimedia.org/wiki/File:Earth_from_SLR-4.jpg https://commons.wikimedia.org/wiki/File:The_Earth_seen_from_Apollo_17.jpg
https://www.nasa.gov/image-article/pale-blue-dot/ https://example.com
""".split()


def host_of(url: str) -> str:
    host = url.split("://", 1)[-1].split("/", 1)[0].lower()
    return host.removeprefix("www.")


CURATED_HOSTS = sorted({host_of(u) for u in CURATED_URLS})
TRUSTED_HOSTS = sorted({*CURATED_HOSTS, *map(host_of, SEED_URLS)})
