"""Fixed values that results depend on: word lists, tables and patterns, in their natural order."""

# Suffixes of two labels under which names are registered.
MULTI_PART_SUFFIXES = """
co.uk org.uk ac.uk gov.uk me.uk net.uk sch.uk
com.au net.au org.au edu.au gov.au
co.nz net.nz org.nz
co.jp or.jp ne.jp ac.jp go.jp
com.br net.br org.br
co.in net.in org.in firm.in gen.in
com.cn net.cn org.cn gov.cn
co.za org.za net.za
com.sg com.hk com.tw com.mx com.ar com.tr com.pl
co.il co.kr com.es com.pt com.ua
""".split()

# Query parameters that only track; a key counts if it begins with one.
TRACKING_PREFIXES = r"(?i)^(utm_|fbclid|gclid|msclkid|mc_cid|mc_eid|ref|source|hsa_|_hs|igshid|yclid|dclid|wbraid|gbraid)"

# Domains that are never crawled.
BLOCKED_DOMAINS = """
linkedin.com crunchbase.com zoominfo.com apollo.io rocketreach.co
glassdoor.com indeed.com facebook.com instagram.com threads.net
twitter.com x.com tiktok.com pinterest.com reddit.com
google.com bing.com duckduckgo.com yandex.com baidu.com
youtube.com amazon.com wikipedia.org medium.com substack.com
github.com gitlab.com producthunt.com angel.co wellfound.com
""".split()

# Mail and hosting domains that are never a company's own.
NON_COMPANY_DOMAINS = """
gmail.com googlemail.com yahoo.com hotmail.com outlook.com live.com
aol.com icloud.com protonmail.com proton.me gmx.de gmx.net web.de
mail.ru yandex.ru qq.com 163.com
wordpress.com wixsite.com squarespace.com weebly.com blogspot.com
sites.google.com notion.site webflow.io github.io vercel.app netlify.app
""".split()

# Local parts that name a role rather than a person.
ROLE_LOCAL_PARTS = """
info kontakt contact hello hallo mail email office team
support help sales vertrieb press presse media jobs career
careers bewerbung admin service enquiries enquiry inquiries
welcome moin bonjour ciao hola post anfrage general
""".split()

# Patterns of addresses and numbers in running text.
EMAIL_SCAN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,24}(?![a-zA-Z])"
PHONE_SCAN = r"(?:\+|00)[\d][\d\s().\-]{7,20}\d"
EMAIL_SHAPE = r"(?i)^[^\s@]+@[^\s@]+\.[a-z]{2,}$"
EMAIL_JUNK = r"(?i)\.(png|jpe?g|gif|webp|svg|css|js|woff2?|ttf|ico|pdf)$"
EMAIL_PLACEHOLDER = r"(?i)^(example|test|your|name|user|email|someone|firstname|john\.?doe|max\.?mustermann|sentry|wixpress)@|@(example|sentry|test|domain|email|yourdomain|company)\."
ADDRESS_LINE = r"\b\d{4,5}\s+[A-ZÄÖÜ][a-zäöüß]+|\b[A-ZÄÖÜ][a-zäöüß]+(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse)\s+\d+"
FOUNDED = r"(?:founded|established|gegr[üu]ndet|seit|since|est\.)\s*(?:in\s*)?(19\d{2}|20[0-2]\d)"
FORM_WORDS = r"(?i)email|e-mail|message|nachricht|betreff|subject|anfrage"

# Kinds of pages by priority, with the patterns of their addresses and of their link texts.
LINK_KINDS = [
    ("imprint", 100, r"\/(impressum|imprint|mentions-legales|legal-notice|aviso-legal|note-legali|colofon)\b", r"\b(impressum|imprint|mentions l[ée]gales|legal notice|aviso legal|note legali)\b"),
    ("contact", 90, r"\/(contact|kontakt|contacto|contatti|contactez|neem-contact|kapcsolat|contacte)\b", r"\b(contact|kontakt|contacto|contatti|contactez[- ]nous|get in touch|schreib|reach us)\b"),
    ("about", 80, r"\/(about|about-us|ueber-uns|über-uns|unternehmen|company|a-propos|chi-siamo|quienes-somos|over-ons|om-oss)\b", r"\b(about|about us|[uü]ber uns|unternehmen|company|our story|[àa] propos|chi siamo|qui[ée]nes somos|over ons)\b"),
    ("team", 70, r"\/(team|people|leadership|management|founders|vorstand|mitarbeiter|equipo|equipe|squadra)\b", r"\b(team|our team|people|leadership|management|founders|gr[üu]nder|vorstand|equipo|[ée]quipe)\b"),
    ("careers", 40, r"\/(careers|jobs|karriere|stellenangebote|join-us|work-with-us|vacatures|empleo)\b", r"\b(careers|jobs|karriere|stellen|join us|work with us|we're hiring|wir stellen ein)\b"),
]

# Order of page kinds in a packed text, and characters a token is taken to have.
PACK_ORDER = ["imprint", "about", "home", "team", "careers", "contact", "other"]
CHARS_PER_TOKEN, PAGE_TOKENS, DOMAIN_TOKENS = 3.6, 3000, 7000

# Hosts of social platforms, for extraction and for validation.
SOCIAL_HOSTS = {"linkedin": ["linkedin.com"], "twitter": ["twitter.com", "x.com"], "github": ["github.com"], "facebook": ["facebook.com"]}
SOCIAL_HOSTS_VALID = SOCIAL_HOSTS | {"facebook": ["facebook.com", "fb.com"]}

# Words of headings, and lower-case particles of names.
HEADING_WORDS = "our|the|meet|join|team|leadership|management|board|founders?|advisors?|people|careers?|jobs?|contact|about|imprint|impressum|kontakt|ueber|über|unser|unsere"
NAME_PARTICLES = "van|von|de|der|den|di|da|del|la|le|bin|al"

# Legal forms that a company's name is compared without.
LEGAL_FORMS = r"gmbh|mbh|ag|ug|kg|ohg|se|e\.?v|inc|llc|ltd|limited|plc|corp|corporation|co|company|bv|nv|sarl|sas|sa|srl|spa|oy|ab|as|aps|kft|sp\s?z\s?o\s?o|pty|pte"

# Words too general to name an industry.
STOPWORDS = """
and the for with that this our their company companies
startup startups business businesses firm solution solutions
platform software service services technology technologies
""".split()

# Codes and own names of countries, by English name.
COUNTRY_ALIASES = {
    "germany": ["de", "deu", "ger", "deutschland"],
    "austria": ["at", "aut", "oesterreich", "österreich"],
    "switzerland": ["ch", "che", "schweiz", "suisse"],
    "united states": ["us", "usa", "u.s.", "u.s.a."],
    "united kingdom": ["uk", "gb", "gbr"],
    "netherlands": ["nl", "nld", "holland", "nederland"],
    "france": ["fr", "fra"],
    "spain": ["es", "esp", "espana", "españa"],
    "italy": ["it", "ita", "italia"],
    "sweden": ["se", "swe", "sverige"],
    "denmark": ["dk", "dnk", "danmark"],
    "finland": ["fi", "fin"],
    "norway": ["no", "nor"],
    "poland": ["pl", "pol", "polska"],
    "belgium": ["be", "bel"],
    "ireland": ["ie", "irl"],
    "portugal": ["pt", "prt"],
    "canada": ["ca", "can"],
    "australia": ["au", "aus"],
    "india": ["in", "ind"],
    "israel": ["il", "isr"],
}

# Score weights, and the credit of a requirement that nothing is known about.
WEIGHTS = {"industry": 22.0, "geography": 18.0, "size": 15.0, "funding": 15.0, "contactability": 20.0, "evidence": 10.0}
UNKNOWN = 0.45

# Signatures of bot challenges in headers and bodies, in the order they are tried.
CHALLENGE_HEADERS = [("cloudflare", "cf-mitigated", "(?i)challenge"), ("datadome", "x-datadome", "(?i)protected|challenge"), ("perimeterx", "x-px", ".")]
CHALLENGE_BODIES = [
    ("cloudflare", r"cf-browser-verification|cf_chl_opt|__cf_chl_|challenge-platform|cdn-cgi\/challenge-platform"),
    ("cloudflare", r"checking your browser before accessing|just a moment\.\.\.|enable javascript and cookies to continue"),
    ("cloudflare", r"attention required!\s*\|\s*cloudflare|error 1020|ray id:"),
    ("akamai", r"akamai\b.*(reference|bot manager)|_abck|ak_bmsc|reference\s*#\d+\.\w+\.\d+"),
    ("perimeterx", r"_px(?:aj|hd|Captcha)|perimeterx|px-captcha|please verify you are a human"),
    ("datadome", r"datadome|dd_cookie_test|geo\.captcha-delivery\.com"),
    ("imperva", r"incapsula incident id|_incapsula_|imperva|visid_incap"),
    ("sucuri", r"sucuri website firewall|cloudproxy"),
    ("generic", r"captcha-delivery|hcaptcha\.com\/captcha|g-recaptcha.{0,200}verify you are human|are you a robot\?"),
    ("generic", r"access denied.{0,200}(unusual traffic|automated|bot)|request unsuccessful\. incapsula"),
]
CHALLENGE_STATUS = [401, 403, 405, 406, 429, 503]
CONSENT_VENDORS = r"(?i)onetrust|optanon|ot-sdk-container|cookiebot|cookieconsent|cookie-consent-banner|usercentrics|uc-banner|klaro|cookieyes|termly|borlabs-cookie|complianz|cmplz-"
CONSENT_WORDS = r"(?i)(cookie|einwilligung|datenschutz|consent|privacy|zustimmen|accept all|akzeptieren)"
ROOT_MOUNTS = ["#root", "#__next", "#app", "#___gatsby", "[data-reactroot]", "#nuxt", "#svelte"]
CONTACT_PATH = r"(?i)(contact|kontakt|impressum|imprint|about|ueber|über|team|legal|mentions-legales|contatti|contacto)"
ORG_JSONLD = r'(?i)"@type"\s*:\s*"?\[?[^"]*?(Organization|LocalBusiness|Corporation)'
ORG_TYPES = r"(?i)^(Organization|Corporation|LocalBusiness|NGO|EducationalOrganization|GovernmentOrganization|SportsOrganization|MedicalOrganization|Company|ProfessionalService|SoftwareCompany|OnlineBusiness)$|Organization|Business"
CONTENT_TYPES = ["text/html", "application/xhtml+xml", "text/plain"]

# Kinds and addresses of resources that a rendering browser leaves out.
BLOCKED_RESOURCES = ["image", "media", "font", "stylesheet"]
BLOCKED_RESOURCE_URLS = "(?i)" + "|".join([
    r"google-analytics\.com|googletagmanager\.com|doubleclick\.net|facebook\.net",
    r"hotjar\.com|mixpanel\.com|segment\.(io|com)|amplitude\.com|fullstory\.com",
    r"intercom\.io|drift\.com|hubspot\.com\/.*\/analytics|clarity\.ms",
    r"\.(png|jpe?g|gif|webp|avif|svg|ico|woff2?|ttf|otf|mp4|webm|mp3)(\?|$)",
])

# Columns of the CSV export.
EXPORT_COLUMNS = """
company_name domain website score industry country city address employee_count employee_range founded_year
funding_stage funding_amount funding_year emails phones linkedin technologies contact_form_url match_reason
merged_domains description
""".split()

# States of runs and domains, with label and tone.
RUN_STATES = {
    "planning": ("Planning", "info"),
    "awaiting_approval": ("Awaiting approval", "warn"),
    "discovering": ("Discovering", "info"),
    "scraping": ("Scraping", "info"),
    "completed": ("Completed", "ok"),
    "failed": ("Failed", "danger"),
    "cancelled": ("Cancelled", "idle"),
}
DOMAIN_TONES = {"queued": "idle", "fetching": "info", "extracting": "info", "done": "ok", "failed": "danger", "blocked": "danger", "skipped": "idle"}
DOMAIN_TERMINAL = ["done", "failed", "blocked", "skipped"]
RUN_TERMINAL = ["completed", "failed", "cancelled"]
RUN_ACTIVE = ["planning", "discovering", "scraping"]

# A job's attempts, first back-off, lease, forgiven stalls, and how long its end is kept (milliseconds).
JOB_ATTEMPTS = 2
JOB_BACKOFF_MS = 5_000
JOB_LEASE_MS = 120_000
JOB_STALLS = 1
KEEP_DONE_MS = 24 * 3_600_000
KEEP_FAILED_MS = 7 * 24 * 3_600_000
