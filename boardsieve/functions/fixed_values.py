"""Fixed values.

Word lists, weights, lookup tables and formats that decide results.  They are
plain data: operators read them through :class:`boardsieve.settings.RuleSet`,
so any of them can be replaced without touching an operator.
"""

# ---------------------------------------------------------------------------
# Places and remote scope
# ---------------------------------------------------------------------------
REMOTE_ONLY_BOARDS = ("remoteok", "weworkremotely", "remotive")

EU_COUNTRIES = (
    "germany", "deutschland", "austria", "österreich", "switzerland", "schweiz",
    "france", "spain", "portugal", "italy", "netherlands", "belgium", "luxembourg", "ireland",
    "sweden", "denmark", "norway", "finland", "iceland",
    "poland", "czech republic", "czechia", "romania", "hungary",
    "slovakia", "slovenia", "croatia", "bulgaria",
    "estonia", "latvia", "lithuania",
    "greece", "cyprus", "malta",
    "dach", "benelux",
)

GERMAN_CITIES = (
    "berlin", "münchen", "munich", "hamburg", "frankfurt", "köln", "cologne", "düsseldorf",
    "stuttgart", "leipzig", "dresden", "hannover", "nuremberg", "nürnberg", "dortmund",
    "essen", "bremen",
)

GERMANY_NAMES = ("germany", "deutschland")

BLOCK_PHRASES = (
    "uk only", "united kingdom only", "gb only", "london only",
    "us only", "usa only", "u.s. only", "united states only", "canada only",
)

UK_SIGNALS = ("uk only", "united kingdom only", "gb only", "london only", "uk-based")

COUNTRY_BLOCKLIST = (
    "united states", "usa", "us only", "remote us", "remote - us",
    "canada", "canada only", "remote canada",
    "australia", "new zealand", "brazil", "india", "nigeria",
    "singapore", "japan", "south korea", "china",
    "united kingdom", "uk only", "london", "england",
    "mexico", "argentina", "colombia",
)
COUNTRY_BLOCKLIST_WHOLE_WORD = ("usa", "london", "england")  # plus every entry of <= 4 characters

REMOTE_KEYWORDS = (
    "remote", "work from anywhere", "work from home", "home office", "distributed",
    "telecommute", "hybrid", "work from",
)

WORLDWIDE_KEYWORDS = ("worldwide", "global", "anywhere", "work from anywhere")
WORLDWIDE_IN_LOCATION = ("worldwide", "work from anywhere", "remote - worldwide", "global")

EU_REGION_KEYWORDS = (
    "europe", "european union", "eu ", "eu,", "eu/", "(eu)", "emea",
    "remote - eu", "remote - europe", "remote eu", "remote europe",
)

RESIDENCY_PHRASES = (
    "must be located in", "must reside in", "must be based in", "based in", "resident in",
    "residing in", "eligible to work in", "located in", "living in", "work from",
)
RESIDENCY_WINDOW = 80

NON_EU_WHOLE_WORD = ("us", "usa", "u.s.", "uk", "u.k.")
NON_EU_PATTERNS = (
    "united states", "united kingdom",
    "us", "usa", "u.s.", "uk", "u.k.",
    "canada", "australia", "india", "brazil", "mexico",
    "singapore", "japan", "china", "south korea", "israel",
    "south africa", "new zealand", "philippines", "nigeria", "argentina", "colombia",
    "california", "new york", "texas", "florida", "illinois",
    "massachusetts", "washington", "colorado", "georgia", "virginia",
    "north carolina", "pennsylvania", "ohio", "michigan", "arizona",
    "oregon", "minnesota", "tennessee", "maryland", "connecticut",
    "san francisco", "los angeles", "new york city", "nyc",
    "seattle", "austin", "boston", "chicago", "denver",
    "atlanta", "miami", "portland", "dallas", "houston",
    "san diego", "philadelphia", "phoenix", "detroit", "charlotte",
    "nashville", "raleigh", "salt lake city", "minneapolis",
    "tampa", "pittsburgh", "st. louis", "baltimore",
    "toronto", "vancouver", "montreal", "ottawa", "calgary",
    "london", "manchester", "edinburgh", "bristol", "leeds",
    "sydney", "melbourne", "brisbane",
    "mumbai", "bangalore", "hyderabad", "delhi",
    "remote - us", "remote us", "remote, us", "remote (us)",
    "remote - usa", "remote usa", "remote, usa",
    "remote - united states", "remote, united states",
    "remote - canada", "remote, canada", "remote (canada)",
    "remote - uk", "remote, uk", "remote (uk)",
    "americas", "apac", "latam", "latin america",
)

# Default scope for rows a board leaves unclassified: source -> scope.
SCOPE_DEFAULT_BY_SOURCE = {
    "arbeitnow": "germany",
    "weworkremotely": "worldwide",
    "remotive": "worldwide",
    "hours80k": "worldwide",
    "idealist": "worldwide",
    "remoteok": "worldwide",
}
PRESET_SCOPES = ("worldwide", "eu", "germany", "restricted")
ACCEPTED_SCOPES = ("worldwide", "eu", "germany")

# ---------------------------------------------------------------------------
# Role, stack and seniority
# ---------------------------------------------------------------------------
TITLE_REJECT = (
    "office assistant", "executive assistant", "virtual assistant", "brand manager",
    "marketing manager", "marketing director", "marketing lead", "growth marketing",
    "growth manager", "sales", "account executive", "account manager",
    "business development", "customer success", "customer support", "support agent",
    "recruiter", "recruiting", "talent acquisition", "talent team lead", "human resources",
    " hr ", "hr manager", "hr director", "people ops", "people operations",
    "finance manager", "accountant", "bookkeeper", "content writer", "content strategist",
    "copywriter", "social media", "graphic designer", "ui designer", "ux designer",
    "project manager", "scrum master", "agile coach",
    "go to market", "go-to-market", "gtm engineer", "marketing",
    "product manager", "senior product manager", "staff product manager",
    "principal product manager", "head of product", "product owner", "product operations",
    "product capability",
    "c++ developer", "c++ engineer", "c++ software",
    "java developer", "java engineer", "java backend", "spring boot", "java spring",
    "c# developer", ".net developer", "dotnet developer", "golang developer",
    "rust developer", "rust engineer", "embedded developer", "embedded engineer",
    "firmware engineer",
    "devops engineer", "sre", "site reliability engineer", "platform engineer",
    "infrastructure engineer", "systems administrator", "sysadmin", "linux administrator",
    "network engineer", "cloud engineer", "cloud architect", "kubernetes engineer",
    "kubernetes consultant", "solutions architect",
    "research engineer", "ml engineer", "ai researcher", "ai research",
    "machine learning researcher", "data scientist", "quantitative analyst", "quant analyst",
    "mathematical modeller", "mathematical model", "research laboratory", "lab technician",
    "benchside", "wet lab",
    "security engineer", "penetration tester", "pen tester", "security researcher",
    "identity engineer", "offensive security",
    "qa engineer", "quality engineer", "test engineer", "test specialist",
    "quality assurance",
    "3d artist", "environment artist", "game artist", "motion designer",
    "linguist", "translator", "request for proposals", "rfp",
    "smart contract", "blockchain engineer", "web3 engineer", "solidity", "defi engineer",
    "crypto engineer", "svm engineer",
    "intern ", "intern,", "intern-", "internship", "working student", "werkstudent",
    "praktikum", "praktikant", "apprentice", "trainee", "c-suite", "chief", "vp of",
    "vice president", "android engineer", "ios engineer", "mobile engineer",
    "embedded", "firmware", "hardware engineer", "data analyst", "business analyst",
    "financial analyst", "seo specialist", "seo manager",
)
TITLE_REJECT_WHOLE_WORD = ("data engineer", "go developer", "go engineer", "go backend")
INTERN_TITLE = "intern"

ROLE_ACCEPT = (
    "full stack", "fullstack", "full-stack", "frontend", "front-end", "front end",
    "backend", "back-end", "back end", "software engineer", "software developer",
    "software development engineer", "web developer", "web engineer",
    "web application developer", "api developer", "api engineer", "platform developer",
    "internal tools engineer", "integration engineer", "technical lead", "staff engineer",
    "principal engineer", "application developer", "application engineer",
    "react", "next.js", "nextjs", "vue", "vue.js", "nuxt", "typescript", "javascript",
    "node.js", "nodejs", "python", "django", "fastapi", "flask", "ruby on rails", "ruby",
    "rails", "php", "symfony", "laravel",
    "docker", "ci/cd", "gitlab ci", "github actions",
    "postgresql", "mysql", "graphql", "apollo graphql", "rest api", "llm", "rag",
    "ai engineer", "tailwindcss", "tailwind", "accessibility", "a11y", "seo engineer",
    "seo developer", "developer", "engineer",
)

INCOMPATIBLE_STACKS = (
    "java", "spring", "kotlin", "c++", "c#", ".net", "dotnet", "golang", "rust",
    "cobol", "fortran", "mainframe", "salesforce", "sap",
    "ios developer", "swift developer", "android developer", "kotlin developer",
    "unity developer", "unreal engine", "c/al", "navision", "dynamics",
)
GO_CONTEXT = ("golang", "go developer", "go engineer", "go backend")
USER_STACK = (
    "react", "next", "vue", "nuxt", "typescript", "javascript", "python", "django",
    "fastapi", "rails", "ruby", "php", "symfony", "laravel", "node", "graphql",
    "tailwind", "frontend", "full stack", "fullstack", "full-stack",
    "web developer", "web engineer",
)

SENIOR_ACCEPT = ("senior", "lead", "staff", "principal", "head", "director", "architect")
SENIOR_REJECT = ("junior", "mid-level", "mid level", "entry-level", "entry level", "intern")

# ---------------------------------------------------------------------------
# Match score
# ---------------------------------------------------------------------------
STACK_WEIGHTS = {
    "react": 20, "next.js": 18, "nextjs": 18, "typescript": 16, "vue": 15, "vue.js": 15,
    "nuxt": 14, "nuxt.js": 14, "fastapi": 16, "django": 15, "tailwind": 12,
    "tailwindcss": 12, "python": 14,
    "node": 12, "node.js": 12, "nodejs": 12, "ruby on rails": 12, "rails": 10, "ruby": 8,
    "graphql": 10, "postgresql": 8, "postgres": 8, "langchain": 12, "rag": 12, "llm": 10,
    "javascript": 10,
    "php": 7, "symfony": 8, "docker": 6, "gitlab": 5, "ci/cd": 5, "rest api": 5,
    "mysql": 5, "mongodb": 4, "jest": 4, "vitest": 4, "rspec": 4, "wcag": 5,
    "accessibility": 5, "stripe": 4, "redis": 3,
    "ngo": 15, "nonprofit": 15, "non-profit": 15, "social impact": 10,
    "mission-driven": 10, "open source": 6, "digital rights": 8, "civic tech": 8,
    "humanitarian": 8, "tactical tech": 20,
    "java": -5, "spring boot": -5, "c++": -8, "c#": -5, ".net": -5, "kubernetes": -3,
    "ansible": -3, "terraform": -3,
}
STACK_WHOLE_WORD = ("ai", "vue", "php", "rag", "llm", "c#", "c++")
STACK_SYNONYMS = {
    "nextjs": "nextjs", "next.js": "nextjs",
    "nodejs": "nodejs", "node": "nodejs", "node.js": "nodejs",
    "tailwind": "tailwind", "tailwindcss": "tailwind",
    "ngo": "ngo", "nonprofit": "ngo", "non-profit": "ngo",
    "vue": "vue", "vue.js": "vue",
    "nuxt": "nuxt", "nuxt.js": "nuxt",
    "postgresql": "postgresql", "postgres": "postgresql",
    "ruby on rails": "rails", "rails": "rails",
}
NGO_FLAG_BONUS = 10
# Piecewise-linear score curve: (raw from, score at that point, gain, per raw points).
SCORE_CURVE = ((50, 95, 5, 30), (40, 90, 5, 10), (25, 70, 20, 15), (15, 50, 20, 10), (5, 20, 30, 10), (0, 0, 20, 5))
SCORE_MAX = 100

# ---------------------------------------------------------------------------
# Organisation type
# ---------------------------------------------------------------------------
NGO_COMPANY = (
    "foundation", "ngo", "nonprofit", "non-profit", "not-for-profit", "civil society",
    "charity", "humanitarian", "international development", "development organisation",
    "development organization",
)
NGO_DESCRIPTION = (
    "social impact", "mission-driven", "mission driven", "501(c)", "civil rights",
    "human rights", "open data", "digital rights", "transparency", "advocacy", "policy",
    "public interest", "social good", "civic tech", "open source", "open society",
    "press freedom", "internet freedom",
)
KNOWN_NGOS = (
    "tactical tech", "amnesty international", "amnesty", "oxfam", "msf",
    "médecins sans frontières", "unhcr", "greenpeace", "eff",
    "electronic frontier foundation", "open knowledge", "open knowledge foundation",
    "wikimedia", "wikimedia foundation", "mozilla foundation", "mozilla", "access now",
    "article 19", "privacy international", "reporters without borders",
    "transparency international", "human rights watch", "the engine room", "internews",
    "global witness", "center for democracy & technology", "free press",
    "fight for the future", "open rights group", "european digital rights", "edri",
    "witness", "signal foundation", "tor project", "freedom of the press foundation",
    "committee to protect journalists", "cpj", "ford foundation", "omidyar network",
    "luminate", "digital freedom fund",
)
NOT_NGO = (
    "marketplace", "e-commerce", "ecommerce", "saas", "b2b platform", "b2c platform",
    "fintech", "adtech", "ad tech", "proptech", "insurtech", "home services",
    "real estate platform", "venture-backed", "series a", "series b", "series c", "ipo",
)
NOT_NGO_STRONG = (
    "assessment platform", "hiring platform", "recruiting platform", "hr software",
    "hrtech", "hr tech", "talent assessment", "skills testing", "skills assessment",
    "saas platform", "b2b saas", "series a funded", "series b funded", "venture backed",
)

# ---------------------------------------------------------------------------
# limits
# ---------------------------------------------------------------------------
MAX_PER_COMPANY = 2
MAX_AGE_DAYS = 14
MAX_AGE_BY_SOURCE = {"reliefweb": 30}
MIN_NGO_SCORE = 1
DIGEST_HOURS = 6
DIGEST_LIMIT = 15
WEEKLY_DAYS = 7
WEEKLY_LIMIT = 20
WEEKLY_SHOWN = 10
STALE_HOURS = 2
SNAPSHOTS_KEPT = 7
RECENT_HOURS = 24

# ---------------------------------------------------------------------------
# Boards, in registry order
# ---------------------------------------------------------------------------
BOARDS = (
    "remotive", "arbeitnow", "remoteok", "weworkremotely", "idealist", "reliefweb",
    "techjobsforgood", "eurobrussels", "hours80k", "goodjobs", "devex", "linkedin",
    "stepstone", "nofluffjobs", "himalayas", "landingjobs", "themuse",
)

# arbeitnow addresses
ADDRESS_CITIES = (
    "berlin", "münchen", "munich", "hamburg", "frankfurt", "köln",
    "cologne", "düsseldorf", "stuttgart", "leipzig", "dresden",
    "hannover", "nuremberg", "nürnberg", "dortmund", "essen", "bremen",
    "bonn", "mannheim", "karlsruhe", "augsburg", "wiesbaden",
    "freiburg", "mainz", "heidelberg", "potsdam", "rostock",
)
ADDRESS_COUNTRIES = {
    "germany": "Germany", "deutschland": "Germany",
    "austria": "Austria", "österreich": "Austria",
    "switzerland": "Switzerland", "schweiz": "Switzerland",
    "france": "France", "spain": "Spain", "portugal": "Portugal",
    "italy": "Italy", "netherlands": "Netherlands", "belgium": "Belgium",
    "luxembourg": "Luxembourg", "ireland": "Ireland", "sweden": "Sweden",
    "denmark": "Denmark", "norway": "Norway", "finland": "Finland", "poland": "Poland",
    "czech republic": "Czech Republic", "czechia": "Czech Republic",
    "romania": "Romania", "hungary": "Hungary",
}
ADDRESS_NON_CITIES = ("remote", "worldwide", "hybrid", "on-site", "onsite")

# remoteok locations
REMOTEOK_URL = "https://remoteok.com/remote-jobs/"
REMOTEOK_WORLDWIDE = (
    "worldwide", "global", "anywhere", "work from anywhere", "remote - worldwide", "remote worldwide",
)
REMOTEOK_EU = (
    "europe", "eu", "emea", "remote - europe", "remote europe", "remote - eu", "remote eu",
)
REMOTEOK_GERMANY = (
    "germany", "deutschland", "berlin", "munich", "münchen", "hamburg", "frankfurt",
)
REMOTEOK_RESTRICTED = (
    "united states", "usa", "us", "us only", "remote us", "remote - us", "remote, us", "u.s.",
    "canada", "canada only", "remote canada", "remote - canada",
    "australia", "new zealand", "brazil", "india", "nigeria",
    "singapore", "japan", "south korea", "china",
    "united kingdom", "uk", "uk only", "england", "london",
    "mexico", "argentina", "colombia",
    "americas", "apac", "latam", "latin america",
    "california", "new york", "texas", "florida", "illinois",
    "massachusetts", "washington", "colorado", "georgia", "virginia",
    "north carolina", "pennsylvania", "ohio", "michigan", "arizona",
    "oregon", "minnesota", "tennessee", "maryland", "connecticut",
    "san francisco", "los angeles", "nyc", "seattle", "austin",
    "boston", "chicago", "denver", "atlanta", "miami", "portland",
    "dallas", "houston", "tampa", "toronto", "vancouver", "montreal",
)
REMOTEOK_WHOLE_WORD_MAX = 3  # entries up to this length match as whole words only

# idealist
IDEALIST_URL = "https://www.idealist.org"
IDEALIST_EU_CODES = (
    "DE", "AT", "CH", "FR", "ES", "PT", "IT", "NL", "BE", "LU", "IE",
    "SE", "DK", "NO", "FI", "IS", "PL", "CZ", "RO", "HU", "SK", "SI", "HR", "BG",
    "EE", "LV", "LT", "GR", "CY", "MT",
)
IDEALIST_NGO_TYPES = ("NONPROFIT", "NGO", "CHARITY", "FOUNDATION", "SOCIAL_ENTERPRISE")
SALARY_PERIODS = {"year": "/yr", "month": "/mo", "week": "/wk", "hour": "/hr", "day": "/day"}
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}

# reliefweb
RELIEFWEB_FEEDS = {
    "ICT": "Information and Communications Technology",
    "PPM": "Program/Project Management",
    "IM": "Information Management",
}
RELIEFWEB_TECH_TITLES = (
    "software", "developer", "engineer", "digital", "data", "ict", "it ", "i.t.", "web ",
    "tech", "devops", "cloud", "systems", "platform", "full stack", "fullstack",
    "frontend", "backend", "machine learning", "ai ",
)
RELIEFWEB_ORG_WORDS = (
    "Organization", "Committee", "Agency", "Fund", "Programme", "Office", "Council",
    "Foundation", "Association", "Society", "Network", "Coalition", "Commission", "Job",
)
RELIEFWEB_COUNTRY_PATTERN = r'class="tag country">Country:\s*([^<]+)<'

# eurobrussels
EUROBRUSSELS_URL = "https://www.eurobrussels.com"
EUROBRUSSELS_DEFAULT_LOCATION = "Brussels, Belgium"
EUROBRUSSELS_NGO = (
    "ngo and political", "ngo", "political", "eu institution", "international organisations",
    "international organization", "academic and think tank", "think tank",
)
EUROBRUSSELS_CATEGORIES = (
    "Communication/Public Relations", "EU Institution", "Industry Association",
    "International Organisations", "NGO and Political", "Academic and Think Tank",
    "Consultancy", "Economist", "Legal", "Operations (Accounts, HR, IT)",
    "Secretarial and Assistant",
)
EUROBRUSSELS_NAV = ("save this job", "email me jobs like this", "subscribe")
SLUG_CITIES = (
    "Brussels", "Bonn", "Berlin", "Paris", "Luxembourg", "Amsterdam", "Geneva", "The",
    "Prague", "Vienna", "Dublin", "Madrid", "Rome", "Grenoble", "Strasbourg", "Stockholm",
    "Copenhagen", "Helsinki", "Lisbon", "Warsaw",
)
SLUG_COUNTRIES = (
    "Belgium", "Germany", "France", "Luxembourg", "Netherlands", "Czech", "Republic",
    "Austria", "Ireland", "Spain", "Italy", "Sweden", "Denmark", "Norway", "Finland",
    "Poland", "Portugal", "Greece", "Europe", "Outside",
)

# goodjobs
GOODJOBS_URL = "https://goodjobs.eu"
GOODJOBS_SKIP = ("anmelden", "konto erstellen", "stellenanzeige", "cookie")
GOODJOBS_LEGAL_FORMS = (
    "ggmbh", "e.v.", "e. v.", "stiftung", "gemeinnützig", "gug", "non-profit", "nonprofit", "ngo",
)
GOODJOBS_CITY_PATTERN = r"[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-Za-zäöüß]+)?"
GOODJOBS_PATTERN_CITIES = (
    "Berlin", "Hamburg", "München", "Munich", "Frankfurt", "Köln", "Cologne", "Stuttgart",
    "Leipzig", "Dresden", "Düsseldorf", "Hannover", "Bremen", "Bonn", "Mannheim",
    "Heidelberg", "Freiburg", "Potsdam", "Tübingen", "Lüneburg", "Heilbronn", "Bielefeld",
    "Dortmund", "Essen", "Nürnberg", "Nuremberg", "Wiesbaden",
)
GOODJOBS_WORK_TYPES = ("Hybrid", "Remote", "Nur vor Ort", "Vor Ort")
GOODJOBS_CITIES = (
    "Berlin", "Hamburg", "München", "Munich", "Frankfurt", "Köln", "Cologne", "Stuttgart",
    "Leipzig", "Dresden", "Düsseldorf", "Hannover", "Bremen", "Bonn",
)
GOODJOBS_SALARY_PATTERN = r"(?:Jahresgehalt\s+)?(\d{1,3}(?:\.\d{3})*€)\s*[–-]\s*(\d{1,3}(?:\.\d{3})*€)"
GOODJOBS_COMPANY_PATTERN = r"([A-ZÄÖÜ][^\n]{3,50}?)\s+(?:GoodCompany|Company)"
GOODJOBS_COMPANY_PREFIXES = (
    "Anstellungsart: Festanstellung", "Anstellungsart:", "Deutsch", "Englisch",
    "Zu den Ersten gehören", "Kein Anschreiben benötigt",
)
GOODJOBS_COMPANY_NOISE = ("GoodCompan", "Nachhaltigkeits", "Auswahlprozess", "bedeutet")

# devex, linkedin, stepstone, techjobsforgood
DEVEX_URL = "https://www.devex.com/jobs/"
LINKEDIN_URL = "https://www.linkedin.com"
STEPSTONE_URL = "https://www.arbeitsagentur.de/jobsuche/suche?id="
STEPSTONE_REMOTE = (
    "remote", "homeoffice", "home office", "home-office", "hybrid", "teilweise remote",
    "mobiles arbeiten",
)
TECHJOBS_URL = "https://www.techjobsforgood.com"
TECHJOBS_BLOCK_PHRASES = (
    "you have been blocked", "cf-error-details", "attention required", "cloudflare ray id",
)
HTML_MIN_CHARS = 500
RELATIVE_TIME_PATTERN = r"(?i)(\d+)\s+(minute|hour|day|week|month)s?\s+ago"
RELATIVE_TIME_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}

# nofluffjobs
NOFLUFF_URL = "https://nofluffjobs.com/job/"
NOFLUFF_CATEGORIES = (
    "backend", "fullstack", "devops", "data", "mobile", "architecture", "security",
    "artificialintelligence", "frontend", "embedded",
)
NOFLUFF_MAX_AGE_DAYS = 14
DACH_CODES = ("de", "at", "ch")
SCOPE_WORLDWIDE_WORDS = ("worldwide", "global", "anywhere")

# himalayas
HIMALAYAS_CATEGORIES = (
    "software", "engineering", "fullstack", "backend", "frontend", "devops",
    "infrastructure", "data", "machine-learning", "cloud", "security", "sre", "platform",
    "systems", "developer", "development",
)
HIMALAYAS_TITLES = (
    "engineer", "developer", "devops", "sre", "backend", "frontend", "fullstack", "data",
    "architect", "platform",
)
HIMALAYAS_EU = (
    "germany", "france", "netherlands", "spain", "italy", "belgium", "austria",
    "switzerland", "portugal", "ireland", "denmark", "sweden", "norway", "finland",
    "poland", "czech republic", "romania", "hungary", "greece", "croatia",
    "united kingdom", "uk", "luxembourg",
)
HIMALAYAS_OPEN = ("worldwide", "global", "anywhere", "remote")

# themuse
MUSE_NON_PLACES = ("flexible / remote", "remote")
MUSE_GERMANY = ("germany", "berlin", "munich", "hamburg")
MUSE_EU = (
    "europe", "london", "amsterdam", "paris", "brussels", "dublin", "lisbon", "barcelona", "madrid",
)

# hours80k
H80K_WORLDWIDE = ("remote, global", "worldwide", "global")
H80K_GERMANY = ("germany", "berlin", "deutschland", "munich", "hamburg")
H80K_EU = ("europe", "eu ", "emea", "brussels", "amsterdam")
H80K_REJECT = (
    "request for proposals", "rfp", "research laboratory", "lab technician", "benchside",
    "mathematical model", "quantitative", "wet lab", "clinical", "policy analyst",
    "policy researcher", "programme officer", "program officer", "operations lead",
    "operations manager", "communications", "outreach", "fellowship", "internship",
)
H80K_DEV = (
    "engineer", "developer", "architect", "devops", "fullstack", "full stack", "full-stack",
    "frontend", "front-end", "front end", "backend", "back-end", "back end", "software",
    "platform", "infrastructure", "sre", "data engineer",
)

# ---------------------------------------------------------------------------
# Message formats
# ---------------------------------------------------------------------------
SOURCE_ICONS = {
    "remotive": "🟣", "arbeitnow": "🔴", "remoteok": "🟠", "weworkremotely": "⚪",
    "idealist": "🟡", "reliefweb": "🔵", "techjobsforgood": "🟢", "eurobrussels": "🔵",
    "hours80k": "⚫", "goodjobs": "🟢", "devex": "🔴", "linkedin": "🔷", "stepstone": "🟦",
}
DIGEST_ICONS = {
    "remotive": "🟣", "arbeitnow": "🔴", "remoteok": "🟠", "reliefweb": "🔵",
    "hours80k": "⚫", "goodjobs": "🟢", "devex": "🔴", "eurobrussels": "🔵",
}
DEFAULT_ICON = "🌐"
COLOUR_HIGH_MATCH = 0xF59E0B
COLOUR_NGO = 0x10B981
COLOUR_GENERAL = 0x6366F1
HIGH_MATCH_FROM = 60
MATCH_LABELS = ((80, "🔥 Excellent"), (50, "⭐ Strong"), (20, "📊 Moderate"), (0, "📊 Low"))
SCOPE_EMOJI = {"worldwide": "🌍", "eu": "🇪🇺", "germany": "🇩🇪"}
SCOPE_LABELS = {"worldwide": "Worldwide", "eu": "EU / Europe", "germany": "Germany"}
