"""Vocabularies, closed value sets and constants.

Everything in this file is data. Results depend on these exact values, so they
are spelled out as text. Every normaliser takes its vocabulary as an argument;
these are only the defaults.
"""

# --- fixed values: closed sets -------------------------------------------
SOURCES = ("hn", "remotive", "web3", "habr")
CUT_SOURCES = ("adzuna",)
DOC_TYPES = ("posting", "candidate", "other")
RUN_STATUSES = ("ok", "invalid", "error")
SENIORITIES = ("intern", "junior", "mid", "senior", "staff+", "unknown")
EMPLOYMENTS = ("full-time", "part-time", "contract", "unknown")
REMOTE_POLICIES = ("remote", "hybrid", "onsite", "unknown")

# --- fixed values: constants ---------------------------------------------
WINDOW_DAYS = 90
PREFILTER_MIN_CHARS = 120
ERROR_CHARS = 500
HOURS_PER_MONTH = 173.33
MONTHS_PER_YEAR = 12
GOLD_SEED = 20260813
GOLD_QUOTAS = {"hn": 16, "habr": 10, "web3": 8, "remotive": 6}

# --- fixed values: reply contract ----------------------------------------
INHERITABLE = (
    "stack", "location", "remote_policy", "employment_type",
    "salary_min", "salary_max", "salary_period", "salary_currency",
)
SALARY_QUOTE_KEY = "salary"
POSTING_KEYS = ("source_quotes", *INHERITABLE, "doc_type", "company", "roles")
ROLE_KEYS = ("source_quotes", *INHERITABLE, "title", "seniority")

# --- fixed values: HTML tags that start a block ---------------------------
BLOCK_TAGS = (
    "p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6",
    "blockquote", "section", "article", "ul", "ol", "table",
)

# --- fixed values: strings that mean "nothing was stated" -----------------
BLANKS = ("", "null", "none", "n/a", "na", "nil", "-", "—", "–")

# --- fixed values: money --------------------------------------------------
CURRENCY_SIGNS = "$€£₽₸₴¥₹"
FREE_TEXT_SIGNS = "$€£₽₸₴"
MAGNITUDES = {"k": 1e3, "K": 1e3, "к": 1e3, "К": 1e3, "m": 1e6, "M": 1e6}
PERIODS = {
    "year": "year", "yearly": "year", "yr": "year", "annual": "year", "annually": "year",
    "per year": "year", "/year": "year", "pa": "year",
    "month": "month", "monthly": "month", "mo": "month", "per month": "month",
    "/month": "month", "mth": "month",
    "hour": "hour", "hourly": "hour", "hr": "hour", "per hour": "hour", "/hour": "hour",
}
CURRENCIES = {
    "rur": "RUB", "rub": "RUB", "руб": "RUB", "руб.": "RUB", "р.": "RUB", "₽": "RUB",
    "usd": "USD", "$": "USD", "us$": "USD", "$usd": "USD", "долл": "USD",
    "eur": "EUR", "€": "EUR",
    "gbp": "GBP", "£": "GBP",
    "kzt": "KZT", "₸": "KZT",
    "uah": "UAH", "₴": "UAH",
    "byn": "BYN",
    "inr": "INR", "₹": "INR",
    "jpy": "JPY",
    "cny": "CNY", "¥": "CNY",
}

# --- fixed values: seniority, employment, work mode -----------------------
SENIORITY = {
    "intern": "intern", "internship": "intern", "trainee": "intern",
    "стажер": "intern", "стажёр": "intern", "стажировка": "intern",
    "junior": "junior", "jr": "junior", "entry": "junior", "entry-level": "junior",
    "джуниор": "junior", "джун": "junior", "младший": "junior",
    "mid": "mid", "middle": "mid", "mid-level": "mid", "intermediate": "mid",
    "миддл": "mid", "мидл": "mid", "средний": "mid",
    "senior": "senior", "sr": "senior", "senior-level": "senior",
    "синьор": "senior", "сеньор": "senior", "старший": "senior",
    "staff": "staff+", "staff+": "staff+", "principal": "staff+", "architect": "staff+",
    "lead": "staff+", "tech lead": "staff+", "team lead": "staff+", "teamlead": "staff+",
    "head": "staff+", "тимлид": "staff+", "ведущий": "staff+", "руководитель": "staff+",
}
EMPLOYMENT = {
    "full-time": "full-time", "fulltime": "full-time", "full": "full-time",
    "permanent": "full-time", "полная занятость": "full-time", "полный день": "full-time",
    "part-time": "part-time", "parttime": "part-time", "part": "part-time",
    "частичная занятость": "part-time", "неполный день": "part-time",
    "contract": "contract", "contractor": "contract", "freelance": "contract",
    "temporary": "contract", "temp": "contract", "b2b": "contract",
    "фриланс": "contract", "подряд": "contract", "проектная работа": "contract",
}
REMOTE = {
    "remote": "remote", "fully remote": "remote", "fully-remote": "remote",
    "100% remote": "remote", "100%-remote": "remote",
    "remote first": "remote", "remote-first": "remote", "wfh": "remote",
    "work from home": "remote", "work-from-home": "remote",
    "distributed": "remote", "anywhere": "remote", "worldwide": "remote",
    "удаленно": "remote", "удалённо": "remote",
    "удаленная работа": "remote", "удалённая работа": "remote",
    "hybrid": "hybrid", "partially remote": "hybrid", "partially-remote": "hybrid",
    "flexible": "hybrid", "гибрид": "hybrid", "гибридный": "hybrid",
    "onsite": "onsite", "on-site": "onsite", "on site": "onsite",
    "on-premise": "onsite", "on premise": "onsite",
    "in-office": "onsite", "in office": "onsite", "office": "onsite",
    "in-person": "onsite", "in person": "onsite", "local": "onsite",
    "офис": "onsite", "в офисе": "onsite",
}

# --- fixed values: skills -------------------------------------------------
SKILL_STOPLIST = (
    "open source", "opensource", "remote", "hybrid", "onsite", "full-time", "part-time",
    "contract", "internship", "entry-level", "junior", "senior", "lead", "non-tech",
    "engineer", "developer", "dev", "executive", "operations", "sales", "marketing",
    "crypto", "blockchain", "web3", "defi", "bitcoin", "ethereum",
    "united-states", "china", "europe", "worldwide", "usa", "uk", "team lead",
    "управление проектами", "управление рисками", "управление людьми",
    "управление разработкой", "планирование", "построение команды",
    "оптимизация бизнес-процессов", "информационная безопасность",
    "разработка программного обеспечения",
)
SKILL_ALIASES = {
    "postgresql": "postgres", "psql": "postgres", "postgre": "postgres",
    "k8s": "kubernetes", "golang": "go", "node": "nodejs", "node.js": "nodejs",
    "js": "javascript", "ts": "typescript", "py": "python",
    "c#": "csharp", "c++": "cpp", "objective-c": "objc",
    "amazon web services": "aws", "google cloud": "gcp", "google cloud platform": "gcp",
    "microsoft azure": "azure",
    "react.js": "react", "reactjs": "react", "vue.js": "vue", "vuejs": "vue",
    "next.js": "nextjs", "rest": "rest-api", "restful": "rest-api",
    "ci/cd": "ci-cd", "cicd": "ci-cd",
    "java spring framework": "spring", "spring boot": "spring",
    "oracle pl/sql": "plsql", "pl/sql": "plsql",
    "гост": "gost", "объектное хранилище s3": "s3", "1с": "1c",
}
LOOKALIKES_CYRILLIC = "АВЕКМНОРСТУХаеорсух"
LOOKALIKES_LATIN = "ABEKMHOPCTYXaeopcyx"
