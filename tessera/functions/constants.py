"""Word lists, weights, thresholds and rates that results depend on."""

from __future__ import annotations

# fmt: off
# Currency rates to USD.
RATES = {"USD": 1.0, "EUR": 1.1, "GBP": 1.27, "CHF": 1.13, "INR": 0.012, "KES": 0.0078, "ZAR": 0.055, "CAD": 0.73, "AUD": 0.65}
# Lookup tables, key to label.
COUNTRIES = {"IN": "India", "KE": "Kenya", "US": "United States", "GB": "United Kingdom", "ZA": "South Africa", "CH": "Switzerland", "FR": "France", "DE": "Germany", "CA": "Canada", "AU": "Australia"}
LEVELS = ["intern", "junior", "mid", "senior", "lead", "executive"]
MISSIONS = ["health", "education", "gender", "climate", "governance", "human_rights", "wash", "livelihoods", "economic_growth", "peacebuilding", "refugees", "urban", "infrastructure", "energy", "information_systems", "communications", "youth", "culture", "food_security", "innovation", "mel", "cross_sector"]
MODALITIES = ["onsite", "field", "remote", "hybrid", "home_based", "flexible"]
CONTRACTS = ["full_time", "part_time", "project_based", "short_term", "freelance", "volunteer", "fixed_term"]
ORG_TYPES = ["un", "ingo", "ngo", "gov", "csr", "foundation", "academic", "social_enterprise", "network"]
CRISES = ["conflict", "earthquake", "flood", "drought", "epidemic", "cyclone", "displacement"]
CLUSTERS = ["health", "wash", "shelter", "protection", "cccm", "nutrition", "education", "food_security", "logistics", "early_recovery"]
PHASES = ["preparedness", "response", "recovery", "resilience"]
BENEFITS = ["health_insurance", "pension", "relocation", "visa_sponsorship", "housing", "travel", "hazard_pay"]
POLICIES = ["pay_transparent", "disability_friendly", "gender_friendly"]
DONORS = ["usaid", "giz", "eu", "world_bank", "adb"]
# Synonyms, raw value to key.
LEVEL_SYNONYMS = {"entry": "junior", "entry-level": "junior", "entry level": "junior", "associate": "junior", "mid-level": "mid", "mid level": "mid", "intermediate": "mid", "staff": "mid", "senior": "senior", "sr": "senior", "sr.": "senior", "senior-level": "senior", "senior level": "senior", "manager": "senior", "principal": "lead"}
MISSION_SYNONYMS = {"healthcare": "health", "medical": "health", "sanitation": "wash", "water": "wash", "human-rights": "human_rights", "humanrights": "human_rights"}
MODALITY_SYNONYMS = {"office": "onsite", "on-site": "onsite", "on site": "onsite", "wfh": "remote", "work from home": "remote", "home based": "home_based", "home-based": "home_based"}
# The older profile of normalisation.
OLD_COUNTRIES = {"afghanistan": "AF", "bangladesh": "BD", "congo": "CD", "drc": "CD", "democratic republic of congo": "CD", "ethiopia": "ET", "india": "IN", "kenya": "KE", "nigeria": "NG", "pakistan": "PK", "sudan": "SD", "somalia": "SO", "syria": "SY", "syrian arab republic": "SY", "united states": "US", "usa": "US", "us": "US", "yemen": "YE"}
OLD_LEVELS = {"intern": "Intern", "internship": "Intern", "junior": "Junior", "entry": "Junior", "entry-level": "Junior", "entry level": "Junior", "mid": "Mid", "mid-level": "Mid", "mid level": "Mid", "intermediate": "Mid", "senior": "Senior", "sr": "Senior", "sr.": "Senior", "lead": "Lead", "principal": "Lead", "staff": "Lead"}
OLD_TAGS = {"health": "health", "healthcare": "health", "medical": "health", "education": "education", "learning": "education", "teaching": "education", "wash": "wash", "water": "wash", "sanitation": "wash", "hygiene": "wash", "climate": "climate", "environment": "climate", "climate change": "climate", "gender": "gender", "women": "gender", "women's rights": "gender", "protection": "protection", "child protection": "protection", "safeguarding": "protection", "nutrition": "nutrition", "food": "nutrition", "malnutrition": "nutrition", "livelihoods": "livelihoods", "economic": "livelihoods", "employment": "livelihoods", "shelter": "shelter", "housing": "shelter", "food-security": "food-security", "food security": "food-security", "famine": "food-security"}
# Quality weights and grades.
QUALITY_WEIGHTS = {"title": 0.20, "apply_url": 0.20, "location": 0.15, "deadline": 0.15, "description": 0.10, "org_name": 0.10, "geocoding": 0.05, "country": 0.05}
QUALITY_GRADES = [("high", 0.85), ("medium", 0.70), ("low", 0.50)]
# Parts of urls that mark listing pages, as each report counts them.
LISTING_SOURCE = ["/jobs", "/careers", "/vacancies", "/opportunities", "/list", "/search", "/all", "/index"]
LISTING_GLOBAL = ["/jobs", "/careers", "/vacancies", "/opportunities", "/list", "/search"]
LISTING_HEALTH = ["/jobs", "/careers", "/vacancies"]
LISTING_ISSUES = ["/jobs", "/careers"]
# Link heuristics.
BLOCKED_LINKS = ["more jobs", "global", "where we work", "leadership recruitment", "life at", "get prepared", "send me jobs", "candidate login", "home", "about us", "contact us", "login", "register", "search", "menu", "skip to content", "privacy", "terms", "cookie"]
LINK_WORDS = ["job", "vacanc", "consultanc", "apply", "/job/", "/view/", "/opportunity", "/tender", "/consultanc", "position", "career", "opening", "recruitment", "hiring", "application", "posting", "specialist", "officer", "manager", "coordinator", "analyst"]
DETAIL_PARTS = ["/view/", "/job/", "/detail/", "/position/", "/id=", "?id="]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "_ga", "ref", "source"]
# Page classifier.
PAGE_WORDS = ["job", "position", "vacancy", "career", "opportunity", "recruitment", "hiring", "opening", "posting", "role"]
PAGE_URL_PARTS = ["/job", "/career", "/position", "/vacancy", "/opportunity"]
PAGE_NEGATIVES = ["login", "sign in", "register", "homepage", "about us"]
# Extracted-row validation.
NAV_WORDS = ["home", "about", "contact", "login", "register", "privacy", "terms", "cookie", "sitemap", "search", "menu", "skip", "read more", "view all", "subscribe", "newsletter", "donate", "support", "volunteer", "careers", "our work", "what we do", "who we are", "news", "blog", "press", "media"]
DATE_TITLES = [r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$", r"^\d{1,2}\s+[a-z]{3,9}\s+\d{2,4}$", r"^[a-z]{3,9}\s+\d{1,2},?\s+\d{2,4}$", r"^(monday|tuesday|wednesday|thursday|friday|saturday|sunday)", r"^(january|february|march|april|may|june|july|august|september|october|november|december)"]
ROLE_WORDS = ["manager", "officer", "coordinator", "specialist", "advisor", "director", "assistant", "analyst", "engineer", "consultant"]
TITLE_WORDS = [*ROLE_WORDS, "expert", "lead", "senior", "junior", "intern", "volunteer", "position", "role", "vacancy"]
GENERIC_TITLES = ["job", "position", "vacancy", "career", "opportunity", "apply", "application", "hiring", "recruitment"]
NON_TITLES = [r"^click here", r"^read more", r"^learn more", r"^view details", r"^see all", r"^next page", r"^previous page", r"^\d+$", r"^page \d+$", r"^loading\.\.\.$"]
URL_WORDS = ["job", "position", "vacancy", "career", "opportunity", "apply", "application", "posting", "listing"]
# Repair.
DATE_FRAGMENTS = ["nov", "dec", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "fr", "af", "ca"]
NOT_PLACES = ["assistant", "director", "manager", "officer", "specialist", "internship", "consultant", "professional", "deputy", "senior", "junior", "statistical", "communications", "methodologies", "education", "project", "general", "service", "contract", "national"]
PLACES = {"paris": "Paris, France", "montreal": "Montreal, Canada", "kabul": "Kabul, Afghanistan", "cairo": "Cairo, Egypt", "geneva": "Geneva, Switzerland", "bangkok": "Bangkok, Thailand", "dhaka": "Dhaka, Bangladesh", "beijing": "Beijing, China", "tashkent": "Tashkent, Uzbekistan", "apia": "Apia, Samoa", "santiago": "Santiago, Chile", "erbil": "Erbil, Iraq", "suva": "Suva, Fiji", "almaty": "Almaty, Kazakhstan", "perugia": "Perugia, Italy", "moscow": "Moscow, Russia"}
DOMAIN_PLACES = [(["paris", "france"], "Paris, France"), (["montreal", "canada"], "Montreal, Canada"), (["geneva", "switzerland"], "Geneva, Switzerland")]
ORG_PLACES = [("unesco", "Paris, France"), ("undp", "New York, USA"), ("unicef", "New York, USA"), ("who", "Geneva, Switzerland")]
PLACE_PATTERNS = [r"([A-Z][a-zA-Z\s]+),\s*([A-Z][a-zA-Z\s]+)", r"([A-Z][a-zA-Z\s]+)\s+([A-Z]{2,3})"]
# Levels from titles: (level, words, words that exclude it).
LEVEL_RULES = [
    ("Entry / Intern", ["intern", "internship", "trainee", "graduate", "entry-level", "entry level"], ["senior", "chief", "head", "director", "manager", "lead", "principal"]),
    ("Junior / Associate", ["junior", "entry", "assistant", "associate", "coordinator"], ["senior", "chief", "head", "director", "manager", "lead", "principal", "specialist", "advisor"]),
    ("Officer / Professional", ["officer", "professional", "analyst", "representative"], ["senior", "chief", "head", "director", "manager", "lead", "principal", "specialist", "advisor"]),
    ("Specialist / Advisor", ["specialist", "advisor", "adviser", "expert", "consultant", "technical advisor"], ["senior", "chief", "head", "director", "manager"]),
    ("Manager / Senior Manager", ["manager", "senior manager", "program manager", "project manager", "deputy"], ["chief", "head", "director", "executive"]),
    ("Head / Director", ["head", "director", "deputy director", "country director", "regional director", "program director"], ["chief", "executive", "president"]),
    ("Executive / Chief", ["chief", "executive", "president", "vice president", "vp", "ceo", "cto", "cfo", "country representative"], []),
]
LEVEL_SHIFTS = {"senior": 1, "lead": 1, "principal": 1, "chief": 2, "head": 2, "executive": 2, "deputy": 0, "assistant": -1, "junior": -1, "entry": -1}
LEVEL_OF_EXPERIENCE = {"Early / Junior": "Junior / Associate", "Officer / Associate": "Officer / Professional", "Specialist / Advisor": "Specialist / Advisor", "Manager / Senior Manager": "Manager / Senior Manager", "Head of Unit / Director": "Head / Director", "Expert / Technical Lead": "Specialist / Advisor"}
# Enrichment.
OPERATIONAL_ROLES = ["Finance, Accounting & Audit", "HR, Admin & Ops", "IT / Digital / Systems", "Logistics, Supply Chain & Procurement", "Communications & Advocacy"]
EVIDENCE_ROLES = ["MEAL / Research / Evidence", "Monitoring Officer / Field Monitoring", "Data & GIS"]
# Days between runs by type of organisation.
RUN_DAYS = {"un": 1, "ingo": 2, "ngo": 3, "academic": 7, "private": 5}
# Plain-query parsing.
REMOTE_WORDS = ["remote", "work from home", "wfh", "telecommute"]
QUERY_LEVELS = [
    (["entry", "junior", "early", "0-2", "0 to 2"], "Early / Junior (0–2 yrs)"), (["mid", "mid-level", "officer", "associate", "2-5", "2 to 5"], "Officer / Associate (2–5 yrs)"),
    (["senior", "specialist", "advisor", "5-8", "5 to 8"], "Specialist / Advisor (5–8 yrs)"), (["manager", "7-12", "7 to 12"], "Manager / Senior Manager (7–12 yrs)"),
    (["director", "head", "10+", "10 plus"], "Head of Unit / Director (10+ yrs)"), (["expert", "lead", "technical lead"], "Expert / Technical Lead (variable)"),
]
QUERY_DOMAINS = {"wash": "Water, Sanitation & Hygiene (WASH)", "water": "Water, Sanitation & Hygiene (WASH)", "sanitation": "Water, Sanitation & Hygiene (WASH)", "health": "Public Health & Primary Health Care", "education": "Education (Access & Quality)", "gender": "Gender Equality & Women's Empowerment", "protection": "Child Protection & Early Childhood Development", "shelter": "Shelter & CCCM", "nutrition": "Food Security & Nutrition", "food": "Food Security & Nutrition", "climate": "Climate & Environment", "disaster": "Disaster Risk Reduction & Preparedness", "migration": "Migration, Refugees & Displacement", "refugee": "Migration, Refugees & Displacement", "humanitarian": "Humanitarian Response & Emergency Operations", "meal": "Monitoring, Evaluation, Accountability & Learning (MEAL)", "monitoring": "Monitoring, Evaluation, Accountability & Learning (MEAL)"}
QUERY_ROLES = {"program": "Program & Field Implementation", "project manager": "Project Management", "pm": "Project Management", "meal": "MEAL / Research / Evidence", "monitoring": "Monitoring Officer / Field Monitoring", "data": "Data & GIS", "gis": "Data & GIS", "communications": "Communications & Advocacy", "grants": "Grants / Partnerships / Fundraising", "finance": "Finance, Accounting & Audit", "hr": "HR, Admin & Ops", "admin": "HR, Admin & Ops", "logistics": "Logistics, Supply Chain & Procurement", "procurement": "Logistics, Supply Chain & Procurement", "it": "IT / Digital / Systems", "digital": "IT / Digital / Systems", "security": "Security & Safety", "coordinator": "Program & Field Implementation", "officer": "Program & Field Implementation", "specialist": "Technical Specialists", "director": "Senior Leadership"}
QUERY_COUNTRIES = ["kenya", "nepal", "bangladesh", "ethiopia", "uganda", "tanzania", "somalia", "sudan", "yemen", "syria"]
# fmt: on
