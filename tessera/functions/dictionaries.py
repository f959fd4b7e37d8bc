"""Word lists and tables that results depend on, stated as they are."""

from __future__ import annotations

# --- fixed values: enterprise stacks that only matter to those who list them
ENTERPRISE_STACKS = ["abap", "sap", "mainframe", "cobol", "peoplesoft", "workday", "salesforce admin", "dynamics 365"]

# --- fixed values: aliases of skill words
SKILL_ALIASES = {
    "ml": ["machine learning", "machine-learning"],
    "ai": ["artificial intelligence"],
    "nlp": ["natural language processing", "natural language"],
    "cv": ["computer vision"],
    "dsa": ["data structures", "algorithms"],
    "llm": ["large language model", "large language models"],
    "rag": ["retrieval augmented", "retrieval-augmented"],
    "js": ["javascript"],
    "ts": ["typescript"],
    "py": ["python"],
    "k8s": ["kubernetes"],
    "kube": ["kubernetes"],
    "postgres": ["postgresql"],
    "mongo": ["mongodb"],
    "tf": ["tensorflow"],
    "pt": ["pytorch"],
    "react.js": ["react"],
    "reactjs": ["react"],
    "node.js": ["nodejs", "node"],
    "next.js": ["nextjs"],
    "vue.js": ["vue"],
    "langchain": ["lang graph", "langgraph"],
    "fastapi": ["fast api"],
    "scikit-learn": ["sklearn"],
}

# --- fixed values: skills that count as related
SKILL_RELATED = {
    "react": ["javascript", "typescript", "frontend", "next.js", "nextjs"],
    "pytorch": ["python", "deep learning", "machine learning", "ml"],
    "tensorflow": ["python", "deep learning", "machine learning", "ml"],
    "langchain": ["python", "llm", "rag", "langgraph"],
    "fastapi": ["python", "rest", "api", "backend"],
    "django": ["python", "backend", "web"],
    "kubernetes": ["docker", "devops", "cloud"],
    "aws": ["cloud", "devops", "ec2", "s3"],
    "sql": ["postgresql", "mysql", "database"],
}

# --- fixed values: words that mark a technical role
TECH_ROLE_WORDS = ["engineer", "developer", "analyst", "scientist", "architect", "programmer", "mlops"]

# --- fixed values: words that mark a remote place
REMOTE_TERMS = ["remote", "anywhere", "work from home", "wfh", "distributed", "worldwide"]

# --- fixed values: cities as (name, aliases, region, region aliases, country, country aliases)
INDIA = ["india", "in", "bharat"]
CITIES = [
    ("bengaluru", ["bangalore", "blr", "bangalore urban", "bengaluru urban"], "karnataka", ["ka"], "india", INDIA),
    ("mumbai", ["bombay", "bom"], "maharashtra", ["mh"], "india", INDIA),
    ("delhi", ["new delhi", "ncr", "delhi ncr", "national capital region"], "delhi", ["new delhi", "nct"], "india", INDIA),
    ("hyderabad", ["hyd"], "telangana", ["andhra pradesh", "ap"], "india", INDIA),
    ("chennai", ["madras"], "tamil nadu", ["tn"], "india", INDIA),
    ("kolkata", ["calcutta"], "west bengal", ["wb"], "india", INDIA),
    ("pune", ["poona"], "maharashtra", ["mh"], "india", INDIA),
    ("gurugram", ["gurgaon"], "haryana", ["hr", "ncr", "delhi ncr"], "india", INDIA),
    ("noida", ["greater noida"], "uttar pradesh", ["up", "ncr", "delhi ncr"], "india", INDIA),
    ("jaipur", [], "rajasthan", [], "india", INDIA),
    ("ahmedabad", ["amdavad"], "gujarat", ["gj"], "india", INDIA),
    ("kochi", ["cochin"], "kerala", ["kl"], "india", INDIA),
    ("thiruvananthapuram", ["trivandrum"], "kerala", [], "india", INDIA),
    ("chandigarh", ["mohali"], "chandigarh", [], "india", INDIA),
    ("indore", [], "madhya pradesh", ["mp"], "india", INDIA),
    ("lucknow", [], "uttar pradesh", ["up"], "india", INDIA),
    ("coimbatore", [], "tamil nadu", ["tn"], "india", INDIA),
    ("visakhapatnam", ["vizag"], "andhra pradesh", ["ap"], "india", INDIA),
    ("san francisco", ["sf", "bay area"], "california", ["ca", "california"], "united states", ["usa", "us", "united states", "america"]),
    ("new york", ["nyc", "new york city"], "new york", [], "united states", ["usa", "us", "united states"]),
    ("london", ["greater london"], "england", [], "united kingdom", ["united kingdom", "uk", "u.k", "britain", "great britain"]),
    ("toronto", [], "ontario", [], "canada", ["canada", "ca"]),
    ("singapore", [], "", [], "singapore", ["singapore", "sg"]),
]

# --- fixed values: patterns of pages that ask for proof of a human
CHALLENGE_PATTERNS = [
    r"\bcaptcha\b",
    "recaptcha",
    "hcaptcha",
    "cf-challenge",
    "challenge-platform",
    "attention required",
    "just a moment",
    "verify you are (a )?human",
    "are you a robot",
    "enable javascript and cookies",
    "access denied",
    "/cdn-cgi/challenge",
]

# --- fixed values: tier names, and how far a candidate's tier reaches up and down
TIER_LABELS = ["Intern / Fresher", "Junior / Entry", "Mid-level", "Senior", "Lead / Staff", "Executive"]
TIERS_ABOVE = {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}
TIERS_BELOW = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}

# --- fixed values: years of experience in a text
YEARS_REQUIRED = r"(?i)(?:minimum|min\.?|at least|requires?|must have)\s*(\d+)\+?\s*years?"
YEARS_EXPERIENCE = r"(?i)(\d+)\+?\s*years?\s+(?:of\s+)?(?:relevant\s+)?experience"
YEARS_PLUS = r"(?i)\b(\d+)\s*\+\s*years?\b"
YEARS_RANGE = r"(?i)\b(\d+)\s*[-–]\s*(\d+)\s*years?\b"

# --- fixed values: title words by tier
EXECUTIVE_WORDS = ["executive", "vp", "vice president"]
LEAD_WORDS = ["principal", "staff", "tech lead", "director", "head of", "lead"]
SENIOR_WORDS = ["senior", "sr", "architect"]
ENTRY_PATTERN = r"\b(intern|internship|trainee|junior|jr|entry[\s-]?level|associate|graduate|new grad|fresher|entry)\b"
LEADERSHIP_PATTERN = r"\b(principal|staff|director|vp|vice president|head of|partner|lead)\b"
SALES_PATTERN = (
    r"(?i)\b(pre[\s-]?sales|post[\s-]?sales|sales engineer|solutions? engineer|partner solutions|solution selling|"
    r"account executive|business development|customer success|sales manager)\b"
)

# --- fixed values: headers of listing sections, and inferred attributes
REQUIREMENTS_HEADER = r"(?i)^(?:requirements?|qualifications?|must have|what you.ll need|what we.re looking for|minimum qualifications?)\s*:?\s*$"
NICE_HEADER = r"(?i)^(?:nice to have|preferred qualifications?|bonus|pluses?)\s*:?\s*$"
RESUME_HEADER = r"(?i)^(?:experience|work experience|professional experience|employment|education|projects?|skills|technical skills|certifications?|summary|objective|about me)\s*:?\s*$"
REMOTE_POLICY = r"\b(fully remote|remote-first|hybrid|on-?site|office-based)\b"
EMPLOYMENT = r"\b(full[\s-]?time|part[\s-]?time|contract|internship|freelance)\b"

# --- fixed values: contacts
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4}"
URL = r"(?i)https?://[^\s<>]+|(?:linkedin\.com/in/\S+|github\.com/\S+)"

# --- fixed values: sources as (id, kind, safety, default_on)
SOURCES = [
    ("remotive", "api", "api", True),
    ("remoteok", "api", "api", True),
    ("arbeitnow", "api", "api", True),
    ("jobicy", "api", "api", True),
    ("himalayas", "api", "api", True),
    ("themuse", "api", "api", True),
    ("weworkremotely", "api", "api", True),
    ("workingnomads", "api", "api", True),
    ("wellfound", "browser", "scrape_risky", True),
    ("indeed", "browser", "scrape_risky", True),
    ("naukri", "browser", "scrape_risky", True),
    ("linkedin", "browser", "scrape_risky", True),
    ("glassdoor", "browser", "scrape_risky", True),
]

# --- fixed values: prefixes that embedding models expect
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
PASSAGE_PREFIX = "Represent this sentence for retrieving relevant jobs: "
