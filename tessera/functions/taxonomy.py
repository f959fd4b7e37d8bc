"""Career fields, families of roles, and words that tell skills from other phrases, stated as they are."""

from __future__ import annotations

from typing import NamedTuple


class CareerField(NamedTuple):
    label: str
    search: list[str]
    keywords: list[str]
    signals: list[str]


# --- fixed values: career fields with what is searched for, what marks a listing, and what marks a profile
FIELDS = {
    "aiml": CareerField(
        "AI / Machine Learning",
        ["machine learning engineer", "AI engineer", "ML engineer", "deep learning engineer", "NLP engineer", "LLM engineer"],
        ["ai", "ml", "aiml", "machine learning", "deep learning", "artificial intelligence", "nlp", "llm", "rag", "pytorch", "tensorflow", "langchain", "langgraph", "computer vision"],
        ["ai engineer", "ml engineer", "machine learning", "deep learning", "pytorch", "tensorflow", "langchain", "llm", "nlp", "aiml"],
    ),
    "data_science": CareerField(
        "Data Science",
        ["data scientist", "applied scientist", "research scientist"],
        ["data scientist", "data science", "applied scientist", "research scientist", "statistics", "machine learning", "scikit-learn"],
        ["data scientist", "data science", "applied scientist"],
    ),
    "data_analytics": CareerField(
        "Data Analytics / BI",
        ["data analyst", "business intelligence analyst", "analytics engineer", "bi developer"],
        ["data analyst", "business intelligence", "analytics engineer", "bi analyst", "tableau", "power bi", "looker", "sql"],
        ["data analyst", "business intelligence", "tableau", "power bi", "analytics"],
    ),
    "data_engineering": CareerField(
        "Data Engineering",
        ["data engineer", "analytics engineer", "etl developer"],
        ["data engineer", "etl", "spark", "airflow", "kafka", "snowflake", "databricks", "dbt", "pipeline"],
        ["data engineer", "etl", "spark", "airflow", "kafka", "dbt"],
    ),
    "backend": CareerField(
        "Backend Engineering",
        ["backend engineer", "python developer", "java developer"],
        ["backend", "back-end", "api", "microservices", "django", "flask", "fastapi", "node.js", "spring boot"],
        ["backend", "api developer", "django", "flask", "fastapi"],
    ),
    "frontend": CareerField(
        "Frontend Engineering",
        ["frontend engineer", "react developer", "ui developer"],
        ["frontend", "front-end", "react", "vue", "angular", "typescript", "javascript", "ui engineer"],
        ["frontend", "react", "vue", "angular", "ui developer"],
    ),
    "fullstack": CareerField(
        "Full Stack",
        ["full stack engineer", "fullstack developer"],
        ["full stack", "fullstack", "full-stack"],
        ["full stack", "fullstack", "full-stack"],
    ),
    "devops": CareerField(
        "DevOps / SRE",
        ["devops engineer", "site reliability engineer", "platform engineer"],
        ["devops", "sre", "site reliability", "kubernetes", "docker", "ci/cd", "terraform", "ansible"],
        ["devops", "sre", "kubernetes", "terraform", "ci/cd"],
    ),
    "mobile": CareerField(
        "Mobile Development",
        ["android developer", "ios engineer", "mobile developer"],
        ["android", "ios", "flutter", "react native", "kotlin", "swift", "mobile"],
        ["android", "ios", "flutter", "react native", "mobile developer"],
    ),
    "cloud": CareerField(
        "Cloud / Infrastructure",
        ["cloud engineer", "cloud architect", "infrastructure engineer"],
        ["aws", "gcp", "azure", "cloud engineer", "cloud architect", "infrastructure"],
        ["aws", "gcp", "azure", "cloud engineer", "cloud architect"],
    ),
    "qa": CareerField(
        "QA / Testing",
        ["qa engineer", "test automation engineer", "sdet"],
        ["qa engineer", "quality assurance", "test automation", "selenium", "sdet", "software tester"],
        ["qa", "test automation", "selenium", "sdet", "quality assurance"],
    ),
    "software": CareerField(
        "General Software",
        ["software engineer", "software developer"],
        ["software engineer", "software developer", "engineer", "developer"],
        [],
    ),
}

# --- fixed values: words of two letters and more that count as whole words though they are short
SHORT_TERMS = ["ai", "ml", "cv", "nlp", "llm", "rag", "qa", "ui", "ux"]

# --- fixed values: words that mark a technical title, and titles that are of another field than machine learning
TITLE_WORDS = ["engineer", "developer", "scientist", "analyst", "architect", "programmer", "intern", "graduate", "researcher", "tester"]
NOT_AIML_TITLES = [r"\bfrontend\b", r"\bquality\s+engineer\b", r"\bqa\s+engineer\b", r"\bfull[\s-]?stack\b", r"\brails\b", r"\bdevops\b", r"\bsre\b", r"\bproduct\s+engineer\b"]

# --- fixed values: roles near each other, and what puts a profile into a family
ROLE_FAMILIES = {
    "aiml": ["AI Engineer", "ML Engineer", "Machine Learning Engineer", "Data Scientist", "Data Analyst", "Data Engineer", "Analytics Engineer", "NLP Engineer", "Computer Vision Engineer", "MLOps Engineer", "Research Scientist", "Applied Scientist", "Business Intelligence Analyst", "Python Developer"],
    "data": ["Data Analyst", "Data Scientist", "Data Engineer", "Analytics Engineer", "Business Intelligence Analyst", "BI Developer", "ML Engineer"],
    "software": ["Software Engineer", "Backend Engineer", "Full Stack Developer", "Python Developer", "API Developer"],
}
AIML_MARKERS = ["pytorch", "tensorflow", "langchain", "langgraph", "llm", "machine learning", "deep learning", "nlp", "computer vision", "scikit", "sklearn", "xgboost", "huggingface", "transformers", "opencv", "rag", "ai engineer", "ml engineer", "aiml", "ai/ml"]
DATA_MARKERS = ["sql", "tableau", "power bi", "pandas", "numpy", "excel", "dbt", "snowflake", "spark", "analytics", "etl", "data analyst", "data scientist", "data engineer"]
TITLE_HINTS = ["ai engineer", "ml engineer", "machine learning", "data scientist", "data analyst", "data engineer", "nlp", "computer vision", "deep learning", "analytics engineer", "applied scientist", "research scientist", "mlops", "business intelligence"]

# --- fixed values: skills that are no search terms, and a catalog to fill up from
NOT_SEARCHED = ["communication", "teamwork", "leadership", "english", "hindi", "soft skills", "problem solving", "ms office"]
CATALOG = ["python", "sql", "pytorch", "tensorflow", "machine learning", "langchain", "pandas", "fastapi", "aws", "azure", "docker", "nlp", "tableau", "power bi", "scikit-learn", "opencv"]

# --- fixed values: phrases that are no technical skills
SOFT_PHRASES = [
    "communication", "communicate", "communicator", "english", "fluency", "fluent", "reliability", "reliable", "dependable",
    "self-organizational", "self-organisation", "self-organization", "organizational", "organisation", "organization", "team player",
    "teamwork", "collaborative", "collaboration", "passionate", "passion", "motivated", "self-motivated", "proactive",
    "detail-oriented", "details oriented", "culture fit", "cultural fit", "ownership", "accountability", "attitude", "mindset",
    "soft skill", "soft skills", "interpersonal", "written communication", "verbal communication", "problem solving",
    "problem-solving", "critical thinking", "time management", "multitask", "multi-task", "work ethic", "positive attitude",
    "fast learner", "quick learner", "independent", "autonomous", "self starter", "self-starter",
]
SALES_PHRASES = [
    "solution selling", "solutions selling", "pre-sales", "presales", "pre sales", "post-sales", "postsales", "post sales",
    "champion building", "champion-building", "partner enablement", "partner solutions", "account management", "account manager",
    "business development", "relationship building", "stakeholder management", "customer success", "quota", "pipeline", "evangelism",
    "evangelist", "gtm", "go-to-market", "go to market", "sales engineering activities", "selling skills", "sales methodology",
    "consultative selling", "opportunity management", "rfp", "proposal writing",
]
#: Phrases that are of sales even beside a product's name.
SALES_ALWAYS = ["selling", "champion", "pre-sales", "presales", "post-sales", "postsales", "enablement"]

# --- fixed values: products and languages, years asked for, and machine-learning work
TECH_TOKEN = (
    r"(?i)(?:sase|sse|ztna|casb|swg|python|java|kotlin|golang|go\b|rust|ruby|scala|typescript|javascript|node\.?js|react|vue|angular|fastapi|django|flask|"
    r"pytorch|tensorflow|keras|scikit|sklearn|xgboost|huggingface|aws|gcp|azure|databricks|snowflake|spark|kafka|airflow|docker|kubernetes|k8s|terraform|ansible|"
    r"mlflow|unity catalog|delta lake|dbt|tableau|power bi|postgresql|mysql|mongodb|redis|elasticsearch|langchain|langgraph|openai|llm|rag|nlp|opencv|c\+\+|sql|nosql|graphql|rest api)"
)
YEARS_GAP = r"(?i)\d+\s*\+?\s*years?|\bseniority\b|\bexperience\b.*\byears?\b"
AIML_WORK = r"(?i)\b(machine learning|deep learning|data scien|ml engineer|ai engineer|artificial intelligence|computer vision|nlp|llm|pytorch|tensorflow|aiml|ai/ml)\b"
SALES_WORDS = ["pre-sales", "presales", "sales engineer", "account executive"]

# --- fixed values: levels of experience in words
FRESH_LEVELS = ["fresher", "fresh graduate", "new grad", "student"]
LEVEL_RANGE = r"(\d+)\s*[-–]\s*(\d+)\s*years?"

# --- fixed values: spellings of cities in searches
CITY_SPELLINGS = {"delhi": "New Delhi"}
