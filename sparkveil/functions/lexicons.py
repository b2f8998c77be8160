"""Fixed values of the engine: word lists, patterns and repair tables.

They define the results and are stated as they must be.
"""

# Cities, country names and neighbourhoods, matched with case.
CITIES = [
    "Tirana", "Tiranë", "Tirane", "Durrës", "Durres", "Vlorë", "Vlore", "Shkodër", "Shkoder", "Elbasan", "Korçë", "Korce", "Fier", "Berat",
    "Lushnjë", "Pogradec", "Kavajë", "Gjirokastër", "Sarandë", "Saranda", "Koplik", "Lezhë", "Kukës", "Përmet", "Permet", "Bual", "Tropojë",
    "Prishtinë", "Pristina", "Prizren", "Peja", "Albania", "Albanian", "Shqipëri", "Shqiperi",
    "Kombinat", "Astir", "Zogu i Zi", "Komuna e Parisit", "Blloku", "21 Dhjetori", "Don Bosko", "Lapraka",
]

# First names and last names, lower case.
FIRST_NAMES = [
    "astrit", "qerime", "blerina", "zgjatje", "ardit", "besnik", "bujar", "dritan", "edmond", "endrit", "enver", "fatmir", "florian", "gentian",
    "ilir", "jorgo", "klodian", "luan", "mentor", "petrit", "saimir", "agim", "albert", "alfred", "altin", "armand", "arben", "arta",
    "blerta", "diana", "drita", "edi", "elona", "ermal", "fatos", "festim", "gentiana", "halil", "ilirjana", "klodiana", "lindita",
    "manjola", "merita", "miranda", "nora", "olta", "pranvera", "rezarta", "sara", "shpresa", "valbona", "vera", "vjollca", "yllka",
    "eliona", "ardian", "migena", "arber", "arbër", "mirela",
]
LAST_NAMES = [
    "patozi", "dallku", "koçi", "koci", "ndregjoni", "hoxha", "hoxhaj", "krasniqi", "berisha", "kelmendi", "shehu", "sula", "frashëri",
    "frasheri", "gjoni", "marku", "kola", "luka", "leka", "leska", "noli", "rexhepi", "selmani", "tafa", "veliu", "xhafa", "ymeri",
    "zeneli", "shkurti", "braho", "metaçi", "metaci", "kodra",
]

# Organisation suffixes (patterns), keywords, and what marks an address.
ORG_SUFFIXES = [r"sh\.?p\.?k\.?", r"sh\.?a\.?", r"L\.?L\.?C\.?", r"Ltd\.?", r"Inc\.?", r"S\.?p\.?A\.?", r"GmbH"]
ORG_KEYWORDS = [
    "bank", "banka", "telecom", "albtelecom", "credins", "raiffeisen", "intesa", "abi", "tirana", "alpha", "bkt", "kombetare", "kombëtare",
    "softec", "century", "imobiliare", "consult", "konsult", "solutions", "albania", "shqiperi", "shqipëri", "albasoft", "ict",
    "bashkia", "ministria", "ministry", "qkb", "ashk", "drejtoria", "spitali", "spitalit", "prefektura",
]
ADDRESS_WORDS = ["rruga", "pall.", "pallati"]
EDUCATION_KEYWORDS = ["university", "universiteti", "polytechnic", "politechnic", "gjimnazi", "shkolla", "fakulteti", "akademia", "instituti", "school", "academy", "institute", "college", "kolegji"]

# Patterns of the first layer, all without regard to case, in order of emission.
L1_PATTERNS = {
    "EMAIL": [r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"],
    "PHONE": [
        r"\+355\s?6[789]\s?\d{3}\s?\d{4}",
        r"\+355\s?\d{2}\s?\d{3}\s?\d{4}",
        r"\+355\d{7,10}",
        r"\b06[789][\s\-]?\d{3}[\s\-]?\d{4}\b",
        r"00\s?355\s?\d{2,3}\s?\d{3}\s?\d{4}",
    ],
    "URL": [
        r"\b(?:https?://)?(?:www\.)?linkedin\.com/in/[\w\-]+",
        r"\b(?:https?://)?(?:www\.)?github\.com/[\w\-/]+",
        r"\b(?:https?://)?[\w\-]+\.(?:com|al|org|net|io|dev|eu)(?:/[\w\-/]*)?",
    ],
    "DOB": [
        r"\b\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December"
        r"|Janar|Shkurt|Mars|Prill|Maj|Qershor|Korrik|Gusht|Shtator|Tetor|Nëntor|Dhjetor)\s+\d{4}\b",
        r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}\b",
    ],
    "AL_NID": [r"\b[A-Z]\d{8}[A-Z]\b"],
    "PASSPORT": [r"\b[A-Z]{2}\d{6,8}\b"],
    "IBAN": [r"\bAL\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b"],
}
#: The full length of an Albanian IBAN (8 digits and 16 letters or digits after the check digits), for the strict option.
STRICT_IBAN = r"\bAL\d{2}(?:\s?[A-Z0-9]{4}){6}\b"

# Personal facts, without regard to case.
PERSONAL_PATTERNS = {
    "MARITAL": [r"\b(?:Single|Married|Divorced|Widowed|i\s+martuar|beqar|beqare|i\s+divorcuar|i\s+ve)\b", r"Marital\s+status\s*[:\.]?\s*(\w+)"],
    "GENDER": [
        r"\bGender\s*[:\.]?\s*(Male|Female|Mashkull|Femër|Femer)\b",
        r"\bSex\s*[:\.]?\s*(M|F|Male|Female)\b",
        r"(?<=\n)(Male|Female|Mashkull|Femër|Femer)(?=\s*\n)",
    ],
    "RELIGION": [r"\bReligion\s*[:\.]?\s*\w+", r"\b(?:Muslim|Christian|Catholic|Orthodox|Protestant|Jewish|Muslim|Atheist|Bektashi)\b"],
    "FAMILY": [r"\b\d+\s+(?:children|kids|fëmijë)\b", r"\b(?:single\s+parent|prind\s+i\s+vetëm)\b"],
}

# Patterns of the heuristic recogniser.
ADDRESS = r"\b(?:Rruga|Rr\.?)\s+[^\n,]+(?:,\s*[^\n,]+){0,4}"
PERSON_NAME = r"\b[A-ZÇËÄ][a-zçëä]+(?:[-'][A-ZÇËÄ][a-zçëä]+)?(?:\s+[A-ZÇËÄ][a-zçëä']+){1,3}\b"
ORG_BEFORE_SUFFIX = r"\b[A-Z][\w\-&.\s]{2,40}\s+"
TITLE_PHRASE = r"\b[A-Z][\w&]{2,}(?:\s+(?:[A-Z][\w&]{1,}|[a-z]{2,3}\.?|of|the|de|al))?(?:\s+[A-Z][\w&]{2,})?(?:\s+[A-Z][\w&]{2,})?\b"
EDUCATION = r"\b(?:{keyword})\s+(?:of\s+|i\s+|e\s+|'[^']+'\s*)?[\w\s,\-']{{3,80}}?(?=\s*[—,|\n])"
HEADER_TOKEN = r"^[A-ZÇËÄ][a-zA-ZçëäÇËÄ'\-]+$"

# Words that count as real in the extraction score, besides all of three letters or more.
SHORT_WORDS = ["me", "my", "in", "of", "to", "an", "is", "it", "as", "at", "by", "on", "or", "be", "do", "if", "we", "he", "ne", "te", "si", "ku", "ka"]

# Labels of a named-entity model and the types they stand for.
MODEL_LABELS = {
    "person name": "PERSON", "full name": "PERSON", "email address": "EMAIL", "phone number": "PHONE", "home address": "ADDRESS", "street address": "ADDRESS",
    "city": "LOCATION", "country": "LOCATION", "date of birth": "DOB", "nationality": "LOCATION", "linkedin profile": "URL", "github profile": "URL",
    "id number": "ID_NUMBER", "passport number": "ID_NUMBER", "organisation": "ORG", "company": "ORG", "school": "ORG", "university": "ORG",
}

# Types of tokens, and those the sanitiser removes.
TOKEN_TYPES = ["PERSON", "EMAIL", "PHONE", "ADDRESS", "DOB", "AL_NID", "PASSPORT", "ID_NUMBER", "IBAN", "MARITAL", "GENDER", "RELIGION", "FAMILY", "LOCATION", "URL", "ORG"]
REMOVED_TYPES = TOKEN_TYPES[:13]

# Field labels that go with their values (without regard to case).
FIELD_LABELS = [r"Date\s+of\s+birth\s*:?\s*", r"Phone\s+(?:number|no\.?)\s*:?\s*", r"Email\s+address\s*:?\s*", r"\bE-?mail\b\s*:?\s*", r"\(\s*Mobile\s*\)\s*"]
# What is left of a word after a token that swallowed its start, and the word.
SUFFIX_REPAIR = {
    "lude": "include", "luded": "included", "ludes": "includes", "luding": "including", "ome": "income", "omes": "incomes",
    "rease": "increase", "reased": "increased", "reases": "increases", "reasing": "increasing", "orate": "corporate", "oration": "corporation",
    "orations": "corporations", "gorithm": "algorithm", "gorithms": "algorithms", "chelor": "bachelor", "red": "shared", "ring": "sharing",
}
# Names of organisations that are tools; they are restored.
TECH_TOOLS = [
    "snowflake", "databricks", "dbt", "apache spark", "spark", "hadoop", "hive", "kafka", "apache kafka", "airflow", "apache airflow",
    "airbyte", "fivetran", "talend", "informatica", "snowpark", "snowpipe", "aws", "azure", "gcp", "google cloud", "amazon web services",
    "azure devops", "azure data factory", "azure blob", "azure blobs", "github", "gitlab", "jenkins", "docker", "kubernetes", "terraform",
    "git", "vscode", "vs code", "oracle", "postgresql", "postgres", "mysql", "mongodb", "redis", "elasticsearch", "cassandra", "teradata",
    "sql server", "microsoft sql server", "db2", "tableau", "power bi", "qlik", "qlik sense", "qlik compose", "qlik replicate", "looker",
    "metabase", "superset", "ssrs", "ssis", "ssas", "microsoft ssis", "microsoft ssrs", "salesforce", "sap", "dynamics", "dynamics 365",
    "hubspot", "workday", "prefect", "dagster", "mlflow", "kubeflow", "power automate", "power apps", "spss", "stata", "matlab", "r studio",
    "jira", "confluence",
]
UNIVERSITY_WORDS = ["university", "universiteti", "college", "kolegji", "polytechnic", "politechnic", "faculty", "fakulteti", "school of", "shkolla", "academic"]
TRAINING_WORDS = ["training", "institute", "instituti", "academy", "akademia", "centre", "center", "certification", "professional development", "association of", "chamber of"]
EDUCATION_SECTIONS = ["education", "qualifications", "academic background", "education and training"]
TRAINING_SECTIONS = ["certifications", "certification", "training", "courses", "course", "professional development"]
SECTION_HEADER = (
    r"(?:EDUCATION(?:\s+AND\s+TRAINING)?|CERTIFICATIONS?|TRAINING|COURSES?|QUALIFICATIONS?|WORK EXPERIENCE|EXPERIENCE|EMPLOYMENT|PROFESSIONAL SUMMARY|SUMMARY"
    r"|REFERENCES?|SKILLS?|LANGUAGES?|PERSONAL INFORMATION|DIGITAL SKILLS)"
)
# Places, employers, persons and training platforms masked by name.
PLACES = [
    "Grand Canyon", "Arizona", "United States", "Skopje", "North Macedonia", "Luxembourg", "Budapest", "Hungary", "Chicago", "Illinois", "Vienna", "Austria",
    "Prague", "Czech Republic", "Brussels", "Belgium", "Amsterdam", "Netherlands", "Paris", "France", "Berlin", "Germany", "Rome", "Italy", "Madrid", "Spain",
    "Warsaw", "Poland", "Bucharest", "Romania", "Belgrade", "Serbia", "Sarajevo", "Podgorica", "Pristina", "United Kingdom",
]
EMPLOYERS = ["INSPIRE11", "XANTERRA PARKS & RESORTS", "XANTERRA", "REDCLIFFE", "ATTF", "GLC", "Semos Education", "Semos", "Okionomotekniki"]
PERSONS = ["Mark Andrews"]
TRAINING_PLATFORMS = ["Udemy"]

# Cheap tests, in lower case, that every match of a pattern passes: strings, or a plain pattern.
MONTHS = "january february march april may june july august september october november december janar shkurt mars prill maj qershor korrik gusht shtator tetor nëntor dhjetor".split()
GATES = {
    "EMAIL": [(["@"], None)],
    "PHONE": [(["355"], None)] * 3 + [([], "06[789]"), (["355"], None)],
    "URL": [(["linkedin.com/in/"], None), (["github.com/"], None), ([], r"\.(?:com|al|org|net|io|dev|eu)")],
    "DOB": [(MONTHS, None), ([], r"[/.\-]\P{ASCII}?\d|\d[/.\-]|[/.\-][0-9]")],
    "AL_NID": [([], r"(?U)\d{8}")],
    "PASSPORT": [([], r"(?U)\d{6}")],
    "IBAN": [([], r"(?U)al\d")],
    "MARITAL": [(["single", "married", "divorced", "widowed", "martuar", "beqar", "divorcuar"], r"i[\s\P{ASCII}]+ve"), (["marital"], None)],
    "GENDER": [(["gender"], None), (["sex"], None), (["male", "mashkull", "fem"], None)],
    "RELIGION": [(["religion"], None), (["muslim", "christian", "catholic", "orthodox", "protestant", "jewish", "atheist", "bektashi"], None)],
    "FAMILY": [(["children", "kids", "fëmijë"], None), (["parent", "prind"], None)],
}
