"""Word lists, patterns and constants that results depend on.

Patterns are matched anywhere in white-space-normalised text, ignoring case, with Unicode classes,
unless said otherwise.
"""

from __future__ import annotations

# ---- Fixed values: keys of whole lines that are never titles ----
NEVER_TITLES = (
    "abstract", "introduction", "conclusion", "conclusions", "references", "bibliography", "acknowledgements",
    "acknowledgments", "acknowledgement", "acknowledgment", "appendix", "appendices", "methodology", "discussion",
    "results", "related work", "background", "keywords", "key words", "contents", "table of contents",
    "list of figures", "list of figure", "list of tables", "list of table", "list of abbreviations", "index", "on",
    "by", "to", "a", "i", "ii", "iii", "iv", "nomenclature", "notation", "preface", "foreword", "summary", "synopsis",
    "disclosure", "funding", "open access", "paper open access", "you may also like", "to cite this article",
    "view the article online", "view the article online for updates and enhancements", "research article",
    "review article", "original article", "original research", "regular paper", "research paper", "case study",
    "short communication", "technical note", "editorial", "guest editorial", "correspondence",
    "letter to the editor", "full length article", "available online", "accepted manuscript", "in press", "preprint",
    "not peer-reviewed", "peer reviewed", "copyright", "all rights reserved", "published by", "downloaded from",
    "creative commons", "conflict of interest", "author contributions", "data availability",
    "supplementary material", "supporting information", "highlights", "graphical abstract", "article info",
    "article history", "manuscript information", "easychair preprint", "manuscript info", "project report",
    "minor project report", "a project report submitted", "a case study report", "submitted by", "submitted to",
    "guided by", "project supervisor", "project guide", "internal guide", "external guide", "internal supervisor",
    "external supervisor", "supervisor", "co supervisor", "co-supervisor", "under the guidance",
    "under the guidance of", "open in app", "sign in", "sign up", "design steps", "design example",
    "learning resource center", "general guidelines", "aims and scope", "editorial board", "internal editor",
    "editor in chief", "bachelor of technology", "bachelor of engineering", "engineering and management",
    "of engineering", "of engineering management", "college of engineering", "institute of engineering",
    "bonafide certificate", "certificate", "certificate of approval", "certificate of authenticity",
    "certificate of originality", "certificate of completion", "examiner's certificate of approval",
    "examiners certificate of approval", "examiner s certificate of approval", "approval sheet",
    "approval certificate", "declaration", "candidate's declaration", "candidates declaration",
    "candidate s declaration", "student's declaration", "students declaration", "declaration of the student",
    "declaration of the candidate", "sr no name", "sr no", "sl no", "enrollment no", "enrolment no",
    "archive of sid ir", "archive of sid.ir", "scientific african", "irjet", "open", "master s degree thesis",
    "master's degree thesis",
)

# ---- Fixed values: left-overs of word processors, in lines and in metadata ----
GENERIC_TITLES = (
    "untitled", "untitled document", "document", "document1", "new document", "microsoft word",
    "microsoft word document", "presentation", "worksheet", "workbook", "layout 1", "layout1", "scan", "scanned",
    "unknown", "null", "none", "title", "paper", "draft", "final", "final draft", "report", "pdf", "export", "output",
    "file", "slide 1", "slide1", "cn report",
)

# ---- Fixed values: (pattern, reason) of lines that are no titles; the first match gives the reason ----
LINE_RULES = (
    (r"\bissn\b", "issn"),
    (r"\bisbn\b", "isbn"),
    (r"\bdoi\s*:?\s*10\.\d", "doi"),
    (r"\b10\.\d{4,9}/[-._;()/:a-z0-9]+", "doi"),
    (r"\barxiv\s*:?\s*\d", "arxiv"),
    (r"https?://", "url"),
    (r"\bwww\.", "url"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "email"),
    (r"\borcid\b", "orcid"),
    (r"available\s+online", "available_online"),
    (r"\bvol(?:ume)?\.?\s*\d+", "volume"),
    (r"\bno(?:\.|umber)?\s*\d+", "issue"),
    (r"\bissue\s*\d+", "issue"),
    (r"\bpp?\.?\s*\d+\s*[–-]\s*\d+", "pages"),
    (r"©|copyright\s+\d{4}", "copyright"),
    (r"all\s+rights\s+reserved", "copyright"),
    (r"\breceived\b.{0,40}\baccepted\b", "dates"),
    (r"^(received|accepted|revised|published|available)\s*[:.]?", "dates"),
    (r"date of submission|submitted date", "dates"),
    (r"corresponding\s+author", "corresponding_author"),
    (r"^(keywords|key\s*words)\s*[:.]", "keywords"),
    (r"^(abstract|summary|highlights)\s*[:.—\-]", "abstract_label"),
    (r"furnished to the author for internal non-commercial", "elsevier_cover"),
    (r"this article appeared in a journal published by", "elsevier_cover"),
    (r"author.?s personal copy", "elsevier_cover"),
    (r"sharing with colleagues", "elsevier_cover"),
    (r"selling or licensing copies", "elsevier_cover"),
    (r"posting to personal, institutional or third party", "elsevier_cover"),
    (r"other uses, including reproduction and distribution", "elsevier_cover"),
    (r"messages\.(studocu|downloaded_by|pdf_cover)", "studocu"),
    (r"lomoarcpsd", "studocu"),
    (r"not sponsored or endorsed", "studocu"),
    (r"archive of sid", "watermark"),
    (r"easychair preprint", "preprint_banner"),
    (r"see discussions, stats, and author profiles", "researchgate"),
    (r"openinapp|open in app", "browser_chrome"),
    (r"https?://medium\.com", "medium_chrome"),
    (r"\bmin\s*read\b", "medium_chrome"),
    (r"\|\s*by\s+.+\bMedium\b", "medium_chrome"),
    (r"\d{1,2}/\d{1,2}/\d{2,4}.+\bMedium\b", "medium_chrome"),
    (r"^a\s+project\s+report\b", "front_matter"),
    (
        r"^(?:the\s+)?(?:(?:internal|external|examiner'?s?|guide'?s?|supervisor'?s?|faculty|hod'?s?)\s+)?(?:bonafide\s+)?"
        r"certificate(?:\s*of\s*(?:approval|authenticity|originality|completion|bonafides?))?$",
        "front_matter",
    ),
    (r"^of\s+approval$", "front_matter"),
    (r"certificateof\s*approval", "front_matter"),
    (
        r"^(?:(?:candidate'?s?|student'?s?|author'?s?|project)\s+)?declaration(?:\s+of\s+the\s+(?:student|candidate|author))?$",
        "front_matter",
    ),
    (r"^this\s+is\s+to\s+certify\b", "front_matter"),
    (
        r"^(?:we|i)\s+(?:extend\s+our\s+thanks|express\s+our|would\s+like\s+to\s+thank|are\s+(?:highly\s+)?(?:thankful|grateful)|take\s+this\s+opportunity)",
        "acknowledgement",
    ),
    (r"\b(?:sincere|heartfelt|deep)\s+(?:thanks|gratitude|appreciation)\b", "acknowledgement"),
    (r"^kindly\s+providing\b", "acknowledgement"),
    (r"^(?:s(?:r|l)?|serial)\.?\s*no\.?(?:\s+name(?:\s+(?:enrollment|enrolment|roll|reg(?:istration)?)\.?\s*no\.?)?)?$", "table_header"),
    (r"^(?:enrollment|enrolment|roll)\s+no\.?$", "table_header"),
    (r"^(?:project\s+)?(?:co[-\s]?)?supervisor\b", "role_label"),
    (r"^(?:internal|external)\s+(?:guide|supervisor)\b", "role_label"),
    (r"^(?:project\s+)?guide\b", "role_label"),
    (r"^under\s+the\s+guidance\b", "role_label"),
    (r"^(course|section|group|semester)\s*[:\-]\s*.{0,48}$", "course_label"),
    (r"^(?:college\s+)?of\s+engineering\s*(?:&|and)\s*management$", "institution"),
    (r"^ud[cs]\s+", "classification"),
    (r"\bdergisi\b|\bzeitschrift\b", "journal_foreign"),
    (r"research journal$", "journal"),
    (r"all right reserved", "copyright"),
    (r"a journal produced by", "journal_cover"),
    (r"^(figure|fig\.?|table|eq(?:uation)?)\s*\d", "caption"),
    (r"contents lists available", "sciencedirect"),
    (r"\birjet\b", "journal"),
    (r"^scientific african$", "journal"),
    (r"journal homepage", "journal"),
    (r"creative\s+commons|cc[\s-]?by", "license"),
    (r"this\s+is\s+an\s+open\s+access", "open_access"),
    (r"you\s+may\s+also\s+like", "iop_chrome"),
    (r"paper\s*[•·\-]?\s*open\s+access", "iop_chrome"),
    (r"to\s+cite\s+this\s+article", "iop_chrome"),
    (r"view\s+the\s+article\s+online", "iop_chrome"),
    (r"this\s+content\s+was\s+downloaded\s+from", "iop_chrome"),
    (r"\biop\s+(?:publishing|conference series)\b", "publisher"),
    (r"downloaded\s+from", "download_banner"),
    (r"licensed\s+under", "license"),
    (r"\belsevier\b|\bspringer(?:\s+nature)?\b|\bwiley\b|\bsage\s+publications\b", "publisher"),
    (r"\bmdpi\b|\btaylor\s*&\s*francis\b|\binderscience\b|\biaeme\b", "publisher"),
    (r"peer[\s-]?review", "peer_review"),
    (r"manuscript\s+(id|number|received)", "manuscript"),
    (r"article\s+(in\s+press|history|info)", "article_info"),
    (r"\bsupplementary\s+(material|data|information)\b", "supplement"),
)

# ---- Fixed values: (pattern, reason) of venue lines ----
VENUE_RULES = (
    (r"\bjournal\s+of\b", "journal"),
    (r"\binternational\s+journal\b", "journal"),
    (r"\bproceedings\s+of\b", "proceedings"),
    (r"\btransactions\s+(on|of)\b", "transactions"),
    (r"\bconference\s+on\b", "conference"),
    (r"\bsymposium\s+on\b", "symposium"),
    (r"\bieee\b|\bacm\b|\basme\b|\bsae\b|\bsiam\b", "society"),
    (r"\bjournal\s+homepage\b", "journal"),
    (r"\bresearch journal\b", "journal"),
    (r"\bconference series\b", "journal"),
    (r"^iop\s+conference", "journal"),
    (r"^scientific reports$", "journal"),
)

# ---- Fixed values: single patterns ----
AFFILIATION = (
    r"\b(university|universit[eé]|universität|department|dept\.|institute|college|faculty|laboratory|laboratoire|school of|"
    r"center for|centre for|research center|research centre|gmbh|pvt\.?\s*ltd|inc\.|campus)\b"
)
NAME_LIST = (
    r"^[^\W\d_][\w.'’-]+(?:\s+[^\W\d_][\w.'’.-]+){0,4}"
    r"(?:\s*,\s*[^\W\d_][\w.'’-]+(?:\s+[^\W\d_][\w.'’.-]+){0,4}){1,}$"
)
NAME_LIST_PART = r"^\s*[^\W\d_][\w.'’-]+(?:\s+[^\W\d_][\w.'’.-]+){0,4}\s*$"
INSTITUTION = r"^(?:the\s+)?(?:national\s+|international\s+)?(?:university|institute|college|department|faculty|school)\b"
LABELLED_TITLE = r"^(?:project\s+titt?le|thesis\s+title|report\s+title|title)\s*[:\-]\s*(.+)$"
PRINT_CHROME_TITLE = r"\d{1,2}/\d{1,2}/\d{2,4}[^|]*\|\s*(.+?)\s*\|\s*by\s+"
COURSE_LINE = r"^(?:course|subject)\s*[:\-]\s*(.+)$"
COURSE_PREFIX = r"^(?:electrical\s+machines?|computer\s+networks|electronics|mechanical(?:\s+engineering)?|civil(?:\s+engineering)?)(?:\s+|$)"
COURSE_CODE = r"^[A-Z]{2,}\s*[-]?\s*\d{3,}\b"  # heeds case
COVER_PAGE = (
    r"furnished to the author for internal non-commercial|this article appeared in a journal published by|sharing with colleagues|"
    r"selling or licensing copies|posting to personal, institutional or third party|messages\.studocu|lomoarcpsd|"
    r"learning resource center|general guidelines"
)
SECTION_NUMBER = r"^(?:[\divxl]+)(?:\.\d+)*[.)]?\s+"
FILE_EXTENSION = r"\.(pdf|docx?|odt|rtf|txt|pptx?|xlsx?|html?|tex|zip)\b"
WORD_PROCESSOR = r"microsoft\s+word|libreoffice|openoffice|google\s+docs|adobe\s+acrobat|powerpoint|word\s*-\s*|pages\s+document"
FILE_PATH = r"^[a-z]:\\|\\\\|/users/|/home/|/tmp/"
SHARING_SITE = r"messages\.(studocu|downloaded)|lomoarcpsd|cn report"
CHROME_MARKER = r"you\s+may\s+also\s+like|paper\s*[•·\-]?\s*open\s+access|to\s+cite\s+this\s+article|iop\s+conference\s+series"
COVER_ROLE = (
    r"^(?:submitted\s+by|submitted\s+to|under\s+the\s+guidance|guided\s+by|prepared\s+by|presented\s+by|a\s+project\s+report|"
    r"in\s+partial\s+fulfill?ment)\b"
)
NOT_A_NAME, NOT_A_NAME_EITHER = ("of", "for", "with", "using", "from", "into", "on", "to", "by"), r"\band the\b"
VENUE_EXEMPT = r"\b(using|based|towards|toward|analysis|study|effect|impact|role|for)\b"
INTRODUCTION_TO = r"\bintroduction\s+to\b"

# ---- Fixed values: tests of names and affiliations; those that heed case say so ----
EMAIL = r"[\w.+-]+@[\w-]+\."
CORRESPONDING = r"\bcorresponding author\b"
CONJUNCTION = r"\b(and|&)\b"
TWO_NAMES = r"^[^\W\d_][\w.'’-]+(?:\s+[^\W\d_][\w.'’-]+){1,3}\s+(?:and|&)\s+[^\W\d_]"  # heeds case
MARKED_NAME = r"[^\W\d_][\w.'-]+(?:\s+[\w.'-]+){0,3}\s*[\d*†‡]+(?:\s*,\s*[^\W\d_])"  # heeds case
TWO_INITIALS = r"\b[A-Z]\.\s*[A-Z]\.\s*[A-Z][a-z]+"  # heeds case
NAME_TOKEN = r"^(?:[A-Z](?:\.[A-Z])+\.?|[A-Z]\.?|[A-Z]\.[A-Z][a-z]+|[A-Z][a-z]+\.[A-Z]\.?|[A-Z][a-z]{1,20}|[a-z]{3,20})$"  # heeds case
INITIALS = r"^(?:[A-Z](?:\.[A-Z])+\.?|[A-Z]\.)$"  # heeds case
HONORIFIC = r"\b(dr|prof|engr|mr|mrs|ms)\b"

# ---- Fixed values: tests of running text ----
FRAGMENT_OPENER = r"^(more than|of the|in the same|to compare|as well as|so it was)\b"
SENTENCE_SUBJECT = r"^(the|this|these|those|it|we|our)\s"
SENTENCE_OPENER = r"^(the|this|these|those|it|we|our|i)\s"
FIRST_PERSON = r"\bI successfully\b|\bwe successfully\b"
FIRST_PERSON_PAST = r"\bI\s+\w+ed\b"  # heeds case
THANKS = r"\b(thank|thanks|gratitude|extend|express|acknowledge)\b"
SENTENCE_PHRASE = r"\b(comprises|which will|in order to|is used for|include a)\b"
LABELLED_SENTENCE = r"^[A-Z][A-Z\s]+:\s*[-–]?\s*(it|this|the)\s+\w+"

# ---- Fixed values: reject reasons of single lines, in the order in which they are tried ----
DEPARTMENT = r"^department of\b"
TEACHING_PLACE = r"\b(university|college of engineering|institute of engineering)\b"
MONTH_YEAR = r"^[A-Za-z]+\s*,?\s*\d{4}$"  # heeds case
DEEP_HEADING, SUB_HEADING = r"^\d+(?:\.\d+){2,}[.)]?\s+\S", r"^\d+\.\d+[.)]?\s+\S"
DEFINITION = r":\s+(use of|using|this is|it is)\b"
LIST_ITEM = r"^\d+\.\s+[A-Z][a-z]"  # heeds case
ROMAN_HEADING = r"^(?:[ivxlcdm]{1,6}|[IVXLCDM]{1,6})\.\s+\S"  # heeds case
CHAPTER_KEY = r"^chapter\s+\d+(?:\s+introduction)?$"
INTRODUCTION = r"^(?:\d+(?:\.\d+)*[.)]?\s+)?introduction\b"
EDITOR = r"\b(internal editor|editor-in-chief|editorial board)\b"
DEGREE = r"\b(bachelor of|master of|partial fulfilment|partial fulfillment)\b"
TITLED_NAME = r"^(?:engr|dr|prof|mr|mrs|ms)\.?"
NO_PERMISSION = r"\bpermission\b.*\bprohibited\b"
NUMERIC = r"^[\d\s./:-]+$"

# ---- Fixed values: single-line tests of the merging folds ----
CONTACT = r"[\w.+-]+@[\w-]+\.|\bdepartment of\b|\bcorresponding author\b"
SUBMITTED = r"date of submission|submitted date|submitted on"
PROSE_OPENER = r"^(the|this|these|those|there|it|we|for)\s"
ID_CODE = r"\b[A-Z]{2,}\d{3,}/\d+"  # heeds case
NAME_PREFIX = r"^(?:engr|dr|prof|mr|mrs|ms)\.\s"
REPORT_KEY = "project report|final project"

# ---- Fixed values: word lists ----
TOPICAL = (
    "design", "analysis", "using", "based", "study", "effect", "investigation", "implementation", "framework",
    "system", "network", "project", "detection", "prevention", "optimization", "simulation", "experimental",
    "transformer", "machine", "bridge", "campus", "smart", "towards", "toward", "evaluation", "development",
    "performance", "removal", "dyeing", "refrigeration", "incubator", "monitoring", "protection", "construction",
    "scaling", "converter", "photovoltaic", "hospital", "cisco", "packet", "engine", "chamber", "combustion", "cfd",
    "nanofluid", "radiator", "compressor", "axial", "cleaner", "boiler", "harvester", "turbine", "gearbox", "mixer",
    "weeder", "thresher", "shredder", "dryer", "cutter", "condenser", "evaporator", "muffler", "impeller", "membrane",
    "chromium", "phosphate", "carrier", "liquid", "automatic",
)
DANGLING = (
    "a", "an", "the", "and", "or", "nor", "but", "of", "for", "in", "on", "to", "with", "by", "from", "as", "at",
    "via", "using", "into", "onto", "upon", "over", "under", "between", "among", "within", "without", "including",
    "plus", "versus", "vs",
)
FINITE_VERBS = (
    "is", "are", "was", "were", "been", "have", "has", "had", "include", "includes", "comprises", "will", "can", "may",
    "should", "does", "did", "plays", "play", "provides", "makes", "describes", "presents", "perform", "performs",
    "deployed", "successfully", "begins", "begin", "focuses", "depends", "consists", "gives", "relates",
)
NAME_NOUNS = (
    "networks", "network", "systems", "system", "african", "journal", "science", "computer", "electrical",
    "mechanical", "scientific", "international", "campus", "university", "transformer", "report", "project",
    "analysis", "design", "engineering", "technology", "college", "machine", "engines", "engine", "thermal", "fluid",
    "power", "plant", "automobile", "transfer", "dynamics", "machinery", "process", "processes", "elements",
    "element", "study", "studies", "review", "research", "institute", "department",
)
NAME_STOPS = ("and", "or", "the", "of", "for", "dr", "prof", "mr", "mrs", "ms", "engr")
SHORT_NAME_NOUNS = (
    "dust", "stone", "soil", "pump", "frame", "system", "network", "converter", "impeller", "bridge", "design",
    "project", "report",
)
SMALL_WORDS = ("a", "an", "the", "of", "and", "or", "for", "to", "in", "on", "by", "with", "from", "at", "vs")
FORMULA_SKIP = ("in", "an", "of", "to", "on", "or", "at", "by", "as", "if", "ic", "si", "ac", "dc", "vs")
ABSTRACT_KEYS = ("abstract", "summary", "highlights", "graphical abstract")
GENERIC_COURSES = ("computer networks", "electrical machine design", "electrical machines")
INTERRUPTERS = ("open", "open access", "research article", "original article")
VENUE_PENALTY = ("journal", "proceedings", "transactions", "conference", "symposium")
BOLD_HINTS = ("bold", "black", "heavy", "demibold", "semibold", "extrabold")
ITALIC_HINTS = ("italic", "oblique")

# ---- Fixed values: thresholds ----
MIN_METADATA_CHARS, MIN_WORDS, MAX_WORDS, SWEET_MIN, SWEET_MAX, MAX_MERGED_WORDS = 8, 2, 28, 3, 22, 28
SAME_SIZE_RATIO, SAME_SIZE_POINTS = 0.06, 0.75
HIGH_SCORE, MEDIUM_SCORE, HIGH_MARGIN, LEAST_SCORE = 58.0, 42.0, 7.0, 18.0
#: Weights of the signals, in the order in which they are added.
WEIGHTS = {
    "font_percentile": 22.0, "size_vs_body": 16.0, "bold": 5.0, "vertical": 10.0, "centering": 10.0, "isolation": 12.0,
    "word_count": 8.0, "capitalization": 5.0, "page_bias": 8.0, "before_abstract": 10.0, "above_authors": 14.0,
    "above_cover_role": 12.0, "prominence": 8.0, "starts_capital": 2.0,
}
PRIMARY_PAGES, SEARCH_PAGES = 4, 7
OCR_BUDGET_SEC, OCR_PAGES, OCR_MIN_TIMEOUT_SEC = 45.0, 3, 20.0
NATIVE_CHARS = 40
FRONT_CHARS, FRONT_CHARS_PER_PAGE, FRONT_FRACTION, SPARSE_CHARS = 1800, 500, 0.40, 120
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
