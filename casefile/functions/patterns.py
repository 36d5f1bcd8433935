"""Regular expressions and word lists of the citation rules (fixed values).

Word boundaries are written as ASCII look-arounds: the rules know no other letters, and the
meaning of ``\\b`` for accented letters differs between Java versions.
"""

# Characters that count as white space.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE_CHARACTERS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
START = r"(?<![A-Za-z0-9_])"
END = r"(?![A-Za-z0-9_])"

# Months, stop words, nouns that name a document, title abbreviations.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
STOP_WORDS = [
    "about", "after", "again", "also", "been", "being", "copy", "dated", "document",
    "exhibit", "exhibited", "from", "have", "into", "northbridge", "meridian", "that",
    "their", "there", "these", "this", "those", "under", "were", "which", "with", "would",
]
NOUN = (
    r"(?:purchase\s+orders?|email\s+chains?|appendices|appendix|contracts?|agreements?|emails?"
    r"|invoices?|letters?|reports?|notices?|minutes|schedules?|spreadsheets?|workbooks?|replies|reply)"
)
LEDGER_NOUN = rf"(?:{NOUN}|ledgers?)"
ABBREVIATION = "(?:Dr|Mr|Mrs|Ms|Prof|Sr|Jr|No|Nos|vs|etc|Inc|Ltd|Co|v)"
NOT_OBJECT = "(?:importance|significance|weight|value|condition|priority|blame|liability)"
NOT_MODIFIER = ["and", "to", "of", "for", "with", "from", "the", "a", "an"]

DATE = rf"\d{{1,2}}\s+(?:{MONTHS})(?:\s+\d{{4}})?"
DOCUMENT_NOUN = rf"(?i){START}{NOUN}{END}"
CLAUSE_BREAK = rf"(?<=[.!?])(?<!{START}{ABBREVIATION}\.)\s+"

# Shapes of a citation inside brackets.
BRACKETS = r"\[[^\[\]()]{1,240}\]|\([^\[\]()]{1,240}\)"
PAGE_TOKEN = (
    r"(?i)^([A-Z]{1,8})\s*(?:-|–|—)?\s*(\d{1,4})\s*/\s*(\d{1,5}|xx)"
    r"\s*(?:-|–|—)?\s*(\d{1,5}|xx)?$"
)
SQUARE_TOKEN = (
    r"(?i)^(?:exhibit|exhib(?:it)?\s*x{1,4}"
    r"|[A-Z][A-Z0-9._ ]{0,23}\s*(?:-|[–—]|\s+)\s*(?:x{1,4}|\d{1,3}|[A-Z])"
    r"|[A-Z]{1,8}(?:[\s-]*x{1,4}|\d{1,3}))$"
)
ROUND_PLACEHOLDER = r"(?i)^(?:exhibit|exhib(?:it)?\s*x{1,4})$"
ROUND_MARK = r"(?i)^([A-Z]{2,8})(?:[\s-]*(x{1,4}|\d{1,3}))$"
ROUND_ASIDE = (
    r"(?i)^(?:para|paras|page|pages|pp|p|clause|item|vol|volume|section|annex|table|fig|figure|sch|no|nos|covid"
    r"|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|q|h|fy)$"
)

# Wording that signals a citation.
REFER = rf"(?i){START}I refer to{END}"
IS_EXHIBITED = rf"(?i){START}(?:is|are)\s+(?:exhibited|at exhibit){END}"
COPY_AT_EXHIBIT = rf"(?i){START}copy of{END}.{{0,220}}{START}(?:is|are)\s+(?:at\s+)?exhibit(?:ed)?{END}"
COPY_EXHIBIT = rf"(?i){START}copy of{END}.{{0,220}}{START}(?:exhibit|exhibited){END}"
EXHIBIT_WORD = rf"(?i){START}(?:exhibit|exhibited|marked){END}"
MARKED_AS = (
    rf"(?i){START}(?:exhibited|marked)\s+(?:together\s+)?(?:to this statement\s+)?(?:as|at){END}"
)
PASSIVE_ATTACH = (
    rf"(?i){START}{NOUN}{END}\s+(?:is|are|was|were)\s+(?:hereby\s+)?(?:attached|enclosed|appended)"
    r"(?:\s+(?:hereto|herewith|to this statement))?(?:[.,;:]|$)"
)
ACTIVE_ATTACH = rf"(?i){START}(?:I|we)\s+(?:hereby\s+)?(?:attach|enclose|append)(?:ed|ing)?{END}(.*)$"
AND_TO_THE = rf"(?i){START}and\s+to\s+the{END}"


def mark(prefix: str = "AH") -> str:
    """A written mark of the statement's own prefix, such as ``AH 12``."""
    return rf"(?i){START}{prefix}\s*(\d{{1,9}}){END}"


def placeholder_mark(prefix: str = "AH") -> str:
    return rf"(?i){START}{prefix}\s*xx{END}"


# Ordered description rules (needs all keywords of one alternative, label).
# ``{date}`` stands for the document date.
DESCRIPTION_RULES = [
    ([["sample agreement"]], "Sample agreement"),
    ([["sample invoice"]], "Sample invoice"),
    ([["sample project report"]], "Sample project report"),
    ([["sample claimant email"]], "Sample claimant email"),
    ([["sample cost workbook"]], "Sample cost workbook"),
    ([["purchase order"]], "Purchase Order NRL-1047"),
    ([["termination letter"], ["terminated"]], "Notice of Termination"),
    ([["quality-warning"], ["thermal shutdown"]], "Quality-warning email chain - {date}"),
    ([["component shortage"], ["processor supply"], ["shortage", "email"]], "Processor supply email chain - {date}"),
    ([["delivery dates"], ["email", "delivery"]], "Delivery assurance email chain - {date}"),
    ([["progress meeting"], ["minutes"]], "Progress Meeting Minutes"),
    ([["notice of delay"]], "Formal Notice of Delay"),
    ([["inspection report"]], "Verity Independent Inspection Report"),
    ([["invoice"]], "Apex Controls Invoice AC-7782"),
    ([["supply agreement"]], "Executed Supply Agreement"),
    ([["email"]], "Email chain - {date}"),
]
DESCRIPTION_DEFAULT = "Document referred to at {date}"
NO_DATE = "Date not stated"
