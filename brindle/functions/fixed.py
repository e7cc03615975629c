"""The patterns that screens must share with the corpora they were made for.

Each stands here once, whole, in the order in which its terms were published; a screen's
result depends on every term.  All ignore case unless said otherwise, and none looks behind.
``quoted`` makes a pattern part of SQL text.
"""

from __future__ import annotations

#: Topics and boilerplate that prose selection leaves out.
CODE_TOPIC = (
    r"(?i)```|\b(?:python|javascript|typescript|java|c\+\+|html|css|sql|bash|powershell|programming|programmers?|source code|pseudocode|coding|computer code|algorithms?|software development|"
    r"api|apis|github|debugging|compiler|command.line|web.scraping|regular expressions?|opencv|tensorflow|pytorch)\b|\b(?:def|class|import)\s+\w+\s*[:(]|=>|</?\w+>"
)
MATH_TOPIC = (
    r"(?i)\b(?:math(?:s|ematics|ematical)?|arithmetic|algebra|geometry|geometric|calculus|trigonometry|equations?|theorems?|polynomials?|logarithms?|probability|probabilities|statistical|"
    r"statistics|topology|numerical|fractions?|matrices|multiplication|division problems?|word problems?|calculate|calculating|calculations?|compute|computing|derivatives?|integrals?|"
    r"percentages?|quadratic|proofs?|square root)\b|\\(?:frac|sum|int|begin|sqrt|alpha|beta)\b|\d\s*[+*/=×÷]\s*\d|\b[a-z]\s*=\s*[-\d]"
)
BOILERPLATE = (
    r"(?i)\b(?:as an ai|as a language model|here is the rewritten|output only|subscribe to|accept all cookies|access denied|page not found|enable javascript|jump to navigation|join to answer|"
    r"full answer|already exists as an alternate|keep in touch with|clients are delighted)\b|^\s*To create\s*:|\bQ:\s*Q:"
)
#: A word of prose (case counts not), marks behind a last full stop, a mark of a list.
PROSE_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
CLOSING = "\"'”’)*_]"
LIST_MARK = r"(?im)^\s*(?:[-*•]|\d+[.)]|(?:\*\*)?Step\s+\d+)"

#: What plain-text conversations leave out, and arithmetic in them.
OUT_OF_SCOPE = (
    r"(?i)```|[{}]|\b(json|xml|yaml|sql|python|javascript|programming|algorithm|equation|algebra|calculus|arithmetic|calculate|multiplication|division|math|mathematics|percentage|percentages|"
    r"quadratic|statistics|dataset|spreadsheet|html|css|function|regex|coding|code|java|c\+\+|formula)\b|https?://|[=<>]"
)
SUMS = r"(?i)\d\s*[+*/=]\s*\d|\b(?:growth rate|sales by quarter|solve for|square root)\b"

#: What single turns are screened for.
BLOCKED = (
    r"(?i)```|https?://|<\|[^>]+\|>|\b(python|javascript|typescript|programming|coding|source code|function calling|sql|html|css|java|algorithm|api|debug|code snippet|github|linux|"
    r"terminal command|calculus|algebra|equation|arithmetic|calculate|calculation|mathematics|maths?|fractions?|trigonometry|ANOVA|multiply|multiplication|divide|division|derivative|integral|"
    r"probability|percent|percentage|interest rate|investment|diagnosis|dosage|prescription|lawsuit)\b|\d\s*[+*/=]\s*\d|\\(?:frac|sum|int)\b"
)
QUANTITIES = r"(?i)\b(how many|how much|compute|solve|mean, median|statistics|statistical|geometry|square root|mathematical|count the|prime number|theorem)\b"
MORE_MATH = (
    r"(?i)\b(exponent\w*|factorials?|logarithm\w*|polynomials?|quadratic|trigonomet\w*|integers?|decimals?|divisib\w*|numerator|denominator|subtraction|addition|matrices|matrix|permutation\w*|"
    r"probabilit\w*|correlation\w*|regression|quantitative|dataset|data set|mean|median|standard deviation|variance|average|ratios?|fractions?|total|inequality|inequalities|geometric|geometry|"
    r"algebra\w*|calculus|numerical|statistic\w*)\b|\d\s*[\^×÷+*/=]\s*[\d(]|[=<>]\s*[-+]?\d"
)
ROLEPLAY = r"(?i)\b(pretend|role.?play|you are (?:a|an|the) (?!AI|assistant)|time travel|imagine (?:you|that you)|act as (?:a|an)|playing the (?:part|role))\b"
BAD_RESPONSE = r"(?i)\b(as (?:an? )?(?:AI|language model)|I (?:grew up|was born|visited|live in|worked as)|today.s (?:weather|news)|current (?:price|president)|as of 20\d\d|latest news)\b"
SETUP = r"(?i)^(?:sure|of course|certainly|absolutely)[!.,:]?\s*(?:please|could you|can you|what (?:would|do)|provide|share|tell me)"
ROLE_MARK = r"(?i)(^|\n)\s*(?:User|Assistant|System|Human|AI):"
PERSONA = (
    r"(?i)\b(?:(?:play|playing|assume|adopt|take on) (?:the |a |an )?(?:role|part|persona)|you(?: are|'re| will be| should be) (?!free\b|able\b|welcome\b)|want you to be|"
    r"your (?:role|character|background) (?:is|will)|in character)\b"
)
MEDICAL = r"(?i)\b(patient|patients|cancer|tumou?r|syndrome|diagnos\w*|therap\w*|treatment|medication|antibiotic|diarrhea)\b"
LIVE = r"(?i)\b(forecast|our area|tonight.s|current news|recent news|today.s news|weather today|weather tomorrow|stock price)\b|[$€£]\s*\d"
DRUGS = r"(?i)\b(drugs?|pharmac\w*|metabolites?|midazolam|CYP\w*)\b"
LOCAL_LIVE = r"(?i)\b(current|latest|weather|traffic|forecast|president|prime minister|mayor|prices?|costs?|news|nearby)\b|\bnear me\b"
REWRITING = r"(?i)\b(edit\w*|rewrit\w*|rephras\w*|gramma\w*|punctua\w*|refin\w*|polish\w*)\b"
PRONOUNS = r"(?i)\b(you|your|he|his|him|she|her|they|their|them|it|its)\b"
#: A signature under a letter; case counts.
SIGNED = r"[.!?][\s\S]*\n(?:Best(?: regards)?|Kind regards|Regards|Sincerely|Thanks),?\s*\n[\w .,-]{2,100}$"
LAST_MARKS = ".!?\"”’'):"
PLAIN_SYSTEM = ("You are a helpful AI assistant.", "You are a helpful assistant.")
NO_PRONOUNS, ONE_SENTENCE = "without using second or third person pronouns", "one very short sentence"
COMMITMENTS = ("agrees", "agreed", "confirmed", "scheduled")
KNOWN_NAMES = ("summary", "according", "following", "despite", "meanwhile", "however")

#: What answers of a base curriculum are screened for.
EDIT_FILLER = r"(?i)\b(?:I(?:'ve| have)? (?:made|changed|removed|replaced|added)|here(?:'s| is) (?:a|the) (?:revised|rephrased|edited)|these changes|suggested (?:edits|revision))\b"
FALSE_SELF = r"(?i)\b(?:I (?:learn|am learning|adapt|am trained) (?:from|through) (?:our|your|each)|constantly being trained|my (?:personal )?experience|I (?:remember when|have always loved))\b"
EDIT_REQUEST = r"(?i)\b(?:edit(?:ing|s)?|revis(?:e|ion)|rephras\w*|rewrit\w*|gramma\w*|punctua\w*|polish\w*|improve this (?:sentence|paragraph))\b"
MORE_SCOPE = (
    r"(?i)\b(?:triangles?|equilateral|trapez\w*|hypotenuse|degrees? angles?|vectors?|mathematic\w*|HTTP|HTTPS|Content-Type|Content-Disposition|multi.?thread\w*|software|application development|"
    r"web server|XML|CSV)\b"
)
META_EDIT = (
    r"(?i)\b(?:more concise|revised (?:sentence|paragraph|text)|improv\w* (?:the |this |your )?(?:writing|sentence|paragraph)|writing in this sentence|by removing|I achieved concision)\b"
)
MORE_PERSONA = r"(?i)\b(?:I need you to be|I want to speak to (?:a|an)|your name is|your name will be|your character|what is your name|my name is (?:Bob|Raven))\b"
WORD_COUNT = r"(?i)\b(?:exactly )?(\d+)[ -]words?\b"

#: What the repair mixture leaves out, and phrases of its answers.
REPAIR_SCOPE = (
    r"(?i)```|[{}]|\b(json|xml|yaml|sql|python|javascript|programming|algebra|calculus|arithmetic|calculate|quadratic|coding|html|css|regex)\b|https?://|\d\s*[+*/=]\s*\d"
)
REPAIR_PHRASES = (
    "(?i)\\b(?:i made (?:a few|some|the following) changes|changes (?:i made|made)|changed\\s+[\"“]|i (?:cannot|can't|am unable to) (?:help|provide|assist)|please try again)\\b"
)

#: Kinds of conversations: sources, a passage to answer from, requests to write.
NO_KIND, WRITING = ("self-oss-instruct",), ("smollm-rewrite-30k", "smol-summarize-20k")
EVIDENCE = r"(?i)according to|passage:|reference text:|provided text|following (?:text|passage)|answer based on"
REQUESTS = r"(?i)\b(write|draft|compose|suggest|give me|create|list|explain|describe|recommend|summarize|rewrite)\b"


def quoted(pattern: str) -> str:
    """The pattern between quotes, for SQL text."""
    return "'" + pattern.replace("'", "''") + "'"
