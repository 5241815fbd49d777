"""Word lists, thresholds and formats that results depend on."""

# Words that identify no party.
NOISE_WORDS = [
    "co", "inc", "llc", "ltd", "corp", "corporation", "company", "the", "of", "and", "ex", "rel", "estate", "in",
    "re", "matter", "no", "nos", "et", "al", "on", "behalf", "as", "trustee", "jr", "sr", "ii", "iii",
]

# Lower-case words that a party's name may hold.
CONNECTORS = [
    "v", "vs", "of", "the", "and", "&", "de", "del", "la", "le", "van", "von", "der", "den", "ex", "rel", "in", "re",
    "on", "for", "by", "as", "a", "an",
]

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = [
    "inc", "co", "corp", "ltd", "llc", "lp", "plc", "rel", "ex", "no", "nos", "st", "ct", "dept", "bros", "assn", "ry",
    "transp", "fed", "natl", "intl", "univ", "bd", "commr", "sec", "jr", "sr", "mr", "mrs", "ms", "dr", "hon", "gen",
    "gov", "sen", "rep", "app", "supp", "ed", "cir", "dist", "div", "cfr", "usc", "stat", "mem", "ord", "op", "v", "vs",
    "et", "al", "atl", "ins", "grp", "holdings", "enters", "prods", "sys", "techs", "steamship", "nav", "us", "sct",
    "led", "wl", "fsupp", "fappx", "appx", "misc", "ny", "cal", "tex", "ill", "mich", "ohio", "pa", "ga", "fla", "md",
    "va", "nc", "sc", "ala", "miss", "la", "okla", "kan", "neb", "iowa", "minn", "mo", "ark", "tenn", "ky", "ind", "wis",
    "wash", "or", "ariz", "colo", "utah", "ida", "mont", "wyo", "nm", "sd", "nd", "me", "nh", "vt", "ri", "conn", "nj",
    "del", "wva", "dc", "pr",
]

# Words of a sentence that say nothing about a passage.
STOPWORDS = [
    "the", "and", "for", "that", "this", "with", "from", "under", "which", "court", "case", "held", "holding", "shall",
    "have", "been", "were", "was", "are", "not", "but", "its", "any", "all", "such", "than", "then", "them", "there",
    "their", "these", "those", "into", "upon", "over", "also", "may", "must", "does", "did", "has", "had", "would",
    "could", "should", "state", "states", "united", "section", "plaintiff", "defendant",
]

# A record with such a name score is the cited case; a weaker score is enough where the record holds the citation.
NAME_MATCH = 0.8
NAME_MATCH_ON_SLOT = 0.5

# Reporters that the corpus records only in part.
PARTIAL_REPORTERS = ["WL", "LEXIS", "US App Lexis"]

# Other written forms of a court -> its id.
COURT_ALIASES = {"supremecourt": "scotus", "us": "scotus"}

# Characters before, after and at most in a case name around a citation.
LOOK_AHEAD, LOOK_BEHIND, LONGEST_NAME = 90, 220, 160

# Limits on a document's text, an opinion's text, opinions of a case, a passage and a paragraph.
LONGEST_DOCUMENT, LONGEST_OPINION, MOST_OPINIONS, LONGEST_PASSAGE, SHORTEST_PARAGRAPH = 400_000, 400_000, 4, 3_500, 60

# A quotation with fewer characters or words is too common to search for.
QUOTE_CHARS, QUOTE_WORDS = 40, 6

# All that Python's \s matches, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# What follows a citation: a parenthesis with court and year, one with a quotation, and all up to the year.
YEAR_PARENTHESIS = r"^\s*(?:,\s*[0-9,\s\-–]+)?\s*\(\s*([^()]{0,80}?)\s*([0-9]{4})\s*\)"
QUOTE_PARENTHESIS = r'^\s*\(\s*(["“][^"”]{0,600}["”])\s*\)'
CITATION_END = r"^((?:,\s*[0-9,\s\-–]+)?\s*(?:\([^()]{0,80}?[0-9]{4}\))?)"

# Months in a parenthesis with court and date, and tokens that a name writes with a full stop.
MONTH = "(?i),?\\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\\.?"
ABBREVIATED_TOKEN = r"\b([A-Za-z][A-Za-z'\-]*)\.(?=\s|,|$)"
