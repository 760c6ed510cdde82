"""Column functions over text: sentences, terms, shingles, captions, and signs that a passage carries weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
CLASS_RULES = [
    ("EXACT_TERM", r"""(?i)(?:["'].+?["']|\bdefin(?:e|ition\s+of)\b|\bwhat\s+does\s+.+?\s+mean\b|\bexact\s+(?:quote|wording|text|phrase)\b|\bverbatim\b|\b(?:equation|theorem|lemma|corollary|definition|formula|proposition)\s+\d[\w.]*\b)"""),
    ("TABLE", r"(?i)\b(?:table\s+\d[\w.]*|in\s+the\s+table|from\s+the\s+table|the\s+table\s+(?:on|above|below|shows?)|rows?\s+(?:in|of|from)\s+the\s+table|columns?\s+(?:in|of|from)\s+the\s+table|tabular\s+(?:data|format))\b"),
    ("VISUAL", r"(?i)\b(?:fig(?:ure)?\s*\d[\w.]*|diagram|flowchart|chart\b|plot\b|the\s+(?:figure|image|graph)\s+(?:on|above|below|shows?)|visuali[sz]ation\b)\b"),
    ("QUIZ_GENERATION", r"(?i)\b(?:quiz(?:\s+me)?|test\s+me\b|practice\s+(?:problems?|questions?)|generate\s+(?:\w+\s+)?questions?|create\s+(?:a\s+)?(?:quiz|test)|sample\s+questions?|make\s+(?:a\s+)?quiz|give\s+me\s+(?:some\s+)?questions?\s+(?:on|about))\b"),
    ("SUMMARY", r"(?i)\b(?:summarize|summarise|give\s+(?:me\s+)?(?:a\s+)?(?:summary|overview)\s+of|key\s+(?:points?|takeaways?|ideas?)|main\s+(?:points?|ideas?|themes?|topics?)|what\s+(?:is|are)\s+the\s+main|outline\s+(?:of|the)|recap\s+of|overview\s+of)\b"),
    ("CONCEPT_MAP", r"(?i)\b(?:concept\s+map|mind\s+map|map\s+out\s+(?:all\s+)?(?:the\s+)?concepts?|how\s+(?:\w+\s+){0,2}(?:everything|it\s+all)\s+fits?\s+together|big[\s-]picture\s+overview|comprehensive\s+overview\s+of\s+all|all\s+the\s+concepts?\s+in)\b"),
    ("COMPARISON", r"(?i)\b(?:compar(?:e|ing|ison)|versus\b|vs\.?\s|differences?\s+between|how\s+(?:do(?:es)?|is|are)\s+\w+(?:\s+\w+){0,4}\s+differ\b|contrast\s+\w+(?:\s+\w+){0,4}\s+(?:and|with|versus)\b|similarities?\s+(?:and\s+differences?\s+)?between|distinguish\s+between)\b"),
    ("AGGREGATION", r"(?i)\b(?:how\s+many\b|how\s+much\b|total\s+(?:number\s+)?of\b|list\s+all\s+(?:the\s+)?|all\s+(?:the\s+)?(?:types?|kinds?|categories|methods?|approaches?|examples?|cases?)\s+of\b|count\s+(?:the\s+|of\s+)?|sum\s+of\b)\b"),
    ("MULTI_DOCUMENT", r"(?i)\b(?:across\s+(?:all\s+)?(?:the\s+)?(?:documents?|papers?|chapters?|files?|sources?)|in\s+(?:all|multiple|several)\s+(?:documents?|papers?|sources?)|multiple\s+(?:documents?|papers?|sources?))\b"),
    ("MULTI_HOP", r"(?i)\b(?:if\s+.{3,}?\bthen\b|given\s+that\s+.{3,}?,\s*(?:what|how|why)|trace\s+(?:through|the\s+steps?)|chain\s+of\s+(?:reasoning|events?|steps?|consequences?)|how\s+would\s+\w+(?:\s+\w+){0,6}\s+lead\s+to|derive\s+(?:the|an?)\s+\w+\s+(?:from|using|for))\b"),
    ("RELATIONSHIP", r"(?i)\b(?:(?:what|describe)\s+(?:is|are)\s+the\s+relationship\s+between|how\s+(?:is|are|does|do)\s+\w+(?:\s+\w+){0,4}\s+(?:relate(?:d)?\s+to|affect\b|influence\b|impact\b|connect(?:ed)?\s+to|depend(?:s)?\s+on)|connection\s+between|what\s+links\b|role\s+of\s+\w+(?:\s+\w+){0,4}\s+in)\b"),
    ("PREREQUISITE", r"(?i)\b(?:prerequisites?\b|before\s+(?:I\s+can|learning|studying|understanding)\s+\w|what\s+(?:do\s+I|should\s+I)\s+(?:need\s+to\s+know|understand)\s+(?:first|before)|background\s+knowledge\b|background\s+(?:needed|required)\s+(?:for|to)|foundational\s+(?:knowledge|concepts?))\b"),
]
FOLLOW_UP = [
    r"(?i)^(?:it|this|that|they|these|those|its|their|them|the\s+same|the\s+above|the\s+previous)\b",
    r"(?i)^(?:why|how|when|who|which|what)\s*\?+\s*$",
    r"(?i)\bas\s+(?:mentioned|described|stated|explained|noted|discussed)\b",
    r"(?i)\byou\s+(?:mentioned|said|described|explained|noted|discussed)\b",
    r"(?i)\btell\s+me\s+more\b",
    r"(?i)\bcan\s+you\s+elaborate\b",
    r"(?i)\bexplain\s+(?:it|that|this|them)\b",
    r"(?i)\bwhat\s+does\s+(?:it|that|this)\s+mean\b",
    r"(?i)\bwhat\s+about\s+(?:it|that|this)\b",
    r"(?i)^(?:and|but|so)\s+(?:what|how|why|where|when)\b",
]
NEGATIONS = ["not", "no", "never", "cannot", "neither", "nor", "without", "none", "nothing", "unable", "fails", "except"]
QUALIFIERS = ["if", "unless", "only", "provided", "assuming", "requires", "must", "always", "approximately", "roughly", "least", "most", "before", "after", "when"]
CONTINUATIONS = ["however", "therefore", "thus", "hence", "consequently", "moreover", "furthermore", "instead", "conversely", "similarly", "nevertheless", "nonetheless", "meanwhile", "otherwise", "accordingly", "besides"]
REFERENCES = ["this", "these", "that", "those", "it", "its", "they", "them", "their", "such", "he", "she", "his", "her"]
CAPTION = r"(?i)^\s*(fig(?:ure)?|table|tbl|chart|diagram|exhibit|plate|scheme)\s*\.?\s*([A-Z]?\.?\d+(?:[.\-]\d+)*[a-z]?)(?!\w)"
LIST_MARKER = r"^\s*(?:[-•*·‣▪◦–—]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|\(?[ivxlcdm]{1,5}[.)]\s)"
MARKER = r"^\s*(?:\d+[.)]\s*|[-*•]\s*)"
DEFINING = r"(?i)\b(where|let|denotes?|defined as|refers? to|is the|are the)\b"
TABLE_LINE = r"(?im)^\s*(table|tbl)\s*\.?\s*([A-Z]?\.?\d+(?:[.\-]\d+)*[a-z]?)(?!\w)"
MATHEMATICAL = "∑∫∂√∇±×÷≤≥≠≈≡∞∝⊂⊆⊃⊇∈∉∀∃∧∨¬→←↔⇒⇔∪∩∅ƒΣΠΔΩαβγδεθλμνξπρστφχψω"
CLASS_COUNTS = {
    "DIRECT": (1, 2), "EXACT_TERM": (1, 3), "TABLE": (1, 3), "VISUAL": (1, 3), "RELATIONSHIP": (2, 5), "PREREQUISITE": (2, 5), "COMPARISON": (2, 5),
    "CONCEPT_MAP": (3, 8), "MULTI_DOCUMENT": (3, 8), "AGGREGATION": (3, 8), "SUMMARY": (3, 8), "QUIZ_GENERATION": (3, 8), "MULTI_HOP": (2, 8),
}
#: White space, as it is stripped from the ends of texts.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with"]


def strip(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.trim(text, F.lit(WHITE))


def with_strip(sql: str) -> str:
    """SQL in which ``strip(x)`` stands for the same."""
    return sql.replace("strip(", f"trim(BOTH '{WHITE}' FROM ")


def query_class(text: Column) -> Column:
    """The first rule that matches names the class; DIRECT without one."""
    found = F.lit("DIRECT")
    for name, pattern in reversed(CLASS_RULES):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def is_follow_up(text: Column) -> Column:
    found = F.lit(False)
    for pattern in FOLLOW_UP:
        found = found | text.rlike(pattern)
    return found


def sentences(text: Column) -> Column:
    """Pieces between sentence ends that a capital or a digit follows, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: strip(s)), lambda s: s != "")


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def shingles(items: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` items, as text; all items as one where there are fewer."""

    def of(w: Column) -> Column:  # the words are bound to a name, else each run would split the text again
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return F.get(F.transform(F.array(items), of), F.lit(0))


def shingle_hashes(items: Column, size: int = 5) -> Column:
    """As ``shingles``, but hashed: 64 bits of each run."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))

    return F.get(F.transform(F.array(items), of), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """Shared items by the smaller number of items; 0 where either has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def load_bearing(sentence: Column) -> Column:
    """Whether a sentence has a number, a negation or a qualifier."""
    listed = F.arrays_overlap(terms(sentence), F.array(*[F.lit(w) for w in NEGATIONS + QUALIFIERS]))
    return sentence.rlike(r"\d") | sentence.rlike(r"(?i)\b\w+n[’']t\b") | F.coalesce(listed, F.lit(False))


def opening_reason(text: Column) -> Column:
    """Why prose reads as cut off from what precedes it, or null."""
    bare = F.regexp_replace(text, r"^[ \t\r\n\f\x0B\"'(\[‘“«]+", "")
    word = F.regexp_replace(F.lower(F.get(F.split(bare, r"\s+"), F.lit(0))), r"^[.,;:!?]+|[.,;:!?]+$", "")
    return (
        F.when(word == "", None)
        .when(bare.rlike(r"^\p{Ll}") | word.isin(CONTINUATIONS), "OPENS_MID_EXPLANATION")
        .when(word.isin(REFERENCES), "OPENS_WITH_A_REFERENCE")
    )


def expansion_reason(text: Column, kind: Column, parent: Column) -> Column:
    """Why a passage has to be read with its parent, or null: by what it is, or for prose by how it opens."""
    return (
        F.when(parent.isNull(), None)
        .when(kind == "TABLE", F.when(~text.rlike(TABLE_LINE), "TABLE_WITHOUT_ITS_CAPTION"))
        .when(kind == "FORMULA", F.when(~text.rlike(DEFINING), "FORMULA_WITHOUT_ITS_DEFINITION"))
        .when(kind.isin("FIGURE", "CHART", "DIAGRAM"), "VISUAL_WITHOUT_ITS_EXPLANATION")
        .otherwise(opening_reason(text))
    )


def query_variants(asked: Column, said: Column, most: int = 3) -> Column:
    """A question, then the first variants of it that a model said, a line each, without list marks and echoes."""
    lines = F.transform(F.split(said, r"\r\n|\r|\n"), lambda x: strip(F.regexp_replace(x, MARKER, "")))
    return F.concat(F.array(asked), F.filter(F.slice(F.filter(lines, lambda x: x != ""), 1, most), lambda x: x != asked))


def element_type(text: Column, size_ratio: Column, bold: Column, lines: Column) -> Column:
    """CAPTION, LIST, FORMULA, HEADING or PARAGRAPH, the first that applies."""
    trimmed = strip(text)
    visible = F.regexp_replace(trimmed, r"\s", "")
    symbols = F.length(visible) - F.length(F.translate(visible, MATHEMATICAL, ""))
    ratio = F.when(F.length(visible) > 0, symbols / F.length(visible)).otherwise(0.0)
    heading = (lines <= 3) & ~trimmed.rlike(r"[.!?:;]$") & ((size_ratio >= 1.15) | bold)
    return F.when(trimmed == "", "PARAGRAPH").when(trimmed.rlike(CAPTION), "CAPTION").when(trimmed.rlike(LIST_MARKER), "LIST").when(ratio >= 0.25, "FORMULA").when(heading, "HEADING").otherwise("PARAGRAPH")


#: The pattern of captions for engines without look-ahead.
CAPTION_SQL = CAPTION.replace(r"(?!\w)", r"(?:\W|$)")


def caption_number(text: Column) -> Column:
    """The number that a caption gives its object, or null."""
    return F.when(caption_kind(text).isNotNull(), F.trim(F.regexp_extract(text, CAPTION, 2), F.lit(". ")))


def caption_kind(text: Column) -> Column:
    word = F.lower(F.regexp_extract(text, CAPTION, 1))
    return F.when(word.isin("fig", "figure", "plate", "exhibit"), "FIGURE").when(word.isin("table", "tbl"), "TABLE").when(word == "chart", "CHART").when(word.isin("diagram", "scheme"), "DIAGRAM")


def page_kind(chars: Column, text_cover: Column, image_cover: Column, drawings: Column) -> Column:
    """COMPLEX, SCANNED, MIXED or NATIVE_TEXT from what can be measured of a page."""
    readable, pictured = (chars >= 50) & (text_cover >= 0.10), image_cover >= 0.15
    return F.when(drawings >= 400, "COMPLEX").when(~readable & pictured, "SCANNED").when(readable & pictured, "MIXED").otherwise("NATIVE_TEXT")
