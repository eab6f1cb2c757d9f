"""Column functions for texts: tokens, sentences, identifiers, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in questions and evidence.
STOP_WORDS = (
    "a", "about", "all", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by", "can", "could",
    "did", "do", "does", "each", "for", "from", "get", "give", "had", "has", "have", "he", "her", "him", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "just", "know", "like", "make", "many", "me", "more", "most", "my",
    "no", "not", "of", "on", "one", "or", "other", "our", "out", "over", "same", "she", "should", "so", "some", "such",
    "tell", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "under", "up",
    "us", "use", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with",
    "would", "you", "your",
)

TOKEN = r"[\p{L}\p{N}_'’]+"
ACCENTS, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"

#: Names of settings whose values are hidden in messages.
SECRETS = r"(?i)(password|secret|api[_-]?key|authorization|credential)"

#: What asks for a figure.
FIGURE_CUES = (
    r"(?i)(?:\b(?:diagrams?|illustrations?|sketches?)\b|\b(?:labell?ed)\b|\bdrawings?\s+of\b|\bdraw\s+(?:me\s+)?(?:a|an|the)\b|"
    r"\bfigures?\s+of\b|\bstructure\s+of\b|\banatomy\s+of\b|\bflowcharts?\b|\bcircuit\s+diagram\b|\bpictures?\s+of\b|\blooks?\s+like\b)"
)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single underscores."""
    ascii_ = F.regexp_replace(F.translate(text, ACCENTS, PLAIN), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\u00a0]+", " "))


def lines(text: Column) -> Column:
    """Lines with something on them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space where a capital or digit follows, perhaps after a quote or bracket."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"), lambda x: F.trim(x) != "")


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    """Estimated subword tokens: 1.35 for each word, rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.size(whitespace_words(text)) * F.lit(1.35)).cast("int"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct terms without stop words and single letters; if none is left, all longer than one letter."""
    every = F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 1))
    kept = F.filter(every, lambda t: ~t.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def content_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def redact_secrets(text: Column) -> Column:
    hidden = F.regexp_replace(text, SECRETS + r"(\s*[=:]\s*)\S+", "$1$2[redacted]")
    return F.regexp_replace(hidden, SECRETS, "[redacted]")


def short_label(text: Column) -> Column:
    return F.substring_index(text, ":", -1)


#: Characters with a meaning in search strings.
RESERVED = r"([+\-&|!(){}\[\]^\"~*?:\\/])"

#: Words for operations, and tokens that belong to one exercise: numbers and coefficients.
OPERATION_WORDS = ("plus", "minus", "times", "equals", "equal", "squared", "cubed")
INSTANCE = r"^(?:\d+[a-z]+|[a-z]+\d+|\d+)$"

#: What tells of differentiation, a power of a bracket, and the rules that are searched then.
DERIVATIVE_CUE = r"(?i)(?:d\s*/\s*d[xy]|dy\s*/\s*dx|differenti\w*|derivative)"
BRACKET_POWER = r"\)\s*\^\s*\d+"
POWER_RULE = "algebra of derivative of functions derivative of x to the power n"
CHAIN_RULE = "derivative of composite functions"


def escaped(text: Column) -> Column:
    """Reserved characters of search strings with a backslash before them."""
    return F.regexp_replace(text, RESERVED, r"\\$1")


def lucene_query(terms: Column) -> Column:
    """A search string of the terms: all as one phrase of triple weight if there are several, or any of them; reserved characters are escaped, no terms give ''."""
    safe = F.transform(terms, escaped)
    phrase = F.when(F.size(terms) > 1, F.concat(F.lit('"'), F.array_join(safe, " "), F.lit('"^3 OR '))).otherwise("")
    return F.concat(phrase, F.array_join(safe, " OR "))


def rule_terms(terms: Column) -> Column:
    """Terms that name a rule, without those of one exercise."""
    return F.filter(terms, lambda t: ~t.isin(*OPERATION_WORDS) & ~t.rlike(INSTANCE))


def maths_query(query: Column, original: Column | None = None) -> Column:
    """What to search for a question of mathematics: the rule, not the exercise.

    Questions on derivatives, by their own words or else by the rewritten ones, become one of two fixed searches; others lose their numbers and coefficients if they
    have any and something is left.
    """
    source = F.coalesce(original if original is not None else F.lit(""), F.lit(""))
    text = F.when(F.trim(F.coalesce(query, F.lit(""))) == "", F.trim(source)).otherwise(F.trim(query))
    cue = F.lit(DERIVATIVE_CUE)
    seen = F.when(F.regexp_like(source, cue), source).otherwise(F.concat_ws(" ", text, source))
    every = tokens(text)
    kept = F.filter(every, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS) & ~t.isin(*OPERATION_WORDS) & ~t.rlike(INSTANCE))
    exercise = F.exists(every, lambda t: t.rlike(INSTANCE)) & (F.size(kept) > 0)
    return (
        F.when((F.regexp_like(source, cue) | F.regexp_like(text, cue)) & F.regexp_like(seen, F.lit(BRACKET_POWER)), CHAIN_RULE)
        .when(F.regexp_like(source, cue) | F.regexp_like(text, cue), POWER_RULE)
        .when(exercise, F.array_join(kept, " "))
        .otherwise(text)
    )
