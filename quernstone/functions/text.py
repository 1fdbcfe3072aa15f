"""Text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "([a-z0-9']+)"
#: Python's white space, which is wider than Java's \s.
SPACE = r"[\s\x1c-\x1f]"
SENTENCE_END = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"

#: The words without topical signal.
STOPWORDS = (
    "a an and are as at be by can do does for from had has have how i in is it its my of on or that the this to was were "
    "what when where which who why will with you your me our us they them he she"
).split()

#: The suffixes a stem loses, tried in this order, and the least length that is left.
SUFFIXES, LEAST_STEM, LEAST_TOKEN = ("ing", "ed", "es", "s"), 3, 5

#: Intents in the order they are tried; the first whose pattern is found wins.
INTENTS = (
    ("inventory", r"(?i)\b(what (documents|files|sources)|which documents|list (the )?(documents|files)|what do you (have|know))\b"),
    ("summarise", r"(?i)\b(summar(y|ise|ize)|overview|tl;?dr|key points|main points)\b"),
    ("lookup", r"\b([A-Z][A-Z0-9_]{4,}|error code|sku|invoice \d+)\b"),
)

#: The letters whose upper case in F.upper is several letters, and the one letter that each has where case goes letter by letter.
WIDE = (
    "ß\u0149\u01f0\u0390\u03b0\u0587\u1e96\u1e97\u1e98\u1e99\u1e9a\u1f50\u1f52\u1f54\u1f56\u1f80\u1f81\u1f82\u1f83\u1f84\u1f85\u1f86\u1f87\u1f88\u1f89\u1f8a"
    "\u1f8b\u1f8c\u1f8d\u1f8e\u1f8f\u1f90\u1f91\u1f92\u1f93\u1f94\u1f95\u1f96\u1f97\u1f98\u1f99\u1f9a\u1f9b\u1f9c\u1f9d\u1f9e\u1f9f\u1fa0\u1fa1\u1fa2\u1fa3\u1fa4"
    "\u1fa5\u1fa6\u1fa7\u1fa8\u1fa9\u1faa\u1fab\u1fac\u1fad\u1fae\u1faf\u1fb2\u1fb3\u1fb4\u1fb6\u1fb7\u1fbc\u1fc2\u1fc3\u1fc4\u1fc6\u1fc7\u1fcc\u1fd2\u1fd3\u1fd6"
    "\u1fd7\u1fe2\u1fe3\u1fe4\u1fe6\u1fe7\u1ff2\u1ff3\u1ff4\u1ff6\u1ff7\u1ffc\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06\ufb13\ufb14\ufb15\ufb16\ufb17"
)
NARROW = (
    "ẞ\u0149\u01f0\u0390\u03b0\u0587\u1e96\u1e97\u1e98\u1e99\u1e9a\u1f50\u1f52\u1f54\u1f56\u1f88\u1f89\u1f8a\u1f8b\u1f8c\u1f8d\u1f8e\u1f8f\u1f88\u1f89\u1f8a"
    "\u1f8b\u1f8c\u1f8d\u1f8e\u1f8f\u1f98\u1f99\u1f9a\u1f9b\u1f9c\u1f9d\u1f9e\u1f9f\u1f98\u1f99\u1f9a\u1f9b\u1f9c\u1f9d\u1f9e\u1f9f\u1fa8\u1fa9\u1faa\u1fab\u1fac"
    "\u1fad\u1fae\u1faf\u1fa8\u1fa9\u1faa\u1fab\u1fac\u1fad\u1fae\u1faf\u1fb2\u1fbc\u1fb4\u1fb6\u1fb7\u1fbc\u1fc2\u1fcc\u1fc4\u1fc6\u1fc7\u1fcc\u1fd2\u1fd3\u1fd6"
    "\u1fd7\u1fe2\u1fe3\u1fe4\u1fe6\u1fe7\u1ff2\u1ffc\u1ff4\u1ff6\u1ff7\u1ffc\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06\ufb13\ufb14\ufb15\ufb16\ufb17"
)


def upper(text: Column) -> Column:
    """Upper case letter by letter, so that a text keeps its length: ẞ for ß, where F.upper writes SS."""
    parts = F.regexp_extract_all(text, F.lit(f"[{WIDE}]+|[^{WIDE}]+"), F.lit(0))
    each = F.transform(parts, lambda p: F.when(p.rlike(f"^[{WIDE}]"), F.translate(p, WIDE, NARROW)).otherwise(F.upper(p)))
    return F.when(text.rlike(f"(?=[\u00df-\uffff])[{WIDE}]"), F.array_join(each, "")).otherwise(F.upper(text))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and apostrophe, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def stem(token: Column) -> Column:
    n = F.length(token)
    out = F.when(n < LEAST_TOKEN, token)
    for s in SUFFIXES:
        out = out.when(token.endswith(s) & (n >= LEAST_STEM + len(s)), F.substring(token, F.lit(1), n - len(s)))
    return out.otherwise(token)


def lexical_tokens(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def content_terms(text: Column) -> Column:
    """Distinct tokens of two characters or more that are no stopwords."""
    return F.filter(F.array_except(tokens(text), F.array(*map(F.lit, STOPWORDS))), lambda t: F.length(t) > 1)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring tokens, joined by a space."""
    t = tokens(text)
    later = F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
    return F.array_distinct(F.filter(F.zip_with(t, later, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull()))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def content_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(" ", *parts), 256), 1, 32)


def citation(filename: Column, label: Column) -> Column:
    named = F.concat(F.lit("["), filename, F.when(label != "", F.concat(F.lit(", "), label)).otherwise(""), F.lit("]"))
    return F.when(filename != "", named).otherwise(F.concat(F.lit("["), label, F.lit("]")))


def section_key(filename: Column, label: Column) -> Column:
    return F.concat(filename, F.lit("#"), label)


def intent(question: Column) -> Column:
    out = None
    for name, pattern in INTENTS:
        out = (F if out is None else out).when(question.rlike(pattern), F.lit(name))
    return out.otherwise("answer")


def bucket(token: Column, dims: int) -> Column:
    """md5 as a 128-bit number modulo dims, folded from its four 32-bit words; only the last one counts where dims divides 2^32."""
    digest, step, out = F.md5(token), (1 << 32) % dims, F.lit(0).cast("long")
    for i in range(4) if step else (3,):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * F.lit(step) + word) % dims if step else word % dims
    return out
