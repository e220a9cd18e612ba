"""Text scalars as Column functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product names whose capitals are no word boundary, and furniture that a context loses.
COMPOUND_NAMES = ["GenAI", "OpenAI", "DeepMind", "GitHub", "LinkedIn", "ChatGPT", "AutoGPT", "LangChain", "LangGraph", "MLOps", "LLMOps"]
BOILERPLATE = [r"(?m)^\s*\d+\s*$", r"(?i)page\s+\d+", r"©\s*\d{4}", r"(?i)all rights reserved\.?", r"\[\d+\]", r"https?://\S+"]
DOC_TYPES = [("annual", "Annual Report"), ("sustainability", "Sustainability"), ("proxy", "Proxy"), ("quarterly", "Quarterly Report"), ("10k", "Annual Report"), ("10q", "Quarterly Report"), ("def14a", "Proxy"), ("esg", "Sustainability"), ("csr", "Sustainability")]
_SHIELD = "\ue000"


def clean(text: Column) -> Column:
    """Blanks at lost word boundaries, product names kept, runs of blanks and empty lines shortened; null stays null."""
    out = text
    for name in COMPOUND_NAMES:  # a private-use character between the letters keeps the rules off
        out = F.regexp_replace(out, rf"(?i)\b{''.join(f'({c})' for c in name)}\b", "".join(f"{_SHIELD}${i + 1}" for i in range(len(name))) + _SHIELD)
    for pattern, to in ((r"([a-z])([A-Z][a-z])", "$1 $2"), (r"([a-z])([A-Z]{2,})", "$1 $2"), (r"([A-Z]{2,})([a-z])", "$1 $2"), (r"(\.)([A-Z])", "$1 $2"), (r"(,)([a-zA-Z])", "$1 $2"), (_SHIELD, ""), (" +", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def corruption(text: Column) -> Column:
    """empty, replacement_chars, low_letters, no_spaces or valid; a null is empty."""
    n = F.length(text)
    lost = n - F.length(F.replace(text, F.lit("�"), F.lit("")))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    blanks = n - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text.isNull() | (n < 100), "empty").when(lost / n > 0.05, "replacement_chars").when(letters / n < 0.40, "low_letters").when((n > 500) & (blanks / n < 0.08), "no_spaces").otherwise("valid")


def sentences(text: Column) -> Column:
    """The sentences: cuts between . ! or ? and a capital."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def paragraphs(text: Column, separator: str = "\n\n", least: int = 100) -> Column:
    """The trimmed paragraphs of more than `least` characters."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > least)


def without_boilerplate(text: Column) -> Column:
    """Page numbers, rights, references and addresses become blanks."""
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def page_estimate(before: Column) -> Column:
    """The page that a place stands on, at 50 lines a page, from the text before it."""
    return (F.floor((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))) / 50) + 1).cast("int")


def unmarked(context: Column) -> Column:
    """A context without the signs around its term."""
    return F.regexp_replace(context, ">>>(.*?)<<<", "$1")


def sanitized(text: Column, most: int = 32000) -> Column:
    """Typographic signs as ASCII, control characters dropped, blanks squeezed, cut at `most`; null as empty."""
    out = F.translate(F.coalesce(text, F.lit("")), "“”„«»‘’‚–—\u00a0", "\"\"\"\"\"'''-- ")
    out = F.replace(F.replace(out, F.lit("…"), F.lit("...")), F.lit("€"), F.lit("EUR"))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), " +", " "))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("..."))).otherwise(out)


def reference_hash(company: Column, year: Column, doc_type: Column, page: Column, text: Column) -> Column:
    """32 hex digits of SHA-256 over the key of a mention."""
    parts = [company, year.cast("string"), doc_type, page.cast("string"), F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 200)]
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def encoded_detection(base: Column, trigger: Column, strength: Column, confidence: Column, reasons: Column) -> Column:
    """base|trigger=|strength=|conf=|reasons= as one string."""
    return F.concat(base, F.lit("|trigger="), trigger, F.lit("|strength="), strength, F.lit("|conf="), F.format_string("%.3f", confidence), F.lit("|reasons="), F.substring(reasons, 1, 250))


def decoded_detection(method: Column) -> dict[str, Column]:
    """strength, confidence and reasons of such a string; null where it has none."""
    part = lambda name, form: F.nullif(F.regexp_extract(method, rf"(?:^|\|){name}=({form})", 1), F.lit(""))
    return {"strength": part("strength", "[a-z_]+"), "confidence": part("conf", "[0-9.]+").cast("double"), "reasons": part("reasons", "[^|]*")}


def file_name(name: Column) -> dict[str, Column]:
    """position, company, year and doc_type of `38. Company - 2024 - kind.pdf`; defaults 0, Unknown, 2024, Annual Report."""
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    body = F.regexp_replace(stem, r"^\d{1,3}\.\s*", "")
    kind = F.lit("Annual Report")
    for needle, label in reversed(DOC_TYPES):
        kind = F.when(F.lower(stem).contains(needle), label).otherwise(kind)
    company = F.trim(F.element_at(F.split(body, r"\s+-\s+"), 1))
    return {
        "position": F.coalesce(F.nullif(F.regexp_extract(stem, r"^(\d{1,3})\.", 1), F.lit("")).cast("int"), F.lit(0)),
        "company": F.when(F.length(company) > 0, company).otherwise("Unknown"),
        "year": F.coalesce(F.nullif(F.regexp_extract(stem, r"(?:^|[ _-])(20(?:1[5-9]|2[0-5]))(?:$|[ _-])", 1), F.lit("")).cast("int"), F.lit(2024)),
        "doc_type": kind,
    }


def is_chinese_version(name: Column) -> Column:
    """File names that end in CN after a blank, underscore or hyphen."""
    stem = F.trim(F.regexp_replace(name, r"(?i)\.pdf$", ""))
    return stem.rlike("[ _-]CN$") | F.upper(stem).endswith(" CN")


def segments(context: Column) -> Column:
    """The plain and marked runs of a context, in order, as (text, marked)."""
    parts = F.split(context, ">>>|<<<")
    return F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("marked"))), lambda s: F.length(s["text"]) > 0)
