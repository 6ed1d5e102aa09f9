"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case words of letters, digits and underscores with ``least`` characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda x: F.length(x) >= least)


def stripped(text: Column) -> Column:
    """Without white space at both ends (Unicode)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunk_id(source_file: Column, index: Column, text: Column) -> Column:
    key = F.concat_ws("::", source_file, index.cast("string"), F.substring(text, 1, 200))
    return F.substring(F.md5(key), 1, 12)


def embedding_text(breadcrumbs: Column, title: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.nullif(breadcrumbs, F.lit("")), F.nullif(title, F.lit("")), text)


def instruct_query(task: str, query: Column) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def section_path(title: Column, section: Column) -> Column:
    return F.when(section != "", F.concat(title, F.lit(" > "), section)).otherwise(title)


def source_url(base: str, source_file: Column) -> Column:
    return F.when(F.coalesce(source_file, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), source_file))


#: White space as Unicode text has it, for both regex dialects.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"
#: The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ADJACENT_BOLD = (rf"\*\*([^*]++)\*\*{SPACE}*+\*\*([^*]++)\*\*", r"**\1 \2**")
#: Several blanks inside a line. Patterns begin with what is rare, and look back from there: a class of characters or a look
#: behind in front is tried at every character of a text.
INNER_BLANKS = (rf"  (?<!{SPACE}  )(?<!^  ) *+(?!{SPACE})(?!$)", " ")
#: The normalisation of a chunk's Markdown, as patterns and what replaces them, in order.
CHUNK_RULES = [
    (r"\*\*\*\*", "★"),
    (rf"({WORD})★({WORD})", r"\1** **\2"),
    (r"★", "**"),
    ADJACENT_BOLD,
    ADJACENT_BOLD,
    ADJACENT_BOLD,
    ADJACENT_BOLD,
    ADJACENT_BOLD,
    (rf"\*\*{SPACE}*\*\*", " "),
    (r"\*{3,}", "**"),
    (r" +([.,:;!?)])", r"\1"),
    INNER_BLANKS,
    (r"[ \t]+(?=\n)", ""),
    (r"\n{3,}", "\n\n"),
]
#: The normalisation of a whole page's Markdown.
PAGE_RULES = [
    (r"\n{3,}", "\n\n"),
    ADJACENT_BOLD,
    ADJACENT_BOLD,
    ADJACENT_BOLD,
    (rf"\*{{2,}}{SPACE}*\*{{2,}}", ""),
    (r"\*{4,}", "**"),
    (r"\*{3}([^*]+)\*{3}", r"**\1**"),
    (rf"(?![!-\x84]){SPACE}(?<!{SPACE}{{2}})(?<!^{SPACE}){SPACE}*+\*\*", "**"),
    (rf"\*\*{SPACE}+(?!{SPACE})(?!$)", "**"),
    # the character in front is not one that the match before has taken
    (r"\*\*(?<!\G\*\*)(?<=[а-яА-ЯёЁa-zA-Z0-9,.]\*\*)([а-яА-ЯёЁa-zA-Z0-9])", r" **\1"),
    (r"\*\*(?<!\G\*\*)(?<=[а-яА-ЯёЁa-zA-Z0-9]\*\*)([а-яА-ЯёЁa-zA-Z(])", r"** \1"),
    (r" +([.,:;!?)])", r"\1"),
    INNER_BLANKS,
    (r"[ \t]+(?=\n)", ""),
]
#: What is replaced in a table's cell before its bars are escaped and its white space squeezed.
CELL_RULES = [ADJACENT_BOLD, ADJACENT_BOLD, ADJACENT_BOLD, (r"\*{4,}", "**"), (rf"\*{{2,}}{SPACE}*\*{{2,}}", "")]


def python_rules(rules: list[tuple[str, str]]) -> list[tuple]:
    """Compiled rules for a Python worker."""
    import regex

    return [(regex.compile(pattern), to) for pattern, to in rules]


def ruled(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to.replace("\\", "$"))
    return text


def trimmed(text: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.btrim(text, F.lit(SPACES))


def markdown_normalised(text: Column) -> Column:
    """A chunk's Markdown, cleaned."""
    return trimmed(ruled(text, CHUNK_RULES))


def page_normalised(text: Column) -> Column:
    """A whole page's Markdown, cleaned."""
    return trimmed(ruled(text, PAGE_RULES))


def unfenced(reply: Column) -> Column:
    """A reply without the code fence that it begins with."""
    raw = trimmed(reply)
    inside = F.regexp_replace(raw, r"(?s)^[^\n]*\n", "")
    inside = F.when(inside.contains("```"), F.regexp_extract(inside, r"(?s)^(.*)```", 1)).otherwise(inside)
    return F.when(raw.startswith("```") & raw.contains("\n"), inside).otherwise(raw)
