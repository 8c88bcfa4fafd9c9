"""Cleaning of raw text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penstroke.functions.text import whitespace_words

#: Named entities that are decoded; others stay as they are.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&#x2F;": "/", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}
#: Extensions by which a bare name is taken for a path.
EXTENSIONS = "rs py js ts tsx jsx go c h cpp hpp java rb sh zsh toml json yaml yml md txt lock cfg ini sql html css xml csv jsonl proto swift kt php pl lua vim el".split()


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\n[\x20\x09\x0D]*\n([\x20\x09\x0D]*\n)+", "\n\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def clean_html(html: Column) -> Column:
    """Text of a page: paragraphs and breaks become blank lines, other tags go, entities are decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<(p|br)\x20*/?>", "\n\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse_blank_lines(out)


def strip_inline_code(line: Column) -> Column:
    return F.regexp_replace(line, "`[^`]*`", "``")


def is_diff_line(line: Column) -> Column:
    return F.regexp(line, F.lit(r"^[\x20\x09]*(@@|diff --git|index\x20|--- a/|\+\+\+ b/|\+[^\x20]|-[^\x20-])"))


def is_url(token: Column) -> Column:
    return F.regexp(token, F.lit(r"^[^\p{L}\p{Nd}/:.]*(https?://|www\.)"))


def is_path(token: Column) -> Column:
    bare = F.regexp_replace(token, r"^[(),.`]+|[(),.`]+$", "")
    ending = F.regexp(bare, F.lit(rf"[^.]\.({'|'.join(EXTENSIONS)})$"))
    return (F.length(bare) >= 3) & (F.regexp(bare, F.lit(r"^(/|\./|\.\./|~).*[/\\]|^/")) | ending)


def strip_code(text: Column) -> Column:
    """Fenced blocks emptied (an open one to the end), diff lines dropped, inline code emptied, urls and paths dropped."""
    fenced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```[^\n]*\n.*?(?:\n[\x20\x09]*```|$)", "```\n```")
    fenced = F.regexp_replace(fenced, r"(?s)~~~[^\n]*\n.*?(?:\n[\x20\x09]*~~~|$)", "~~~\n~~~")
    lines = F.filter(F.split(fenced, "\n"), lambda line: ~is_diff_line(line))
    words = lambda line: F.array_join(F.filter(F.split(line, r"\x20"), lambda w: ~is_url(w) & ~is_path(w)), " ")
    return collapse_blank_lines(F.array_join(F.transform(lines, lambda line: words(strip_inline_code(line))), "\n"))


def code_share(text: Column, stripped: Column) -> Column:
    return F.when(F.length(text) > 0, 1 - F.least(F.length(stripped), F.length(text)) / F.length(text)).otherwise(0.0)


def keep(text: Column, share: Column, most: float = 0.5, least: int = 12) -> Column:
    return (share <= most) & (whitespace_words(text) >= least)


#: Repairs of text that was cut into tokens and joined again, in order: apostrophes, then spaces before a mark, behind an
#: opening and before a closing one, and runs of spaces.
REPAIRS = (
    (r"([\p{L}\p{N}_])[ \t]+([’'])[ \t]*(s|t|re|ve|ll|d|m)(?![\p{L}\p{N}_])", "$1$2$3"), (r"[ \t]+([,.;:!?%])", "$1"), (r"([“‘(\[])[ \t]+", "$1"), (r"[ \t]+([”’)\]])", "$1"), (r"[ \t]{2,}", " "),
)
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def repair_typography(text: Column) -> tuple[Column, Column]:
    """The repaired text, without space at its ends, and the number of substitutions."""
    count = F.lit(0)
    for pattern, to in REPAIRS:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, EDGES, ""), count


def normalize_spaces(text: Column) -> Column:
    """Ligatures apart, invisible characters gone, every space a plain one; quotes and dashes stay."""
    out = F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.regexp_replace(F.translate(out, "\u200b\u200c\u200d\ufeff", ""), r"\p{Zs}", " ")


#: Fixed value: what a line of markup or of a list begins with.
MARKUP = r"^[\x20\x09-\x0D]*(?:[#|*>-]|\.\.)"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def prose_ratio(text: Column, least: int = 8) -> Column:
    """Share of lines with something on them that have at least `least` words and begin with no markup."""
    lines = F.filter(F.split(text, LINE_ENDS), lambda x: F.regexp(x, F.lit(r"[^\x20\x09-\x0D]")))
    prose = F.filter(lines, lambda x: (whitespace_words(x) >= least) & ~F.regexp(x, F.lit(MARKUP)))
    return F.when(F.size(lines) > 0, F.size(prose) / F.size(lines)).otherwise(0.0)


#: What is no prose in documentation, for all formats but one, for that one (`rst`), and blocks indented as code.
DOC_CODE = (
    (r"\A---\n[\s\S]*?\n---\n", ""), (r"\A\+\+\+\n[\s\S]*?\n\+\+\+\n", ""), (r"(?m)^([ \t]*)(```|~~~)[\s\S]*?^\1\2[ \t]*$", "\n"),
    (r"(?i)<(script|style|table|pre|code)\b[\s\S]*?</\1>", "\n"), (r"\{%[\s\S]*?%\}|\{\{[\s\S]*?\}\}", ""), (r"(?m)^\s*\[!\[.*$", ""),
)
RST_CODE = ((r"(?m)^\.\. [a-z-]+::[\s\S]*?(?=\n\S|\z)", "\n"), (r"::\n\n((?:[ \t]+\S.*\n|\n)+)", "\n"), (r"(?m)^[=~^\-*+#]{4,}\s*$", ""))
INDENTED_CODE = (r"(?m)^(?:(?: {4}|\t)\S.*\n|\n)+", "\n")


def strip_doc_code(text: Column, rst: Column | bool = False) -> Column:
    """Documentation without code, front matter, template tags and badges; links and inline code stay."""
    rst = F.lit(rst) if isinstance(rst, bool) else rst
    plain = _swept(text, DOC_CODE)
    out = F.when(rst, _swept(plain, RST_CODE)).otherwise(_swept(plain, (INDENTED_CODE,)))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), EDGES, "")


def _swept(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def strip_licence(text: Column) -> tuple[Column, Column]:
    """The text after its last start marker and before the first end marker that follows, and whether there were markers."""
    start, end = r"(?s)^.*\*\*\* ?START OF[^\n]*\n", r"(?s)\*\*\* ?END OF.*$"
    cut = F.regexp_replace(F.regexp_replace(text, start, ""), end, "")
    return F.regexp_replace(cut, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), cut != text


def is_chapter_heading(line: Column) -> Column:
    roman = r"(?=[IVXLC])(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\.?"
    return (F.length(line) <= 60) & F.regexp(F.trim(line), F.lit(rf"^(#.*|(CHAPTER|BOOK|PART|CANTO|LETTER|ACT|SCENE|Chapter|Book|Part|Canto|Letter|Act|Scene)\b.*|C\.?|{roman})$"))
