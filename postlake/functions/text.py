"""Text helpers: Unicode-aware trimming, blanks, and HTML to plain text."""

import html.entities
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import vocab

# Horizontal white space is every Unicode space but the newline; the classes are
# written as ranges that Java and RE2 read alike.
_H = (r"\t\x{b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
HSPACE = f"[{_H}]"
SPACE = rf"[\n{_H}]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(r"[\s\x1c-\x1f\x85]", c))
CYRILLIC = r"[\x{400}-\x{4ff}]"

# Attributes of a tag: a quoted value may hold '>', stray quotes may not swallow text.
_ATTRS = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+"""
_HIDDEN = "|".join(rf"<{t}(?=[\s/>]){_ATTRS}>.*?(?:</{t}(?=[\s/>])[^>]*>|\z)"
                   for t in ("script", "style", "template", "rt", "rp"))
_DROP = rf"(?is)<!--.*?(?:-->|\z)|{_HIDDEN}|<![^>]*>|<\?[^>]*>"
_BREAK = rf"(?i)<br(?=[\s/>]){_ATTRS}>"
_BLOCK = rf"(?i)<(?:{'|'.join(vocab.BLOCK_TAGS)})(?=[\s/>]){_ATTRS}>"
_TAG = rf"</?[a-zA-Z]{_ATTRS}>"
_ENTITY_OR_TEXT = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of Unicode space from both ends."""
    c = _col(c)
    # Trimming looks at every character; most texts show by their ends alone that there is nothing to trim.
    trimmed = F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)
    return F.when(trimmed, c).otherwise(F.btrim(c, F.lit(_SPACES)))


def collapse(c) -> Column:
    """Turn each run of horizontal space into one blank."""
    return F.regexp_replace(_col(c), f"{HSPACE}+", " ")


def is_blank(c, extra=()) -> Column:
    """True for a string that says nothing; ``extra`` adds words to the list."""
    words = [*vocab.BLANKS, *(w.lower() for w in extra)]
    return F.lower(strip(c)).isin(words)


def blank_as_null(c, extra=()) -> Column:
    """Trimmed text, or null where the text is blank."""
    return F.when(~is_blank(c, extra), strip(c))


def lookup(mapping: dict, key: Column) -> Column:
    """Value of ``key`` in a small literal map, null when absent."""
    return F.try_element_at(F.expr(f"map({', '.join(_sql(x) for kv in mapping.items() for x in kv)})"), key)


def _sql(value) -> str:
    """Literal as SQL text; one parsed map is much quicker to build than its many columns."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def _entity_names() -> dict:
    return {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}


def _legacy_codes() -> dict:
    # Numeric references 128..159 mean the Windows code page, as browsers read them.
    chars = {code: bytes([code]).decode("cp1252", "ignore") for code in range(128, 160)}
    return {code: char for code, char in chars.items() if char}


def _char(code: Column) -> Column:
    legacy = _legacy_codes()
    bad = (code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF))
    return (F.when(bad, F.lit("�"))
            .when(code.between(128, 159), F.coalesce(lookup(legacy, code.cast("int")), F.lit("�")))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def decode_entities(c) -> Column:
    """Replace named and numeric character references by their characters."""
    c = _col(c)
    names = F.from_json(F.lit(json.dumps(_entity_names())), "map<string,string>")

    def piece(p):
        hexa = F.conv(F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("bigint")
        deci = F.regexp_extract(p, r"^&#([0-9]+)", 1).try_cast("bigint")
        return (F.when(~p.startswith("&"), p)
                .when(p.rlike(r"^&#[xX]"), _char(hexa))
                .when(p.startswith("&#"), F.when(F.length(p) > 2, _char(deci)).otherwise(p))
                .otherwise(F.coalesce(
                    F.try_element_at(names, F.regexp_extract(p, r"^&([a-zA-Z0-9]*)", 1)), p)))

    pieces = F.transform(F.regexp_extract_all(c, F.lit(_ENTITY_OR_TEXT), F.lit(0)), piece)
    return F.when(c.contains("&"), F.array_join(pieces, "")).otherwise(c)


def tidy(c) -> Column:
    """One blank between words, clean line edges, at most one empty line."""
    c = F.regexp_replace(_col(c), f"{HSPACE}+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def without_tags(c) -> Column:
    """Text of an HTML fragment with its character references left as they are."""
    c = F.coalesce(_col(c), F.lit(""))
    c = F.regexp_replace(c, _DROP, "")
    c = F.regexp_replace(c, _BREAK, "\n")
    c = F.regexp_replace(c, _BLOCK, "\n\n")
    return F.regexp_replace(c, _TAG, "")


def html_text(c) -> Column:
    """Readable text of an HTML fragment; null becomes the empty string.

    Only an opening block tag starts a new paragraph. Markup that no parser
    would accept is not repaired.
    """
    return tidy(decode_entities(without_tags(c)))
