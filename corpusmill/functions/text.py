"""Scalar text functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
PLACEHOLDER = r"^(nan|n/?a|null|none|<none>|not reported|unknown|undefined|missing|-+|/+|\?+|-99|-9999|999|9999)$"
#: Characters that a plain file name can't have.
PLAIN = r"[^A-Za-z0-9\-_ ËéèêëôöûüàâäîïçÏ]"
#: File names that some systems reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
#: Media types whose extension is settled.
MIME = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/octet-stream": "bin"}


def strip(c: Column) -> Column:
    """Cut white space at both ends, as far as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_placeholder(c: Column, protected: tuple[str, ...] = (), pattern: str = PLACEHOLDER) -> Column:
    """null, blank or a text that stands for a missing value, unless protected."""
    t = strip(c.cast("string"))
    hit = F.lower(t).rlike(pattern)
    if protected:
        hit = hit & ~t.isin(*protected)
    return F.coalesce(c.isNull() | (t == "") | hit, F.lit(True))


def safe_filename(c: Column) -> Column:
    """invalid characters to ``_``, reserved device names prefixed, spaces and dots cut off, never empty."""
    s = F.regexp_replace(c, r'[\\/:"*?<>|]', "_")
    name = F.regexp_extract(s, r"(?s)^(\.*.*?)(\.[^.]*)?$", 1)
    s = F.when(F.upper(name).isin(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    s = F.regexp_replace(s, r"^[ .]+|[ .]+$", "")
    return F.when(s == "", "_empty_filename_").otherwise(s)


def plain_filename(c: Column) -> Column:
    """letters, digits, ``-_``, space and some accented letters only; then white space and dots cut off."""
    s = F.regexp_replace(c, PLAIN, "_")
    s = F.regexp_replace(strip(s), r"^\.+|\.+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def normalize_text(c: Column) -> Column:
    """straight quotes, single spaces, no white space at the ends; null is empty."""
    s = F.translate(F.coalesce(c, F.lit("")), "‘’“”`", "''\"\"'")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def after_marker(c: Column, last: bool = False) -> Column:
    """what follows the first channel marker up to the next one, or what follows the last; without a marker the text."""
    parts = F.split(c, r"<channel\|>")
    return F.when(F.size(parts) > 1, strip(F.element_at(parts, -1) if last else F.get(parts, F.lit(1)))).otherwise(c)


def clean_reply(reply: Column, source: Column) -> Column:
    """a reply without marker text, NULs and, unless the source begins with a quote, wrapping quotes."""
    s = after_marker(F.replace(strip(reply), F.lit("\0"), F.lit("")))
    wrapped = F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"')) & ~F.startswith(source, F.lit('"'))
    return F.when(wrapped, F.substr(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))).otherwise(s)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is found once: inside another lambda an expression would be found again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def targets(c: Column) -> Column:
    """texts inside target tags."""
    return F.regexp_extract_all(c, F.lit(r"(?is)<target>(.*?)</target>"), F.lit(1))


def tag_targets(sentences: Column, chosen: Column) -> Column:
    """F8: sentences joined by spaces, the chosen ones (0-based) in target tags."""
    tag = lambda s: F.concat(F.lit("<target>"), s, F.lit("</target>"))
    return bound(chosen, lambda places: F.array_join(F.transform(sentences, lambda s, i: F.when(F.array_contains(places, i), tag(s)).otherwise(s)), " "))


def links(c: Column) -> Column:
    """distinct href values in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"""href=["']([^"']+)["']"""), F.lit(1)))


def comma_list(c: Column) -> Column:
    """parts between commas, trimmed."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def file_kind(mime: Column, url: Column) -> Column:
    """extension from the media type, else from the link if it is pdf or docx; else null."""
    kind = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    settled = F.coalesce(*[F.when(kind == m, F.lit(e)) for m, e in MIME.items()])
    from_url = F.lower(F.regexp_extract(F.split(url, r"\?")[0], r"\.([^.]+)$", 1))
    known = F.when(from_url.isin("pdf", "docx"), from_url)
    return F.when(settled.isNull() | (settled == "bin"), F.coalesce(known, settled)).otherwise(settled)


def link_key(c: Column, digits: int = 12) -> Column:
    """first hex digits of the link's MD5."""
    return F.substring(F.md5(c.cast("binary")), 1, digits)


def task_seed(key: Column, share: Column) -> Column:
    """CRC-32 of ``key_share``."""
    return F.crc32(F.concat(key.cast("string"), F.lit("_"), share.cast("string")).cast("binary"))


def is_short(c: Column, words: int = 6, chars: int = 40) -> Column:
    """few words or few characters."""
    return (F.size(F.split(strip(c), r"\s+")) <= words) | (F.length(strip(c)) <= chars)


def shard_of(key: Column, shards: int) -> Column:
    """F16: number modulo ``shards``, other keys by a hash that every worker agrees on."""
    return F.pmod(F.coalesce(key.try_cast("bigint"), F.xxhash64(key.cast("string"))), F.lit(shards)).cast("int")


def sorted_tokens(c: Column) -> Column:
    """Whitespace tokens in order, joined by one space."""
    return F.array_join(F.array_sort(F.split(strip(c), r"\s+")), " ")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, by rows of the usual table."""
    xs, ys = F.split(a, ""), F.split(b, "")
    first = F.transform(F.array_insert(ys, 1, ""), lambda _: F.lit(0))

    def row(acc: Column, x: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(F.sequence(F.lit(1), F.size(ys)), start, lambda r, j: F.concat(r, F.array(F.when(F.get(ys, j - 1) == x, F.get(acc, j - 1) + 1).otherwise(F.greatest(F.get(acc, j), F.get(r, j - 1))))))

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(xs, first, row), -1))


def html_to_markdown(c: Column) -> Column:
    """Headings, list items, paragraphs, line breaks, links, images, emphasis, code and rules of simple HTML as Markdown; other tags go, common entities are decoded."""
    s = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    s = F.regexp_replace(s, r"(?is)<pre(?:\s[^>]*)?>\s*(?:<code[^>]*>)?(.*?)(?:</code>)?\s*</pre>", "\n\n```\n$1\n```\n\n")
    for tags, mark in (("b|strong", "**"), ("i|em", "*"), ("code", "`")):
        s = F.regexp_replace(s, rf"(?is)<({tags})(?:\s[^>]*)?>(.*?)</\1>", f"{mark}$2{mark}")
    for attribute, other in (("alt", "src"), ("src", "alt")):
        s = F.regexp_replace(s, rf'(?is)<img\s[^>]*?\b{attribute}="([^"]*)"[^>]*?\b{other}="([^"]*)"[^>]*>', "![$1]($2)" if attribute == "alt" else "![$2]($1)")
    s = F.regexp_replace(s, r"""(?is)<a\s[^>]*?\bhref=["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    s = F.regexp_replace(s, r"(?i)<hr(?:\s[^>]*)?/?>", "\n\n---\n\n")
    for level in range(1, 7):
        s = F.regexp_replace(s, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?is)<li[^>]*>(.*?)</li>", "\n- $1"), r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)</?(p|div|ul|ol|table|tr)[^>]*>", "\n\n"), r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))
