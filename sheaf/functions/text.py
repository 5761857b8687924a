"""Text conversions: HTML -> Markdown (P21), slide text (P22), chunking.

The HTML rules are ours (the original tools delegate to an external converter):
drop head/script/style/nav and comments, map headings, list items, links and
bold/italic to Markdown, turn block ends into line breaks, strip the remaining
tags, unescape the five basic entities and squeeze blank lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# HTML -> Markdown rewrite rules, applied in this order.
# ($n refers to a captured group.)
# ---------------------------------------------------------------------------
HTML_RULES = [
    (r"(?is)<head\b.*?</head>", ""),
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?is)<nav\b.*?</nav>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<h1\b[^>]*>(.*?)</h1>", "\n# $1\n"),
    (r"(?is)<h2\b[^>]*>(.*?)</h2>", "\n## $1\n"),
    (r"(?is)<h3\b[^>]*>(.*?)</h3>", "\n### $1\n"),
    (r"(?is)<li\b[^>]*>(.*?)</li>", "\n- $1"),
    (r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"),
    (r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", "**$1**"),
    (r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)>", "*$1*"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(?:p|div|article|section|footer|header|ul|ol|table|tr)>", "\n\n"),
    (r"<[^>]+>", ""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", "\""),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
]


def html_to_markdown(html: Column) -> Column:
    out = html
    for pattern, repl in HTML_RULES:
        out = F.regexp_replace(out, pattern, repl)
    return F.trim(out)


def _character(reference: Column) -> Column:
    """The character of ``&#n;`` or ``&#xh;``; a number that is no character stays as written."""
    hexadecimal = reference.startswith("&#x") | reference.startswith("&#X")
    digits = F.regexp_extract(reference, "([0-9A-Fa-f]+);$", 1)
    number = F.when(hexadecimal, F.conv(digits, 16, 16)).otherwise(F.conv(digits, 10, 16))
    code = F.conv(number, 16, 10).cast("long")
    valid = (F.length(number) <= 6) & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")).otherwise(reference)


def xml_unescape(c: Column) -> Column:
    """Numeric character references, then the five named entities of XML; the ampersand last."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(&#[xX][0-9A-Fa-f]{1,8};|&#[0-9]{1,8};|[^&]+|&)"), 1)
    numbered = F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("&#") & x.endswith(";"), _character(x)).otherwise(x)), "")
    c = F.when(F.contains(c, F.lit("&#")), numbered).otherwise(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def slide_text(xml: Column) -> Column:
    """Text runs ``<a:t>..</a:t>`` of one slide, joined by spaces."""
    return xml_unescape(F.array_join(F.regexp_extract_all(xml, F.lit(r"(?s)<a:t>(.*?)</a:t>"), 1), " "))


def chunk_starts(text: Column, size: int, overlap: int) -> Column:
    """1-based chunk starts covering the whole text; step = size - overlap."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.length(text)
    last = F.greatest(n - overlap, F.lit(1))
    return F.when(n > 0, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
