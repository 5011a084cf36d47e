"""Text cleaning, keys and formats. (?U) makes \\s match non-breaking and other Unicode spaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Without white space at either end, newlines and non-breaking spaces included."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def collapse(x: str | Column) -> Column:
    return strip(F.regexp_replace(_c(x), _SPACE, " "))


def casefold(x: str | Column) -> Column:
    return F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))


def single_line(x: str | Column) -> Column:
    """Spreadsheet line marks and tags to spaces, white space collapsed; null stays null."""
    t = F.regexp_replace(F.regexp_replace(_c(x), "_x000D_", " "), "<[^>]*>", " ")
    return collapse(t)


def duplicate_key(x: str | Column) -> Column:
    """single_line, folded; null and '' are equal."""
    return casefold(F.coalesce(single_line(x), F.lit("")))


def lines(x: str | Column, separator: str = "\n") -> Column:
    """Trimmed non-blank lines; break tags count as line ends, marks before a comma as spaces."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*_x000D_\s*(?=,)", " "), "_x000D_", "\n")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    return F.filter(F.transform(F.split(t, separator), strip), lambda s: s != "")


def members(x: str | Column, separator: str = ";") -> Column:
    """Trimmed non-blank members of a separated list; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), separator), strip), lambda s: s != "")


def ordered_distinct(x: str | Column, separator: str = ";") -> Column:
    """members, each where it comes first."""
    return F.array_distinct(members(x, separator))


def repaired(x: str | Column, fixes: dict[str, str]) -> Column:
    """Fixed substitutions (regex -> text) in order."""
    return reduce(lambda c, kv: F.regexp_replace(c, kv[0], kv[1]), fixes.items(), _c(x))


def broken_before(x: str | Column, headers: list[str]) -> Column:
    """A newline before every header (regex) that ends in ':', but not at the start."""
    longest = "|".join(sorted(headers, key=len, reverse=True))  # so that no header is taken for the end of a longer one
    return F.regexp_replace(F.regexp_replace(_c(x), rf"\s*(?<!\p{{L}})((?:{longest})\s*:)", "\n$1"), r"^\n", "")


def basic_name(x: str | Column) -> Column:
    """Dashes and quotes folded, white space collapsed, closing punctuation stripped."""
    return F.regexp_replace(collapse(F.translate(_c(x), "–—‘’“”", "--''\"\"")), r"[\s.,;:]+$", "")


def without_tail(x: str | Column, noise: list[str]) -> Column:
    """Without any number of noise words at the end."""
    return F.regexp_replace(_c(x), rf"(?i)(?:\s+(?:{'|'.join(noise)}))+\s*$", "")


def rewritten(x: str | Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered rewrites."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, _c(x))


def without_acronym(x: str | Column) -> Column:
    """Without a closing (ABC) of at most 24 characters, no comma, and two capitals or more."""
    tail = F.regexp_extract(_c(x), r"\(([^()]{1,24})\)\s*$", 1)
    ok = (tail != "") & ~tail.contains(",") & (F.length(F.regexp_replace(tail, "[^A-Z]", "")) >= 2)
    return F.when(ok, strip(F.regexp_replace(_c(x), r"\s*\([^()]{1,24}\)\s*$", ""))).otherwise(_c(x))


def lookup_keys(x: str | Column) -> Column:
    """Folded key, then the key without its acronym where that differs."""
    a = casefold(collapse(x))
    return F.array_distinct(F.array(a, casefold(collapse(without_acronym(x)))))


def project_key(x: str | Column) -> Column:
    """Collapsed, without a closing CLOSED."""
    return strip(F.regexp_replace(collapse(x), r"(?i)\s*closed$", ""))


def prompt_safe(x: str | Column, limit: int = 600) -> Column:
    """Collapsed, fences and braces neutralised, cut with '...' beyond the limit."""
    t = F.translate(F.regexp_replace(collapse(x), "`{3,}", "'"), "{}", "()")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def fingerprint(*parts: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by newlines; null is ''."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(_c(p), F.lit("")) for p in parts]), 256), 1, 16)


def question_key(x: str | Column, numbering: bool = True) -> Column:
    """Folded, without leading numbering, everything but letters and digits to single spaces."""
    t = casefold(x)
    t = F.regexp_replace(t, r"^\s*[0-9]+(?:\.[0-9]+)*[.)]?\s+", "") if numbering else t
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def row_suffix(rank: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa ... (four letters at most)."""
    letters, n = [], rank
    for _ in range(4):
        letters.insert(0, F.when(n > 0, F.char(F.pmod(n - 1, F.lit(26)) + 97)).otherwise(F.lit("")))
        n = F.when(n > 0, F.floor((n - 1) / 26)).otherwise(F.lit(0))
    return F.concat(*letters)


def token(*parts: str | Column, length: int = 12, namespace: str = "") -> Column:
    """Opaque deterministic token: base-32 digits of SHA-256 over namespace and parts."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(namespace), *[_c(p).cast("string") for p in parts]), 256)
    bits = lambda i: F.conv(F.substring(digest, i * 5 // 4 + 1, 3), 16, 10).cast("int")
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = lambda i: F.shiftright(bits(i), 7 - i * 5 % 4).bitwiseAND(F.lit(31))
    return F.concat(*[F.substring(F.lit(alphabet), digit(i) + 1, F.lit(1)) for i in range(length)])


def display_date(x: str | Column) -> Column:
    return F.date_format(_c(x), "dd MMM yyyy")


def display_list(x: str | Column, empty: str = "—") -> Column:
    """Each member with a capital first letter; a dash for nothing."""
    m = F.transform(members(x), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))
    return F.coalesce(F.nullif(F.array_join(m, "; "), F.lit("")), F.lit(empty))


def first_case(x: str | Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Value of the first regex that matches: ordered rules as one CASE."""
    out = F
    for pattern, value in rules:
        out = out.when(_c(x).rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def json_body(x: str | Column) -> Column:
    """Text inside a fenced block, else from the first { to the last }."""
    fenced = F.regexp_extract(_c(x), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.nullif(strip(fenced), F.lit("")), F.nullif(F.regexp_extract(_c(x), r"(?s)(\{.*\})", 1), F.lit("")))


def list_literal(x: str | Column) -> Column:
    """A JSON or quoted list literal, else a ';' list."""
    quoted = F.replace(strip(x), F.lit("'"), F.lit('"'))
    return F.when(strip(x).startswith("["), F.from_json(quoted, "array<string>")).otherwise(members(x))


def _series(run):
    """A string column function from one on pandas series."""
    import pandas as pd

    def work(s):
        return run(s)

    work.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "string")


def unicode_key():
    """NFKC, dashes and apostrophes folded, zero-width characters out: the engine has no NFKC."""

    def run(s):
        folded = s.str.normalize("NFKC").str.replace("[\u2010-\u2015\u2212]", "-", regex=True)
        return folded.str.replace("[\u2018\u2019\u02bc]", "'", regex=True).str.replace("[\u200b-\u200d\ufeff]", "", regex=True)

    return _series(run)


def html_text():
    """Named and numeric entities decoded."""
    import html

    return _series(lambda s: s.map(lambda x: None if x is None else html.unescape(x.replace("&amp,", "&amp;"))))


def title_case():
    """Python's title case: a capital after every non-letter."""
    return _series(lambda s: s.str.title())


def title_text(x: str | Column, fixes: dict[str, str]) -> Column:
    """Known damage repaired, entities decoded, white space collapsed."""
    return collapse(html_text()(repaired(x, fixes)))
