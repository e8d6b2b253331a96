"""Text normalization, grams, hashing and small text columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# NFKC leaves alone what is below U+0100, but for these; anything else goes through the Python normalizer. One range and
# single characters are two quick tests, a class of many ranges takes ten times as long for each character.
_WIDE = r"[^\x{00}-\x{FF}]"
_NARROW = "[\xa0\xa8\xaa\xaf\xb2\xb3\xb4\xb5\xb8\xb9\xba\xbc\xbd\xbe]"
_BLANK = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE = f"[{_BLANK}]+"
_NARROW_BLANK = "\t\n\x0b\f\r\x85"
_MARKS = "*_`~"
# Upper case below U+0100; a text without other characters needs no case mapping of the whole of Unicode.
_UPPER = "".join(chr(i) for i in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
_CJK = r"[\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    """NFKC. Only texts that can change reach Python; the rest stay in the JVM as nulls of the batch."""
    return F.coalesce(_nfkc(F.when(needs_nfkc(c), c)), c)


def match_norm(c: Column) -> Column:
    """Text for matching: NFKC, lower case, emphasis marks dropped, white space collapsed and trimmed."""
    odd = F.regexp_replace(F.lower(_nfkc(F.when(needs_nfkc(c), c))), f"[{_MARKS}]", "")
    plain = F.translate(c, _UPPER + _MARKS, _UPPER.lower())
    # A blank alone stays as it is: only longer runs and other white space are replaced.
    narrow = F.regexp_replace(plain, f"[ {_NARROW_BLANK}]{{2,}}|[{_NARROW_BLANK}]", " ")
    return F.trim(F.coalesce(F.regexp_replace(odd, _SPACE, " "), narrow))


def needs_nfkc(c: Column) -> Column:
    """Whether NFKC can change a text at all."""
    return c.rlike(_WIDE) | c.rlike(_NARROW)


def plain_name(c: Column) -> Column:
    """``name_norm`` of a text that NFKC leaves alone; usable inside array functions."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}@]+", " "))


def name_norm(c: Column) -> Column:
    """Person name for comparison: NFKC, lower case, everything but letters, digits and ``@`` becomes one space."""
    return plain_name(nfkc(c))


def windows(c: Column, n: int, first: str = "") -> Column:
    """Every window of ``n`` characters, in order, or those that begin with the character ``first``.

    One linear pass; ``substring`` per position would be quadratic.
    """
    pattern = r"(?s)(?=(%s.{%d}))" % (first or r"[^\x{DC00}-\x{DFFF}]", n - 1)
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def grams(c: Column) -> Column:
    """Distinct character trigrams of a normalized text; a shorter text is one gram, an empty one has none.

    ``c`` must be a plain column when it was normalized in Python.
    """
    none = F.array().cast("array<string>")
    return F.when(F.length(c) == 0, none).when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(windows(c, 3)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two gram arrays without duplicates; 0 when either is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def truncate_chars(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when the text was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def clean_text(c: Column) -> Column:
    """Newlines unified, control characters and trailing blanks removed, blank runs cut to two, ends trimmed."""
    t = F.regexp_replace(c, r"^\x{FEFF}+", "")
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"[\p{Cc}&&[^\t\n]]", "")
    t = F.regexp_replace(t, r"[\p{Z}\t]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    return F.regexp_replace(t, r"^\n+|\n+\z", "")


def one_line(c: Column) -> Column:
    """White space collapsed; null when nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, _SPACE, " ")), F.lit(""))


def estimate_tokens(c: Column) -> Column:
    """One token per CJK character, one per four other characters (rounded up)."""
    cjk = F.regexp_count(c, F.lit(_CJK))
    return (cjk + F.ceil((F.length(c) - cjk) / 4)).cast("long")


def _le64(n: Column) -> Column:
    big = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)]))


def _part(c: Column) -> Column:
    raw = F.encode(c, "UTF-8")
    return F.concat(_le64(F.octet_length(raw)), raw)


def parts_hash(*parts: Column) -> Column:
    """Hex SHA-256 over parts, each with its length in front."""
    return F.sha2(F.concat(*[_part(p) for p in parts]), 256)


def body_hash(body: Column) -> Column:
    """Input hash of a summary: the body alone."""
    return F.concat(F.lit("b2:"), parts_hash(body))


def native_hash(prompt_version: Column, model: Column, body: Column) -> Column:
    """Input hash of a source-native summary."""
    return parts_hash(prompt_version, model, body)


def hash_of_hashes(hex_hashes: Column) -> Column:
    """``parts_hash`` over an array of 64-character hex strings."""
    framed = F.transform(hex_hashes, lambda h: F.concat(F.lit("4000000000000000"), F.hex(F.encode(h, "UTF-8"))))
    return F.sha2(F.unhex(F.array_join(framed, "")), 256)


def slug(c: Column) -> Column:
    """File-safe id: kept when short and safe, else a readable prefix and 12 hex digits of its hash."""
    safe = F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")
    keep = (safe == c) & ~c.startswith(".") & (c != "") & (F.octet_length(c) <= 64)
    prefix = F.substring(F.regexp_replace(safe, r"^\.+", ""), 1, 40)
    digest = F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 12)
    return F.when(keep, safe).when(prefix == "", digest).otherwise(F.concat_ws("-", prefix, digest))


def bullets(c: Column) -> Column:
    """A bulleted section as an array of its items."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^- ", ""))
    return F.filter(lines, lambda x: F.trim(x) != "")


def snippet(c: Column, terms: Sequence[str], width: int = 80) -> Column:
    """About ``width`` characters around the first match of any term."""
    low = F.lower(c)
    hits = [F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in terms if t]
    first = F.least(*hits, F.lit(None).cast("int")) if hits else F.lit(None).cast("int")
    pos = F.when(F.length(low) == F.length(c), F.coalesce(first - 1, F.lit(0))).otherwise(F.lit(0))
    start = F.greatest(pos - width // 3, F.lit(0))
    end = F.least(start + width, F.length(c))
    body = F.replace(F.substring(c, start + 1, end - start), F.lit("\n"), F.lit(" "))
    return F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(end < F.length(c), F.lit("…")).otherwise(F.lit(""))
    )


def occurrences(c: Column, term: Column | str) -> Column:
    """Number of positions where ``term`` starts in ``c``, overlaps included."""
    t = F.lit(term) if isinstance(term, str) else term
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.regexp_count(c, quoted)


def contains_email(text: Column, email: Column) -> Column:
    """Whether the lower-case ``text`` holds ``email`` as a whole address."""
    quoted = F.concat(F.lit("\\Q"), email, F.lit("\\E"))
    pattern = F.concat(
        F.lit(r"(?<![\p{L}\p{N}._%+\-])"), quoted, F.lit(r"(?![\p{L}\p{N}_\-])(?!\.[\p{L}\p{N}])")
    )
    return F.regexp_like(text, pattern)


def glob_regex(pattern: str) -> str:
    """Anchored, lower-case regex of a glob: ``*`` and ``?`` stop at ``/``, ``**`` does not."""
    out, i, p = [], 0, pattern.lower()
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:.*/.*)?")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append("\\" + p[i] if not p[i].isalnum() and p[i] not in " _" else p[i])
            i += 1
    return "(?s)^" + "".join(out) + "$"


def _by_name(pattern: str) -> str | None:
    """A glob that says the same of the last segment of a path alone, if there is one.

    Without ``/`` and ``**`` that is the glob itself. ``**/*x`` takes any path that ends like ``x``, and so does ``*x`` of
    the last segment.
    """
    last = pattern[3:] if pattern.startswith("**/*") else pattern
    return None if "/" in last or "**" in last else last


def glob_match(c: Column, patterns: Sequence[str], path: bool = False, name: Column | None = None) -> Column:
    """Whether any glob matches; with ``path`` a pattern without ``/`` is also tried on the last segment.

    ``name`` is the end of the path that holds its last segment, if at hand: what it decides does not ask for the path.
    """
    low, cond = F.lower(c), F.lit(False)
    end = low if name is None else F.lower(name)
    last = F.substring_index(end, "/", -1)
    for p in patterns:
        short = _by_name(p) if path else None
        cond = cond | (low.rlike(glob_regex(p)) if short is None else last.rlike(glob_regex(short)))
        if path and short is None and "/" not in p:
            cond = cond | last.rlike(glob_regex(p))
    return cond
