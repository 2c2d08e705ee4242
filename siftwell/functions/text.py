"""Text, identifier and identity functions as column expressions."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.splitlines splits at.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_FOLDED = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň",
    "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
FOLD_FROM = "".join(_FOLDED.values())
FOLD_TO = "".join(k * len(v) for k, v in _FOLDED.items())


def fold(c: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.array_remove(F.split(fold(c), r"[^\p{L}\p{N}]+"), "")


def camel_split(c: Column) -> Column:
    c = F.regexp_replace(c, r"([0-9a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(c, r"([A-Z]{1,})([A-Z][a-z])", "$1 $2")


def normalize_identifier(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.translate(camel_split(F.btrim(c)), "_-.", "   "), r"\s+", " ")))


def identifier_terms(*columns: Column) -> Column:
    """The whole in lower case, each ASCII fragment, and each camel-case or digit part; distinct, in order."""

    def one(c: Column) -> Column:
        fragments = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda x: x != "")
        parts = F.flatten(F.transform(fragments, lambda x: F.concat(F.array(x), F.regexp_extract_all(x, F.lit(r"[0-9]+|[A-Z]+(?=[0-9]|$|[A-Z][a-z])|[A-Z]{0,1}[a-z]+|[A-Z]+"), F.lit(0)))))
        return F.concat(F.array(c), parts)

    found = F.concat(*[F.coalesce(one(c), F.array().cast("array<string>")) for c in columns])
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: x != ""))


def query_terms(query: str, most: int = 32) -> list[str]:
    """Distinct terms of a query, at most 128 characters each; the driver's side of ``tokens``."""
    found = [t for t in re.findall(r"[^\W_]+", query.casefold()) if len(t) <= 128]
    return list(dict.fromkeys(found))[:most]


def fts_terms(c: Column, most: int = 32) -> Column:
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.length(t) <= 128))
    return F.slice(F.array_distinct(words), 1, most)


def folded_query(query: str, most: int = 32) -> list[str]:
    table = str.maketrans(FOLD_FROM, FOLD_TO)
    return [t.translate(table) for t in query_terms(query, most)]


def levenshtein_bounded(a: Column, b: Column, most: int) -> Column:
    """The edit distance, or most + 1 if it is greater."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def fuzzy_score(query: str, candidate: Column, least: float = 0.55) -> Column:
    """The score of a candidate's name; see ``fuzzy_ladder``, which takes normal forms."""
    return F.transform(F.array(normalize_identifier(candidate)), lambda c: fuzzy_ladder(query, c, least))[0]


def fuzzy_ladder(query: str, c: Column, least: float = 0.55) -> Column:
    """1 for equal normal forms, .95 for a prefix, .85 for a part, else 1 - distance / longer length; 0 below ``least``.

    ``c`` is a candidate's normal form, a column, as each branch reads it. Distances are computed up to the bound alone.
    """
    q = normal_query(query)
    longer = F.greatest(F.lit(len(q)), F.length(c))
    bound = F.floor((1 - least) * longer + 1e-12).cast("int")
    distance = F.call_function("levenshtein", F.lit(q), c, bound)
    # lengths alone rule most names out before a distance is computed
    near = F.when(F.abs(len(q) - F.length(c)) > bound, 0.0).when(distance >= 0, 1 - distance / longer).otherwise(0.0)
    ladder = F.when(F.lit(q == "") | (c == ""), 0.0).when(c == q, 1.0).when(F.startswith(c, F.lit(q)), 0.95).when(F.contains(c, F.lit(q)), 0.85).otherwise(near)
    return F.coalesce(ladder, F.lit(0.0)).cast("double")


def normal_query(query: str) -> str:
    """``normalize_identifier`` of a query, on the driver."""
    parts = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([0-9a-z])([A-Z])", r"\1 \2", query.strip(" ")))
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", parts.translate(str.maketrans("_-.", "   "))).strip(" ").lower()


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def uuid5(namespace: str | Column, name: Column) -> Column:
    """RFC 4122 version 5, as lower-case text; the namespace is a UUID's text."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    h = F.sha1(F.concat(F.unhex(F.replace(ns, F.lit("-"), F.lit(""))), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


NAMESPACE = str(uuid.NAMESPACE_URL)


def embedding_text(language: Column, path: Column, kind: Column, symbol: Column, text: Column) -> Column:
    head = F.concat_ws("\n", F.concat(F.lit("Language: "), language), F.concat(F.lit("Path: "), path), F.concat(F.lit("Kind: "), kind), F.concat(F.lit("Symbol: "), symbol))
    return F.concat(head, F.lit("\n"), text)


def line_count(c: Column) -> Column:
    """max(1, number of lines), a last line end not opening another line."""
    ended = F.regexp_replace(c, f"(?:{LINE_ENDS})\\z", "")
    return F.when(c == "", 1).otherwise(F.greatest(F.lit(1), F.size(F.split(ended, LINE_ENDS, -1))))


def lines(c: Column) -> Column:
    ended = F.regexp_replace(c, f"(?:{LINE_ENDS})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(ended, LINE_ENDS, -1))


def under_path(path: Column, wanted: str | None) -> Column:
    """Equal to the path, or below it; the latter without regard to ASCII case."""
    if wanted is None:
        return F.lit(True)
    return (path == wanted) | F.startswith(ascii_lower(path), F.lit(_ascii_lower(wanted) + "/"))


def path_prefix(path: Column, query: str) -> Column:
    return (path == query) | F.startswith(ascii_lower(path), F.lit(_ascii_lower(query)))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def valid_path(path: str | None) -> str | None:
    """A path filter in normal form; None for no filter. Absolute paths, drives, NUL and parent steps are errors."""
    if path is None or path.strip() in ("", "."):
        return None
    p = path.strip().replace("\\", "/")
    if len(p) > 4096 or "\0" in p or p.startswith("/") or re.match(r"[A-Za-z]:", p) or ".." in p.split("/"):
        raise ValueError(f"not a relative path: {path!r}")
    p = "/".join(x for x in p.split("/") if x not in ("", "."))
    return p or None


def is_path_like(query: str) -> bool:
    return bool(re.search(r"[\\/]|(?<!\S)\S+\.[0-9A-Za-z]{1,12}(?!\S)", query))


def path_query(query: str) -> str:
    q = query.strip().replace("\\", "/")
    return q[2:] if q.startswith("./") else q


def is_identifier_like(query: str) -> bool:
    q = query.strip()
    return len(q) <= 256 and bool(re.match(r"[^\W\d]\w*[\w.\-]*$|_[\w.\-]*$", q))


def snippet(c: Column, most: int) -> tuple[Column, Column]:
    """(at most that many characters, whether there were more)."""
    return F.substring(c, 1, most), F.length(c) > most


def symbol_name(c: Column, most: int = 4096) -> Column:
    """A name as results show it: its first 4,096 characters."""
    return F.substring(c, 1, most)


def evidence_text(c: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(c, r"\s+", " ")), 1, 256)


def module_name(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.when(stem == "", "__root__").otherwise(F.replace(stem, F.lit("/"), F.lit(".")))


def hashed_vector(c: Column, dimension: int) -> Column:
    """A deterministic unit vector from SHA-256: byte i of round r is mapped to [-1, 1]."""
    rounds = -(-dimension // 32)
    digest = F.concat(*[F.sha2(F.concat(c.cast("binary"), F.lit(f":{r}").cast("binary")), 256) for r in range(rounds)])
    raw = lambda d: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    scaled = lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))), lambda norm: F.transform(v, lambda x: x / norm))[0]
    # a lambda's body is evaluated per element: digest, components and norm are elements themselves, so each is made once a row
    return F.transform(F.transform(F.array(digest), raw), scaled)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
