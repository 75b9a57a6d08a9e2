"""Types and canonical forms of single values, as column expressions.

All functions take and give columns, also lambda variables of higher-order
functions. Null values give null unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

_PLAIN = r"^[a-z]+\z"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A recognizer that was activated: (prefix, type), for the prefix and ASCII letters or digits to the end; or (predicate over a value, type).
Activation = tuple[str | Callable[[Column], Column], str]


def _like(v: Column, pattern: str) -> Column:
    return F.regexp_like(v, F.lit(pattern))


def one_of(v: Column, words: Sequence[str]) -> Column:
    """Whether a value is in a word list. As one pattern: a plan with a literal for each word is slow to build and optimise."""
    return _like(v, "^(?:" + "|".join(map(re.escape, words)) + r")\z")


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a key in a small constant table, else null."""
    by: dict[str, list[str]] = {}
    for k, v in pairs.items():
        by.setdefault(v, []).append(k)
    return reduce(lambda c, kv: F.when(one_of(key, kv[1]), kv[0]) if c is None else c.when(one_of(key, kv[1]), kv[0]), by.items(), None)


def ascii_upper(v: Column) -> Column:
    return F.translate(v, _LOWER, _UPPER)


def ascii_lower(v: Column) -> Column:
    return F.translate(v, _UPPER, _LOWER)


def lower_each(v: Column) -> Column:
    """Lower case character by character: no rule looks at neighbours."""
    return F.when(F.regexp_like(v, F.lit(r"[^\x00-\x7F]")), F.array_join(F.transform(F.split(v, ""), F.lower), "")).otherwise(F.lower(v))


def _plausible(y: Column, m: Column, d: Column) -> Column:
    return y.cast("int").between(1900, 2100) & m.cast("int").between(1, 12) & d.cast("int").between(1, 31)


def _dates(v: Column) -> list[tuple[str, list[Column]]]:
    """(pattern, [year, month, day]) of each date form."""
    def part(p: str, k: int) -> Column:
        return F.regexp_extract(v, p, k)

    forms = [(p, [part(p, 1), part(p, 2), part(p, 3)]) for p in (L.DATE_ISO, L.DATE_SLASH, L.COMPACT_DATE)]
    us = L.DATE_US
    return [*forms, (us, [part(us, 3), F.lpad(part(us, 1), 2, "0"), F.lpad(part(us, 2), 2, "0")])]


def canonical_date(v: Column) -> Column:
    """YYYY-MM-DD of a date in any of four forms with plausible year, month and day; else null."""
    out = None
    for pattern, (y, m, d) in _dates(v):
        made = F.when(_plausible(y, m, d), F.concat_ws("-", y, m, d))
        out = F.when(_like(v, pattern), made) if out is None else out.when(_like(v, pattern), made)
    return out


def canonical_currency(v: Column) -> Column:
    """The upper-case currency code, else null."""
    return F.when(one_of(ascii_upper(v), L.CURRENCIES), ascii_upper(v))


def file_kind(v: Column) -> Column:
    """The kind of the last extension; ``unknown`` without a known one."""
    kinds = {x: k for k, xs in L.FILE_KINDS.items() for x in xs}
    return F.coalesce(lookup(kinds, ascii_lower(F.regexp_extract(v, L.FILE_EXT, 1))), F.lit("unknown"))


def _extension_known(v: Column) -> Column:
    return one_of(ascii_lower(F.regexp_extract(v, L.FILE, 1)), [x for xs in L.FILE_KINDS.values() for x in xs])


def classify(v: Column, activations: Sequence[Activation] = ()) -> Column:
    """The type of a value; the first rule that holds decides. Empty values are literals."""
    length = F.length(v)
    number = v.try_cast("bigint")
    y, m, d = (F.regexp_extract(v, L.COMPACT_DATE, k) for k in (1, 2, 3))
    slug = F.when(_like(v, L.SLUG), "slug")
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    octets = ~_like(v, r"(?:^|\.)(?:2(?:5[6-9]|[6-9][0-9])|[3-9][0-9]{2})(?:\.|\z)")  # no part above 255
    a, b = F.regexp_extract(v, L.COORDINATE, 1).try_cast("double"), F.regexp_extract(v, L.COORDINATE, 2).try_cast("double")
    placed = (a.between(-90, 90) & b.between(-180, 180)) | (a.between(-180, 180) & b.between(-90, 90))
    c = (
        F.when(v == "", "literal")
        .when((length == 36) & _like(v, L.UUID), "uuid")
        .when(length.between(8, 10) & ((v.contains("-") & _like(v, L.DATE_ISO)) | (v.contains("/") & (_like(v, L.DATE_SLASH) | _like(v, L.DATE_US)))), "date")
        .when(
            _like(v, L.INTEGER),
            F.when(number.between(10**9, 10**10 - 1) | number.between(10**12, 10**13 - 1), "timestamp").when((length == 8) & _plausible(y, m, d), "date").otherwise("integer"),
        )
    )
    for prefix, kind in activations:
        fits = prefix(v) if callable(prefix) else v.startswith(prefix) & _like(F.substring(v, len(prefix) + 1, 1 << 30), r"^[A-Za-z0-9]+\z")
        c = c.when(fits, kind)
    return (
        # The most frequent kinds first: no rule before those of literals and floats holds for these. Each rule passed costs time.
        c.when((length == 1) | (length.between(4, 31) & _like(v, _PLAIN) & ~v.isin("true", "false")), "literal")
        .when((length <= 10) & v.contains(".") & _like(v, L.FLOAT), "float")
        .when(v.startswith("ey") & (length > 4) & _like(v, L.JWT), "jwt")
        .when(v.startswith("#") & _like(v, L.COLOR_HEX), "color")
        .when(v.contains("://") & _like(v, L.URL), "url")
        .when(v.contains("@") & _like(v, L.EMAIL), "email")
        .when(v.contains("/") & _like(v, L.MIME), "mime")
        .when(v.contains("/") & _like(v, L.SCHEMELESS_URL), "url")
        .when(v.contains(".") & _like(v, L.IPV4), F.when(octets, "ipv4").otherwise("opaque_id"))
        .when(v.contains(":") & (_like(v, L.IPV6_FULL) | (v.contains("::") & _like(v, L.IPV6_COMPRESSED))), "ipv6")
        .when(v.contains(",") & _like(v, L.COORDINATE), F.when(placed, "coordinate").otherwise("opaque_id"))
        .when((length >= 32) & _like(v, L.HASH), "hash")
        .when(v.startswith("v") & _like(v, L.VERSION), "version")
        .when(length.between(4, 5) & _like(v, L.BOOLEAN), "boolean")
        .when(length.between(5, 8) & _like(v, L.LOCALE), F.when(one_of(F.regexp_extract(v, L.LOCALE, 1), L.LANGUAGES), "locale").otherwise(F.coalesce(slug, F.lit("literal"))))
        .when((length == 2) & _like(v, L.LOCALE_BARE), F.when(one_of(v, L.LANGUAGES), "locale").otherwise("literal"))
        .when(v.contains(":") & _like(v, L.ISO_TIME), "timestamp")
        .when(v.startswith("+") & _like(v, L.PHONE), F.when(digits.between(7, 15), "phone").otherwise("opaque_id"))
        .when((v.contains("-") | v.contains(".") | v.startswith("(")) & _like(v, L.PHONE_NANP), "phone")
        .when(v.contains(".") & _like(v, L.FLOAT), "float")
        .when((length == 3) & _like(v, L.CURRENCY), F.when(canonical_currency(v).isNotNull(), "currency").otherwise("literal"))
        .when((length == 2) & _like(v, L.COUNTRY), F.when(one_of(v, L.COUNTRIES), "country").otherwise("literal"))
        .when((length >= 16) & (v.contains("=") | v.contains("+") | v.contains("/")) & _like(v, L.BASE64), "base64")
        .when(v.contains(".") & _like(v, L.FILE), F.when(_extension_known(v), "file").otherwise(F.coalesce(slug, F.lit("opaque_id"))))
        .when((v.contains("-") | v.contains("_")) & _like(v, L.SLUG), "slug")
        .when(_like(v, L.LITERAL), "literal")
        .when(_like(v, L.OPAQUE), "opaque_id")
        .otherwise("literal")
    )


def display_type(t: Column) -> Column:
    return F.when(t.isin("ipv4", "ipv6"), "ip").otherwise(t)


def placeholder(t: Column) -> Column:
    return F.concat(F.lit("{"), display_type(t), F.lit("}"))


def param_name_hint(name: Column, t: Column) -> Column:
    """The type that a parameter's name suggests for an untelling type, else null."""
    names = {x: k for k, xs in L.NAME_HINTS.items() for x in xs}
    return F.when(t.isin("literal", "opaque_id", "slug"), lookup(names, F.lower(name)))


def canonical_form(t: Column, v: Column) -> Column:
    """The canonical date or currency of a value of that type, else null."""
    return F.when(t == "date", canonical_date(v)).when(t == "currency", canonical_currency(v))


def singularize(w: Column) -> Column:
    """The singular of an English word by irregular forms and ordered rules; unknown words stay."""
    low = F.lower(w)
    irregular = lookup(L.IRREGULAR, low)
    cased = F.when(w == F.upper(w), F.upper(irregular)).when(F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), F.concat(F.upper(F.substring(irregular, 1, 1)), F.substring(irregular, 2, 1 << 30))).otherwise(irregular)
    c = F.when((w == "") | one_of(low, [*L.UNCOUNTABLE, *L.IRREGULAR]), F.when((w == "") | one_of(low, L.UNCOUNTABLE), w).otherwise(cased))
    # No rule but the last holds for these, and none at all for words with another end than the rules have.
    c = c.when(_like(w, r"(?iu)[^aesuw]s\z"), F.substring(w, F.lit(1), F.length(w) - 1)).when(~_like(w, r"(?iu)[ains]\z"), w)
    for pattern, to in L.SINGULAR_RULES:
        c = c.when(_like(w, pattern), F.regexp_replace(w, pattern, to))
    return c.otherwise(w)


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, three under a known two-label suffix; addresses and short hosts stay."""
    labels = F.split(F.regexp_replace(host, r"\.+\z", ""), r"\.")
    last = F.array_join(F.slice(labels, -2, 2), ".")
    return (
        F.when(_like(host, L.IPV4) | (F.size(labels) <= 2), host)
        .when(one_of(last, L.TWO_LABEL_SUFFIXES), F.array_join(F.slice(labels, -3, 3), "."))
        .otherwise(last)
    )
