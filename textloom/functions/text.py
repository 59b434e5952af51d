"""Column functions over text: words, licences, personal data, names, units, dates, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column, pattern: str = "\\p{L}+") -> Column:
    """Lower-cased matches of a word pattern; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)


def licence_class(text: Column) -> Column:
    """The class of a licence statement or address; the first rule that holds wins."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike("public domain|publicdomain|cc0|zero/1"), "public domain")
        .when(t.rlike(r"by-nc|noncommercial|non-commercial"), "nc")
        .when(t.rlike(r"by-nd|noderiv"), "nd")
        .when(t.rlike(r"by-sa|sharealike|share-alike|gpl|general public license"), "sa")
        .when(t.rlike(r"cc by|cc-by|licenses/by/|apache license|mit license|creative commons attribution"), "by")
        .when(t.rlike("all rights reserved|proprietary"), "restricted")
        .otherwise("unknown")
    )


#: The same rules for the oracle.
LICENCE_SQL = """CASE WHEN regexp_matches({t}, 'public domain|publicdomain|cc0|zero/1') THEN 'public domain' WHEN regexp_matches({t}, 'by-nc|noncommercial|non-commercial') THEN 'nc'
    WHEN regexp_matches({t}, 'by-nd|noderiv') THEN 'nd' WHEN regexp_matches({t}, 'by-sa|sharealike|share-alike|gpl|general public license') THEN 'sa'
    WHEN regexp_matches({t}, 'cc by|cc-by|licenses/by/|apache license|mit license|creative commons attribution') THEN 'by' WHEN regexp_matches({t}, 'all rights reserved|proprietary') THEN 'restricted' ELSE 'unknown' END"""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LINK = r"https?://[^ \n]+"
HANDLE = r"^@[A-Za-z0-9_]{2,}$"
PHONE = r"^\+?[0-9][0-9() -]{6,}[0-9]$"


def personal(token: Column) -> Column:
    """Whether a token is an e-mail address, a link, a handle or a phone number."""
    return token.rlike(f"^{EMAIL}$") | token.rlike(f"^{LINK}$") | token.rlike(HANDLE) | token.rlike(PHONE)


def singular(word: Column) -> Column:
    """ies to y, oes to o, s dropped, but not of ss or us."""
    return F.when(word.rlike("[a-z]{2}ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("oes$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[a-z]{2}s$") & ~word.rlike("(ss|us)$"), F.regexp_replace(word, "s$", "")).otherwise(word)


SINGULAR_SQL = """CASE WHEN regexp_matches({w}, '[a-z]{{2}}ies$') THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, 'oes$') THEN regexp_replace({w}, 'es$', '')
    WHEN regexp_matches({w}, '[a-z]{{2}}s$') AND NOT regexp_matches({w}, '(ss|us)$') THEN regexp_replace({w}, 's$', '') ELSE {w} END"""


def slug(source: Column, title: Column, most: int = 70) -> Column:
    joined = F.lower(F.concat_ws("-", source, title))
    return F.substring(F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def kilobytes(text: Column) -> Column:
    """``16kb`` or ``1.5mb`` to kilobytes, rounded up; null if it says neither."""
    n = F.regexp_extract(F.lower(text), r"([0-9.]+) *(kb|mb)", 1)
    unit = F.regexp_extract(F.lower(text), r"([0-9.]+) *(kb|mb)", 2)
    number = F.when(n != "", n.cast("double"))
    return F.ceil(F.when(unit == "mb", number * 1024).otherwise(number))


def content_key(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed text."""
    return F.substring(F.sha2(F.trim(text), 256), 1, 16)


def normal_text(text: Column) -> Column:
    """White space runs to one blank, trimmed, lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def day_number(ts: Column) -> Column:
    """Days with 719529 for 1970-01-01."""
    return F.datediff(ts, F.lit("1970-01-01")) + 719529


def personal_token(token: Column) -> Column:
    """Whether a whole token is a phone number, an address of a page or of mail, or a handle.

    Of digits and ``-.() +`` alone: three and four digits, or ten or eleven in three groups and more, four at the end.
    After ``@``: two or more letters, digits, underscores and dots, with a letter. With ``@`` inside: two letters or digits
    before it or a dot after it, and a part of two and more with a letter in what looks like a domain.
    """
    t = F.lower(F.coalesce(token, F.lit("")))
    groups = F.filter(F.split(t, "[^0-9]+"), lambda x: x != "")
    n = F.aggregate(groups, F.lit(0), lambda a, x: a + F.length(x))
    size, last = F.size(groups), F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0))
    phone = (last == 4) & (((size == 2) & (F.length(F.get(groups, F.lit(0))) == 3)) | ((size >= 3) & n.between(10, 11)))
    local, domain = F.regexp_extract(t, "^(.*)@([^@]*)$", 1), F.regexp_extract(t, "^(.*)@([^@]*)$", 2)
    parts = F.exists(F.split(domain, "[._-]"), lambda x: (F.length(x) >= 2) & x.rlike("[a-z]"))
    mail = ((F.length(F.regexp_replace(local, "[^a-z0-9]", "")) >= 2) | F.contains(domain, F.lit("."))) & domain.rlike("^[a-z0-9._-]*$") & parts
    handle = t.rlike("^@[a-z0-9_.]{2,}$") & F.substring(t, 2, 1000).rlike("[a-z]")
    return F.when(t.rlike("^[0-9().+ -]+$"), phone).when(t.rlike(r"^(https?://|ftp://|mailto:|www\.)"), F.lit(True)).when(t.startswith("@"), handle).when(F.contains(t, F.lit("@")), mail).otherwise(F.lit(False))


#: The same rules for the oracle.
PERSONAL_SQL = r"""CASE WHEN regexp_matches({t}, '^[0-9().+ -]+$') THEN coalesce(length({g}[-1]) = 4 AND ((len({g}) = 2 AND length({g}[1]) = 3) OR (len({g}) >= 3 AND list_sum(list_transform({g}, lambda x: length(x))) BETWEEN 10 AND 11)), false)
    WHEN regexp_matches({t}, '^(https?://|ftp://|mailto:|www\.)') THEN true WHEN starts_with({t}, '@') THEN regexp_matches({t}, '^@[a-z0-9_.]{{2,}}$') AND regexp_matches({t}, '[a-z]') WHEN contains({t}, '@') THEN
    (length(regexp_replace(regexp_extract({t}, '^(.*)@([^@]*)$', 1), '[^a-z0-9]', '', 'g')) >= 2 OR contains(regexp_extract({t}, '^(.*)@([^@]*)$', 2), '.')) AND regexp_matches(regexp_extract({t}, '^(.*)@([^@]*)$', 2), '^[a-z0-9._-]*$')
    AND len(list_filter(regexp_split_to_array(regexp_extract({t}, '^(.*)@([^@]*)$', 2), '[._-]'), lambda x: length(x) >= 2 AND regexp_matches(x, '[a-z]'))) > 0 ELSE false END""".replace("{g}", "list_filter(regexp_split_to_array({t}, '[^0-9]+'), lambda x: x <> '')")

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def rfc_date(text: Column) -> Column:
    """The date of ``Wed, 01 Oct 1997 11:48:56 GMT``; null for what isn't of that form."""
    part = lambda k: F.regexp_extract(text, r"^\s*\S+\s+([0-9]{1,2})\s+([A-Z][a-z]{2})\s+([0-9]{4})\b", k)
    at = F.instr(F.lit(MONTHS), part(2))
    month = F.when((part(2) != "") & (at % 3 == 1), ((at + 2) / 3).cast("int"))
    return F.try_to_date(F.format_string("%s-%02d-%s", part(3), month, F.lpad(part(1), 2, "0")), "yyyy-MM-dd")


def death_years(authors: Column) -> Column:
    """The last year of each author of ``A, 1820-1891; B, 1850-1920``, 0 for one before our era; null if any has none."""
    each = F.filter(F.transform(F.split(authors, ";"), lambda x: F.trim(x)), lambda x: x != "")
    year = lambda x: F.when(F.contains(x, F.lit("BCE")), 0).otherwise(F.nullif(F.coalesce(F.nullif(F.regexp_extract(x, r"-[^0-9-]*([0-9]{1,9})[^-]*$", 1), F.lit("")), F.lit("0")).cast("int"), F.lit(0)))
    years = F.transform(each, year)
    return F.when((F.size(years) > 0) & F.forall(years, lambda y: y.isNotNull()), years)
