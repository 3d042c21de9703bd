"""Supplier, buyer and solicitation names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
#: Legal forms that a normalised name leaves out.
LEGAL_FORMS = ("inc", "incorporated", "ltd", "ltee", "ltée", "limited", "corp", "corporation", "co", "company", "llc", "lp", "ulc", "srl", "sa", "gmbh")
#: First letters of these, in either case and as Unicode folds them: the forms are only tried where one stands.
LEGAL_BEGIN = "ILCUSGilcusgİıſ"
#: Words that say where or what kind of company, not which one.
GENERIC_WORDS = ("CANADA", "CANADIAN", "GROUP", "THE", "LE", "LA", "LES", "DE", "DU", "DES", "ET", "AND", "OF", "LLP", "LP", "INTERNATIONAL", "DIVISION", "DIV", "HOLDINGS")
JOINT_VENTURE = r"\b(JOINT VENTURE|J V|JV|S E N C|SENC|COENTREPRISE)\b"
SOLICITATION_ENDING = r"(?:VERSION[A-Z0-9]+|[/\-_][A-Z0-9]{1,3}|(?<=\d)[A-Z])$"
#: What a listing adds after a name: " - Ottawa (K2E7L6); 6 award(s)".
LISTED_ENDING = r"(?i)\s+-\s+[^()]*\([^()]*\)(?:;\s*\d+\s+AWARD\(S\))?\s*$"
CODE_BREAKS = r"[\r\n,;|\s]+"
CATEGORY_BREAKS = r"[\r\n,;|]+"
UNSAFE_IN_FILES = r'[<>:"/\\|?*\x00-\x1f]'
# -------------------------------------------------------------------------------------------------


def normal_name(name: Column) -> Column:
    """Upper case without legal forms, signs and repeated blanks; null stays null."""
    plain = F.regexp_replace(F.upper(name), rf"(?=[{LEGAL_BEGIN}])(?iU)\b({'|'.join(LEGAL_FORMS)})\b\.?", " ")
    return F.trim(F.regexp_replace(plain, "[^A-Z0-9À-Ÿ]+", " "))


def core_name(normal: Column) -> Column:
    """A normalised name without generic words."""
    return F.array_join(F.filter(F.split(normal, " "), lambda w: ~w.isin(*GENERIC_WORDS) & (w != "")), " ")


def first_word(normal: Column) -> Column:
    """The first word of the core with four letters or more that isn't a number; null if there is none."""
    return F.get(F.filter(F.split(core_name(normal), " "), lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$")), F.lit(0))


def joint_venture(normal: Column) -> Column:
    return normal.rlike(JOINT_VENTURE)


def listed_name(text: Column) -> Column:
    """A name as a model copied it from a listing, without what the listing added."""
    return F.trim(F.regexp_replace(F.upper(F.trim(text)), LISTED_ENDING, ""))


def postal_code(code: Column) -> Column:
    """Upper case letters and digits only; empty becomes null."""
    plain = F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")
    return F.when(plain != "", plain)


def solicitation(number: Column) -> Column:
    """Upper case without blanks; empty becomes null."""
    plain = F.regexp_replace(F.upper(number), r"\s+", "")
    return F.when(plain != "", plain)


def base_solicitation(number: Column) -> Column:
    """Without a closing version, /A or -01 like part or letter after a digit, if six characters or more are left."""
    base = F.regexp_replace(solicitation(number), SOLICITATION_ENDING, "")
    return F.when(F.length(base) >= 6, base).otherwise(solicitation(number))


def words(name: Column) -> Column:
    """Lower-case words of letters and digits, accents kept, in order."""
    return F.regexp_extract_all(F.lower(name), F.lit(r"([0-9a-zà-ÿ]+)"), 1)


def begins_with(long: Column, short: Column) -> Column:
    a, b = words(long), words(short)
    return (F.size(b) > 0) & (F.slice(a, F.lit(1), F.size(b)) == b)


def says(text: Column, name: Column) -> Column:
    """The name's words occur in the text in a row, as words."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return (F.size(words(name)) > 0) & F.contains(pad(text), pad(name))


def part_of(brand: Column, company: Column) -> Column:
    """Every word of the brand is a word of the company's name."""
    return F.coalesce((F.size(words(brand)) > 0) & (F.size(F.array_except(words(brand), words(company))) == 0), F.lit(False))


def squash(name: Column) -> Column:
    """Lower-case letters and digits only: the key of a respelling."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def safe_component(name: Column, most: int = 90) -> Column:
    """A file name's part: unsafe characters and blanks become underscores; none at the ends."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), UNSAFE_IN_FILES, "_"), r"\s+", "_")
    plain = F.substring(F.regexp_replace(plain, r"^[ ._]+|[ ._]+$", ""), 1, most)
    return F.when(plain != "", plain).otherwise("unnamed")


def url_filename(url: Column, index: Column) -> Column:
    """The file name of the index-th link, with its ending in lower case."""
    base = safe_component(F.substring_index(F.substring_index(url, "/", -1), "?", 1))
    ending = F.regexp_extract(base, r"^(.*[^.].*)(\.[^.]*)$", 2)
    return F.concat(F.format_string("%02d_", index), F.substring(base, F.lit(1), F.length(base) - F.length(ending)), F.lower(ending))


def codes(cell: Column) -> Column:
    """The digits of each part of a cell of codes."""
    return F.transform(F.split(F.coalesce(cell, F.lit("")), CODE_BREAKS), lambda c: F.regexp_replace(c, "[^0-9]", ""))


def first_code(cell: Column, digits: int = 4) -> Column:
    """The first code of a cell with ``digits`` digits or more, digits only; null if there is none."""
    part = r"\r\n,;|\s"
    first = F.regexp_extract(F.coalesce(cell, F.lit("")), rf"(?<![^{part}])(?:[^0-9{part}]*+[0-9]){{{digits}}}[^{part}]*+", 0)
    return F.when(first != "", F.regexp_replace(first, "[^0-9]", ""))


def categories(cell: Column) -> Column:
    """The set of a cell of starred categories."""
    parts = F.transform(F.filter(F.split(F.coalesce(cell, F.lit("")), CATEGORY_BREAKS), lambda c: F.trim(c) != ""), lambda c: F.upper(F.trim(F.regexp_replace(F.trim(c), r"^\*+", ""))))
    return F.array_distinct(parts)
