"""Text as Columns: folding, keys, qualitative wording, labels, review reasons."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, functions as F

UNKNOWN = "$UNKNOWN$"

# ---- fixed values -------------------------------------------------------------------------------
#: How folded text begins or reads that means detected, present or abnormal.
POSITIVE_STARTS = (
    "positiv", "detetad", "detect", "reagent", "reactiv", "resultado positivo", "rara", "raras", "raro", "raros", "raras plaquetas",
)
POSITIVE_WHOLE = (
    "abundantes", "anisocitose", "anisocitose e anisocromia.", "anisocromia", "levemente turvo", "r", "trace", "traces",
    "turvo", "vestigio", "vestigios", "cultura polimicrobiana", "(*)", "*",
)
POSITIVE_INSIDE = ("gram positivo", "gram negativo", "hiperplasiado")
#: What means not detected, absent or normal.
NEGATIVE_STARTS = (
    "negativ", "normal", "nr", "ausent", "ausenci", "nao reagente", "nao det", "not detected", "non reactive", "nao contem",
    "nao se ", "nao revelou", "sem alteracoes", "limpid", "amicrobiano", "cultura esteril", "esteril", "sterile",
    "por hplc nao foram detectadas", "nao foram observad", "exame ecografico", "forma e dimensoes normais",
    "de normal morfologia", "morfologia celular: normal", "o estudo electroforetico", "num exame quimico com ausencia",
    "amarel", "clar", "transparen",
)
NEGATIVE_WHOLE = ("citrina",)
NEGATIVE_INSIDE = ("distendida, apresenta paredes finas",)
STRIP_SECTIONS = (
    "sumária da urina", "sumaria da urina", "exame sumário", "exame sumario", "tipo ii", "elementos anormais",
    "avaliação bioquímica", "avaliacao bioquimica",
)
ABSOLUTE_COUNT_MARKS = (
    "v.abs", "vabs", "10^9/", "10^3/", "10e3/", "10³/", "x10^9/", "x10^3/", "x10e3/", "x10³/", "/mm3", "/mm³", "/ul", "/µl",
)
#: Field labels that must not be inside a lab name.
FIELD_LABELS = ("raw_value:", "raw_lab_unit:", "raw_reference_range:", "raw_comments:", "raw_section_name:", "raw_lab_name:")
# -------------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; trim() alone takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _one_to_one() -> tuple[str, str]:
    """Characters whose compatibility decomposition, without marks, is one other character: made by rule."""
    old, new = [], []
    for code in range(0xA0, 0x2500):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(code):
            old.append(chr(code))
            new.append(plain)
    return "".join(old), "".join(new)


_FROM, _TO = _one_to_one()
_LIGATURES = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xFB00, 0xFB07)}


def fold_accents(c: Column) -> Column:
    """NFKD without combining marks, for characters that stay one, and Latin ligatures."""
    c = F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}+", "")
    for old, new in _LIGATURES.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def fold(c: Column) -> Column:
    return fold_accents(F.lower(strip(c)))


def _any(c: Column, starts=(), whole=(), inside=()) -> Column:
    """One pattern for a class of wordings, so that the generated code stays small."""
    quote = lambda s: "".join("\\" + x if x in r"\.*+?()[]{}|^$" else x for x in s)
    parts = [f"^(?:{'|'.join(map(quote, starts))})"] if starts else []
    parts += [f"^(?:{'|'.join(map(quote, whole))})$"] if whole else []
    parts += [f"(?:{'|'.join(map(quote, inside))})"] if inside else []
    return c.rlike("|".join(parts))


def classify_qualitative(c: Column) -> Column:
    """1 detected or abnormal, 0 absent or normal, null unclear; what is positive is looked for first."""
    t = fold(c)
    return (
        F.when(c.isNull() | t.isin("", "nan", "none", "null"), F.lit(None).cast("int"))
        .when(_any(t, POSITIVE_STARTS, POSITIVE_WHOLE, POSITIVE_INSIDE), 1)
        .when(_any(t, inside=NEGATIVE_INSIDE), 0)
        .when(t.rlike(r"^\++$|^\d+\+$"), 1)
        .when(_any(t, NEGATIVE_STARTS, NEGATIVE_WHOLE), 0)
    )


def blank_like(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit("")).isin("", "nan", "none", "null")


# ---- fixed values: how messages of a service's faults read: exact case, any case --------------------
SERVICE_FAULTS = (
    ("authentication", ("401", "Unauthorized"), ()), ("authorization", ("403", "Forbidden"), ("permission",)), ("timeout", (), ("timeout",)), ("not found", ("404",), ()),
    ("rejected", ("400", "BadRequest"), ("invalid",)), ("connection", ("Connection", "getaddrinfo"), ("refused", "reset", "name or service not known")),
)
# -----------------------------------------------------------------------------------------------------


# ---- keys ---------------------------------------------------------------------------------------
def name_key(c: Column) -> Column:
    return F.lower(strip(c))


def section_key(c: Column) -> Column:
    return F.when(blank_like(c), "").otherwise(F.lower(strip(c)))


def unit_key(c: Column) -> Column:
    """Lower case without spaces; ``null`` if blank; ``x109/l`` with its power sign."""
    compact = F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", "")
    power = F.regexp_replace(compact, r"^x10(\d{1,2})/l$", r"x10^$1/l")
    return F.when(blank_like(c), "null").when(compact.rlike(r"^x10\d{1,2}/l$"), power).otherwise(F.lower(strip(c)))


def cache_key(name: Column, section: Column) -> Column:
    s = section_key(section)
    return F.when(s == "", name_key(name)).otherwise(F.concat(name_key(name), F.lit("|"), s))


def legacy_cache_key(name: Column, section: Column) -> Column:
    s = section_key(section)
    return F.when(s == "", name_key(name)).otherwise(F.concat(s, F.lit(" - "), name_key(name)))


def collapse_spaced_letters(c: Column) -> Column:
    """``I M U N O`` to ``IMUNO``: three or more single letters."""
    return F.when(c.rlike(r"^\p{L}(\s+\p{L}){2,}$"), F.regexp_replace(c, r"\s+", "")).otherwise(c)


def _folded_part(c: Column) -> Column:
    return F.regexp_replace(fold_accents(F.lower(collapse_spaced_letters(strip(c)))), r"\s+", " ")


def folded_key(c: Column) -> Column:
    """The key with each part folded: around ``|``, or else around the first `` - ``."""
    bar, dash = F.instr(c, "|"), F.instr(c, " - ")
    around = lambda at, size, sep: F.concat(_folded_part(F.substring(c, F.lit(1), at - 1)), F.lit(sep), _folded_part(F.substring(c, at + size, F.length(c))))
    return F.when(bar > 0, around(bar, 1, "|")).when(dash > 0, around(dash, 3, " - ")).otherwise(_folded_part(c))


def section_inference_key(c: Column) -> Column:
    return F.regexp_replace(F.replace(fold_accents(F.lower(strip(c))), F.lit("º"), F.lit("o")), r"\s+", " ")


def conversion_unit_token(c: Column) -> Column:
    """A unit for comparing with a conversion table: signs that look alike are one, and spaces go."""
    return F.regexp_replace(F.translate(F.lower(c), "μˆ×³²⁹", "µ^x329"), r"(?U)\s+", "")


# ---- what a text looks like -----------------------------------------------------------------------
def is_strip_section(c: Column) -> Column:
    return F.coalesce(_any(F.lower(strip(c)), inside=STRIP_SECTIONS), F.lit(False))


def is_sediment_section(c: Column) -> Column:
    return F.coalesce(F.lower(c).contains("sedimento"), F.lit(False))


def unit_looks_percent(c: Column) -> Column:
    u = F.lower(F.coalesce(c, F.lit("")))
    return u.contains("%") | u.contains("percent")


def unit_looks_absolute(c: Column) -> Column:
    u = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    return u.rlike(r"(?:^|x)10\^?(?:3|9)/") | _any(u, inside=ABSOLUTE_COUNT_MARKS)


def has_field_label(c: Column) -> Column:
    return _any(F.lower(c), inside=FIELD_LABELS)


def html_text(c: Column, empty: str = "-") -> Column:
    """Text for a page, with its signs escaped; ``empty`` where there is none."""
    s = strip(c.cast("string"))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(sign), F.lit(name))
    return F.when(F.coalesce(s, F.lit("")) == "", empty).otherwise(s)


def reason_chips(c: Column) -> Column:
    """The reasons of a row as escaped text, each in brackets."""
    return F.array_join(F.transform(reason_codes(c), lambda x: F.concat(F.lit("["), html_text(x), F.lit("]"))), "")


def fill_template(c: Column, **values: Column) -> Column:
    """A text with ``{name}`` replaced for the names given; other braces stay."""
    for name, value in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return c


def service_fault(message: Column) -> Column:
    """What kind of fault an error message of a service tells, the first that fits."""
    found: Column = F.lit("unknown")
    for kind, exact, loose in reversed(SERVICE_FAULTS):
        hits = [_any(c, inside=words) for c, words in ((message, exact), (F.lower(message), loose)) if words]
        found = F.when(reduce(Column.__or__, hits), kind).otherwise(found)
    return found


def page_path(directory: Column, stem: Column, page: Column, suffix: str = ".json") -> Column:
    """Where a page's file is: ``directory/stem.NNN.json``; a null page is the first."""
    return F.concat(directory, F.lit("/"), stem, F.lit("."), F.lpad(F.coalesce(page, F.lit(1)).cast("string"), 3, "0"), F.lit(suffix))


def folder_stem(folder: Column, source: Column) -> Column:
    """A document's name: that of the source file in its folder, else the folder's without the hash of eight digits at its end."""
    return F.coalesce(document_label(source), F.regexp_replace(folder, r"^(.+)_[0-9a-fA-F]{8}$", "$1"))


def document_csv_path(directory: Column, stem: Column) -> Column:
    """Where the rows of a document are: ``directory/stem.csv``."""
    return F.concat(directory, F.lit("/"), stem, F.lit(".csv"))


def document_label(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


# ---- review status and reasons --------------------------------------------------------------------
def persisted_status(c: Column) -> Column:
    s = F.lower(strip(c))
    return F.when(s.isin("accepted", "rejected"), s)


def status_label(c: Column) -> Column:
    return F.coalesce(persisted_status(c), F.lit("pending"))


def append_reason(reason: Column, when: Column, code: str) -> Column:
    """The reason text with the code once more at its end, if the row has it and the text doesn't."""
    text = F.coalesce(reason, F.lit(""))
    return F.when(F.coalesce(when, F.lit(False)) & ~text.contains(code), F.concat(text, F.lit(code + "; "))).otherwise(text)


def append_reasons(reason: Column, checks: list[tuple[Column, str]]) -> Column:
    """``append_reason`` for several codes in order. No code is in another, so each is looked for in the text as it was."""
    text = F.coalesce(reason, F.lit(""))
    return F.concat(text, *(F.when(F.coalesce(when, F.lit(False)) & ~text.contains(code), code + "; ").otherwise("") for when, code in checks))


def reason_codes(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def remove_reason(reason: Column, code: str) -> Column:
    left = F.filter(reason_codes(reason), lambda x: x != code)
    return F.when(F.size(left) > 0, F.concat(F.array_join(left, "; "), F.lit("; "))).otherwise("")


def row_token(source: Column, page: Column, index: Column) -> Column:
    """``["file",page,index]``"""
    return F.concat(F.lit('["'), source, F.lit('",'), page.cast("string"), F.lit(","), index.cast("string"), F.lit("]"))


def row_id(source: Column, page: Column, index: Column) -> Column:
    """An opaque id: URL-safe base64 of the identity as JSON with sorted keys, without padding."""
    text = F.concat(F.lit('{"page_number": '), page.cast("string"), F.lit(', "result_index": '), index.cast("string"), F.lit(', "source_file": "'), source, F.lit('"}'))
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), r"=+$|\s", "")


def decode_row_id(c: Column) -> Column:
    padded = F.rpad(F.translate(c, "-_", "+/"), (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.decode(F.unbase64(padded), "UTF-8"), "page_number long, result_index long, source_file string")


def strip_fences(c: Column) -> Column:
    """What a Markdown code fence holds: the lines below the one that opens it. Text that doesn't start with a fence stays as it is."""
    lines = F.split(c, "\n")
    inner = F.slice(lines, F.lit(2), F.size(lines))
    closed = F.coalesce(strip(F.get(inner, F.size(inner) - 1)) == "```", F.lit(False))
    body = F.slice(inner, F.lit(1), F.size(inner) - closed.cast("int"))
    return F.when(c.startswith("```"), strip(F.array_join(body, "\n"))).otherwise(c)


def json_or(c: Column, fallback: Column) -> Column:
    """The JSON of an answer, in a fence or bare, in its shortest form; the fallback where there is none. NaN and Infinity aren't JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(strip_fences(c))), fallback)
