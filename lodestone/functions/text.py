"""Text functions: folding, synonyms, identity keys, conditions, numbers with units."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accents that search folds, synonym groups, and words a query is not searched for.
ACCENTS = ("áéíóúüñ", "aeiouun")
SYNONYMS = (
    ("celular", "celulares", "smartphone", "smartphones", "celu", "telefono", "telefonos"),
    ("notebook", "notebooks", "laptop", "laptops", "portatil", "portatiles", "computador", "computadora", "computadores"),
    ("monitor", "monitores", "pantalla", "pantallas"),
    ("procesador", "procesadores", "cpu"),
    ("grafica", "graficas", "gpu", "video"),
    ("memoria", "rams", "ram"),
    ("ssd", "solido"),
    ("disco", "discos", "hd"),
    ("teclado", "teclados", "keyboard", "keyboards"),
    ("mouse", "raton", "ratones"),
    ("audifono", "audifonos", "auricular", "auriculares", "headset", "headsets"),
    ("camara", "camaras"),
    ("parlante", "parlantes", "speaker", "speakers", "bocina", "bocinas"),
    ("tv", "televisor", "televisores", "smarttv", "smarttvs"),
    ("consola", "consolas", "playstation", "xbox", "nintendo", "switch"),
    ("router", "routers", "enrutador", "enrutadores"),
    ("tablet", "tablets", "ipad", "tableta", "tabletas"),
    ("smartwatch", "smartwatches", "reloj", "relojes"),
    ("silla", "sillas"),
    ("fuente", "fuentes"),
    ("gabinete", "gabinetes", "torre", "torres"),
    ("impresora", "impresoras"),
)
IDLE_WORDS = (
    "para", "por", "de", "del", "la", "las", "el", "los", "un", "una", "unos", "unas", "con", "sin", "en", "como", "que", "cual", "y", "o", "mi",
    "tu", "me", "te", "se", "busca", "busco", "buscar", "busqueda", "quiero", "necesito", "recomendame", "hay", "alguna", "alguno", "mejor", "buen",
    "decime", "cuales", "estos",
)


def fold(word: str) -> str:
    return word.casefold().translate(str.maketrans(*ACCENTS))


def folded(col: Column | str) -> Column:
    """Lower case without Spanish accents."""
    return F.translate(F.lower(col), *ACCENTS)


def _number_forms(word: str) -> set[str]:
    if len(word) <= 3:
        return {word}
    if word[-2:] == "es":
        return {word, word[:-1], word[:-2]}
    return {word, word[:-1]} if word[-1] == "s" else {word, word + "s", word + "es"}


def synonyms(word: str) -> set[str]:
    """Singular and plural forms, and the commercial groups these belong to."""
    forms = _number_forms(fold(word))
    return forms.union(*[group for group in SYNONYMS if forms & set(group)])


def search_terms(query: str) -> list[set[str]]:
    """One set of equivalent terms for each different word worth searching for."""
    words = dict.fromkeys(fold(w) for w in query.split())
    return [synonyms(w) for w in words if len(w) > 1 and w not in IDLE_WORDS]


def matches_all(terms: list[set[str]], *cols: Column) -> Column:
    """Every set has a term in some column; % and _ in a term act as wildcards."""
    some = [reduce(Column.__or__, [c.ilike(f"%{t}%") for t in sorted(group) for c in cols]) for group in terms]
    return reduce(Column.__and__, some, F.lit(True))


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def gtin(col: Column) -> Column:
    """Digits only, of 8, 12, 13 or 14."""
    digits = F.regexp_replace(col, "[^0-9]", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14), digits)


def _unmarked() -> tuple[str, str, dict[str, str]]:
    """What letters are without case and marks, by case folding and compatibility decomposition: those that become one letter, and those
    that become several."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0xFFFF)):
        if c != c.lower() or not c.isprintable():
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x)).casefold()
        if plain and plain != c and all(x.isalnum() for x in plain):
            if len(plain) == 1:
                one[c] = plain
            elif plain.isascii():
                several[c] = plain
    return "".join(one), "".join(one.values()), several


_ONE, _PLAIN, _SEVERAL = _unmarked()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for a row, however often ``use`` names it and wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unmarked(col: Column) -> Column:
    """Lower case, without marks; ligatures, full-width letters and their like as plain letters.

    A text of ASCII alone is only put in lower case. In others only the letters beyond ASCII are looked up.
    """
    parts = F.str_to_map(F.lit(" ".join(f"{c}={plain}" for c, plain in _SEVERAL.items())), F.lit(" "), F.lit("="))

    def spelt(low: Column) -> Column:
        each = F.transform(F.split(low, ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.coalesce(parts[c], c)))
        beyond = F.octet_length(low) != F.length(low)
        return F.when(beyond & low.rlike(rf"(?=[^\x00-\x7F])[{''.join(_SEVERAL)}]"), F.array_join(each, "")).otherwise(low)

    def plain(low: Column) -> Column:
        # The sharp s is the one such letter that texts are full of.
        one = F.replace(F.regexp_replace(F.translate(low, _ONE, _PLAIN), r"\p{Mn}", ""), F.lit("ß"), F.lit("ss"))
        return F.when(F.octet_length(low) == F.length(low), low).otherwise(bound(one, spelt))

    return bound(F.lower(col), plain)


def brand_key(col: Column) -> Column:
    return blank_to_null(unmarked(F.trim(col)))


def mpn_key(col: Column) -> Column:
    return blank_to_null(F.upper(F.trim(F.regexp_replace(col, r"\s+", " "))))


def model_key(col: Column) -> Column:
    return blank_to_null(F.lower(F.trim(F.regexp_replace(col, r"\s+", " "))))


def sku_key(col: Column) -> Column:
    return blank_to_null(F.upper(F.trim(col)))


def mpn_forms(col: Column) -> Column:
    """A part number as it is, without separators, and with spaces for them."""
    key = mpn_key(col)
    forms = F.array(key, F.regexp_replace(key, r"[\s\-_./\\]+", ""), F.trim(F.regexp_replace(key, r"[\s\-_./\\]+", " ")))
    return F.array_distinct(F.filter(forms, lambda v: F.length(v) > 0))


def slug(col: Column) -> Column:
    """Lower case; stretches of other characters than letters and digits become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-|-$", "")


def condition(col: Column) -> Column:
    """A store's wording for the state of an article, in the catalogue's words. The first rule that fits decides."""
    said = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[_-]", " ")
    has = lambda *words: reduce(Column.__or__, [said.contains(w) for w in words])
    rules = ((has("open box", "openbox"), "open_box"), (has("refurb", "reacond"), "refurbished"), (has("semi") & has("nuevo"), "semi_new"), (has("used", "usado"), "used"), (has("new", "nuevo"), "new"))
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules], F.lit("unknown"))


def stock(col: Column) -> Column:
    """Words for being sold out are looked for first, as "unavailable" holds "available"."""
    said = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z]", "")
    return F.when(said.rlike("outofstock|soldout|unavailable|discontinued|agotado"), "out_of_stock").when(said.rlike("instock|available|disponible|limited"), "in_stock").otherwise("unknown")


def peso_amount(col: Column) -> Column:
    """A price in free text: "500 lucas", "500 mil", "$500.000", "500000"; null if there is none."""
    said = F.lower(F.trim(col))
    number = lambda s: F.expr("cast(null as bigint)") if s is None else F.regexp_replace(s, "[., ]", "").try_cast("bigint")
    pattern = r"([0-9][0-9., ]{0,15}) *(lucas|mil|pesos|clp)\b"
    amount, unit = number(F.regexp_extract(said, pattern, 1)), F.regexp_extract(said, pattern, 2)
    plain = number(F.regexp_extract(said, r"[0-9][0-9.,]{1,15}", 0))
    return F.when(unit.isin("lucas", "mil"), amount * 1000).when(unit != "", amount).when(plain >= 1000, plain)


def numbers_with_units(col: Column) -> Column:
    """(value, unit) pairs in a text, units in one spelling."""
    pattern = r"([0-9]+(?:[.,][0-9]+)?) ?(ghz|mhz|gb|tb|mah|wh|hz|mm|cm|kg|w|g)\b"
    said = F.lower(col)
    values, units = F.regexp_extract_all(said, F.lit(pattern), F.lit(1)), F.regexp_extract_all(said, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(values.alias("v"), units.alias("u")), lambda p: F.struct(F.regexp_replace(p["v"], ",", ".").cast("double").alias("value"), p["u"].alias("unit")))


# Spellings of units.
UNIT_NAMES = {
    "gigabyte": "gb", "gigabytes": "gb", "gigas": "gb", "gigs": "gb", "megabyte": "mb", "megabytes": "mb",
    "gigahertz": "ghz", "megahertz": "mhz", "hertz": "hz", "watt": "w", "watts": "w", "mah": "mah", "volts": "v",
}


def quantities(col: Column) -> Column:
    """The different (value, unit) pairs of a text, without case and marks: any letters after a number are its unit, in one spelling. Null texts have none."""
    said = unmarked(F.coalesce(col, F.lit("")))
    pattern = F.lit("([0-9]+(?:[.,][0-9]+)?)\\s*([a-z%\"']+)")
    values, units = (F.regexp_extract_all(said, pattern, F.lit(i)) for i in (1, 2))
    spelling = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    one = lambda v, u: F.struct(F.replace(v, F.lit(","), F.lit(".")).cast("double").alias("value"), F.coalesce(spelling[u], u).alias("unit"))
    return F.array_distinct(F.zip_with(values, units, one))


def tokens(col: Column) -> Column:
    """Different words of letters a-z and digits, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0)))
