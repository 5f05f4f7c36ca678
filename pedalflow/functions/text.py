"""Station names, file names and headers."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header synonyms (snake_case) and month names in file names.
SYNONYMS = {
    "genero": "genero_usuario",
    "sexo": "genero_usuario",
    "edad": "edad_usuario",
    "bici": "bici",
    "id_bici": "bici",
    "bike_id": "bici",
    "ciclo_estacion_retiro": "ciclo_estacion_retiro",
    "estacion_retiro": "ciclo_estacion_retiro",
    "ciclo_estacion_arribo": "ciclo_estacion_arribo",
    "estacion_arribo": "ciclo_estacion_arribo",
    "fecha_retiro": "fecha_retiro",
    "hora_retiro": "hora_retiro",
    "fecha_arribo": "fecha_arribo",
    "hora_arribo": "hora_arribo",
}
MONTH_NAMES = {
    "enero": 1,
    "ene": 1,
    "febrero": 2,
    "feb": 2,
    "marzo": 3,
    "mar": 3,
    "abril": 4,
    "abr": 4,
    "mayo": 5,
    "may": 5,
    "junio": 6,
    "jun": 6,
    "julio": 7,
    "jul": 7,
    "agosto": 8,
    "ago": 8,
    "septiembre": 9,
    "sep": 9,
    "sept": 9,
    "octubre": 10,
    "oct": 10,
    "noviembre": 11,
    "nov": 11,
    "diciembre": 12,
    "dic": 12,
}


def _ascii(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if ord(ch) < 128)


@cache
def _folding() -> tuple[str, str, str]:
    """Compatibility folding of all code points to ASCII: one-letter foldings of the basic plane as two strings of equal
    length, all others as a JSON object."""
    source, target, others = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        folded = "" if 0xD800 <= point <= 0xDFFF else _ascii(chr(point))
        if len(folded) == 1 and point < 0x10000:
            source.append(chr(point))
            target.append(folded)
        elif folded:
            others[chr(point)] = folded
    return "".join(source), "".join(target), json.dumps(others)


def unaccent(c: Column) -> Column:
    """Compatibility-decomposed ASCII part of a text; plain ASCII text is passed through untouched.

    Letters with a folding of one letter are translated; what is left beyond ASCII is looked up one by one, and
    dropped where it has no folding.
    """
    source, target, others = _folding()
    table = F.from_json(F.lit(others), "map<string,string>")
    folded = F.translate(c, source, target)
    parts = F.transform(
        F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)),
        lambda ch: F.when(ch > F.lit("\u007f"), F.coalesce(F.try_element_at(table, ch), F.lit(""))).otherwise(ch),
    )
    beyond = r"[^\x00-\x7F]"
    return F.when(~c.rlike(beyond), c).when(folded.rlike(beyond), F.array_join(parts, "")).otherwise(folded)


def normalize_name(c: Column) -> Column:
    """Unaccented, lower case, runs of anything but letters and digits as one space; '' for NULL."""
    spaced = F.regexp_replace(F.lower(unaccent(c)), r"[^a-z0-9]+", " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def infer_period(file_name: Column) -> tuple[Column, Column]:
    """(year, month) from ``20YY-MM`` or, failing that, a year and a month name; both or neither."""
    numeric = r"(20[0-9]{2})[-_](0[1-9]|1[0-2])"
    names = "|".join(sorted(MONTH_NAMES, key=len, reverse=True))
    num_year = F.nullif(F.regexp_extract(file_name, numeric, 1), F.lit(""))
    num_month = F.nullif(F.regexp_extract(file_name, numeric, 2), F.lit(""))
    any_year = F.nullif(F.regexp_extract(file_name, r"(20[0-9]{2})", 1), F.lit(""))
    word = F.lower(F.nullif(F.regexp_extract(file_name, f"(?i)({names})", 1), F.lit("")))
    lookup = F.create_map(*[F.lit(v) for item in MONTH_NAMES.items() for v in item])
    spelled = any_year.isNotNull() & word.isNotNull()
    year = F.when(num_year.isNotNull(), num_year.cast("int")).when(spelled, any_year.cast("int"))
    month = F.when(num_year.isNotNull(), num_month.cast("int")).when(spelled, F.element_at(lookup, word))
    return year, month


def to_snake_case(name: str) -> str:
    """Header text to unaccented snake_case, splitting camelCase."""
    words = re.findall(r"[A-Z]*[a-z0-9]+|[A-Z]+", _ascii(name))
    return "_".join(words).lower()


def canonical_header(names: list[str]) -> dict[str, int]:
    """Canonical column name → position of the first header cell that maps to it."""
    positions: dict[str, int] = {}
    for position, name in enumerate(names):
        snake = to_snake_case(name)
        positions.setdefault(SYNONYMS.get(snake, snake), position)
    return positions
