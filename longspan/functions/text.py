"""Short labels from long clinical code names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of the unit before the slash.
UNIT_HEADS = {
    "#": "#",
    "Entitic mass": "M",
    "Entitic volume": "V",
    "Enzymatic activity": "Activity",
    "Interpretation": "Interp",
    "Length": "L",
    "Log #": "Log #",
    "Mass": "M",
    "Mass Ratio": "M/M",
    "Molar ratio": "mol/mol",
    "Moles": "mol",
    "Multiple of the median": "Median mult",
    "Partial pressure": "PP",
    "Percentile": "%ile",
    "Presence": "Presence",
    "Ratio": "Ratio",
    "Susceptibility": "Susc",
    "Time": "T",
    "Titer": "Titer",
    "Units": "U",
    "Volume Fraction": "VF",
    "Volume Rate": "VR",
    "Z-score": "Z",
}
# Abbreviations of the unit after the slash.
UNIT_TAILS = {"area": "A", "mass": "M", "time": "T", "volume": "V"}
# Phrases in the order in which they are replaced.
PHRASES = (
    ("in Serum, Plasma, or Blood", "in SPB"),
    ("in Serum or Plasma", "in SP"),
    ("in Serum", "in S"),
    ("in Plasma", "in P"),
    ("in Blood", "in B"),
    ("by automated count", "by AC"),
)
# Prefix up to the last bracket, head, slash, tail, rest.
_UNITS = r"^(.*\[)([^/]*)(/?)(.*)(\][\s\S]*)$"
# A line may break at a space, or after a hyphen between letters.
_BREAK = r"(?:\s|(?<=\w[^\W\d]-)(?=\w+[^\W\d]))"


def _mapped(text: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)


def shorten(text: Column, width: int, placeholder: str = "...") -> Column:
    """Cut at a word boundary so that the text with placeholder fits."""
    if width < len(placeholder):
        raise ValueError("the placeholder is wider than the text may be")
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    # The longest start that leaves room for the placeholder and ends at a break.
    kept = F.regexp_extract(flat, f"^(.{{0,{width - len(placeholder)}}}){_BREAK}", 1)
    cut = F.when(kept == "", F.lit(placeholder.lstrip())).otherwise(F.concat(kept, F.lit(placeholder)))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)


def short_label(text: Column, width: int | None = 80, placeholder: str = "...") -> Column:
    """Abbreviate units in the last brackets and common phrases, then shorten.

    'Iron [Mass/volume] in Serum or Plasma' becomes 'Iron [M/V] in SP'.
    """
    head = _mapped(F.regexp_extract(text, _UNITS, 2), UNIT_HEADS)
    tail = _mapped(F.lower(F.regexp_extract(text, _UNITS, 4)), UNIT_TAILS)
    units = F.concat(head, F.when(tail != "", F.concat(F.lit("/"), tail)).otherwise(""))
    whole = F.concat(F.regexp_extract(text, _UNITS, 1), units, F.regexp_extract(text, _UNITS, 5))
    out = F.when(F.regexp_like(text, F.lit(_UNITS)), whole).otherwise(text)
    for phrase, brief in PHRASES:
        out = F.regexp_replace(out, f"(?iu){phrase}", brief)
    out = F.translate(F.regexp_replace(out, r"(?U)\s+", " "), "_", " ")
    return shorten(out, width, placeholder) if width and width > 0 else out


def feature_label(description: Column, concept_id: Column, impact: Column) -> Column:
    """Description (concept) [ impact ]."""
    return F.format_string("%s (%s) [ %s ]", description, concept_id.cast("string"), impact)
