"""Style guides: forms as XML for prompts and as Markdown for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from babelmill.functions.text import escape_xml

# Section, its title, and its fields with element names and labels.
SECTIONS = (
    ("tone_and_register", "Tone & Register", (("register", "register", "Register"), ("address", "address", "Address"), ("emotion", "emotion", "Emotion"), ("toneNotes", "notes", "Notes"))),
    ("target_audience", "Target Audience", (("expertise", "expertise_level", "Expertise Level"), ("ageGroup", "age_group", "Age Group"), ("culturalVariant", "cultural_variant", "Cultural Variant"), ("audienceNotes", "notes", "Notes"))),
    ("sentence_style", "Sentence Style & Structure", (("sentenceLen", "sentence_length", "Sentence Length"), ("structureFidelity", "structure_fidelity", "Structure Fidelity"), ("passive", "passive_voice", "Passive Voice"), ("styleNotes", "notes", "Notes"))),
    ("numbers_dates_units", "Numbers, Dates & Units", (("dateFormat", "date_format", "Date Format"), ("decimal", "decimal_separator", "Decimal Separator"), ("units", "units_handling", "Units Handling"), ("currency", "currency_handling", "Currency Handling"), ("numNotes", "notes", "Notes"))),
    ("cultural_adaptation", "Cultural Adaptation", (("adaptation", "adaptation_level", "Adaptation Level"), ("idioms", "idiom_handling", "Idiom Handling"), ("culturalRefs", "cultural_references", "Cultural References"), ("humor", "humor_handling", "Humor Handling"), ("culturalNotes", "notes", "Notes"))),
)


def field(form: Column, name: str) -> Column:
    """A field of map<string, string>, null if blank."""
    return F.nullif(F.try_element_at(form, F.lit(name)), F.lit(""))


def joined(pieces: list[Column]) -> Column:
    return F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in pieces]), "")


def section(pieces: list[Column], head: str, tail: str) -> Column:
    """head, the pieces that are there, tail; nothing without pieces."""
    body = joined(pieces)
    return F.when(body == "", "").otherwise(F.concat(F.lit(head), body, F.lit(tail)))


def as_xml(form: Column, forbidden: Column | None = None) -> Column:
    """XML of a form; `forbidden` (array<string>) makes the section of hard rules, whose list is joined as it is."""
    element = lambda name, value: F.concat(F.lit(f"  <{name}>"), value, F.lit(f"</{name}>\n"))
    parts = [section([element(e, escape_xml(field(form, f))) for f, e, _ in fields], f"  <{name}>\n", f"  </{name}>\n") for name, _, fields in SECTIONS]
    if forbidden is not None:
        rules = [element("forbidden_practices", F.array_join(forbidden, ", ")), element("notes", escape_xml(field(form, "forbiddenNotes")))]
        parts.append(F.when(F.size(F.coalesce(forbidden, F.array().cast("array<string>"))) > 0, section(rules, "  <hard_rules>\n", "  </hard_rules>\n")))
    return F.concat(F.lit("<style_guide>\n"), joined(parts), F.lit("</style_guide>"))


def as_markdown(form: Column) -> Column:
    line = lambda label, value: F.concat(F.lit(f"- **{label}:** "), value, F.lit("\n"))
    parts = [section([line(label, field(form, f)) for f, _, label in fields], f"## {title}\n", "\n") for _, title, fields in SECTIONS]
    return F.regexp_replace(F.concat(F.lit("# Translation Style Guide\n\n"), joined(parts)), r"\s+$", "")


def is_filled(form: Column) -> Column:
    return F.exists(F.map_values(form), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
