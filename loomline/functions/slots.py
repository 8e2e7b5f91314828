"""Template slotting: confirmed person names in a text become numbered markers, and come back with fitting particles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "⟪", "⟫"


def confirmed(text: Column, entities: Column) -> Column:
    """array<struct<surface, name>>: linked persons whose surface occurs in the text, one per surface (the first name), by first position (stable)."""
    linked = F.filter(
        entities,
        lambda e: (e["type"] == "PER") & e["kb_id"].isNotNull() & (F.trim(F.coalesce(e["resolved_name"], F.lit(""))) != "") & text.contains(e["surface"]),
    )
    once = F.filter(linked, lambda e, i: ~F.exists(F.slice(linked, F.lit(1), i), lambda f: f["surface"] == e["surface"]))
    placed = F.transform(once, lambda e, i: F.struct(F.instr(text, e["surface"]).alias("at"), i.alias("i"), e["surface"].alias("surface"), e["resolved_name"].alias("name")))
    return F.transform(F.array_sort(placed), lambda e, i: F.struct(F.concat(F.lit(OPEN + "PER"), (i + 1).cast("string"), F.lit(CLOSE)).alias("marker"), e["surface"].alias("surface"), e["name"].alias("name")))


def _longest_first(slots: Column, field: str) -> Column:
    keyed = F.transform(slots, lambda s, i: F.struct((-F.length(s[field])).alias("n"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def source_template(text: Column, slots: Column) -> Column:
    """Surfaces replaced by markers, longest first; null without slots."""
    filled = F.aggregate(_longest_first(slots, "surface"), text, lambda acc, s: F.replace(acc, s["surface"], s["marker"]))
    return F.when(F.size(slots) > 0, filled)


def translation_template(translation: Column, slots: Column) -> Column:
    """Full names replaced by markers, longest first; null if the text is blank or a name is missing from what is left of it."""
    step = lambda acc, s: F.when(acc.contains(s["name"]), F.replace(acc, s["name"], s["marker"]))
    return F.when(F.trim(translation) != "", F.aggregate(_longest_first(slots, "name"), translation, step))


def has_final_consonant(name: Column) -> Column:
    code = F.ascii(F.substring(name, -1, 1))
    return code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0)


#: Particle pairs after a name that ends in a consonant or in a vowel.
PARTICLES = (("이", "가"), ("을", "를"), ("은", "는"), ("과", "와"))


def fill_slot(text: Column, marker: Column, name: Column) -> Column:
    """Every marker replaced by the name, the particle after it made to fit. A one-syllable particle counts only before a non-Hangul character or the end."""
    final = has_final_consonant(name)
    out = F.replace(text, F.concat(marker, F.lit("이라")), F.concat(name, F.when(final, "이라").otherwise("라"), F.lit("\u0001")))
    for a, b in PARTICLES:
        fixed = F.concat(name, F.when(final, a).otherwise(b))
        out = F.regexp_replace(out, F.concat(marker, F.lit(f"[{a}{b}](?![가-힣])")), fixed)
    return F.replace(F.replace(out, marker, name), F.lit("\u0001"), F.lit(""))


def reinject(template: Column, slots: Column) -> Column:
    """The template with the slots' names; null if a marker is missing from it or one is left."""
    out = F.aggregate(slots, template, lambda acc, s: F.when(acc.contains(s["marker"]), fill_slot(acc, s["marker"], s["name"])))
    return F.when(~out.contains(OPEN), out)


def name_reflected(text: Column, name: Column) -> Column:
    """The whole name occurs, or of a name of three or more characters what follows the first."""
    return text.contains(name) | ((F.length(name) >= 3) & text.contains(F.substr(name, F.lit(2))))


def quality_grade(translation: Column, entities: Column) -> Column:
    """struct(grade, missing): REJECTED if blank or a confirmed name is missing, DEGRADED if a person is unknown, else VERIFIED."""
    names = F.transform(F.filter(entities, lambda e: e["kb_id"].isNotNull() & e["resolved_name"].isNotNull()), lambda e: e["resolved_name"])
    missing = F.filter(names, lambda n: ~name_reflected(translation, n))
    miss = F.exists(entities, lambda e: e["link_stage"] == "MISS")
    blank = F.coalesce(F.trim(translation), F.lit("")) == ""
    grade = F.when(blank | (F.size(missing) > 0), "REJECTED").when(miss, "DEGRADED").otherwise("VERIFIED")
    return F.struct(grade.alias("grade"), F.when(blank, F.array().cast("array<string>")).otherwise(missing).alias("missing"))
