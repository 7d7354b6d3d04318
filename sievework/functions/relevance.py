"""Grading of business listings by name and type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded

#: Place types that settle the question, are unclear, or settle it the other way.
MEDICAL_TYPES = ("doctor", "dentist", "dental_clinic", "hospital", "medical_lab", "physiotherapist", "chiropractor")
UNCLEAR_TYPES = ("medical_clinic", "health", "skin_care_clinic", "wellness_center")
OTHER_TYPES = (
    "pharmacy", "drugstore", "real_estate_agency", "church", "place_of_worship", "locality", "political", "community_center",
    "event_venue", "manufacturer", "clothing_store", "cosmetics_store", "pet_store", "store", "restaurant", "bar", "cafe", "gym",
    "beauty_salon", "hair_salon", "lodging", "school", "insurance_agency", "lawyer",
)
VETERINARY_TYPES = ("veterinary_care",)
VETERINARY = "κτηνιατρ"
#: Stems of practice names, accents folded, tried in this order at each place.
NAME_STEMS = (
    "(?<!κτην)ιατρ", "γιατρ", "οδοντ", "ορθοπ", "ορθοδοντ", "οφθαλμ", "παιδιατρ", "χειρουργ", "μαιευτ", "καρδιολογ", "παθολογ",
    "γυναικολογ", "δερματολογ", "νευρολογ", "ουρολογ", "πνευμονολογ", "ενδοκρινολογ", "γαστρεντερολογ", "ρευματολογ", "ογκολογ",
    "αιματολογ", "μικροβιολογ", "βιοπαθολογ", "ακτινολογ", "αναισθησιολογ", "ωτορινολαρυγγολογ", "αλλεργιολογ", "νεφρολογ",
    "ψυχιατρ", "διαγνω", "πολυιατρ", "κλινικ", "νοσοκομ", "φυσικοθεραπ", "λογοθεραπ", "εργοθεραπ", "ποδολογ", "κεντρο υγειας",
    r"\bωρλ\b", r"\bdr\b", r"\bδρ\b", r"\bmd\b", "clinic", "medical", "dental",
)
#: Specialty stems and labels, the first that fits counts.
SPECIALTIES = (
    ("ωτορινολαρυγγολογ", "Ωτορινολαρυγγολόγος"), ("γαστρεντερολογ", "Γαστρεντερολόγος"), ("ενδοκρινολογ", "Ενδοκρινολόγος"),
    ("νευροχειρουργ", "Νευροχειρουργός"), ("αγγειοχειρουργ", "Αγγειοχειρουργός"), ("αναισθησιολογ", "Αναισθησιολόγος"),
    ("αλλεργιολογ", "Αλλεργιολόγος"), ("πνευμονολογ", "Πνευμονολόγος"), ("ρευματολογ", "Ρευματολόγος"),
    ("μικροβιολογ", "Μικροβιολόγος"), ("βιοπαθολογ", "Μικροβιολόγος"), ("αιματολογ", "Αιματολόγος"), ("ακτινολογ", "Ακτινολόγος"),
    ("δερματολογ", "Δερματολόγος"), ("γυναικολογ", "Γυναικολόγος - Μαιευτήρας"), ("μαιευτ", "Γυναικολόγος - Μαιευτήρας"),
    ("καρδιολογ", "Καρδιολόγος"), ("παιδιατρ", "Παιδίατρος"), ("νευρολογ", "Νευρολόγος"), ("νεφρολογ", "Νεφρολόγος"),
    ("ουρολογ", "Ουρολόγος"), ("ογκολογ", "Ογκολόγος"), ("παθολογ", "Παθολόγος"), ("οφθαλμ", "Οφθαλμίατρος"),
    ("ορθοδοντ", "Ορθοδοντικός"), ("ορθοπ", "Ορθοπαιδικός"), ("οδοντ", "Οδοντίατρος"), ("ψυχιατρ", "Ψυχίατρος"),
    ("φυσικοθεραπ", "Φυσικοθεραπευτής"), ("λογοθεραπ", "Λογοθεραπευτής"), ("εργοθεραπ", "Εργοθεραπευτής"), ("ποδολογ", "Ποδολόγος"),
    ("κτηνιατρ", "Κτηνίατρος"), ("χειρουργ", "Χειρουργός"), ("διαγνω", "Διαγνωστικό κέντρο"), ("πολυιατρ", "Πολυϊατρείο"),
    ("κεντρο υγειας", "Κέντρο Υγείας"), ("νοσοκομ", "Νοσοκομείο"),
)
DISPLAY_ALIASES = {
    "οδοντιατρείο": "Οδοντίατρος", "κτηνιατρική βοήθεια": "Κτηνίατρος", "κτηνιατρείο": "Κτηνίατρος",
    "ιατρική κλινική": "Ιατρείο / κλινική", "νοσοκομείο": "Νοσοκομείο", "φυσιοθεραπευτής": "Φυσικοθεραπευτής",
}
DISPLAY_NOISE = (
    "σημείο ενδιαφέροντος", "υπηρεσίες", "υγεία", "επιχείρηση", "κατάστημα", "κέντρο ευεξίας", "σύμβουλος", "point of interest",
    "establishment", "health", "service", "store",
)
GENERIC_STEMS = ("ιατρ", "γιατρ", "clinic", "medical")
GENERIC_LABEL = "Ιατρός (μη προσδιορισμένη ειδικότητα)"


def first_of(types: Column, wanted: tuple[str, ...]) -> Column:
    """The first of the types that is wanted, else null."""
    return F.get(F.filter(types, lambda t: t.isin(*wanted)), F.lit(0))


def graded_name(name: Column, types: Column, with_vets: bool = False) -> Column:
    """Struct (tier, signal): names outrank types, veterinary names all others."""
    plain = folded(F.coalesce(name, F.lit("")))
    stem = F.regexp_extract(plain, "(?U)" + "|".join(NAME_STEMS), 0)
    made = lambda tier, kind, value: F.struct(F.lit(tier).alias("tier"), F.concat(F.lit(f"{kind}:"), value).alias("signal"))
    steps = [
        (F.contains(plain, F.lit(VETERINARY)), made("confirmed" if with_vets else "excluded", "name", F.lit(VETERINARY))),
        (stem != "", made("confirmed", "name", stem)),
    ]
    graded = [("confirmed", MEDICAL_TYPES), ("excluded", OTHER_TYPES)]
    graded += [("review", VETERINARY_TYPES)] * with_vets + [("review", UNCLEAR_TYPES)]
    for tier, wanted in graded:
        found = first_of(types, wanted)
        steps.append((found.isNotNull(), made(tier, "type", found)))
    out = F.struct(F.lit("excluded").alias("tier"), F.lit(None).cast("string").alias("signal"))
    for condition, value in reversed(steps):
        out = F.when(condition, value).otherwise(out)
    return out


def specialty(name: Column, display: Column) -> Column:
    """The specialty in the name, else the display name, else a generic label, else null."""
    plain, shown = folded(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(display, F.lit("")))
    has = lambda stem: F.contains(plain, F.lit(stem))
    out = F.when(F.lit(False), "")
    for stem, label in SPECIALTIES:
        out = out.when(has(stem), label)
    for key, label in DISPLAY_ALIASES.items():
        out = out.when(F.lower(shown) == key, label)
    out = out.when((shown != "") & ~F.lower(shown).isin(*DISPLAY_NOISE), shown)
    for stem in GENERIC_STEMS:
        out = out.when(has(stem), GENERIC_LABEL)
    return out
