"""Plate texts as Column expressions: cleaning, plausibility, correction by position, status and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provinces by first letter, characters that readers confuse, patterns of plates, status texts.
PROVINCES = {
    "A": "Azuay", "B": "Bolivar", "U": "Canar", "C": "Carchi", "X": "Cotopaxi", "H": "Chimborazo", "O": "El Oro",
    "E": "Esmeraldas", "W": "Galapagos", "I": "Imbabura", "L": "Loja", "R": "Los Rios", "M": "Manabi",
    "V": "Morona Santiago", "N": "Napo", "S": "Pastaza", "P": "Pichincha", "Q": "Orellana", "K": "Sucumbios",
    "T": "Tungurahua", "Z": "Zamora Chinchipe", "Y": "Santa Elena", "J": "Santo Domingo",
}
DIGITS, AS_LETTERS = "01852647", "OIBSZGAT"
LETTERS, AS_DIGITS = "OIBSZGDQATL", "01852600471"
CAR, MOTORCYCLE, OTHER = "^[A-Z]{3}[0-9]{3,4}$", "^[A-Z]{2}[0-9]{3}[A-Z]$", "^[A-Z]{2}[0-9]{4}$"
MISSING, LOW, REVIEW, OK = "PLACA_NO_DETECTADA", "BAJA_CONFIANZA", "REVISION_MANUAL", "OK"
TOO_SHORT = "Texto demasiado corto para placa estándar"
NOT_A_PLATE = "Formato no corresponde a placa ecuatoriana (posible texto de carrocería, calcomanía o marca)"
AMBIGUOUS = "Ambigüedad en lectura: requiere revisión manual"
ODD_FORMAT = "Formato no estándar"
UNCHANGED = "Lectura directa sin cambios"


def normalize(text: Column) -> Column:
    """ASCII letters and digits in capitals; null if none is left."""
    return F.nullif(F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "")), F.lit(""))


def clean(text: Column) -> Column:
    """Letters and digits of any script in capitals; null if none is left."""
    return F.nullif(F.upper(F.regexp_replace(text, "[^\\p{L}\\p{N}]", "")), F.lit(""))


def plausible(text: Column) -> Column:
    """Whether a text may be a plate: 5 to 8 characters with a letter and two digits or more, not four letters ahead."""
    return F.coalesce(
        F.length(text).between(5, 8)
        & text.rlike("[A-Za-z]")
        & (F.regexp_count(text, F.lit("[0-9]")) >= 2)
        & ~text.rlike("^[A-Z]{4,}"),
        F.lit(False),
    )


def province(text: Column) -> Column:
    """The province of a plate's first letter, or null."""
    names = F.create_map(*[F.lit(x) for pair in PROVINCES.items() for x in pair])
    return F.try_element_at(names, F.substring(text, 1, 1))


def is_motorcycle(norm: Column) -> Column:
    return (F.length(norm) == 6) & norm.rlike("^[A-Z]{2}[0-9]")


def correct(norm: Column) -> Column:
    """Letters where letters belong and digits where digits belong, for texts of six or seven characters."""
    letters = lambda c: F.translate(c, DIGITS, AS_LETTERS)
    digits = lambda c: F.translate(c, LETTERS, AS_DIGITS)
    part = lambda a, n: F.substring(norm, a, n)
    return (
        F.when(F.length(norm) < 4, norm)
        .when(is_motorcycle(norm), F.concat(letters(part(1, 2)), digits(part(3, 3)), letters(part(6, 1))))
        .when(F.length(norm).isin(6, 7), F.concat(letters(part(1, 3)), digits(part(4, 4))))
        .otherwise(norm)
    )


def standard(text: Column) -> Column:
    return text.rlike(CAR) | text.rlike(MOTORCYCLE) | text.rlike(OTHER)


def _not_a_plate(text: Column) -> Column:
    return (
        ~F.length(text).between(5, 8)
        | ~text.rlike("[A-Z]")
        | (F.regexp_count(text, F.lit("[0-9]")) < 2)
        | text.rlike("^[A-Z]{4,}")
    )


def _bound(fn, **values: Column) -> Column:
    """fn of values that are each evaluated once, however often fn names them; generated code stays small."""
    row = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(row, lambda r: fn(**{k: r[k] for k in values})), F.lit(0))


def _blank(raw: Column) -> Column:
    return raw.isNull() | (F.trim(raw) == "")


def status(raw: Column, confidence: Column, review: Column) -> Column:
    """The state of a reading; the first condition that holds decides."""

    def decide(raw: Column, norm: Column, fixed: Column, conf: Column, review: Column) -> Column:
        return (
            F.when(_blank(raw), MISSING)
            .when(norm.isNull() | (F.length(norm) < 4), LOW)
            .when(_not_a_plate(fixed) | review, REVIEW)
            .when(standard(fixed) & (conf >= 0.80), OK)
            .when(standard(fixed) & (conf >= 0.70), REVIEW)
            .when(conf < 0.70, LOW)
            .otherwise(REVIEW)
        )

    return _bound(lambda raw, norm, conf, review: _bound(decide, raw=raw, norm=norm, fixed=correct(norm), conf=conf, review=review), raw=raw, norm=normalize(raw), conf=confidence, review=review)


def reasons(raw: Column, confidence: Column, review: Column) -> Column:
    """What led to the corrected text and the state, joined by semicolons; null for a missing plate."""

    def parts(norm: Column, fixed: Column, conf: Column, review: Column) -> Column:
        prefix = F.when(is_motorcycle(norm), "moto_pos_").otherwise("pos_")
        at = lambda text, i: F.substring(text, i + 1, F.lit(1))
        changed = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: (i < F.length(norm)) & (at(norm, i) != at(fixed, i))),
            lambda i: F.concat(prefix, i.cast("string"), F.lit(": "), at(norm, i), F.lit("->"), at(fixed, i)),
        )
        shown = F.format_string("%.2f", conf.cast("double"))
        last = (
            F.when(_not_a_plate(fixed), NOT_A_PLATE)
            .when(review, AMBIGUOUS)
            .when(standard(fixed) & (conf >= 0.80), F.lit(None))
            .when(standard(fixed) & (conf >= 0.70), F.concat(F.lit("Lectura con confianza moderada ("), shown, F.lit("): requiere verificación manual")))
            .when(conf < 0.70, F.concat(F.lit("Baja confianza de OCR ("), shown, F.lit(" < 0.70)")))
            .otherwise(ODD_FORMAT)
        )
        return F.concat(changed, F.array_compact(F.array(F.concat(F.lit("Provincia: "), province(fixed)), last)))

    def text(raw: Column, norm: Column, conf: Column, review: Column) -> Column:
        found = _bound(parts, norm=norm, fixed=correct(norm), conf=conf, review=review)
        joined = F.concat_ws("; ", found)
        return (
            F.when(_blank(raw), F.lit(None).cast("string"))
            .when(norm.isNull() | (F.length(norm) < 4), TOO_SHORT)
            .otherwise(F.when(joined != "", joined).otherwise(UNCHANGED))
        )

    return _bound(text, raw=raw, norm=normalize(raw), conf=confidence, review=review)


def same_plate(a: Column, b: Column) -> Column:
    """Equal, or both of six characters or more and: one edit apart, one inside the other, or the same last four with
    lengths at most one apart."""
    a, b = F.upper(F.trim(a)), F.upper(F.trim(b))
    near = (
        (F.levenshtein(a, b) <= 1)
        | F.contains(b, a)
        | F.contains(a, b)
        | ((F.substring(a, -4, 4) == F.substring(b, -4, 4)) & (F.abs(F.length(a) - F.length(b)) <= 1))
    )
    return F.coalesce((a != "") & (b != "") & ((a == b) | ((F.length(a) >= 6) & (F.length(b) >= 6) & near)), F.lit(False))


def accepted(text: Column, confidence: Column, least: float = 0.70) -> Column:
    """Whether a consensus reading is good enough to become the event's plate."""
    return F.coalesce((F.length(clean(text)) >= 5) & (confidence >= least) & plausible(clean(text)), F.lit(False))
