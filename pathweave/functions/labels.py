"""Activity-label normalisation and collapsing; duration-label rewriting."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathweave.functions.timefns import let, round_exact

# The ordered (regex, label) rules that collapse clinical
# procedure descriptions into groups.  Applied to trimmed, lower-cased text;
# a match anywhere, or text already containing the label, turns the whole
# value into the label; the first rule that fires wins.
CLINICAL_RULES = [
    (r"pregnan|prenatal|amniotic|fetal|uterine fundal|childbirth|pregnancy test",
     "pregnancy & fetal care"),
    (r"depression|patient health questionnaire|phq[- ]?(2|9)?|anxiety|mental health|cognitive and behavioral therapy",
     "mental/behavioral health"),
    (r"substance use|drug abuse|alcohol use disorders identification test|audit[- ]?c",
     "substance/abuse screening"),
    (r"renal dialysis|hemodialysis|haemodialysis",
     "renal/dialysis"),
    (r"chemotherapy|radiation therapy|teleradiotherapy",
     "oncology therapy"),
    (r"electrical cardioversion|electrocardiographic|ecg|echocardiography",
     "cardiology procedures/tests"),
    (r"\bx-ray\b|radiograph|mammography|bone density scan|computed tomography|magnetic resonance|ultrasound",
     "imaging tests"),
    (r"hemoglobin|hematocrit|platelet count|cytopathology|smear|chlamydia|gonorrhea|syphilis|hepatitis|human immunodeficiency virus|\bhiv\b",
     "lab tests / std panel"),
]

_LABEL_RE = r"^(\d+(?:\.\d+)?)\s*([smhdSMHD])$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_text(x, lower: bool = True) -> Column:
    """Trim all leading/trailing whitespace (not only spaces); optionally lower-case."""
    t = F.regexp_replace(_c(x), r"^\s+|\s+$", "")
    return F.lower(t) if lower else t


def collapse_labels(x, rules=CLINICAL_RULES) -> Column:
    """Ordered rule collapse as one CASE expression (first rule wins).

    Equal to applying the rules one after another as long as no label is hit
    by a later rule, which holds for :data:`CLINICAL_RULES`; a user list is
    checked by :func:`rules_are_order_safe`.
    """
    if isinstance(x, str):
        return _collapse_named(x, tuple(tuple(r) for r in rules))
    return _collapse(_c(x), rules)


@lru_cache(maxsize=64)
def _collapse_named(name: str, rules):
    return _collapse(F.col(name), rules)


def _collapse(c: Column, rules) -> Column:
    expr = None
    for regex, label in rules:
        hit = c.rlike(regex) | c.contains(label)
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return c if expr is None else expr.otherwise(c)


def rules_are_order_safe(rules) -> bool:
    """True when no label would be rewritten by a later rule (pure Python, on the rule list only)."""
    import re
    for i, (_, label) in enumerate(rules):
        for regex, later in rules[i + 1:]:
            if re.search(regex, label) or later in label:
                return False
    return True


def duration_label_to_minutes(x) -> Column:
    """'3h' -> '180.00 min' (units s, m, h, d; case-insensitive); other text unchanged."""
    c = _c(x)
    parsed = F.struct(F.regexp_extract(c, _LABEL_RE, 1).alias("v"),
                      F.lower(F.regexp_extract(c, _LABEL_RE, 2)).alias("u"))

    def to_minutes(p):
        val, unit = p["v"].cast("double"), p["u"]
        # Seconds are divided by 60; minutes, hours, days multiplied by 1, 60, 1440.
        return (F.when(unit == "s", val / F.lit(60.0))
                .when(unit == "m", val)
                .when(unit == "h", val * F.lit(60.0))
                .when(unit == "d", val * F.lit(1440.0)))

    minutes = let(parsed, to_minutes)
    # '%.2f' of the exact binary value, as Python formats it
    return let(minutes, lambda m: F.when(m.isNotNull(), F.format_string("%.2f min", round_exact(m, 2)))
               .otherwise(c))
