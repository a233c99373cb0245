"""Column -> Column text functions: admission, extraction, cleaning, redaction.

All are built-in expressions (JVM side, whole-stage codegen) except NFKC,
which Spark has no expression for and which runs as an Arrow pandas UDF.
Java regexes use ``(?U)`` so that ``\\w``, ``\\s``, ``\\d`` and ``\\b`` are
Unicode-aware, as in Python's ``re`` on ``str``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnFn = Callable[[Column], Column]

# --- fixed values (must equal the specification) ---------------------------
# Abbreviation expansion, applied one after another in this order, whole word,
# any case.
ABBREVIATIONS = [
    ("pt", "patient"),
    ("dx", "diagnosis"),
    ("tx", "treatment"),
    ("hx", "history"),
    ("ecg", "electrocardiogram"),
    ("eeg", "electroencephalogram"),
    ("ct", "computed tomography"),
    ("mri", "magnetic resonance imaging"),
    ("ultrasound", "ultrasound imaging"),
    ("xray", "x-ray imaging"),
]
# Identifier patterns replaced by the redaction marker (case-sensitive):
# social security number, slashed date, record number.
PHI_PATTERNS = [
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{2}/\d{2}/\d{4}\b",
    r"\b[A-Z]{2}\d{6}\b",
]
REDACTED = "[REDACTED]"
# Unit spelling of the scientific pipeline (case-sensitive).
SCIENTIFIC_UNITS = [
    (r"\bmg/dl\b", "mg/dL"),
    (r"\bug/ml\b", "μg/mL"),
    (r"\bng/ml\b", "ng/mL"),
]
# Unit spelling of the normaliser, applied after lower-casing.
NORMALISER_UNITS = [
    (r"\b(?:mg/dl|mg/dL)\b", "mg/dL"),
    (r"\b(?:mcg|μg|ug)/(?:ml|mL)\b", "μg/mL"),
    (r"\b(?:ng)/(?:ml|mL)\b", "ng/mL"),
]
URL_PATTERN = r"(?:https?://|www\.)\S+"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# ---------------------------------------------------------------------------


def _u(pattern: str) -> str:
    return "(?U)" + pattern


# P1 -------------------------------------------------------------------------
def is_not_blank(c: Column) -> Column:
    """True when the text is not null and has a non-whitespace character."""
    return c.isNotNull() & c.rlike(_u(r"\S"))


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(is_not_blank(F.col(col)))


# P2 -------------------------------------------------------------------------
def text_field(df: DataFrame, preferred: str = "text", fallback: str = "content") -> Column:
    """``text`` if the frame has it, else ``content`` (decided at plan time);
    when both exist the row-level rule is ``coalesce(text, content)``."""
    cols = {c.lower(): c for c in df.columns}
    if preferred in cols and fallback in cols:
        return F.coalesce(F.col(cols[preferred]), F.col(cols[fallback]))
    if preferred in cols:
        return F.col(cols[preferred])
    if fallback in cols:
        return F.col(cols[fallback])
    return F.lit(None).cast("string")


# P3 -------------------------------------------------------------------------
def extract_text(*cols: Column, sep: str = "\n") -> Column:
    """Main text and description fields joined; nulls skipped."""
    return F.concat_ws(sep, *cols)


# P4 -------------------------------------------------------------------------
def remove_urls_emails(c: Column) -> Column:
    c = F.regexp_replace(c, URL_PATTERN, "")
    return F.regexp_replace(c, EMAIL_PATTERN, "")


#: Texts that are Python strings at the same time.
_ROWS_AT_ONCE = 256


# P5 -------------------------------------------------------------------------
@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Composed as NFKC demands (Arrow's own utf8_normalize leaves accents
    apart); ASCII texts are in the form already."""
    if isinstance(s, pa.ChunkedArray):
        s = s.combine_chunks()
    out = []
    for i in range(0, len(s), _ROWS_AT_ONCE):
        part = s.slice(i, _ROWS_AT_ONCE)
        plain = pc.all(pc.string_is_ascii(part)).as_py() is not False
        out.append(part.cast(pa.string()) if plain else pa.array(
            [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string()))
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def normalise(c: Column, literal: bool = False) -> Column:
    """NFKC, newline/tab runs and whitespace runs to one space, thousands
    marks between digits dropped, lower case, unit spelling.

    ``literal=True`` gives the as-coded behaviour where the patterns are taken
    as literal strings and so never match: only NFKC and lower case act.
    """
    c = nfkc(c)
    if literal:
        return F.lower(c)
    c = F.regexp_replace(c, r"[\n\r\t]+", " ")
    c = F.regexp_replace(c, _u(r"\s+"), " ")
    c = F.regexp_replace(c, _u(r"(?<=\d)[,.](?=\d{3})"), "")
    c = F.lower(c)
    for pat, rep in NORMALISER_UNITS:
        c = F.regexp_replace(c, _u(pat), rep)
    return c


# P6 -------------------------------------------------------------------------
def expand_abbreviations(c: Column) -> Column:
    for abbr, full in ABBREVIATIONS:
        c = F.regexp_replace(c, "(?iU)\\b" + abbr + "\\b", full)
    return c


# P7 -------------------------------------------------------------------------
def redact_phi(c: Column) -> Column:
    for pat in PHI_PATTERNS:
        c = F.regexp_replace(c, _u(pat), REDACTED)
    return c


def phi_hits(c: Column) -> Column:
    """Number of identifier matches (before redaction), as BIGINT."""
    total = F.lit(0)
    for pat in PHI_PATTERNS:
        total = total + F.regexp_count(c, F.lit(_u(pat)))
    return total.cast("bigint")


def medical_clean(c: Column) -> Column:
    return redact_phi(expand_abbreviations(c))


# P8 -------------------------------------------------------------------------
def scientific_clean(c: Column) -> Column:
    for pat, rep in SCIENTIFIC_UNITS:
        c = F.regexp_replace(c, _u(pat), rep)
    return F.regexp_replace(c, _u(r"(\d+)\s*\^\s*(\d+)"), "$1^$2")


# P9 -------------------------------------------------------------------------
def strip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace on both ends."""
    return F.regexp_replace(c, _u(r"^\s+|\s+$"), "")


def general_clean(c: Column) -> Column:
    c = F.regexp_replace(c, _u(r"\s+"), " ")
    c = F.regexp_replace(c, _u(r"[^\w\s.,!?-]"), "")
    return strip(c)


# P10 / X1 -------------------------------------------------------------------
PIPELINES: dict[str, ColumnFn] = {
    "medical": medical_clean,
    "scientific": scientific_clean,
    "general": general_clean,
}


def register_pipeline(name: str, fn: ColumnFn) -> None:
    """Add a named Column -> Column pipeline to the registry."""
    PIPELINES[name] = fn


def get_pipeline(name: str | None) -> ColumnFn:
    return PIPELINES.get(name or "general", general_clean)


def apply_pipeline(text: Column, pipeline: Column,
                   names: tuple[str, ...] | None = None) -> Column:
    """Per-row pipeline choice; unknown or missing names get ``general``."""
    names = names or tuple(k for k in PIPELINES if k != "general")
    out = None
    for name in names:
        branch = PIPELINES[name](text)
        out = F.when(pipeline == name, branch) if out is None else out.when(pipeline == name, branch)
    general = PIPELINES["general"](text)
    return general if out is None else out.otherwise(general)


def pipeline_for_dataset(dataset: Column, mapping: dict[str, str]) -> Column:
    """Look a dataset name up in a {dataset: pipeline} descriptor."""
    if not mapping:
        return F.lit(None).cast("string")
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.element_at(m, dataset)


# P12 / A8 -------------------------------------------------------------------
def word_count(c: Column) -> Column:
    """Whitespace word count after strip; blank or null -> 0 (BIGINT)."""
    s = strip(c)
    return F.when(s.isNull() | (s == ""), F.lit(0)).otherwise(
        F.size(F.split(s, _u(r"\s+")))).cast("bigint")


def words(c: Column) -> Column:
    """Array of whitespace-separated words of a text (empty text -> [])."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, _u(r"\s+")))


# S10 ------------------------------------------------------------------------
def safe_file_name(name: Column) -> Column:
    """``file_`` + first 8 hex chars of MD5 of the name + its suffix."""
    final = F.regexp_extract(name, r"([^/]*)$", 1)
    suffix = F.regexp_extract(final, r"^.+(\.[^.]+)$", 1)
    return F.concat(F.lit("file_"), F.substring(F.md5(name), 1, 8), suffix)
