"""Text, identifier and number clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped or collapsed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Annotation aliases and the two normalised names they map to.
NO_MAPPING_ALIASES = ("<no_phrog_mapping>", "no_phrog_mapping")
BLANK_ALIASES = ("", "NA", "None", "nan")
BLANK_NAME = "unresolved_blank_annotation"
NO_MAPPING_NAME = "no_phrog_mapping"
# Strand spellings.
FORWARD_STRANDS = ("+", "1", "forward", "f")
REVERSE_STRANDS = ("-", "-1", "reverse", "r")
# Identifier shapes.
UNIPROT_SHAPES = (
    r"^[OPQ][0-9][A-Z0-9]{3}[0-9]$",
    r"^[A-NR-Z][0-9][A-Z0-9]{3}[0-9]$",
    r"^[A-Z0-9]{10}$",
)
GENBANK_SHAPE = r"^[A-Z]{1,4}_[0-9]+(?:\.[0-9]+)?$|^[A-Z]{1,2}[0-9]{5,}\.[0-9]+$|^[A-Z]{3}[0-9]{5,}\.[0-9]+$"
# Wording variants mapped to one spelling, applied in this order.
TERM_VARIANTS = (
    ("anti restriction", "anti-restriction"),
    ("tailspike", "tail spike"),
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITESPACE}]+", " ")


def nonblank(c: Column) -> Column:
    """True for a non-null, non-empty value; never null."""
    return F.length(F.coalesce(c.cast("string"), F.lit(""))) > 0


def normalize_annotation(
    c: Column, no_mapping: tuple[str, ...] = NO_MAPPING_ALIASES, blanks: tuple[str, ...] = BLANK_ALIASES
) -> Column:
    """Blank aliases (exact case) and no-mapping aliases (any case) get fixed names; other text is tidied."""
    tidy = collapse_spaces(strip(c))
    return (
        F.when(c.isNull() | tidy.isin("", *blanks), F.lit(BLANK_NAME))
        .when(F.lower(tidy).isin(*[a.lower() for a in no_mapping]), F.lit(NO_MAPPING_NAME))
        .otherwise(tidy)
    )


def is_known(c: Column) -> Column:
    """1 unless null, blank, ``nan`` or ``<no_phrog_mapping>`` (any case)."""
    text = F.lower(strip(c.cast("string")))
    return F.when(c.isNull() | text.isin("", "nan", "<no_phrog_mapping>"), F.lit(0)).otherwise(F.lit(1))


def len_norm(c: Column, denom: float = 1000.0) -> Column:
    """min(c / denom, 1); null and NaN give 0 (``least`` alone would skip the null and give 1)."""
    value = c.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(F.least(value / F.lit(denom), F.lit(1.0)))


def strand_flags(c: Column) -> Column:
    text = strip(c.cast("string"))
    return F.struct(
        F.coalesce(text.isin(*FORWARD_STRANDS), F.lit(False)).cast("double").alias("forward"),
        F.coalesce(text.isin(*REVERSE_STRANDS), F.lit(False)).cast("double").alias("reverse"),
    )


def same_strand(a: Column, b: Column) -> Column:
    return strip(a.cast("string")).eqNullSafe(strip(b.cast("string")))


def first_matching(c: Column, shapes: tuple[str, ...]) -> Column:
    text = strip(c)
    hit = text.rlike(shapes[0])
    for shape in shapes[1:]:
        hit = hit | text.rlike(shape)
    return F.when(hit, text)


def uniprot_like(c: Column) -> Column:
    return first_matching(c, UNIPROT_SHAPES)


def afdb_like(c: Column) -> Column:
    text = strip(c)
    return F.when(F.startswith(text, F.lit("AF-")) & F.contains(text, F.lit("-F")), text)


def genbank_like(c: Column) -> Column:
    return first_matching(c, (GENBANK_SHAPE,))


def family_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(c), r"(?i)^phrog_(\d+)$", 1), F.lit(""))


def archive_name(family: Column) -> Column:
    return F.when(family.isNotNull(), F.format_string("phrog_%05d.tar.gz", family.cast("long")))


def seq_sha256(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def clean(c: Column) -> Column:
    """Trimmed text; null for null, blank and ``nan`` (any case)."""
    text = strip(c.cast("string"))
    return F.when((F.length(text) > 0) & (F.lower(text) != "nan"), text)


def norm_format(c: Column) -> Column:
    name = F.lower(c)
    return F.when(~nonblank(c) | name.isin("mmcif", "cif"), F.lit("cif")).otherwise(name)


def to_num(c: Column, default: float = -1.0) -> Column:
    """Number in the text, or the default where there is none."""
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def priority(c: Column, order: dict[str, int], default: int = 999) -> Column:
    pairs = [F.lit(x) for pair in order.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default)).cast("int")


def output_path(source: Column, entity: Column, model: Column, fmt: Column) -> Column:
    low = F.lower(source)
    ext = F.when(fmt == "cif", F.lit("cif")).otherwise(F.lit("pdb"))
    name = F.concat_ws("__", entity.cast("string"), low, model.cast("string"))
    return F.concat(low, F.lit("/"), name, F.lit("."), ext)


def instance_key(contig: Column, index: Column) -> Column:
    return F.concat(contig.cast("string"), F.lit("_"), index.cast("long").cast("string"))


def first_candidate(*cols: Column) -> Column:
    return F.coalesce(*[clean(c) for c in cols])


def round6(c: Column) -> Column:
    return F.round(c, 6)


def term_variants(c: Column, rules: tuple[tuple[str, str], ...] = TERM_VARIANTS) -> Column:
    for old, new in rules:
        c = F.regexp_replace(c, f"(?i)\\b{old}\\b", new)
    return c


def unit_confidence(score: Column, scale: Column) -> Column:
    """Confidence on 0..1: scores on a 0..100 scale are divided, others pass."""
    return F.when(scale == "plddt_0_100", score / F.lit(100.0)).otherwise(score)


def structure_text_ok(text: Column, fmt: Column) -> Column:
    """Whether a structure file's text looks like its format."""
    head = F.ltrim(F.btrim(text, F.lit(WHITESPACE)))
    cif = F.startswith(head, F.lit("data_"))
    pdb = (
        F.startswith(head, F.lit("HEADER")) | F.startswith(head, F.lit("MODEL")) | F.contains(text, F.lit("\nATOM"))
    )
    return F.coalesce(F.when(F.lower(F.coalesce(fmt, F.lit(""))) == "cif", cif).otherwise(pdb), F.lit(False))
