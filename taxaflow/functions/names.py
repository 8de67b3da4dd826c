"""Column functions on names: samples, barcodes, taxa, lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks, their lineage prefixes, and names that mean no name. Fixed values.
RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")
PREFIXES = ("k", "p", "c", "o", "f", "g", "s")
PLACEHOLDERS = ("", "nan", "none", "na", "unassigned", "uncultured", "metagenome")
UNASSIGNED = "Unassigned"


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sample_name(path: Column, style: str = "stem", suffix: str = "") -> Column:
    """The sample of a file. stem: name without FASTQ ending; suffix: without a known ending; accession: SRR, ERR or DRR number, else
    folder and stem; barcode: barcodeNN, else accession, else the stem up to an abundance table's ending."""
    stem = F.regexp_replace(_base(path), r"(?i)\.(?:fastq|fq)(?:\.gz)?$", "")
    accession = _or_null(F.regexp_extract(path, r"((?:SRR|ERR|DRR)\d{5,})", 1))
    if style == "stem":
        return stem
    if style == "suffix":
        return F.when(stem.endswith(suffix), F.substring(stem, F.lit(1), F.length(stem) - len(suffix))).otherwise(stem) if suffix else stem
    if style == "accession":
        folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
        return F.coalesce(accession, F.concat_ws("_", folder, stem))
    barcode = _or_null(F.lower(F.regexp_extract(path, r"(?i)(barcode\d+)", 1)))
    return F.coalesce(barcode, accession, F.regexp_replace(_base(path), r"(?:\.t)?_rel-abundance.*$|\.tsv$", ""))


def barcode_no(name: Column) -> Column:
    return _or_null(F.regexp_extract(name, r"(?i)barcode0*(\d+)", 1)).try_cast("int")


def barcode_label(n: Column, prefix: str = "barcode") -> Column:
    return F.when(n.isNotNull(), F.concat(F.lit(prefix), F.when(n < 10, F.lit("0")).otherwise(F.lit("")), n.cast("string")))


def run_id(label: Column) -> Column:
    return _or_null(F.regexp_extract(label, r"(SRR\d+)", 1))


def is_unassigned(name: Column) -> Column:
    return name.isNull() | F.lower(F.trim(name)).isin(*PLACEHOLDERS)


def _part(c: Column) -> Column:
    return F.replace(F.coalesce(_or_null(F.trim(c.cast("string"))), F.lit(UNASSIGNED)), F.lit("|"), F.lit("_"))


def taxon_id(rank: str, tax_id: Column | None, name: Column) -> Column:
    """rank|tax_id|name; a bar inside a part becomes an underscore, an empty part Unassigned, an absent tax_id NA."""
    return F.concat_ws("|", F.lit(rank), F.lit("NA") if tax_id is None else _part(tax_id), _part(name))


def tax_id_of(taxon: Column) -> Column:
    return F.when(taxon.contains("|"), F.split_part(taxon, F.lit("|"), F.lit(2))).otherwise(taxon)


def lineage(*ranks: Column) -> Column:
    """k__a; p__b; ... over the ranks given, from the highest."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{p}__"), F.coalesce(_or_null(F.trim(r)), F.lit(UNASSIGNED))) for p, r in zip(PREFIXES, ranks, strict=False)])


def rank_from_lineage(text: Column, rank: str) -> Column:
    prefix = PREFIXES[RANKS.index(rank)]
    name = F.trim(F.regexp_extract(text, rf"{prefix}__([^;]+)", 1))
    return F.when(text.isNull() | is_unassigned(name), F.lit(UNASSIGNED)).otherwise(name)


def taxonomy_to_rank(taxonomy: DataFrame, rank: str, key: str = "taxon_id") -> DataFrame:
    """(key, rank name) by the rank's column, else by a lineage column, else by the seven rank columns."""
    by_lower = {c.lower(): c for c in taxonomy.columns}
    if rank in by_lower:
        name = F.col(by_lower[rank])
    elif text := next((by_lower[c] for c in ("taxonomy", "taxonomia", "lineage") if c in by_lower), None):
        name = rank_from_lineage(F.col(text), rank)
    elif all(r in by_lower for r in RANKS):
        name = rank_from_lineage(lineage(*[F.col(by_lower[r]) for r in RANKS]), rank)
    else:
        raise ValueError(f"no column tells the {rank}; there are {', '.join(taxonomy.columns)}")
    return taxonomy.select(key, F.when(is_unassigned(name), F.lit(UNASSIGNED)).otherwise(F.trim(name)).alias(rank))


def normalise_ranks(df: DataFrame) -> DataFrame:
    """Rank columns under their standard names, whatever their case."""
    return df.withColumnsRenamed({c: c.lower() for c in df.columns if c.lower() in RANKS})


def to_number(c: Column, invalid: float | None = 0.0) -> Column:
    x = c.try_cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    return x if invalid is None else F.coalesce(x, F.lit(invalid))


def map_group(name: Column, mapping: dict[str, str], default: str = "Sin metadata") -> Column:
    """Labels under their normal form: upper-cased keys, unknown names kept, missing ones `default`."""
    key = F.upper(F.trim(name))
    known = F.lit(None).cast("string")
    for k, v in mapping.items():
        known = F.when(key == k.upper(), F.lit(v)).otherwise(known)
    return F.coalesce(known, F.trim(name), F.lit(default))


def log_scale_pct(x: Column, pseudo: float = 1e-6) -> Column:
    return (F.greatest(x, F.lit(0.0)) + pseudo) * 100
