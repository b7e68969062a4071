"""Column functions on identifiers, locations, sequences and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAXON = "NCBITaxon_"


def taxon_id(c: Column) -> Column:
    """``9606`` and ``NCBITaxon:9606`` -> ``NCBITaxon_9606``; the canonical form stays."""
    s = F.replace(c.cast("string"), F.lit(":"), F.lit("_"))
    return F.when(s.startswith(TAXON), s).otherwise(F.concat(F.lit(TAXON), s))


def taxon_number(c: Column) -> Column:
    return F.regexp_replace(c, f"^{TAXON}", "")


def underscored(c: Column) -> Column:
    """``GO:0000001`` -> ``GO_0000001``."""
    return F.replace(c, F.lit(":"), F.lit("_"))


def from_iri(c: Column) -> Column:
    """The part of an IRI after its last slash or hash."""
    return F.regexp_extract(c, r"([^/#]*)$", 1)


def fasta_id(header: Column) -> Column:
    """``>sp|P1|NAME_ORG rest`` -> ``NAME_ORG``; headers without bars give their first word."""
    first = F.split(F.regexp_replace(header, "^>", ""), r"\s")[0]
    parts = F.split(first, r"\|")
    return F.when(F.size(parts) >= 3, parts[2]).otherwise(first)


def accession(entry: Column) -> Column:
    return F.substring_index(entry, "_", 1)


def file_field(path: Column, name: str) -> Column:
    """``fold`` or ``taxon`` of a file name like ``predictions_fold_{fold}_taxon_{taxon}.tsv``; null without it."""
    pattern = {"fold": r"_fold_([^_/]+)_taxon_", "taxon": r"_taxon_([^_/.]+)\.tsv"}[name]
    got = F.regexp_extract(path, pattern, 1)
    return F.when(got != "", got)


def dated(c: Column) -> Column:
    """``23-MAY-2024`` as a date, null if it is none."""
    return F.try_to_timestamp(F.initcap(F.lower(F.trim(c))), F.lit("dd-MMM-yyyy")).cast("date")


def location(c: Column) -> Column:
    """A feature location as struct(start, end, complement): outermost positions of joins."""
    n = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return F.struct(F.array_min(n).alias("start"), F.array_max(n).alias("end"), c.contains("complement").alias("complement"))


def attributes(c: Column) -> Column:
    """``a=1;b=x%20y`` as a map with values decoded."""
    pairs = F.filter(F.split(c, ";"), lambda x: x.contains("="))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.url_decode(F.replace(F.substring(x, F.instr(x, "=") + 1, F.length(x)), F.lit("+"), F.lit("%2B"))).alias("v")))))


AMINO = "ARNDCQEGHILKMFPSTWYV"


def valid_sequence(c: Column) -> Column:
    """No ambiguous residues (U, O, B, Z, J, *) in a sequence."""
    return ~c.rlike("[UOBZJ*]")


def tokens(c: Column, length: int) -> Column:
    """Residue numbers from 1 (0: none of the twenty), cut or padded to a length."""
    order = F.map_from_arrays(F.array(*[F.lit(x) for x in AMINO]), F.array(*[F.lit(i + 1) for i in range(len(AMINO))]))
    ids = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(order, x), F.lit(0)))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def one_hot(c: Column, length: int) -> Column:
    """Rows of 21 zeros and one one, by residue number."""
    return F.transform(tokens(c, length), lambda i: F.transform(F.sequence(F.lit(0), F.lit(len(AMINO))), lambda k: (k == i).cast("float")))


def percent(a: Column, b: Column) -> Column:
    """100 a / b with two decimals, half to even; null if b is 0."""
    return F.bround(F.try_divide(100.0 * a, b), 2)


def signature(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def listed(c: Column, separator: str = "|") -> Column:
    """Non-empty, trimmed parts of a separated string."""
    return F.filter(F.transform(F.split(c, "[" + separator + "]"), lambda x: F.trim(x)), lambda x: x != "")


# fixed value: the published pattern of accession numbers
UNIPROT = r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"


def is_accession(c: Column) -> Column:
    return c.rlike(UNIPROT)


# fixed values: organism names of complex catalogues and their taxonomy numbers
ORGANISMS = {"Human": "9606", "Mouse": "10090", "Rat": "10116", "Pig": "9823", "Bovine": "9913", "Hamster": "10029", "Dog": "9615", "Rabbit": "9986", "Chicken": "9031"}


def organism_number(organism: Column) -> Column:
    """Taxon number of the common names that complex catalogues use."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ORGANISMS.items() for x in kv]), organism)


def most_general(predicted: Column, lineage: Column) -> Column:
    """Is the predicted taxon in the lineage of the true one?"""
    return F.array_contains(lineage, predicted)
