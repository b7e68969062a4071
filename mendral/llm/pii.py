r"""Personal data: patterns propose spans, validators confirm, context adjusts the score.

Everything is SQL functions on the row. ``split`` and ``regexp_extract_all`` with
one pattern give the gaps and the matches of a text, whose lengths in code points
add up to the span positions.

Base kinds (contract): email, ip, card, phone. Added kind: iban (two letters, two
check digits, 11 to 30 more, valid modulo 97). A span's score is the base of its
kind, plus 0.15 if a context word of the kind stands within ``CONTEXT`` code
points before or after it; validated kinds (card, iban) start higher.

Defined results: null and empty texts have no spans: counts 0, the digest of the
empty string, ``spans`` and ``scores`` empty. Ids are passed on as they are, null
or repeated. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

CONTEXT = 40
#: Matches per block of the two-level running sum of lengths.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    name: str
    #: The pattern as stated.
    pattern: str
    #: The same matches, found in one linear scan: a match can only begin where the
    #: one before ended or where its first run of characters begins.
    scan: str
    #: What a text must contain to have a match at all.
    needs: str
    #: Score in hundredths, and the words nearby that add CONTEXT_BONUS.
    score: int
    words: str


CONTEXT_BONUS = 15
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 80, "mail|contact|write|kontakt|correo"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 60, "host|server|address|login|network"),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", "", 70, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 60, "phone|call|mobile|fax|telefon|appel"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "", 80, "iban|account|bank|konto|compte|cuenta"),
)
BASE = KINDS[:4]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits is a multiple of ten."""
    value = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(x == "", 0).when(i % 2 == 0, x.cast("int")).when(x >= "5", x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(short) < 3, True).when(F.length(short) > 3, False).otherwise(short <= "255")


def mod97(m: Column) -> Column:
    """The check of an IBAN: letters become 10 to 35 and the first four characters go last."""
    moved = F.concat(F.substring(m, 5, 64), F.substring(m, 1, 4))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, x: F.when(x == "", a).when(x <= "9", (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))
    return rest == 1


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), octet)
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return mod97(m) if kind == "iban" else F.lit(True)


SPAN = "array<struct<start:int,kind:int,end:int,score:int>>"


def spans_of(number: int, kind: Kind) -> Column:
    """The valid matches of a kind as spans, from columns f (matches), g (lengths of gaps) and step (both)."""
    f, g, step, block = (F.col(f"{c}_{kind.name}") for c in ("f", "g", "step", "block"))

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def span(i: Column) -> Column:
        whole = F.floor(i / BLOCK).cast("int")
        start = add(F.slice(block, F.lit(1), whole)) + add(F.slice(step, whole * BLOCK + 1, i % BLOCK)) + F.get(g, i)
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(F.get(f, i))).alias("end"))

    def scored(s: Column) -> Column:
        low = F.greatest(F.lit(0), s["start"] - CONTEXT)
        around = F.concat(F.substring(F.col("text"), low + 1, s["start"] - low), F.lit(" "), F.substring(F.col("text"), s["end"] + 1, F.lit(CONTEXT)))
        bonus = F.when(around.rlike(f"(?i)({kind.words})"), CONTEXT_BONUS).otherwise(0)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), (F.lit(kind.score) + bonus).alias("score"))

    index = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: valid(kind.name, F.get(f, i)))
    return F.when(F.size(f) > 0, F.transform(F.transform(index, span), scored)).otherwise(F.array().cast(SPAN)).alias(f"s_{kind.name}")


def block_sums(name: str) -> Column:
    """Sums of each BLOCK of an array's values."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(name) / BLOCK).cast("int"))
    return F.transform(blocks, lambda b: F.aggregate(F.slice(name, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``spans``: all spans of every text by start, then kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for k in KINDS:
        matches = F.regexp_extract_all("text", F.lit(k.scan), F.lit(0))
        rows = rows.withColumn(f"f_{k.name}", F.when(F.contains("text", F.lit(k.needs)), matches).otherwise(none) if k.needs else matches)
    zero = F.array().cast("array<int>")
    gaps = {f"g_{k.name}": F.when(F.size(f"f_{k.name}") > 0, F.transform(F.split("text", k.scan, -1), F.length)).otherwise(zero) for k in KINDS}
    rows = rows.withColumns(gaps)
    rows = rows.withColumns({f"step_{k.name}": F.zip_with(f"g_{k.name}", f"f_{k.name}", lambda g, m: g + F.coalesce(F.length(m), F.lit(0))) for k in KINDS})
    rows = rows.withColumns({f"block_{k.name}": block_sums(f"step_{k.name}") for k in KINDS})
    rows = rows.select("doc_id", "text", *[spans_of(i, k) for i, k in enumerate(KINDS)])
    return rows.select("doc_id", "text", *[f"s_{k.name}" for k in KINDS], F.array_sort(F.concat(*[F.col(f"s_{k.name}") for k in KINDS])).alias("spans"))


def written(spans: Column, score: bool = False) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: s["score"].cast("string") if score else F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans and their scores."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *[F.size(f"s_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        written(F.col("spans"), score=True).alias("scores"),
    )


def redact(docs: DataFrame, least_score: int = 0) -> DataFrame:
    """doc_id and the text with each span of at least this score replaced by its kind in brackets."""
    found = find(docs)
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    chosen = F.filter("spans", lambda s: s["score"] >= least_score)
    # overlapping spans: what an earlier one covers is not shown again
    done = F.aggregate(
        chosen,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return found.select("doc_id", done.alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


def _oracle() -> str:
    """The same in DuckDB, with the patterns as stated and plain running sums."""
    digit = "regexp_replace(m, '[^0-9]', '', 'g')"
    checks = {
        "email": "true",
        "ip": r"len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": f"length({digit}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({digit}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {digit}[-j]::INT WHEN {digit}[-j]::INT >= 5 THEN {digit}[-j]::INT * 2 - 9 ELSE {digit}[-j]::INT * 2 END)) % 10 = 0",
        "phone": f"length({digit}) BETWEEN 9 AND 15",
        "iban": "list_reduce(list_transform(string_split(concat(substr(m, 5), substr(m, 1, 4)), ''), lambda c: (CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT), lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97, 0::BIGINT) = 1",
    }
    first, found = [], []
    for i, k in enumerate(KINDS):
        n = k.name
        first.append(f"regexp_extract_all(x, '{k.pattern}') AS f_{n}, list_transform(string_split_regex(x, '{k.pattern}'), lambda s: length(s)) AS g_{n}")
        start = f"(coalesce(list_sum(g_{n}[1:i]), 0) + coalesce(list_sum(list_transform(f_{n}[1:i-1], lambda s: length(s))), 0))::BIGINT"
        ok = f"list_filter(range(1, len(f_{n}) + 1), lambda i: list_transform([f_{n}[i]], lambda m: {checks[n]})[1])"
        at = f"list_transform({ok}, lambda i: {{'s': {start}, 'k': {i}, 'e': ({start} + length(f_{n}[i]))::BIGINT}})"
        around = f"concat(substr(x, greatest(0, t.s - {CONTEXT}) + 1, t.s - greatest(0, t.s - {CONTEXT})), ' ', substr(x, t.e + 1, {CONTEXT}))"
        found.append(f"list_transform({at}, lambda t: {{'s': t.s, 'k': t.k, 'e': t.e, 'c': {k.score} + CASE WHEN regexp_matches({around}, '(?i)({k.words})') THEN {CONTEXT_BONUS} ELSE 0 END}}) AS s_{n}")
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    text = f"lambda s: concat({names}[s.k + 1], ':', s.s, ':', s.e)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS (SELECT doc_id, x, {", ".join(first)} FROM t),
v AS (SELECT doc_id, {", ".join(found)} FROM m),
a AS (SELECT *, list_sort(list_concat({", ".join(f"s_{k.name}" for k in KINDS)})) AS spans FROM v)
SELECT doc_id, {", ".join(f"len(s_{k.name})::BIGINT AS n_{k.name}" for k in KINDS)},
  sha256(array_to_string(list_transform(list_filter(spans, lambda s: s.k < {len(BASE)}), {text}), ',')) AS base_sha256,
  array_to_string(list_transform(spans, {text}), ',') AS spans,
  array_to_string(list_transform(spans, lambda s: s.c::VARCHAR), ',') AS scores
FROM a
"""


ORACLE = _oracle()
