"""Secret scan by a battery of randomness tests, in DataFrame functions alone.

Keyed assignments, access keys and hex runs are found by pattern.  Beyond them, every long token gets an inferred encoding and three
tests of how far it is from ordinary text and how near to random: chi-squared uniformity of its alphabet, the number of
runs of character classes, and the serial correlation of neighbouring characters.  Letters of one case have no classes but vowels and
consonants, which ordinary text alternates more than chance does, and their neighbours are judged by the share of common digrams.  Each test gives a normal score under "ordinary
text"; Stouffer's sum joins them.  A token of 16 characters tells less than one of 80, and there are more of them,
so false discoveries are controlled by Benjamini and Hochberg's rule within each stratum of encoding and length over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm import spans
from traceloom.session import materialize

#: The patterns of the base detections and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE, LEAST_ACCESS = 6, 20

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
RATE = 0.001  # share of false ones among the discoveries of a stratum, at most
LENGTHS = (24, 32, 48, 80)  # upper ends of the length strata
STEPS = 20  # steps of the p-value grid per power of ten
LEAST_P = 12  # powers of ten the grid goes down

#: encoding, alphabet size, Σp² and Σp³ of its characters in ordinary text, chance of a class change there, correlation there (letters: share of
#: common digrams).  For letters, joined English words have 0.67 and 0.85, random letters 0.35 and 0.30; the values are set lower for other languages.
NULLS = (
    ("hex", 16, 0.110, 0.0160, 0.20, 0.30),
    ("base32", 32, 0.066, 0.0056, 0.10, 0.20),
    ("letters", 26, 0.066, 0.0056, 0.60, 0.72),
    ("base64", 64, 0.055, 0.0042, 0.25, 0.30),
)

#: The 200 digrams taken as common in English, French, German and Spanish: a first letter and what may follow it.
FOLLOW = "a:bcdgilmnrstuvy b:aeilory c:aehiklortu d:aeiorsu e:acdeilmnrstuvx f:aefiortu g:aehilnoru h:aeiot i:acdefglmnorstvz k:eio l:adeiloty m:abeimopu n:acdegiknostu o:cdflmnoprstuvw p:aeloprtu q:u r:acdeikmnorstuy s:aceihkopstu t:aehiorstuy u:aeilnprst v:aeio w:aeio x:pt y:s z:eu"
DIGRAM = "(?=" + "|".join(f"{first}[{after}]" for first, _, after in (x.partition(":") for x in FOLLOW.split())) + ")"


def encoding(token: Column) -> Column:
    """The smallest alphabet that holds the token; null for numbers, which are never judged."""
    return (
        F.when(token.rlike("^[0-9]+$"), None)
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^([a-z]+|[A-Z]+)$"), "letters")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .otherwise("base64")
    )


def _normal_tail(z: Column) -> Column:
    """P(N > z): Abramowitz and Stegun 26.2.17 with a relative error small enough for ranks; symmetric for z < 0."""

    def of(z: Column) -> Column:
        def upper(t: Column) -> Column:
            poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
            return F.exp(-z * z / 2) * 0.3989422804014327 * poly

        return spans.let(spans.let(1 / (1 + 0.2316419 * F.abs(z)), upper), lambda u: F.when(z >= 0, u).otherwise(1 - u))

    return spans.let(z, of)


def _by_encoding(kind: Column, index: int) -> Column:
    out = F.lit(None).cast("double")
    for row in NULLS:
        out = F.when(kind == row[0], F.lit(float(row[index]))).otherwise(out)
    return out


def p_value(token: Column) -> Column:
    """Probability that ordinary text of this encoding and length looks as random as ``token``; null for numbers."""
    kind = encoding(token)
    n = F.length(token).cast("double")
    chars = F.split(token, "")

    def judged(c: Column) -> Column:
        squares = F.aggregate(F.array_distinct(c["chars"]), F.lit(0.0), lambda a, x: a + F.pow(F.length(token) - F.length(F.replace(token, x, F.lit(""))), F.lit(2.0)))
        size, s2, s3 = _by_encoding(c["kind"], 1), _by_encoding(c["kind"], 2), _by_encoding(c["kind"], 3)
        # Chi-squared against the uniform alphabet is size / n * squares - n; its mean and variance in ordinary text follow from Σp² and Σp³.
        chi = size / n * squares - n
        mean = size * (1 - s2) + n * (size * s2 - 1)
        spread = size / n * F.sqrt(4 * F.pow(n, F.lit(3.0)) * (s3 - s2 * s2) + 2 * n * n * s2)
        uniform = (mean - chi) / spread

        # Marks that join words make no run of their own, and a capital letter goes with the small ones behind it.
        classed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[^A-Za-z0-9]", ""), "[A-Z]?[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
        change = _by_encoding(c["kind"], 4)
        runs = (F.length(classed) - 1 - (n - 1) * change - 0.5) / F.sqrt((n - 1) * change * (1 - change))
        small = F.lower(token)
        voiced = F.regexp_replace(F.regexp_replace(small, "[aeiouy]+", "1"), "[a-z]+", "2")
        alternating = ((n - 1) * change - (F.length(voiced) - 1) - 0.5) / F.sqrt((n - 1) * change * (1 - change))

        codes = F.transform(c["chars"], lambda x: F.ascii(x).cast("double"))
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("square"), F.lit(0.0).alias("product"))
        sums = F.aggregate(
            codes, start, lambda a, x: F.struct(x.alias("last"), (a["sum"] + x).alias("sum"), (a["square"] + x * x).alias("square"), (a["product"] + F.coalesce(a["last"] * x, F.lit(0.0))).alias("product"))
        )
        serial = spans.let(sums, lambda q: spans.let(q["sum"] / n, lambda m: (q["product"] / (n - 1) - m * m) / F.greatest(q["square"] / n - m * m, F.lit(1e-9))))
        usual = _by_encoding(c["kind"], 5)
        correlated = (usual - serial) * F.sqrt(n)
        uncommon = ((n - 1) * usual - F.regexp_count(small, F.lit(DIGRAM)) - 0.5) / F.sqrt((n - 1) * usual * (1 - usual))
        letters = c["kind"] == "letters"
        joined = (uniform + F.when(letters, alternating).otherwise(runs) + F.when(letters, uncommon).otherwise(correlated)) / F.sqrt(F.lit(3.0))
        return F.when(c["kind"].isNotNull(), _normal_tail(joined))

    return spans.let(F.struct(kind.alias("kind"), chars.alias("chars")), judged)


def stratum(token: Column) -> Column:
    n = F.length(token)
    band = F.lit(len(LENGTHS))
    for i, upper in reversed(list(enumerate(LENGTHS))):
        band = F.when(n < upper, i).otherwise(band)
    return F.concat_ws(":", encoding(token), band.cast("string"))


def grid(p: Column) -> Column:
    """Cells of the p-value grid: 0 is 1, higher cells are smaller values, rounded up to the cell's upper end."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(10.0**-LEAST_P))) * STEPS), F.lit(LEAST_P * STEPS)).cast("int")


def discoveries(tokens: DataFrame, rate: float = RATE) -> dict[str, int]:
    """Per stratum the lowest grid cell that counts as a discovery, from a column token.

    Benjamini and Hochberg on the grid: the largest p with p * tokens / (tokens at or below p) <= rate.  At most
    strata x grid cells rows reach the driver, whatever the corpus.
    """
    judged = tokens.select(stratum(F.col("token")).alias("stratum"), p_value(F.col("token")).alias("p")).filter("p is not null")
    rows = judged.groupBy("stratum", grid(F.col("p")).alias("cell")).count().collect()
    counts: dict[str, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["stratum"], {})[r["cell"]] = r["count"]
    out = {}
    for name, cells in counts.items():
        total, below = sum(cells.values()), 0
        for cell in sorted(cells, reverse=True):
            below += cells[cell]
            if 10 ** (-cell / STEPS) * total / below <= rate:
                out[name] = cell
    return out


def _base(text: Column) -> Column:
    assign = spans.found(text, ASSIGN, "assign", 0, text.rlike(r"(?i:passw|secret|token|api_?key)"))
    value = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= LEAST_VALUE
    access = F.filter(spans.found(text, ACCESS, "access", 1, text.contains("AKIA")), lambda s: s["end"] - s["start"] >= LEAST_ACCESS)
    return F.concat(F.filter(assign, value), access, spans.found(text, HEX, "hex", 2))


def secret_scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base, added for every row of ``docs``: arrays of spans by start.

    Offsets are code points, ends exclusive.  Null texts count as empty and have no spans.  A token that overlaps a base span adds
    nothing; repeated tokens are all judged and all reported.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = texts.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
    lowest = discoveries(materialize(tokens, "tokens"), rate)

    def secret(s: Column) -> Column:
        def above(name: Column) -> Column:
            bar = F.lit(None).cast("int")
            for known, cell in sorted(lowest.items()):
                bar = F.when(name == known, cell).otherwise(bar)
            return F.when(bar.isNotNull(), grid(p_value(s["text"])) >= bar).otherwise(False)

        return F.coalesce(spans.let(stratum(s["text"]), above), F.lit(False))

    if not lowest:
        return texts.select("doc_id", spans.in_order(_base(F.col("text"))).alias("base"), spans.none().alias("added"))
    based = texts.select("doc_id", spans.in_order(_base(F.col("text"))).alias("base"), spans.found(F.col("text"), TOKEN, "random", 3).alias("token"))
    added = spans.let(spans.borders(F.col("base")), lambda taken: F.filter("token", lambda s: spans.apart(s, taken) & secret(s)))
    return based.select("doc_id", "base", added.alias("added"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans."""
    scanned = secret_scan(docs)
    return scanned.select(
        "doc_id",
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        spans.written(spans.in_order(F.concat("base", "added"))).alias("spans"),
    )
