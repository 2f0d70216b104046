"""Secret scan (operator 5, SQL only): fixed patterns, then sliding-window entropy over candidate strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPANS, apart_from, let, listed, number_of, spans

#: Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is too short has no longer one within it
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # a run matches from its start or, too short, nowhere
BASE_KINDS = ("assign", "access", "hex")

#: Candidates for the entropy test.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"


@dataclass(frozen=True)
class EntropyClass:
    """Candidates that fit pattern (the first class that fits counts) are secret if some window reaches `bits`."""

    name: str
    pattern: str
    bits: float


#: Letters alone have no class: their entropy doesn't set them apart from long words.
CLASSES = (
    EntropyClass("hex", r"^[0-9A-Fa-f]+$", 3.0),
    EntropyClass("base64", r"^(?=.*[0-9])(?=.*[A-Za-z])", 3.8),
)
WINDOW = 20

#: Candidates that are never secrets: identifiers in their public form.
IDENTIFIER = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
#: Placeholders and runs of an alphabet: what stands between two slashes and holds one is left out of a candidate.
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|your[_-]|xxxx|redacted|abcdefgh|12345678|qwertyui"
#: Paths and names of words: every part between these signs is a word or a short number.
SIGNS, WORD = r"[/_+-]+", r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})?$"


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any `window` consecutive characters of value (of all, if it is shorter).

    One pass: counts hold how often each distinct character is in the window; a step adds the entering and takes
    off the leaving character, and moves the sum of n*log2(n) by just these two.
    """

    def over(chars: Column) -> Column:
        def walk(alphabet: Column) -> Column:
            codes = F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int") - 1)

            def gain(n: Column) -> Column:  # n*log2(n)
                return F.when(n > 1, n * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))

            def slide(code: Column) -> Column:
                width = F.least(F.size(code), F.lit(window))

                def step(acc: Column, i: Column) -> Column:
                    come, gone = F.get(code, i), F.when(i >= window, F.get(code, i - window)).otherwise(F.lit(-1))
                    same = come == gone
                    more, less = F.get(acc["n"], come), F.when(gone >= 0, F.get(acc["n"], F.greatest(gone, F.lit(0)))).otherwise(F.lit(0))
                    total = F.when(same, acc["s"]).otherwise(acc["s"] + gain(more + 1) - gain(more) + gain(less - 1) - gain(less))
                    counts = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda c, k: c + (k == come).cast("int") - (k == gone).cast("int")))
                    bits = F.log2(width.cast("double")) - total / width
                    return F.struct(counts.alias("n"), total.alias("s"), F.when(i >= width - 1, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

                start = F.struct(F.array_repeat(F.lit(0), F.size(alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
                return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, lambda acc: acc["best"])

            return let(codes, slide)

        return let(F.array_distinct(chars), walk)

    return F.when(F.length(value) > 0, let(F.split(value, ""), lambda c: over(F.filter(c, lambda x: x != "")))).otherwise(F.lit(0.0))


def allowed(value: Column) -> Column:
    """Whether value is on the allow-list: an identifier, or a path or name of words."""
    return value.rlike(IDENTIFIER) | F.forall(F.split(F.rtrim(value, F.lit("=")), SIGNS), lambda part: part.rlike(WORD))


def _dense(value: Column) -> Column:
    """Whether value has a class, isn't allowed, and reaches its class's entropy in some window."""
    bits = F.lit(None).cast("double")
    for c in reversed(CLASSES):
        bits = F.when(value.rlike(c.pattern), F.lit(c.bits)).otherwise(bits)
    return F.when((F.length(value) < WINDOW) | bits.isNull() | allowed(value), F.lit(False)).otherwise(window_entropy(value) >= bits)


def is_secret(value: Column) -> Column:
    """Whether some stretch of a candidate, between the parts that hold a placeholder, is dense."""
    parts = F.transform(F.split(value, "/"), lambda p: F.when(p.rlike(PLACEHOLDER), F.lit(" ")).otherwise(p))
    return F.when(value.rlike(PLACEHOLDER), F.exists(F.split(F.array_join(parts, "/"), " "), _dense)).otherwise(_dense(value))


def secret_spans(text: Column) -> Column:
    """All spans of secrets in text, sorted by start, then kind: those of BASE_KINDS and the added kind entropy."""
    none = F.array().cast(SPANS)
    sign, run = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), text.rlike(CANDIDATE)  # which most texts lack
    base = F.sort_array(F.concat(
        F.when(sign, spans(text, ASSIGN, "assign", 0, keep=lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, "access", 1)).otherwise(none),
        F.when(run, spans(text, HEX, "hex", 2)).otherwise(none),
    ))
    added = F.when(run, spans(text, CANDIDATE, "entropy", 3, keep=is_secret)).otherwise(none)
    return let(base, lambda known: let(added, lambda more: F.sort_array(F.concat(known, apart_from(known, more)))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text, secrets (array of start, order, end, kind, value, score).

    Base kinds are assign, access and hex; entropy spans are added where no base span overlaps. Whole texts are
    scanned in place, without a shuffle. A null text counts as empty and has no spans; repeated rows are scanned
    alike; extra columns are ignored; an empty table gives an empty result.
    """
    return docs.select("doc_id", "text", let(F.coalesce("text", F.lit("")), secret_spans).alias("secrets"))


def digest(found: DataFrame, column: str, base_kinds: tuple[str, ...], *more: Column) -> DataFrame:
    """Counts of each base kind, a hash of the base spans and all spans as text."""
    base = F.filter(column, lambda s: s["kind"].isin(*base_kinds))
    return found.select("doc_id", *(number_of(F.col(column), k).alias(f"n_{k}") for k in base_kinds), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(column)).alias("spans"), *more)


def op5_query(spark, sf_dir: str) -> DataFrame:
    """op5: secrets of every document, as counts, hash and list of spans."""
    return digest(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "secrets", BASE_KINDS)
