"""Quality rules as weak supervision (operator 8, SQL only): rules vote or abstain, EM weighs them, a posterior decides.

A document is good or junk of some kind. Each rule names a kind of junk, as what it votes junk; how the other rules vote
on it, and how often each rule calls good documents junk, is estimated. So junk that trips one rule alone is told
from a careless rule by what all others say, and rare kinds of junk aren't lost to the frequent ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, own, stage

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for with "
    "der die und das den von zu mit ist ein "
    "de la le les des et un une que en "
    "el los y por con del se las para es"
).split()


def _count(text: Column, characters: str) -> Column:
    """How often any of these characters is in text; replace() scans bytes and is far faster than a regular expression."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def repeat_words(words: Column) -> Column:
    """How many words lie in a window of three words found twice or more.

    Hashes of the windows (64 bits) tell whether any is repeated; only then are they sorted, to find where. A
    window at p covers up to the next repeated one at most, so that the sum of min(3, gap) counts each word once.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.get(at, k + 1) - p)), F.lit(0), lambda a, b: a + b)

    def places(pairs: Column) -> Column:
        same = lambda s, k: F.coalesce(F.get(pairs, k)["h"] == s["h"], F.lit(False))
        twice = F.filter(pairs, lambda s, k: same(s, k + 1) | ((k > 0) & same(s, F.greatest(k - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(twice, lambda s: s["p"])), covered)

    def found(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, places))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), found))


def measures(text: Column) -> Column:
    """Struct of the counts that rules go by, over the whole text; all zero for a text without words. n_stops: different stop words."""

    def lines(full: Column) -> Column:
        return F.struct(F.size(full).alias("n_lines"), (F.size(full) - F.size(F.array_distinct(full))).alias("n_dup_lines"))

    def count(w: Column) -> Column:
        full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def put(of: Column, words: Column) -> Column:
            values = {
                "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_symbols": _count(text, SYMBOLS), "n_dup_lines": of["n_dup_lines"],
                "n_repeat_words": repeat_words(w), "n_lines": of["n_lines"], "n_bangs": _count(text, "!"), "n_distinct": F.size(words),
                "n_stops": F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))), "ends": F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(2)).rlike(r"[.!?][\"')]?$").cast("int"),
            }
            return F.struct(*(v.cast("bigint").alias(k) for k, v in values.items()))

        return let(F.struct(let(full, lines).alias("lines"), F.array_distinct(w).alias("words")), lambda x: put(x["lines"], x["words"]))

    return let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), count)


@dataclass(frozen=True)
class Rule:
    """Votes -1 (junk) where bad holds, else 1 (fine) where good holds, else abstains; both are SQL over the measures."""

    name: str
    bad: str
    good: str


#: The production rules. Ratios are compared by products, as texts may have no words.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 100"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 8 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("stop_words", "n_stops < 3 and n_words >= 50", "n_stops >= 6"),
    Rule("lines", "2 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    Rule("repetition", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("exclamation", "5 * n_bangs > n_words", "50 * n_bangs <= n_words"),
    Rule("variety", "10 * n_distinct < n_words and n_words < 2000", "10 * n_distinct >= 3 * n_words"),
    Rule("ending", "ends = 0", "ends = 1"),
)
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

#: What is expected before any data: share of good documents, and how votes fall as (junk, abstain, fine) in good
#: documents and in junk that another rule names. They count as much as PRIOR_WEIGHT documents a class, and say which way is up.
PRIOR_GOOD = 0.85
PRIOR_FINE, PRIOR_JUNK = (0.1, 0.3, 0.6), (0.25, 0.35, 0.4)
PRIOR_WEIGHT = 2.0
ROUNDS = 300
KEEP_FROM = 0.5


@dataclass(frozen=True)
class LabelModel:
    """Share of each class (good, then a kind of junk for each rule) and, by class and rule, the chances of votes -1, 0, 1."""

    shares: np.ndarray
    chances: np.ndarray

    def logs(self, votes: np.ndarray) -> np.ndarray:
        """Log-likelihood of each class (row) for rows of votes."""
        with np.errstate(divide="ignore"):
            shares, chances = np.log(self.shares), np.log(self.chances)
        return shares[:, None] + sum(chances[:, r, votes[:, r] + 1] for r in range(votes.shape[1]))

    def posteriors(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each class (row) for rows of votes."""
        logs = self.logs(votes)
        weights = np.exp(logs - logs.max(axis=0))
        return weights / weights.sum(axis=0)

    def posterior(self, votes: Column) -> Column:
        """Probability that a document with this array of votes is good."""

        def log_of(c: int) -> Column:
            out = F.lit(float(np.log(self.shares[c])))
            for r in range(self.chances.shape[1]):
                junk, none, fine = (float(x) for x in np.log(np.maximum(self.chances[c, r], 1e-300)))
                vote = F.get(votes, F.lit(r))
                out = out + F.when(vote == -1, F.lit(junk)).when(vote == 1, F.lit(fine)).otherwise(F.lit(none))
            return out

        def share(logs: Column) -> Column:
            return 1 / F.aggregate(logs, F.lit(0.0), lambda acc, x: acc + F.exp(F.least(x - F.get(logs, F.lit(0)), F.lit(700.0))))

        return let(F.array(*(log_of(c) for c in range(len(self.shares)))), share)


def fit_votes(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns, at most 3 to the number of rules.

    The kind of junk of a rule has its junk vote by definition (its anchor); all else is free.
    """
    prior = np.empty((n_rules + 1, n_rules, 3))
    prior[0], prior[1:] = PRIOR_FINE, PRIOR_JUNK
    kinds = np.arange(n_rules)
    prior[kinds + 1, kinds] = (1.0, 0.0, 0.0)
    shares = np.array([PRIOR_GOOD] + [(1 - PRIOR_GOOD) / n_rules] * n_rules)
    model = LabelModel(shares, prior)
    if not patterns:
        return model
    votes = np.array(sorted(patterns))
    counts = np.array([patterns[tuple(v)] for v in votes.tolist()], dtype=float)
    weight = PRIOR_WEIGHT * n_rules
    for _ in range(rounds):
        mass = model.posteriors(votes) * counts
        now = (mass.sum(axis=1) + weight * shares) / (counts.sum() + weight)
        seen = np.stack([np.stack([mass[:, votes[:, r] == v].sum(axis=1) for v in (-1, 0, 1)], axis=1) for r in range(n_rules)], axis=1) + PRIOR_WEIGHT * prior
        new = seen / seen.sum(axis=2, keepdims=True)
        new[kinds + 1, kinds] = prior[kinds + 1, kinds]
        moved = max(np.abs(now - model.shares).max(), np.abs(new - model.chances).max())
        model = LabelModel(now, new)
        if moved < 1e-9:
            break
    return model


def _on(sql: str, m: str, fields: list[str]) -> Column:
    """SQL over measures, by their path in the struct column m: documents may have columns of the same names."""
    return F.expr(" ".join(f"`{m}`.{w}" if w in fields else w for w in sql.split(" ")))


def _measured(docs: DataFrame, *columns: Column) -> tuple[DataFrame, str, list[str]]:
    """A staged table of these columns and the measures of text as a struct; its name and fields."""
    (name,) = fresh(docs, "__m")
    m = stage(docs.select(*columns, let(F.coalesce("text", F.lit("")), measures).alias(name)), "measures")
    return m, name, [f.name for f in m.schema[name].dataType.fields]


def _judge(m: DataFrame, name: str, fields: list[str], rules: tuple[Rule, ...], keep_from: float) -> tuple[Column, Column, Column, Column]:
    """Votes, base_failed, quality and kept as expressions, by a model fitted to the vote patterns of all rows."""
    votes = F.array(*(F.when(_on(r.bad, name, fields), -1).when(_on(r.good, name, fields), 1).otherwise(0) for r in rules))
    tally = m.select(votes.alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    model = fit_votes({tuple(r["votes"]): r["n"] for r in tally.collect()}, len(rules))
    failed = F.coalesce(_on(BASE_FAILED, name, fields), F.lit(True))
    quality = let(votes, model.posterior)
    return votes, failed, quality, ~failed & (quality >= keep_from)


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_from: float = KEEP_FROM) -> DataFrame:
    """Judge every document: doc_id, the measures, votes (array), base_failed, quality (posterior), kept.

    Measures are taken once over whole texts and written to the shared folder; the model is fitted to the counts of
    vote patterns of all documents, of which there are at most 3 ** len(rules). A null text counts as having no
    words, and like every text under 50 words fails; repeated rows are judged alike; extra columns are ignored; an
    empty table gives an empty result.
    """
    m, name, fields = _measured(docs, F.col("doc_id"))
    votes, failed, quality, kept = _judge(m, name, fields, rules, keep_from)
    return m.select("doc_id", f"`{name}`.*", votes.alias("votes"), failed.alias("base_failed"), quality.alias("quality"), kept.alias("kept"))


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that score_quality keeps, with their own columns.

    Documents are written to the shared folder with their measures, which take far longer to find than to store: the
    model is fitted to these alone, and the verdict filters the written rows in place. Nulls, repeated rows and
    empty tables are as in score_quality; columns of any name are carried.
    """
    m, name, fields = _measured(docs, *own(docs))
    return m.where(_judge(m, name, fields, rules, keep_from)[3]).select(*own(docs))


def op8_query(spark, sf_dir: str) -> DataFrame:
    """op8: counts and verdict of every document."""
    judged = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "quality", F.array_join(F.transform("votes", lambda v: v.cast("string")), ",").alias("votes"))
