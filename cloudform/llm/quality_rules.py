"""Quality rules: a decision list learnt from labelled statistics by sequential covering, run as a Spark expression.

Each rule is a conjunction of thresholds on a text's statistics that marks low quality. A rule grows on two thirds of
the examples by information gain, is pruned on the rest, and is kept while it is precise there; what it covers is set
aside for the next one. The list becomes ordered CASE conditions, so applying it needs no Python.

Words are runs of bytes that are no ASCII white space. A null text has none. Lines are split at line feeds. A text
without words has 0 in each ratio. A bounded sample of labelled rows is learnt from (`most`, by the smallest hash of
their id); without labels of both classes the list is empty and keeps all. Rows that repeat an id count one by one. A
list has at most `most_rules` rules of at most `most_terms` thresholds each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import SPACES, Powers, U, batches, mix, small_batches, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_bytes", "n_distinct")
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)", "symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)", "upper": "n_upper / greatest(word_chars, 1)", "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)", "distinct": "n_distinct / greatest(n_words, 1)", "words": "cast(n_words as double)",
}


def seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys equal an earlier one, and which occur more than once."""
    by = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[by][1:] == keys[by][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[by] = same
    both = same.copy()
    both[:-1] |= same[1:]
    twice[by] = both
    return later, twice


def statistics(data, offsets, powers: Powers) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, counts = words(data, offsets)
    sums = powers.sums(data)
    hashes = powers.hashes(sums, starts, ends)
    of_word = np.repeat(np.arange(n), counts)
    per_text = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
    by_text = lambda owner, hit: np.bincount(owner[hit], minlength=n)
    salt = mix(np.arange(n).astype(U), 51)

    inside = ~SPACES[data]
    letter = (data & 0xC0) != 0x80
    out = {"n_words": counts, "word_chars": per_text(inside & letter), "n_symbols": per_text(SYMBOLS[data]), "n_bytes": np.diff(offsets)}
    out["n_upper"] = per_text((data >= 65) & (data <= 90))
    out["n_digits"] = per_text((data >= 48) & (data <= 57))
    out["n_marks"] = per_text((data == 33) | (data == 63))
    out["n_distinct"] = counts - by_text(of_word, seen_before(hashes ^ salt[of_word])[0])

    feeds = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    owner = np.repeat(np.arange(n), per_text(data == 10) + 1)
    line_end = np.sort(np.concatenate([feeds, offsets[1:]]))
    spot = np.concatenate([[0], np.cumsum(inside)])
    worded = spot[line_end] > spot[line_start]
    line = powers.hashes(sums, line_start[worded], line_end[worded]) ^ salt[owner[worded]]
    out["n_lines"] = np.bincount(owner[worded], minlength=n)
    out["n_dup_lines"] = by_text(owner[worded], seen_before(line)[0])

    covered = np.zeros(len(hashes) + 2, bool)
    if len(hashes) > 2:
        full = of_word[2:] == of_word[:-2]
        window = (mix(hashes[:-2], 1) + mix(hashes[1:-1], 2) + mix(hashes[2:], 3))[full]
        at = np.flatnonzero(full)
        at = at[seen_before(mix(window ^ salt[of_word[:-2][full]]))[1]]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = by_text(of_word, covered[: len(hashes)])
    return out


def measured(keep: list[str]):
    def run(frames):
        powers = Powers()
        for batch, i, j, data, offsets in batches(frames):
            got = statistics(data, offsets, powers)
            some = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(k)) for k in keep), *(pa.array(got[k].astype(np.int64)) for k in COUNTS)], [*keep, *COUNTS])

    return run


def text_statistics(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and the counts of COUNTS, of each row. Columns of docs named like a count give way."""
    keep = [f for f in docs.schema.fields if f.name != "text" and f.name.lower() not in COUNTS]
    small_batches(docs.sparkSession)
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{k} long" for k in COUNTS])
    return docs.mapInArrow(measured([f.name for f in keep]), kind)


# ---------------------------------------------------------------- sequential covering
def grown(x, y, cuts, most_terms: int) -> list[tuple[int, str, float]]:
    rule, inside = [], np.ones(len(y), bool)
    while y[inside].mean() < 1 and len(rule) < most_terms:
        p, n = y[inside].sum(), (~y[inside]).sum()
        old = np.log2(p / (p + n))
        best, gain = None, 0.0
        for f, values in enumerate(cuts):
            for sign in ("<=", ">"):
                hit = (x[inside, f][:, None] <= values) == (sign == "<=")
                good, bad = hit[y[inside]].sum(0), hit[~y[inside]].sum(0)
                won = good * (np.log2(np.maximum(good, 1e-9) / np.maximum(good + bad, 1e-9)) - old)
                k = int(won.argmax())
                if won[k] > gain + 1e-9:
                    best, gain = (f, sign, float(values[k])), won[k]
        if best is None:
            break
        rule.append(best)
        inside &= covers([best], x)
    return rule


def covers(rule, x) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, cut in rule:
        out &= (x[:, f] <= cut) == (sign == "<=")
    return out


def pruned(rule, x, y):
    def worth(r):
        hit = covers(r, x)
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / max(p + n, 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn_rules(x: np.ndarray, y: np.ndarray, *, precision: float = 0.95, most_rules: int = 12, most_terms: int = 4, thresholds: int = 64, seed: int = 0) -> list:
    """Ordered conjunctions [(feature, '<=' or '>', threshold)] that mark y (low quality)."""
    rules, left = [], np.ones(len(y), bool)
    share = np.random.default_rng(seed).random(len(y)) < 2 / 3
    cuts = [np.unique(np.quantile(x[y, f] if y.any() else x[:, f], np.linspace(0, 1, thresholds))) for f in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.quantile(x[:, f], np.linspace(0, 1, thresholds))])) for f, c in enumerate(cuts)]
    while len(rules) < most_rules and (left & share & y).sum() >= 3:
        rule = grown(x[left & share], y[left & share], cuts, most_terms)
        if not rule:
            break
        check = left & ~share
        rule = pruned(rule, x[check], y[check]) if check.any() else rule
        hit = covers(rule, x)
        on = hit & check
        if (on & y).sum() < precision * max(on.sum(), 1) or not on.any():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(statistics_: DataFrame, *, most: int = 20000, **how) -> list:
    """Rules from rows with the counts of text_statistics and a column quality (0: low, 1: good)."""
    rows = statistics_.where("quality in (0, 1)").select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))
    got = rows.orderBy("h", "doc_id").limit(most).toPandas()
    if got.quality.nunique() < 2:
        return []
    return learn_rules(got[list(FEATURES)].to_numpy(float), (got.quality == 0).to_numpy(), **how)


def decision_list(rules) -> F.Column:
    """The number (from 1) of the first rule that fits, 0 if none does."""
    names = list(FEATURES)
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        fits = F.lit(True)
        for f, sign, cut in rule:
            value = F.expr(FEATURES[names[f]])
            fits = fits & ((value <= cut) if sign == "<=" else (value > cut))
        out = F.when(fits, k).otherwise(out)
    return out


def describe(rules) -> list[str]:
    names = list(FEATURES)
    return [" and ".join(f"{names[f]} {sign} {cut:g}" for f, sign, cut in rule) for rule in rules]


def quality_rules(statistics_: DataFrame, rules, *, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Rows of text_statistics with base_failed, rule (see decision_list) and kept; columns of these names are replaced."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return statistics_.withColumn("base_failed", failed).withColumn("rule", decision_list(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
