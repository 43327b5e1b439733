"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

One pass over whole texts counts what the rules look at (``COUNTS``). Each rule of
``rule_votes`` then says good (1), bad (-1) or abstains (0). No labels are read: the
corpus enters the fit as counts of vote patterns, one grouped aggregate with at most
``3 ** len(RULES)`` rows, and expectation-maximisation estimates the share of good
documents and, for each rule, how often its vote is right on good and on bad documents
(abstaining says nothing). A document's quality probability is the posterior given
its votes, a sum of log-likelihood ratios in a column expression, and takes the place
of "every rule must pass". A bad document may fail one rule and pass all others, so a rule
may be right on few bad documents, but never so few that a good vote would speak
against a document (accuracies add up to 1 at least).

Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and blank texts have no words: all
counts 0, all rules abstain but ``length``, base failed. Very long texts are split into
words a megabyte at a time; a word of a text is held as one number, so memory is 8
bytes a word plus its distinct words. Rows may repeat and ids may be null or tie: each
row is judged by itself. An empty table gives no rows and the prior accuracies. Other
columns of any name are left alone; ``keep_good`` returns exactly the columns it got.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stored, text_pieces

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0xC0, 256))  # a code point beyond ASCII counts by its first byte
CONTINUED = bytes(range(0x80, 0xC0))
ENDS = bytes(32 if b in SPACE else 46 if b in b".!?" else b for b in range(256))
#: Frequent function words of several languages; our own choice.
FUNCTION_WORDS = [w.encode() for w in """the of and to in a is that for it with as was on be by this are or an from have not
der die das und ist nicht mit von zu den ein eine für auf im le la les et est une dans pour que des du el los las y en
con por para un una se del no al os e o da do em il di che per non sono de het een van dat""".split()]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_ends",
          "n_function", "n_top"]
RULES = ["length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "letters", "sentences", "function_words", "top_word"]
PRIOR = (0.95, 0.5)  # how often a rule is right on good and on bad documents, before any evidence
PRIOR_SHARE = 0.02   # which counts as much as this share of the documents, so the fit does not hang on corpus size


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Number of words that stand in a three-word window found twice or more; ``ids`` number the words exactly."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
    _, window, times = np.unique(pair * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k:len(ids) - 2 + k] |= again
    return int(hit.sum())


def count(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of a whole text in UTF-8."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    parts = []
    for piece in text_pieces(text):
        words = piece.split()
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if not len(ids):
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS))) + (0,) * (len(COUNTS) - 3)
    times = np.bincount(ids)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = text.translate(ENDS)
    return (len(ids), len(text.translate(None, SPACE + CONTINUED)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(ids, len(number)), len(lines),
            len(text) - len(text.translate(None, LETTERS)), len(text) - len(text.translate(None, UPPER)),
            marks.count(b". ") + marks.endswith(b"."), int(sum(times[number[w]] for w in FUNCTION_WORDS if w in number)), int(times.max()))


def measured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) as one struct ``row``, beside ``COUNTS`` of the text."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                       F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = np.array([count(t.as_py()) for t in b.column(1)], np.int64).reshape(b.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, k]) for k in range(len(COUNTS)))], ["row", *COUNTS])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def rule_votes() -> dict[str, Column]:
    """Each rule's vote on the counts of a text: 1 (good), -1 (bad) or 0 (abstains)."""
    n = F.col("n_words")

    def vote(good: Column, bad: Column, when: Column | None = None) -> Column:
        v = F.when(bad, -1).when(good, 1).otherwise(0)
        return F.when((n > 0) if when is None else (n > 0) & when, v).otherwise(0)

    chars, symbols, lines, top = F.col("word_chars"), F.col("n_symbols"), F.col("n_lines"), F.col("n_top")
    letters, upper, ends = F.col("n_letters"), F.col("n_upper"), F.col("n_ends")
    return {
        "length": F.when(n < 50, -1).when(n.between(100, 100_000), 1).otherwise(0),
        "word_length": vote((chars >= 3 * n) & (chars <= 10 * n), (2 * chars < 5 * n) | (chars > 12 * n)),
        "symbols": vote(symbols * 50 <= n, symbols * 10 >= n),
        "dup_lines": vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 10 >= lines * 3, lines > 1),
        "repeats": vote(F.col("n_repeat_words") * 100 <= n * 20, F.col("n_repeat_words") * 100 > n * 50),
        "capitals": vote(upper * 100 <= letters * 15, upper * 100 >= letters * 50, letters > 0),
        "letters": vote(letters * 100 >= chars * 90, letters * 100 < chars * 70),
        "sentences": vote((ends * 4 <= n) & (ends * 60 >= n), (ends * 3 > n) | (ends == 0), n >= 50),
        "function_words": vote(F.col("n_function") * 100 >= n * 5, F.col("n_function") == 0, n >= 100),
        "top_word": vote(top * 10 <= n, top * 5 >= n, n >= 20),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class LabelModel:
    """Share of good documents and each rule's accuracy on good and on bad ones."""

    share: float = 0.75
    right: dict[str, tuple[float, float]] = field(default_factory=lambda: dict.fromkeys(RULES, PRIOR))

    def weight(self, rule: str, vote: int) -> float:
        """What a vote adds to the log odds."""
        good, bad = self.right[rule]
        return float(np.log(good / (1 - bad)) if vote > 0 else np.log((1 - good) / bad) if vote < 0 else 0.0)

    def probability(self) -> Column:
        z = F.lit(float(np.log(self.share / (1 - self.share))))
        for rule, v in rule_votes().items():
            z = z + F.when(v == 1, self.weight(rule, 1)).when(v == -1, self.weight(rule, -1)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """Fit to vote patterns (rows of -1, 0, 1) and how many documents show each."""
    m = LabelModel()
    if not len(votes) or not counts.sum():
        return m
    share = counts / counts.sum()
    for _ in range(rounds):
        z = np.full(len(votes), np.log(m.share / (1 - m.share)))
        for k, r in enumerate(RULES):
            z += np.choose(votes[:, k] + 1, [m.weight(r, -1), 0.0, m.weight(r, 1)])
        good = share / (1 + np.exp(-z))
        bad = share - good
        right = {}
        for k, r in enumerate(RULES):
            yes, no = votes[:, k] == 1, votes[:, k] == -1
            a, b = ((s[hit].sum() + p * PRIOR_SHARE) / (s[yes | no].sum() + PRIOR_SHARE) for s, hit, p in zip((good, bad), (yes, no), PRIOR, strict=True))
            a = float(np.clip(a, 0.5, 0.995))
            right[r] = a, float(np.clip(b, 1 - a, 0.995))
        new = LabelModel(float(np.clip(good.sum(), 0.05, 0.95)), right)
        moved = max(abs(new.share - m.share), *(abs(a - b) for r in RULES for a, b in zip(new.right[r], m.right[r], strict=True)))
        m = new
        if moved < 1e-10:
            break
    return m


def fit(counts: DataFrame) -> LabelModel:
    """The model of a table with ``COUNTS``; only its distinct vote patterns reach the driver."""
    rows = counts.select(*[v.alias(r) for r, v in rule_votes().items()]).groupBy(*RULES).count().collect()
    rows = sorted(tuple(int(x) for x in r) for r in rows)
    table = np.array(rows, np.int64).reshape(len(rows), len(RULES) + 1)
    return expectation_maximisation(table[:, :-1], table[:, -1])


def judged(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, LabelModel]:
    """(``row``, ``COUNTS``, votes (struct), ``quality`` (probability), ``base_failed``, ``kept``) for each row; the model.

    Texts are read once; their counts are written to the shared folder, from which the fit and the verdicts come.
    """
    counts = stored(measured(docs, text_col, keep), "rule-counts")
    model = fit(counts)
    out = counts.withColumn("votes", F.struct(*[v.alias(r) for r, v in rule_votes().items()])).withColumn("quality", model.probability())
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)), model


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    return judged(docs, text_col)[0].where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
